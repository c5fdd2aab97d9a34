"""Documents whose sets of word shingles overlap, and groups of them.

The incidence of documents and shingles is a sparse matrix; the overlaps of
documents are its product with its transpose.  It is never multiplied whole:

1. *Classes.*  Documents with equal sets are one row from here on.
2. *Column order.*  Shingles are put in one order, rare ones first as far as a
   table of counts by hash tells.  The table has a fixed size; any order gives
   the same result, a good one only keeps common columns out of step 3.
3. *First columns.*  Two sets that link share at least ``a`` shingles, a bound
   that follows from their sizes.  Of the first ``n - a + k`` shingles of
   either in that order they then share ``k`` or more.  Rows of these first
   columns are brought together by shingle; batches of columns are multiplied
   (overlap counts of the pairs within each column) and the counts of a pair
   summed.  Pairs outside the size bounds are discarded at once, pairs with
   fewer than ``k`` shared first columns after that.
4. *Full columns.*  A column that very many classes have among their first ones
   isn't multiplied.  It counts for each of its classes as if shared, so that no
   pair is discarded for it; classes with ``k`` such columns or more, which
   could link without any other column, are tied to each other.
5. *Row blocks.*  What is left connects classes to clusters, mostly near copies
   of each other.  Their shingles are fetched, clusters are cut into row blocks
   of bounded mass, and the product of two row blocks is accumulated densely, a
   run of columns at a time.  Pairs outside the size bounds are discarded, exact
   counts decide the rest, and a block returns a spanning forest of its links,
   not the links.  A cluster's blocks are first multiplied with themselves and
   with its first block; after that, only what is not yet connected is
   multiplied with the remaining blocks.

Links between different sets are decided on exact counts, and none is lost:
what is left out are pairs that are already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearscore.llm import words as W
from hearscore.llm.graph import components
from hearscore.session import drop_stage, stage

SHINGLE = 3
SIMILARITY = 90  # percent

# Bytes of text whose shingles are made at once.
_SLICE = 1 << 18
# Numbers in the table of shingle counts.
_COUNTS = 1 << 18
# Further first columns that linked sets must share, percent of the smaller set.
_EXTRA = 2
# Classes of a column that is multiplied, and pairs at hand.
_FULL = 64
_PAIRS = 1 << 17
# Shingles and rows of a row block, about.
_MASS = 200_000
_ROWS = 512
# Columns multiplied at once.
_COLUMNS = 4096


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text and their offsets.  A text
    of fewer words is one shingle; one without words has none."""
    words = W.words_of(texts, lower=True)
    starts, offsets = words.windows(shingle)
    ends = starts + shingle
    short = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
    text = np.concatenate([np.repeat(np.arange(len(texts)), np.diff(offsets)), short])
    hashes = words.run_hashes(
        np.concatenate([starts, words.offsets[short]]), np.concatenate([ends, words.offsets[short + 1]])
    )
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(texts) + 1))


def _signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One number for every set: the same for equal sets."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(hashes), dtype=np.uint64)])
    sizes = np.diff(offsets).astype(np.uint64)
    return W.mix(sums[offsets[1:]] - sums[offsets[:-1]] + sizes * np.uint64(0x9E3779B97F4A7C15))


def least_overlap(one, two, similarity: int):
    """Shingles that sets of these sizes share at least if they link."""
    return -(-similarity * (one + two) // (100 + similarity))


def least_shared(n):
    """First columns that linked sets share at least, the smaller of size ``n``."""
    return 1 + _EXTRA * n // 100


def first_columns(n, similarity: int):
    """How many of the first columns of a set of size ``n`` can count for a
    link, whatever the other set."""
    return np.minimum(n, n - -(-similarity * n // 100) + least_shared(n))


def _count_rows(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_COUNTS, dtype=np.int64)
        for batch in batches:
            for part in W.slices(batch, "text", _SLICE):
                hashes, _ = shingle_sets(part.column("text"), shingle)
                counts += np.bincount(_number(hashes), minlength=_COUNTS)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], names=["number", "n"])

    return rows


def _number(hashes: np.ndarray) -> np.ndarray:
    """Place of each shingle in the table of counts."""
    return (W.mix(hashes) % np.uint64(_COUNTS)).astype(np.int64)


def _column_counts(docs: DataFrame, shingle: int) -> np.ndarray:
    """The table of counts: ``_COUNTS`` numbers, for documents of any number."""
    found = docs.select("text").mapInArrow(_count_rows(shingle), "number long, n long")
    found = found.groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_COUNTS, dtype=np.int64)
    counts[found.column("number").to_numpy()] = found.column("n").to_numpy()
    # Their order is all that matters.
    return np.unique(counts, return_inverse=True)[1].astype(np.int32)


def _first_rows(shingle: int, similarity: int, counts):
    """A row per document (without ``column``), and a row per first column of
    each class."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for part in W.slices(batch, "text", _SLICE):
                hashes, offsets = shingle_sets(part.column("text"), shingle)
                sizes = np.diff(offsets)
                signature = _signatures(hashes, offsets).view(np.int64)
                none = pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(signature, mask=sizes == 0), pa.array(sizes), none, none],
                    names=["doc_id", "key", "class", "n", "column", "place"],
                )
                # Copies within the task give the same rows once.
                new = np.zeros(len(part), dtype=bool)
                for i in np.flatnonzero(sizes):
                    if (s := int(signature[i])) not in done:
                        done.add(s)
                        new[i] = True
                owner = np.repeat(np.arange(len(part)), sizes)
                keep = new[owner]
                owner, own = owner[keep], hashes[keep]
                order = np.lexsort((own, counts.value[_number(own)], owner))
                owner, own = owner[order], own[order]
                place = np.arange(len(own)) - np.searchsorted(owner, owner)
                first = place < first_columns(sizes, similarity)[owner]
                owner, own, place = owner[first], own[first], place[first]
                none = pa.nulls(len(owner), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, *map(pa.array, (signature[owner], sizes[owner], own.view(np.int64), place))],
                    names=["doc_id", "key", "class", "n", "column", "place"],
                )

    return rows


def _pair_rows(similarity: int):
    """Of each batch of columns, how many first columns pairs of classes share."""

    def shared(members: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Pairs of one row of ``members`` each, and the sizes of both."""
        x, y = np.triu_indices(members.shape[1], 1)
        a, b = members[:, x].ravel(), members[:, y].ravel()
        n_a, n_b, at_a, at_b = (v.ravel() for v in (sizes[:, x], sizes[:, y], places[:, x], places[:, y]))
        swap = a > b
        least = least_overlap(n_a, n_b, similarity)
        more = least_shared(np.minimum(n_a, n_b))
        near = (100 * np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b)) & (a != b)
        near &= (at_a < n_a - least + more) & (at_b < n_b - least + more)
        pairs = np.stack([np.where(swap, b, a), np.where(swap, a, b), np.where(swap, n_b, n_a), np.where(swap, n_a, n_b)])
        return pairs[:, near]

    def summed(parts: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate([*parts, np.zeros((4, 0), np.int64)], axis=1)
        pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
        new = np.concatenate([[True], (pairs[:2, 1:] != pairs[:2, :-1]).any(0)])[: pairs.shape[1]]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, pairs.shape[1]))
        return pa.RecordBatch.from_arrays(
            [*(pa.array(v) for v in pairs[:, first]), pa.array(count)], names=["a", "b", "n_a", "n_b", "both"]
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            lists = batch.column("members")
            offsets = lists.offsets.to_numpy()
            own = [lists.values.field(c).to_numpy() for c in ("class", "n", "place")]
            length = np.diff(offsets)
            for k in np.unique(length[length > 1]).tolist():
                starts = offsets[:-1][length == k]
                step = max(1, _PAIRS // (k * k))
                for at in range(0, len(starts), step):
                    place = starts[at : at + step, None] + np.arange(k)
                    parts.append(shared(*(v[place] for v in own)))
                    held += parts[-1].shape[1]
                    if held > _PAIRS:
                        yield summed(parts)
                        parts, held = [], 0
        if held:
            yield summed(parts)

    return rows


def _set_rows(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", _SLICE):
                hashes, offsets = shingle_sets(part.column("text"), shingle)
                sets = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                own = _signatures(hashes, offsets).view(np.int64) == part.column("class").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("class", "cluster", "blocks", "block")),
                        pa.array(np.diff(offsets)),
                        pa.array(sets, pa.binary()),
                    ],
                    names=["class", "cluster", "blocks", "block", "n", "shingles"],
                ).filter(pa.array(own))  # an id may have several texts

    return rows


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Product of the incidence matrix of some sets with its transpose,
    accumulated over runs of those columns that more than one set has."""
    values = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    counts = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, _COLUMNS):
        a, b = np.searchsorted(column, [start, start + _COLUMNS])
        block = np.zeros((len(sets), min(_COLUMNS, width - start)), dtype=np.float32)
        block[row[a:b], column[a:b] - start] = 1
        counts += block @ block.T
    return counts.astype(np.int64)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    edges, left = [], np.ones(len(linked), dtype=bool)
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            u = queue.pop()
            found = np.flatnonzero(linked[u] & left)
            left[found] = False
            edges += [(u, int(v)) for v in found]
            queue += found.tolist()
    return edges


def _linked(similarity: int):
    """Links of a group of rows: each cluster (and pair of its blocks) apart."""

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, own in rows.groupby(["cluster", "one", "two"], sort=False):
            own = own.drop_duplicates("class")
            if len(own) < 2:
                continue
            sets = [np.frombuffer(s, np.uint64) for s in own["shingles"]]
            size = own["n"].to_numpy()
            fits = 100 * np.minimum.outer(size, size) >= similarity * np.maximum.outer(size, size)
            both = overlaps(sets)
            linked = fits & (100 * both >= similarity * (np.add.outer(size, size) - both))
            np.fill_diagonal(linked, False)
            ids = own["class"].to_numpy()
            out += [(int(ids[u]), int(ids[v])) for u, v in _forest(linked)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return product


def _multiply(rows: DataFrame, similarity: int) -> DataFrame:
    """Links within each ``cluster, one, two``.  Small groups share a task
    call; ``bin`` is at most one large group or about a block of small ones."""
    return stage(
        rows.select("class", "cluster", "n", "shingles", "one", "two", "bin")
        .groupBy("bin")
        .applyInPandas(_linked(similarity), "a long, b long"),
        "links",
    )


def _strays(large: DataFrame, sets: DataFrame, first: DataFrame, binned, similarity: int) -> DataFrame:
    """Links of what the first products left unconnected in large clusters:
    of each cluster, the rows outside the component with most rows, in blocks
    of their own, times all its blocks."""
    joined = components(first).toDF("class", "joined")
    large = stage(large.join(joined, "class", "left").withColumn("joined", F.coalesce("joined", "class")), "joined")
    main = stage(
        large.groupBy("cluster", "joined")
        .agg(F.count("*").alias("rows"), F.sum("n").alias("mass"))
        .groupBy("cluster")
        .agg(
            F.max_by("joined", F.struct("rows", "joined")).alias("main"),
            (F.sum("rows") - F.max("rows")).alias("strays"),
            (F.sum("mass") - F.max_by("mass", F.struct("rows", "joined"))).alias("mass"),
        )
        .filter("strays > 0")
        .select("cluster", "main", F.greatest(F.ceil(F.col("strays") / _ROWS), F.ceil(F.col("mass") / _MASS)).alias("cuts")),
        "main_parts",
    )
    rows = large.join(main, "cluster").withColumn("stray", F.col("joined") != F.col("main"))
    zero = F.lit(0).cast("long")
    every = rows.withColumn("one", F.explode(F.sequence(zero, F.col("cuts") - 1))).withColumn("two", F.col("block"))
    strays = (
        rows.filter("stray")
        .withColumn("one", F.pmod(F.xxhash64("class", F.lit(1)), F.col("cuts")))
        .withColumn("two", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    )
    pairs = every.select("class", "one", "two").union(strays.select("class", "one", "two"))
    return _multiply(binned(sets.join(pairs, "class")), similarity)


def _candidates(first: DataFrame, similarity: int) -> DataFrame:
    """``a, b``: edges that connect any two classes that can link, directly
    or through others.  ``first`` has the first columns of all classes."""
    columns = (
        first.groupBy("column")
        .agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("rows"))
        .filter("low < high")
        .select("column", (F.col("rows") > _FULL).alias("full"))
    )
    # Joins with all rows or texts are shuffled at every size.
    shared = stage(first.join(stage(columns, "shared_columns").hint("merge"), "column"), "shared_first_columns")
    full = stage(shared.filter("full").select("column", "class", "n").distinct(), "full_columns")
    n_full = full.groupBy("class").agg(F.first("n").alias("n"), F.count("*").alias("n_full"))
    n_full = stage(n_full, "full_column_counts")

    counted = (
        shared.filter("NOT full")
        .groupBy("column")
        .agg(F.collect_set(F.struct("class", "n", "place")).alias("members"))
        .mapInArrow(_pair_rows(similarity), "a long, b long, n_a long, n_b long, both long")
        .groupBy("a", "b")
        .agg(F.least(F.first("n_a"), F.first("n_b")).alias("n"), F.sum("both").alias("both"))
    )
    known = n_full.select("class", "n_full")
    needed = F.lit(1) + F.floor(F.lit(_EXTRA) * F.col("n") / 100)
    pairs = (
        counted.join(known.toDF("a", "full_a"), "a", "left")
        .join(known.toDF("b", "full_b"), "b", "left")
        .filter(F.col("both") + F.least(F.coalesce("full_a", F.lit(0)), F.coalesce("full_b", F.lit(0))) >= needed)
        .select("a", "b")
    )
    # The smaller of two linked sets has at least this share of the other.
    smallest = F.ceil(F.lit(similarity) * F.col("n") / 100)
    tied = full.join(
        n_full.filter(F.col("n_full") >= 1 + F.floor(_EXTRA * smallest / 100)).select("class"), "class", "left_semi"
    )
    hubs = tied.groupBy("column").agg(F.min("class").alias("a"))
    stars = tied.join(hubs, "column").filter("class > a").select("a", F.col("class").alias("b"))
    edges = stage(pairs.union(stars).distinct(), "candidates")
    drop_stage(shared)
    return edges


def _class_components(docs: DataFrame, shingle: int, similarity: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key, class, n`` of every row of ``docs`` (``class`` null if it
    has no shingles) and the ``links`` of a spanning forest of classes."""
    if not 0 < similarity <= 100:
        raise ValueError("similarity is a percentage above 0")
    counts = docs.sparkSession.sparkContext.broadcast(_column_counts(docs, shingle))  # 1 MB
    rows = stage(
        docs.mapInArrow(
            _first_rows(shingle, similarity, counts), "doc_id long, key long, class long, n long, column long, place long"
        ),
        "first_columns",
    )
    members = stage(rows.filter("column IS NULL").select("doc_id", "key", "class", "n"), "members")
    edges = _candidates(rows.filter("column IS NOT NULL").select("column", "class", "n", "place"), similarity)
    drop_stage(rows)
    clusters = stage(components(edges).toDF("class", "cluster"), "clusters")

    # One row stands for its class.  What is cut and paired are rows without
    # shingles; those come last.
    classes = members.filter("class IS NOT NULL").groupBy("class").agg(
        F.min_by(F.struct("doc_id", "key"), F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("one"),
        F.first("n").alias("n"),
    )
    found = stage(clusters.join(classes, "class").select("class", "cluster", "n", "one.*"), "clustered")
    size = stage(
        found.groupBy("cluster")
        .agg(F.count("*").alias("rows"), F.sum("n").alias("mass"))
        .withColumn("blocks", F.greatest(F.ceil(F.col("rows") / _ROWS), F.ceil(F.col("mass") / _MASS))),
        "cluster_sizes",
    )
    n_bins = size.agg(F.ceil(F.sum("mass") / _MASS)).first()[0] or 1
    placed = stage(
        found.join(size.select("cluster", "blocks"), "cluster").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks"))),
        "row_blocks",
    )
    own = placed.select(F.col("doc_id").alias("__id"), "key", "class", "cluster", "blocks", "block").hint("merge")
    same = (docs["key"] == own["key"]) & docs["doc_id"].eqNullSafe(own["__id"])
    sets = stage(
        docs.join(own, same)
        .select("text", "class", "cluster", "blocks", "block")
        .mapInArrow(_set_rows(shingle), "class long, cluster long, blocks long, block long, n long, shingles binary"),
        "sets",
    )

    def binned(df: DataFrame) -> DataFrame:
        small = F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(n_bins)))
        return df.withColumn("bin", F.when(F.col("blocks") == 1, small).otherwise(F.concat_ws("-", "cluster", "one", "two")))

    # Every block with the first one; that includes the pairs within both.
    last = F.col("blocks") - 1
    others = F.when(F.col("block") > 0, F.array("block")).otherwise(F.sequence(F.least(F.lit(1), last), last))
    first = _multiply(binned(sets.withColumn("one", F.lit(0)).withColumn("two", F.explode(others))), similarity)
    links = first
    large = placed.filter("blocks > 1")
    if not large.isEmpty():
        links = first.union(_strays(large, sets, first, binned, similarity))
    drop_stage(sets)
    return members, links


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, key, text``; the key stands for the text."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")


def link(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Two documents link when 100 * |A & B| >= similarity * |A | B| for their
    sets of distinct shingles; ``component_id`` is the smallest ``doc_id``
    reachable by links.  Only ``doc_id`` and ``text`` are read.  A text that is
    null or without words has no shingles and links nothing.  Rows that share a
    ``doc_id`` are one document: what links to any of its texts is reachable
    through it, while ``n_shingles`` is each row's own.  A row without a
    ``doc_id`` links like others but gives no id to a component, which is null
    where no row of it has one.
    """
    members, links = _class_components(_keyed(docs), shingle, similarity)
    full = members.filter("class IS NOT NULL")
    named = full.filter("doc_id IS NOT NULL")
    several = named.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a < b")
    same = named.join(several.select("doc_id", "a"), "doc_id").filter("class > a").select("a", F.col("class").alias("b"))
    linked = components(links.union(stage(same.distinct(), "texts_of_one_id"))).toDF("class", "root")
    found = full.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    found = found.join(linked, "class", "left").withColumn("root", F.coalesce("root", "class"))
    found = stage(found, "linked_classes")
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_class = stage(found.join(least, "root").select("class", "component_id"), "class_components")
    placed = stage(full.join(by_class, "class").select("doc_id", "n", "component_id"), "components")
    blank = members.filter("class IS NULL").select("doc_id", "n")
    by_id = placed.groupBy("doc_id").agg(F.first("component_id").alias("component_id"))
    return placed.union(
        blank.join(by_id, "doc_id", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id"))
    ).withColumnRenamed("n", "n_shingles")


def distinct(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, but of each group of equal
    or linked texts only one.

    That with the smallest ``doc_id`` stays (rows without one come last); of
    several texts of that id which are linked, the one with the smallest
    ``xxhash64``, and of rows that repeat this id and text, the first one as
    JSON.  Ids don't link: other texts of an id are judged for themselves.
    Texts without words stay, all of them.
    """
    members, links = _class_components(_keyed(docs), shingle, similarity)
    linked = components(links).toDF("class", "root")
    found = members.filter("class IS NOT NULL").join(linked, "class", "left")
    found = found.select("doc_id", "key", F.coalesce("root", "class").alias("root"))
    found = stage(found.groupBy("doc_id", "key").agg(F.first("root").alias("root"), F.count("*").alias("n")), "texts")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = found.groupBy("root").agg(F.min(order).alias("first"))
    # Texts that go, and those that stay but are there several times.  Names are
    # longer than those of any column.
    key, own, of, stays, again = (
        name + "_" * max(map(len, docs.columns)) for name in ("key", "id", "of", "stays", "again")
    )
    marks = found.join(first, "root").select(
        F.col("doc_id").alias(own), F.col("key").alias(of), (order == F.col("first")).alias(stays), "n"
    )
    marks = stage(marks.filter(~F.col(stays) | (F.col("n") > 1)).drop("n"), "marks").hint("merge")
    rows = docs.withColumn(key, F.xxhash64("text"))
    same = (F.col(key) == F.col(of)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own))
    once = rows.join(marks, same, "left_anti")
    if not marks.filter(stays).isEmpty():
        order = Window.partitionBy("doc_id", key).orderBy(F.to_json(F.struct(*docs.columns)))
        repeated = rows.join(marks.filter(stays), same, "left_semi").withColumn(again, F.row_number().over(order))
        once = once.union(repeated.filter(F.col(again) == 1).drop(again))
    return once.drop(key)
