"""Ranked lexical search: the best documents for every item, by BM25 in
integers.

1. *Index.*  Documents are dealt into segments of bounded bytes.  A segment has
   one row per term: ascending document numbers, occurrences and, for lists
   of more than a block, the most occurrences and the fewest words of any
   document in each block of postings; and one row with its documents.  All terms of all documents are
   indexed, so an index serves any items.
2. *Weights.*  Document frequencies are sums over the lists of a term.
3. *Search.*  The lists that items ask for are brought together by segment,
   items in blocks.  Within a segment an item's short lists are first summed
   term by term into accumulators.  These are from then on one more list, with
   the largest sums of its blocks as bounds.  It and the long lists are read
   document by document: only lists that can still lift a document over the
   least of the best are walked, of them only blocks whose bounds allow it, and
   the other lists are looked up at the documents found, as long as a document's bound
   stays high enough.  The least of the best is carried on from one segment
   of a task to the next.
4. *Merge.*  Tasks return their best documents of every item; the best of
   those are ranked.

Nothing is skipped that could enter the result: bounds never lie below a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearscore.llm import words as W
from hearscore.session import stage

TOP = 50
#: Weight of a document's length, in percent.
B = 50
#: Saturation of repeated terms, in tenths.
K1 = 20

# Text of a segment, in bytes, and its documents, which get 16-bit numbers.
_SEGMENT = 16 << 20
_DOCS = 1 << 16
# Postings of a block.
_BLOCK = 64
# Postings that are read from a list at once.
_STEP = 512
# A list is short if it has at most this share of a segment's documents.
_SHORT = 16
# Terms of a block of items, about.
_TERMS = 8192

_INDEX = "segment long, term long, n_docs long, n_terms long, docs binary, tfs binary, tops binary, lows binary"


def _cut(values: np.ndarray, offsets: np.ndarray, absent: np.ndarray | None = None) -> pa.Array:
    """Binary values: runs of an array."""
    data = np.ascontiguousarray(values)
    where = (offsets * data.itemsize).astype(np.int32)
    mask = None
    if absent is not None:
        mask = pa.py_buffer(np.packbits(~absent, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [mask, pa.py_buffer(where), pa.py_buffer(data)])


def _segment_rows(number: int, ids: list, sizes: list, hashes: list) -> pa.RecordBatch:
    """Rows of one segment: of every term, and of its documents."""
    n = np.concatenate(sizes)
    every = np.concatenate(hashes)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    tfs = np.diff(np.append(first, len(every)))
    term, doc = every[first], owner[first]
    head = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    offsets = np.append(head, len(term))
    length = np.diff(offsets)
    place = np.arange(len(term)) - np.repeat(head, length)
    edge = np.flatnonzero(place % _BLOCK == 0)
    single = length <= _BLOCK
    blocks = np.where(single, 0, -(-length // _BLOCK))
    kept = ~np.repeat(single, -(-length // _BLOCK))
    tops = np.maximum.reduceat(tfs, edge)[kept]
    lows = np.minimum.reduceat(n[doc], edge)[kept]
    cuts = np.concatenate([[0], np.cumsum(blocks)])
    id_column = pa.concat_arrays(ids)
    none = np.flatnonzero(id_column.is_null().to_numpy(zero_copy_only=False))
    whole = lambda values: pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())
    lists = [
        _cut(doc.astype("<u2"), offsets),
        _cut(tfs.astype("<i4"), offsets),
        _cut(tops.astype("<i4"), cuts, single),
        _cut(lows.astype("<i4"), cuts, single),
    ]
    own = [
        whole(id_column.fill_null(0).to_numpy().astype("<i8")),
        whole(n.astype("<i8")),
        whole(none.astype("<i4")),
        pa.nulls(1, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(head) + 1, number)),
            pa.concat_arrays([pa.array(term[head].view(np.int64)), pa.nulls(1, pa.int64())]),
            pa.array(np.append(length, len(n))),
            pa.array(np.append(np.add.reduceat(tfs, head), n.sum())),
            *(pa.concat_arrays([a, b]) for a, b in zip(lists, own)),
        ],
        names=["segment", "term", "n_docs", "n_terms", "docs", "tfs", "tops", "lows"],
    )


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids, sizes, hashes, used, n_docs = [], [], [], 0, 0
    for batch in batches:
        for part in W.slices(batch, "text"):
            for at in range(0, len(part), _DOCS):
                some = part.slice(at, _DOCS)
                words = W.words_of(some.column("text"), W.ALNUM, lower=True)
                full = words.counts > 0
                if ids and (used + len(words.data) > _SEGMENT or n_docs + full.sum() > _DOCS):
                    yield _segment_rows(number, ids, sizes, hashes)
                    number += 1
                    ids, sizes, hashes, used, n_docs = [], [], [], 0, 0
                if full.any():
                    ids.append(some.column("doc_id").filter(pa.array(full)))
                    sizes.append(words.counts[full])
                    hashes.append(words.hashes)
                    used += len(words.data)
                    n_docs += int(full.sum())
    if ids:
        yield _segment_rows(number, ids, sizes, hashes)


def build_index(docs: DataFrame) -> DataFrame:
    """Index of ``docs`` as a stored table.  Only ``doc_id`` and ``text`` are
    read.  Documents without terms aren't in it."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return stage(docs.mapInArrow(_index_rows, _INDEX), "ranked_index")


@dataclass
class Measure:
    """How occurrences score, given the corpus: its documents and terms."""

    n_docs: int
    n_terms: int
    b: int = B
    k1: int = K1

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """Length of documents of ``n`` terms, as scores see it."""
        if len(n) and self.b * int(n.max()) * self.n_docs >= 1 << 63:
            return np.array([100 - self.b + self.b * int(x) * self.n_docs // self.n_terms for x in n], dtype=np.int64)
        return 100 - self.b + self.b * n.astype(np.int64) * self.n_docs // self.n_terms

    def gain(self, weight: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return weight * (1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + self.k1 * m))


@dataclass
class Postings:
    """The list of a term, with the highest score of each block, or the sums
    of several lists (``sums``)."""

    docs: np.ndarray
    bounds: np.ndarray
    tfs: np.ndarray | None = None
    weight: int = 0
    sums: np.ndarray | None = None

    def scores(self, at: np.ndarray | slice, m: np.ndarray, measure: Measure) -> np.ndarray:
        if self.sums is not None:
            return self.sums[at]
        return measure.gain(self.weight, self.tfs[at], m[self.docs[at]])


class Best:
    """The best documents of one item so far, best first."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    def least(self) -> int:
        """What a document must score at least to be taken."""
        return max(1, int(self.scores[-1])) if len(self.scores) >= self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]


def accumulated(short: list[Postings], m: np.ndarray, measure: Measure) -> Postings:
    """Short lists summed term at a time, as one list."""
    sums = np.zeros(len(m), dtype=np.int64)
    for one in short:
        sums[one.docs] += one.scores(slice(None), m, measure)
    docs = np.flatnonzero(sums)
    sums = sums[docs]
    bounds = np.maximum.reduceat(sums, np.arange(0, len(docs), _BLOCK)) if len(docs) else sums
    return Postings(docs, bounds, sums=sums)


def search_segment(
    lists: list[Postings], m: np.ndarray, ids: np.ndarray, named: np.ndarray, measure: Measure, best: Best
) -> int:
    """Take the documents of a segment that belong to the best (those that are
    ``named``: have an id); returns how many documents were looked at."""
    share = max(_BLOCK, len(m) // _SHORT)
    short = [one for one in lists if len(one.docs) <= share]
    walked = [one for one in lists if len(one.docs) > share]
    if short:
        walked.append(accumulated(short, m, measure))
    walked = [one for one in walked if len(one.docs)]
    walked.sort(key=lambda one: -int(one.bounds.max()))
    most = [int(one.bounds.max()) for one in walked]
    # Highest score that a list and all after it can give.
    after = np.append(np.cumsum(most[::-1], dtype=np.int64)[::-1], 0)
    at, seen = 0, 0
    while at < len(m):
        least = best.least()
        essential = int(np.searchsorted(-after, -least, side="right"))
        if essential == 0:
            break
        starts = [int(np.searchsorted(one.docs, at)) for one in walked[:essential]]
        until = min(
            (int(one.docs[s + _STEP]) for one, s in zip(walked, starts) if s + _STEP < len(one.docs)), default=len(m)
        )
        found = []
        for one, start, own in zip(walked, starts, most):
            place = np.arange(start, int(np.searchsorted(one.docs, until)))
            # A block counts only if it could lift a document high enough.
            reach = one.bounds + (int(after[0]) - own) >= least
            found.append(one.docs[place[reach[place // _BLOCK]]])
        docs = np.unique(np.concatenate(found)).astype(np.int64)
        docs = docs[named[docs]]
        seen += len(docs)
        scores = np.zeros(len(docs), dtype=np.int64)
        for one, rest in zip(walked, after):
            high = scores + rest >= least
            docs, scores = docs[high], scores[high]
            place = np.searchsorted(one.docs, docs)
            hit = np.flatnonzero(place < len(one.docs))
            hit = hit[one.docs[place[hit]] == docs[hit]]
            scores[hit] += one.scores(place[hit], m, measure)
        high = scores >= least
        best.add(scores[high], ids[docs[high]])
        at = until
    return seen


def _postings(row: dict, m: np.ndarray, measure: Measure) -> Postings:
    docs, tfs = np.frombuffer(row["docs"], "<u2"), np.frombuffer(row["tfs"], "<i4")
    if row["tops"] is None:
        bounds = measure.gain(row["weight"], tfs, m[docs]).max(keepdims=True)
    else:
        low = measure.lengths(np.frombuffer(row["lows"], "<i4"))
        bounds = measure.gain(row["weight"], np.frombuffer(row["tops"], "<i4"), low)
    return Postings(docs, bounds, tfs, row["weight"])


def _search_group(rows: list[dict], measure: Measure, top: int, best: dict) -> None:
    """One block of items against one segment: its documents come first."""
    first, *terms = rows
    ids = np.frombuffer(first["docs"], "<i8")
    m = measure.lengths(np.frombuffer(first["tfs"], "<i8"))
    named = np.ones(len(ids), dtype=bool)
    named[np.frombuffer(first["tops"], "<i4")] = False
    by_item: dict = {}
    for row in terms:
        one = _postings(row, m, measure)
        for item in row["items"]:
            by_item.setdefault(item, []).append(one)
    for item, lists in by_item.items():
        search_segment(lists, m, ids, named, measure, best.setdefault(item, Best(top)))


def _best_rows(measure: Measure, top: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, segment, held, best = None, None, [], {}

        def result() -> pa.RecordBatch:
            items = [item for item, own in best.items() for _ in own.ids]
            ids = np.concatenate([own.ids for own in best.values()])
            scores = np.concatenate([own.scores for own in best.values()])
            return pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int64()), pa.array(ids), pa.array(scores)], names=["item_id", "doc_id", "score"]
            )

        for batch in batches:
            for row in batch.to_pylist():
                if (row["block"], row["segment"]) != (block, segment):
                    if held:
                        _search_group(held, measure, top, best)
                    if row["block"] != block and best:
                        yield result()
                        best = {}
                    block, segment, held = row["block"], row["segment"], []
                held.append(row)
        if held:
            _search_group(held, measure, top, best)
        if best:
            yield result()

    return rows


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text"):
            words = W.words_of(part.column("text"), W.ALNUM, lower=True)
            owner = pa.array(words.texts())
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id").take(owner), pa.array(words.hashes.view(np.int64))], names=["item_id", "term"]
            )


def search(index: DataFrame, items: DataFrame, top: int = TOP, b: int = B, k1: int = K1) -> DataFrame:
    """``item_id, rank, doc_id, score``: for every item its ``top`` documents
    of highest score above 0, equal scores by ascending ``doc_id``.

    Only ``item_id`` and ``text`` of ``items`` are read.  A null text has no
    terms; an item without terms that occur has no rows.  Rows that share an
    ``item_id`` are one item with the terms of all its texts; rows without one
    are not searched.  Documents without a ``doc_id`` count in the corpus but
    are not returned; repeated rows are documents of their own, each ranked.
    """
    whole = index.filter("term IS NULL")
    n_docs, n_terms = whole.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    measure = Measure(n_docs or 0, n_terms or 0, b, k1)
    asked = stage(
        items.select(F.col("item_id").cast("long"), "text")
        .filter("item_id IS NOT NULL")
        .mapInArrow(_term_rows, "item_id long, term long")
        .distinct(),
        "item_terms",
    )
    blocks = -(-asked.count() // _TERMS) or 1
    known = asked.select("term").distinct()
    weights = (
        index.filter("term IS NOT NULL")
        .join(known, "term", "left_semi")
        .groupBy("term")
        .agg(F.sum("n_docs").alias("df"))
        .select("term", F.floor(1000 * F.log((2.0 * measure.n_docs + 2.0) / (2 * F.col("df") + 1))).alias("weight"))
    )
    uses = stage(
        asked.join(weights, "term")
        .groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"), "term")
        .agg(F.first("weight").alias("weight"), F.collect_list("item_id").alias("items")),
        "item_blocks",
    )
    every = whole.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.lit(None).cast("long").alias("weight"),
        F.lit(None).cast("array<long>").alias("items"),
        "segment", "term", "docs", "tfs", "tops", "lows",
    )
    lists = index.join(uses, "term").select(*every.columns)
    best = (
        every.union(lists)
        .repartition("segment")
        .sortWithinPartitions("block", "segment", F.col("term").asc_nulls_first())
        .mapInArrow(_best_rows(measure, top), "item_id long, doc_id long, score long")
    )
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The same over documents that have no index yet."""
    return search(build_index(docs), items, top)
