"""Nearest neighbours by cross-polytope hashing.

A vector on the unit sphere is turned by a pseudo-random rotation (three times
random signs and a fast Hadamard transform) and named after the signed axis it
comes to lie nearest to.  Each table has its own rotation.  A query probes, in
every table, the cells of the axes that its own turned vector is nearest to;
the vectors in those cells are ranked by their exact distance.

Nothing is capped: of equal vectors only the ``k + 1`` smallest ids travel,
which are all that a list of k others can show; cells are cut into pieces of
bounded size that each see the query; a query that finds fewer than k is
compared with all rows, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearscore.session import stage

TABLES = 8
PROBES = 12
# Vectors of one piece of a cell, about.
_PIECE = 4096
_KEY = ["high", "low"]


def rotate(vectors: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-random rotation number ``table`` of rows, padded with zeros to a
    power of two."""
    size = 1 << max(0, int(vectors.shape[1] - 1).bit_length())
    x = np.zeros((len(vectors), size))
    x[:, : vectors.shape[1]] = vectors
    random = np.random.default_rng((size, table))
    for _ in range(3):
        x = x * random.choice([-1.0, 1.0], size)
        half = 1
        while half < size:
            pairs = x.reshape(len(x), -1, 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), size)
            half *= 2
    return x / size**1.5


def axes(vectors: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of every row, nearest first."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = rotate(unit, table)
    signed = np.concatenate([turned, -turned], axis=1)
    return np.argsort(-signed, axis=1, kind="stable")[:, :probes]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _cell_rows(tables: int, probes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(size):
                own = batch.filter(pa.array(size == n))
                vectors = _matrix(own.column("vector"), n)
                for table in range(tables):
                    found = axes(vectors, table, probes)
                    which = np.repeat(np.arange(len(own)), found.shape[1])
                    cell = (int(n) * tables + table) * (1 << 24) + found.reshape(-1)
                    out = own.take(pa.array(which))
                    yield out.append_column("cell", pa.array(cell, pa.int64()))

    return rows


def _nearest(k: int):
    """Of a piece, the k + 1 nearest of each query; more if distances tie."""

    def search(queries: pa.Table, found: pa.Table) -> pa.Table:
        kind = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(queries) or not len(found):
            return kind.empty_table()
        ids = found.column("vec_id").to_numpy()
        size = len(found.column("vector")[0])
        c = _matrix(found.column("vector").combine_chunks(), size)
        high, low = queries.column("high").to_numpy(), queries.column("low").to_numpy()
        rows, scores, hits = [], [], []
        for start in range(0, len(queries), 512):
            q = _matrix(queries.column("vector").slice(start, 512).combine_chunks(), size)
            norm = (q * q).sum(1)[:, None] + (c * c).sum(1)
            near = norm - 2 * q @ c.T
            keep = min(k + 1, len(c)) - 1
            bound = np.partition(near, keep, axis=1)[:, keep]
            # Rounding of the product can't push out one that belongs.
            row, hit = np.nonzero(near <= bound[:, None] + 1e-9 * norm)
            for a in range(0, len(row), 1 << 16):
                r, h = row[a : a + (1 << 16)], hit[a : a + (1 << 16)]
                rows.append(r + start)
                hits.append(h)
                scores.append(np.sqrt(((q[r] - c[h]) ** 2).sum(1)))
        row, hit, score = np.concatenate(rows), np.concatenate(hits), np.concatenate(scores)
        order = np.lexsort((ids[hit], score, row))
        row, hit, score = row[order], hit[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank <= k
        return pa.Table.from_arrays(
            [pa.array(high[row[top]]), pa.array(low[row[top]]), pa.array(ids[hit[top]]), pa.array(score[top])], schema=kind
        )

    return search


def _ranked(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The k + 1 best of each query vector; both have a column ``cell``."""
    pieces = stage(
        found.groupBy("cell").agg(F.ceil(F.count("*") / _PIECE).alias("pieces")), "cell_pieces"
    )
    found = found.join(pieces, "cell").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")))
    queries = queries.join(pieces, "cell").withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))
    )
    best = Window.partitionBy(*_KEY).orderBy("score", "vec_id")
    return (
        queries.select(*_KEY, "vector", "cell", "piece")
        .groupBy("cell", "piece")
        .cogroup(found.select("vec_id", "vector", "cell", "piece").groupBy("cell", "piece"))
        .applyInArrow(_nearest(k), "high long, low long, vec_id long, score double")
        .groupBy(*_KEY, "vec_id")
        .agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k + 1)
        .drop("rank")
    )


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, tables: int = TABLES, probes: int = PROBES
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest other rows found for
    every row of ``vectors`` where ``is_query`` (over ``vec_id``) holds, by
    Euclidean distance, ties to the smaller id; all, if there are fewer.

    Reads ``vec_id`` and ``embedding``.  Rows take no part whose id or vector
    is null, or whose vector is empty, zero, or has null or non-finite
    components; vectors of different lengths are never compared.  Rows that
    repeat an id count once.
    """
    clean = F.transform("embedding", lambda x: x.cast("double"))
    rows = (
        vectors.select("vec_id", clean.alias("vector"))
        .filter("vec_id IS NOT NULL AND size(vector) > 0")
        .filter(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)))
        .filter(F.exists("vector", lambda x: x != 0))
        .dropDuplicates(["vec_id"])
        .select("vec_id", "vector", F.xxhash64("vector").alias("high"), F.xxhash64(F.lit(1), "vector").alias("low"))
    )
    rows = stage(rows, "vectors")
    by_id = Window.partitionBy(*_KEY).orderBy("vec_id")
    found = (
        rows.withColumn("copy", F.row_number().over(by_id)).filter(F.col("copy") <= k + 1).select("vec_id", "vector")
    )
    found = stage(found, "distinct_vectors")
    queries = rows.filter(is_query)
    asked = stage(queries.groupBy(*_KEY).agg(F.first("vector").alias("vector")), "query_vectors")
    hashed = found.mapInArrow(_cell_rows(tables, 1), "vec_id long, vector array<double>, cell long")
    probed = asked.mapInArrow(_cell_rows(tables, probes), "high long, low long, vector array<double>, cell long")
    best = stage(_ranked(probed, hashed, k), "nearest")

    count = best.groupBy(*_KEY).agg(F.count("*").alias("n"))
    short = stage(
        asked.join(count, _KEY, "left").filter(F.coalesce("n", F.lit(0)) <= k).select(*_KEY, "vector"), "short_lists"
    )
    if not short.isEmpty():
        cell = F.size("vector").cast("long").alias("cell")
        whole = _ranked(short.select("*", cell), found.select("*", cell), k)
        best = best.join(short.select(*_KEY), _KEY, "left_anti").unionByName(whole)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        queries.select(F.col("vec_id").alias("query_id"), *_KEY)
        .join(best, _KEY)
        .filter("query_id != vec_id")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
