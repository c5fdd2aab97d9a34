"""Importance resampling of documents towards a target corpus.

A document's features are its words and runs of words, hashed into buckets.
The gain of a bucket is how much more often the target has it (log ratio,
smoothed by one); a document's weight is the sum of its features' gains.  With
Gumbel noise added, the highest scores are a draw without replacement in
proportion to the weights' exponentials.

1. *Gains.*  Each task counts into one array of buckets; the sums are as many
   rows as there are buckets, whatever the corpus, and so is the array of
   gains that goes to the tasks.
2. *Weights.*  Gains are gathered from the array by bucket numbers and summed
   per document.
3. *Ranks.*  A radix sort, least digit first: the composite key (score down,
   id up) is cut into digits, and each pass is a stable counting sort.  Rows
   lie in blocks of consecutive positions; a histogram of (block, digit) is
   summed to the first destination of each, by digit and then by block, and a
   row's place among the equal digits of its block does the rest.  After the
   last pass the position is the rank.

A pass shuffles the keys once, in groups that a block bounds; no task sees the
whole order, and no range of scores has to be guessed for it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearscore.llm import words as W
from hearscore.session import stage

BUCKETS = 10_000
RUNS = 1
SEED = 2024
#: Percent of the documents that can be drawn, and the words they need.
SHARE = 10
MIN_WORDS = 20

# Rows of a block and bits of a digit of the sort.
_BLOCK = 8192
_DIGIT = 10
# Features of more bytes are hashed one by one.
_LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for every range, all ranges at a time."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    begin, size = starts[order], size[order]
    crc = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    first = int(np.searchsorted(-size, -_LONG))  # ranges of more bytes come first
    for k in range(int(size[first]) if first < len(size) else 0):
        last = int(np.searchsorted(-size, -k))
        own = crc[first:last]
        crc[first:last] = own >> 8 ^ _CRC[(own ^ data[begin[first:last] + k]) & 0xFF]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(first):
        crc[i] = zlib.crc32(data[begin[i] : begin[i] + size[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(texts: pa.Array, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the features of some texts, text by text, the offsets of
    each text's features, and the words of each text."""
    words = W.words_of(texts, W.ALNUM, lower=True)
    data, starts, ends = W.spaced(words)
    owners, found = [], []
    for n in range(1, runs + 1):
        first, offsets = words.windows(n)
        owners.append(np.repeat(np.arange(len(texts)), np.diff(offsets)))
        found.append(crc32(data, starts[first], ends[first + n - 1]) % np.uint32(buckets))
    owner, found = np.concatenate(owners), np.concatenate(found)
    if runs > 1:
        order = np.argsort(owner, kind="stable")
        owner, found = owner[order], found[order]
    return found, np.searchsorted(owner, np.arange(len(texts) + 1)), words.counts


def _count_rows(runs: int, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in W.slices(batch, "text"):
                counts += np.bincount(features(part.column("text"), runs, buckets)[0], minlength=buckets)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], names=["bucket", "n"])

    return rows


def bucket_counts(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: ``buckets`` numbers."""
    counted = texts.select("text").mapInArrow(_count_rows(runs, buckets), "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row.bucket] = row.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold log ratio of each bucket's shares, rounded down."""
    n_corpus, n_target, buckets = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (n_corpus + buckets) / ((s + 1.0) * (n_target + buckets))))
            for s, t in zip(corpus.tolist(), target.tolist())
        ],
        dtype=np.int64,
    )


def _weight_rows(gains: np.ndarray, runs: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                found, offsets, n_words = features(part.column("text"), runs, len(gains))
                sums = np.concatenate([[0], np.cumsum(gains[found])])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n_words.astype(np.int64)),
                        pa.array(np.diff(offsets).astype(np.int64)),
                        pa.array(sums[offsets[1:]] - sums[offsets[:-1]]),
                    ],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    return rows


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandfold Gumbel noise of an id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def _digits(rows: DataFrame, keys: Sequence[tuple[str, bool]], bits: int) -> list[Column]:
    """The digits of the composite key, least first.  A key that differs in no
    row has none."""
    ends = rows.agg(*(f(c) for c, _ in keys for f in (F.min, F.max))).first()
    digits = []
    for i, (name, down) in reversed(list(enumerate(keys))):
        low, high = ends[2 * i], ends[2 * i + 1]
        if low is None or low == high:
            continue
        column = F.col(name).cast("long")
        if high - low < 1 << 63:
            value, width = (F.lit(high) - column if down else column - F.lit(low)), (high - low).bit_length()
        else:  # the order of unsigned numbers
            value, width = column.bitwiseXOR(F.lit(-(1 << 63))), 64
            value = F.bitwise_not(value) if down else value
        passes = -(-width // bits)
        step = -(-width // passes)
        digits += [
            F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << step) - 1)) for shift in range(0, width, step)
        ]
    return digits


def _counting_sort(rows: DataFrame, label: str) -> DataFrame:
    """One pass: ``position`` of every row after a stable sort by ``digit`` of
    rows that lie in blocks, in the order of ``position`` within each."""
    counts = rows.groupBy("block", "digit").agg(F.count("*").alias("n"))
    counts = stage(counts, f"{label}_histogram")
    up_to_here = Window.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(up_to_here.orderBy("digit")), F.lit(0))  # one row per digit
    digits = counts.groupBy("digit").agg(F.sum("n").alias("n")).select("digit", before.alias("smaller"))
    earlier = F.coalesce(F.sum("n").over(up_to_here.partitionBy("digit").orderBy("block")), F.lit(0))
    first = counts.withColumn("earlier", earlier).join(digits, "digit")
    first = first.select("block", "digit", (F.col("smaller") + F.col("earlier")).alias("first"))
    place = F.row_number().over(Window.partitionBy("block", "digit").orderBy("position"))
    moved = rows.withColumn("place", place).join(first, ["block", "digit"])
    payload = [c for c in rows.columns if c not in ("block", "digit", "position")]
    return stage(moved.select(*payload, (F.col("first") + F.col("place") - 1).alias("position")), label)


def radix_ranks(rows: DataFrame, keys: Sequence[tuple[str, bool]], block: int = _BLOCK, bits: int = _DIGIT) -> DataFrame:
    """``rows`` with ``position``: 0, 1, 2 … in the order of ``keys``, whole
    numbers without nulls, each (column, whether descending).  Rows with equal
    keys get neighbouring positions in an order of no meaning."""
    digits = _digits(rows, keys, bits) or [F.lit(0).cast("long")]
    n_blocks = -(-rows.count() // block) or 1
    # Where rows lie before the first pass is of no importance.
    number = F.xxhash64(*(F.col(c) for c, _ in keys))
    sorted_ = rows.withColumn("block", F.pmod(number, F.lit(n_blocks))).withColumn("position", number)
    for k, digit in enumerate(digits):
        if k:
            sorted_ = sorted_.withColumn("block", F.floor(F.col("position") / block))
        sorted_ = _counting_sort(sorted_.withColumn("digit", digit), f"radix_pass_{k}")
    return sorted_


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: int = SHARE,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    runs: int = RUNS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs``.

    Of the N documents with at least ``min_words`` words the highest
    ``share * N // 100`` scores are drawn and ranked 1, 2, 3 …, ties to the
    smaller ``doc_id``; ``rank`` is null for the others.  Only ``doc_id`` and
    ``text`` of ``docs`` and ``text`` of ``target`` are read; a null text has no
    words, a document without features weight 0.  A row without a ``doc_id``
    counts in the corpus, but has no score, isn't one of the N and is never drawn.
    Repeated rows are documents of their own: each can be drawn, with
    neighbouring ranks; texts of one id with equal scores are ordered by their
    features.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    gains = bucket_gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    weighed = docs.mapInArrow(
        _weight_rows(gains, runs), "doc_id long, n_words long, n_features long, weight long"
    ).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    weighed = stage(weighed, "weights")
    able = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    taking_part = weighed.filter(able)
    drawn = share * taking_part.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = radix_ranks(taking_part.select(*columns), [("score", True), ("doc_id", False), ("n_features", False)])
    rank = F.when(F.col("position") < drawn, F.col("position") + 1).cast("long").alias("rank")
    rest = weighed.filter(~able).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank).union(rest)
