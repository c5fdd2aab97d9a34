"""A hashed maximum-entropy language model.

The probability of a word after its history is that of its class times that of
the word within the class.  The classes follow a softmax over hashed features:
the word before, the word before that (a skip), and the classes of both.  Words
within a class follow their counts.  Frequent words are grouped into classes by
their neighbours and their frequency; all others, unknown ones included, are
one class.

Everything is gathered from all training documents: counts of all words,
neighbours of frequent words, feature counts of classes, and, for each gradient
update, the feature counts that the model expects.  An update moves the weights
by the log of observed over expected counts (iterative scaling, which is a
gradient step with a rate per feature).  Texts are tokenised twice, once to
count and once to write them as numbers of frequent words; later passes read
those.  The driver and the tasks hold tables of fixed size: ``LOOKUP`` counts,
``CORE`` classes, ``FEATURES`` by ``CLASSES`` weights.  Counts of rarer words
are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearscore.llm import words as W
from hearscore.session import stage

# Words whose counts each task holds, and words that have a class of their own
# neighbours, at most.
LOOKUP = 1 << 19
CORE = (1 << 16) - 2
# Groups by neighbours, times groups by frequency; and one of all rare words.
GROUPS = 6
BINS = 5
CLASSES = GROUPS * BINS + 1
FEATURES = (1 << 13, 1 << 13, 1 << 10)
UPDATES = 2

_SIDES = 16  # columns of the neighbour table
_RARE = 65535
_START = 65534
_END = np.uint64(0x1234567)  # hash that stands for the end of a text
_SMOOTH = 0.1
_AT = np.cumsum((0, *FEATURES))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each followed by its end."""
    words = W.words_of(texts, lower=True)
    hashes = np.insert(words.hashes, words.offsets[1:], _END)
    return hashes, words.offsets + np.arange(len(words.offsets))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate([v for v, _ in held])
        counts = np.concatenate([c for _, c in held])
        found, inverse = np.unique(values, return_inverse=True)
        return found, np.bincount(inverse, counts, len(found)).astype(np.int64)

    def out(values: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(values), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(values[part].view(np.int64)), pa.array(counts[part])], names=["word", "n"])

    for batch in batches:
        for part in W.slices(batch, "text"):
            values, counts = np.unique(_tokens(part.column("text"))[0], return_counts=True)
            held.append((values, counts))
            if sum(len(v) for v, _ in held) > 1 << 20:
                held[:] = [merged()]
                if len(held[0][0]) > 1 << 19:
                    yield from out(*held.pop())
    if held:
        yield from out(*merged())


@dataclass
class Counts:
    """Counts of the most frequent words, by hash, and of all words."""

    words: np.ndarray
    counts: np.ndarray
    core: np.ndarray  # number of the word among those with a class, or _RARE
    total: int
    distinct: int
    core_total: int
    core_distinct: int
    least: int

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + _SMOOTH) / (self.total + _SMOOTH * (self.distinct + 1)))

    @property
    def rare_scale(self) -> float:
        """Log of what the rare words and an unknown one share."""
        distinct = self.distinct - self.core_distinct
        return float(np.log10(self.total - self.core_total + _SMOOTH * (distinct + 1)))


def _frequent(counts: DataFrame, most: int) -> int:
    """Smallest count such that at most ``most`` words have it or more."""
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(F.log2("n") * 64))
    rows = counts.groupBy(step.alias("step")).agg(F.min("n").alias("n"), F.count("*").alias("words")).collect()
    least, seen = 1 << 62, 0  # rows: a bounded number of steps
    for r in sorted(rows, key=lambda r: -r.n):
        seen += r.words
        if seen > most:
            break
        least = r.n
    return least


def count(docs: DataFrame) -> tuple[DataFrame, Counts]:
    """Counts of all words of ``docs`` (a stored table) and the part that
    tasks hold."""
    counts = stage(docs.select("text").mapInArrow(_count_rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least, core = _frequent(counts, LOOKUP), _frequent(counts, CORE)
    table = counts.filter(F.col("n") >= least).toArrow()  # at most LOOKUP rows
    words = table.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    words, n = words[order], table.column("n").to_numpy()[order]
    number = np.full(len(words), _RARE)
    number[n >= core] = np.arange((n >= core).sum())
    return counts, Counts(words, n, number, total, distinct, int(n[n >= core].sum()), int((n >= core).sum()), least)


def _coded_rows(shared):
    """Texts as numbers of core words (two bytes each) and the sums that need
    nothing else; words that tasks don't know the count of are listed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counts = shared.value
        for batch in batches:
            for part in W.slices(batch, "text"):
                hashes, offsets = _tokens(part.column("text"))
                if len(own.words):
                    at = np.minimum(np.searchsorted(own.words, hashes), len(own.words) - 1)
                    known = own.words[at] == hashes
                else:
                    at, known = np.zeros(len(hashes), int), np.zeros(len(hashes), bool)
                core = np.where(known, own.core[at] if len(own.core) else _RARE, _RARE).astype(np.uint16)
                n = np.where(known, own.counts[at] if len(own.counts) else 0, 0)
                # Of rare words with a known count, the log of it.
                log = np.where(known & (core == _RARE), np.log10(n + _SMOOTH), 0.0)
                base = np.where(known, own.base(n), 0.0)
                total = lambda x: np.add.reduceat(x, offsets[:-1]) if len(part) else x
                cut = zip(offsets[:-1], offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array(np.diff(offsets)),
                        pa.array(total(known.astype(np.int64))),
                        pa.array(total(base)),
                        pa.array(total(log)),
                        pa.array([core[a:b].tobytes() for a, b in cut], pa.binary()),
                        pa.array([hashes[a:b][~known[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "rare", "core", "unlisted"],
                )

    return rows


def _sequences(batches: Iterator[pa.RecordBatch], size: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with their core numbers and offsets."""
    for batch in batches:
        length = pc.binary_length(batch.column("core")).to_numpy(zero_copy_only=False) // 2
        ends = np.cumsum(length)
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
            part = batch.slice(start, stop - start)
            core = np.frombuffer(b"".join(part.column("core").to_pylist()), np.uint16)
            yield part, core, np.concatenate([[0], np.cumsum(length[start:stop])])
            start = stop


def _shifted(core: np.ndarray, offsets: np.ndarray, by: int) -> np.ndarray:
    """The word ``by`` places earlier in the same text, or its start."""
    out = np.full(len(core), _START, dtype=np.uint16)
    out[by:] = core[: len(core) - by]
    at = np.minimum(np.repeat(offsets[:-1], np.diff(offsets)) + by, len(core))
    out[np.arange(len(core)) < at] = _START
    return out


def _columns(table: np.ndarray, prefix: str = "c") -> pa.RecordBatch:
    some = np.flatnonzero(table.any(1))
    arrays = [pa.array(some.astype(np.int64)), *(pa.array(table[some, k].astype(np.float64)) for k in range(table.shape[1]))]
    return pa.RecordBatch.from_arrays(arrays, names=["row", *(f"{prefix}{k}" for k in range(table.shape[1]))])


def _summed(coded: DataFrame, rows: Callable, height: int, width: int) -> np.ndarray:
    """Sum over all tasks of a table of ``height`` by ``width`` numbers."""
    names = [f"c{k}" for k in range(width)]
    kind = "row long, " + ", ".join(f"{c} double" for c in names)
    table = coded.mapInArrow(rows, kind).groupBy("row").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    out = np.zeros((height, width))
    at = table.column("row").to_numpy()
    for k, c in enumerate(names):
        out[at, k] = table.column(c).to_numpy()
    return out


def _side_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every core word, how often its neighbours hash to each column."""
    table = np.zeros((CORE, _SIDES))
    for _, core, offsets in _sequences(batches):
        before = _shifted(core, offsets, 1)
        column = (W.mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(_SIDES)).astype(np.int64)
        ok = (core < CORE) & (before < CORE)
        a, b = core[ok].astype(np.int64), before[ok].astype(np.int64)
        for word, side in ((a, b), (b, a)):
            table += np.bincount(word * _SIDES + column[side], minlength=CORE * _SIDES).reshape(CORE, _SIDES)
    yield _columns(table)


def group_words(sides: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Class of every core word: k-means over its neighbours (square roots of
    shares), then bins of equal mass from the most frequent word down."""
    shares = np.sqrt(sides / np.maximum(sides.sum(1, keepdims=True), 1))
    order = np.argsort(-counts, kind="stable")
    centres = shares[order[:1]] if len(order) else np.zeros((1, sides.shape[1]))
    top = shares[order[:2000]]
    while len(centres) < GROUPS and len(top):
        gap = ((top[:, None] - centres[None]) ** 2).sum(2).min(1)
        centres = np.vstack([centres, top[gap.argmax()]])
    group = np.zeros(len(counts), dtype=np.int64)
    for _ in range(15):
        group = ((shares[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for k in range(len(centres)):
            if (mine := group == k).any():
                centres[k] = np.average(shares[mine], axis=0, weights=np.sqrt(counts[mine]))
    classes = np.zeros(len(counts), dtype=np.int64)
    for k in range(GROUPS):
        mine = order[group[order] == k]
        mass = np.sqrt(counts[mine])
        before = np.cumsum(mass) - mass
        classes[mine] = k * BINS + np.minimum((before / max(mass.sum(), 1) * BINS).astype(np.int64), BINS - 1)
    return classes


@dataclass
class Model:
    classes: np.ndarray  # of every core number; _RARE and _START included
    within: np.ndarray  # log10 of a core word's share of its class
    bias: np.ndarray
    weights: np.ndarray

    def features(self, core: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        one, two = _shifted(core, offsets, 1), _shifted(core, offsets, 2)
        both = self.classes[one].astype(np.int64) * (CLASSES + 1) + self.classes[two]
        return [
            _AT[0] + (one.astype(np.int64) * 40503 >> 3) % FEATURES[0],
            _AT[1] + (two.astype(np.int64) * 40503 >> 3) % FEATURES[1],
            _AT[2] + both % FEATURES[2],
        ]

    def odds(self, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of the classes' logits, and their sums."""
        logits = self.weights[features[0]]
        for own in features[1:]:
            logits += self.weights[own]
        logits += self.bias
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        return logits, logits.sum(1)


def _feature_rows(shared, expected: bool):
    """Feature counts of classes: observed ones or those a model expects."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        height = int(_AT[-1])
        table = np.zeros((height, CLASSES))
        for _, core, offsets in _sequences(batches, 1 << 16):
            features = own.features(core, offsets)
            if expected:
                odds, total = own.odds(features)
                odds /= total[:, None]
                for f in features:
                    for k in range(CLASSES):
                        table[:, k] += np.bincount(f, odds[:, k], height)
            else:
                label = own.classes[core].astype(np.int64)
                for f in features:
                    table += np.bincount(f * CLASSES + label, minlength=height * CLASSES).reshape(height, CLASSES)
        yield _columns(table)

    return rows


def train(coded: DataFrame, counts: Counts, updates: int = UPDATES) -> Model:
    """Model of coded training texts, from weights in closed form (how much a
    feature raises each class, smoothed) and ``updates`` gradient updates."""
    spark = coded.sparkSession
    size = counts.core_distinct
    own = np.zeros(size)
    own[counts.core[counts.core != _RARE]] = counts.counts[counts.core != _RARE]
    sides = _summed(coded, _side_rows, CORE, _SIDES)[:size]
    classes = np.full(1 << 16, CLASSES - 1, dtype=np.uint8)
    classes[:size] = group_words(sides, own)
    classes[_START] = CLASSES
    mass = np.bincount(classes[:size], own, CLASSES)
    within = np.zeros(1 << 16)
    within[:size] = np.log10(own / mass[classes[:size]])
    mass[CLASSES - 1] = counts.total - counts.core_total
    share = (mass + 1) / (mass.sum() + CLASSES)
    bias = np.log(share).astype(np.float32)
    empty = np.zeros((int(_AT[-1]), CLASSES), dtype=np.float32)
    model = Model(classes, within, bias, empty)
    seen = _summed(coded, _feature_rows(spark.sparkContext.broadcast(model), False), *empty.shape)
    smooth = 20 * share
    raised = np.log((seen + smooth) / (seen.sum(1, keepdims=True) + 20)) - np.log(share)
    weights = (raised / len(FEATURES) * 1.2).astype(np.float32)
    for _ in range(updates):
        model = Model(classes, within, bias, weights)
        hoped = _summed(coded, _feature_rows(spark.sparkContext.broadcast(model), True), *empty.shape)
        weights = weights + (np.log((seen + smooth) / (hoped + smooth)) / len(FEATURES)).astype(np.float32)
    return Model(classes, within, bias, weights)


def _score_rows(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        for part, core, offsets in _sequences(batches, 1 << 16):
            odds, total = own.odds(own.features(core, offsets))
            label = own.classes[core]
            value = np.log10(odds[np.arange(len(core)), label]) - np.log10(total) + own.within[core]
            sums = np.add.reduceat(value, offsets[:-1])
            rare = np.add.reduceat((core == _RARE).astype(np.int64), offsets[:-1])
            keep = [part.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "rare")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(rare), pa.array(sums)], names=[*_KEPT, "n_rare", "score"])

    return rows


_KEPT = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "rare"]


def _unlisted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("unlisted").to_pylist()
        words = np.frombuffer(b"".join(lists), np.uint64).view(np.int64)
        row = np.repeat(batch.column("row").to_numpy(), [len(x) // 8 for x in lists])
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(words)], names=["row", "word"])


def score(docs: DataFrame, held_out: Column, updates: int = UPDATES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score`` for every row of ``docs``.

    Tokens are the words of the text with A-Z lowered and one end; a null text
    is empty.  ``base_score`` is the smoothed unigram log10 probability,
    ``score`` that of the model; both learn from the rows where ``held_out``
    (over ``doc_id``) doesn't hold.  Only ``doc_id`` and ``text`` are read;
    repeated rows count as often as they occur.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    counts, own = count(docs.filter("NOT held_out"))
    coded = stage(
        docs.mapInArrow(
            _coded_rows(spark.sparkContext.broadcast(own)),
            "doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare double, core binary, unlisted binary",
        ).withColumn("row", F.monotonically_increasing_id()),
        "coded",
    )
    model = train(coded.filter("NOT held_out").select("core"), own, updates)
    kind = (
        "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare double, "
        "n_rare long, score double"
    )
    scored = coded.select(*_KEPT, "core").mapInArrow(_score_rows(spark.sparkContext.broadcast(model)), kind)
    rest = (
        coded.select("row", "unlisted")
        .mapInArrow(_unlisted_rows, "row long, word long")
        .groupBy("word", "row")
        .agg(F.count("*").alias("times"))
    )
    rest = stage(rest, "unlisted_words").join(counts.filter(F.col("n") < own.least), "word", "left")
    n = F.coalesce("n", F.lit(0))
    log = F.log10(n + _SMOOTH)
    scale = float(np.log10(own.total + _SMOOTH * (own.distinct + 1)))
    rest = rest.groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * log).alias("more_rare"),
        F.sum(F.col("times") * (log - scale)).alias("more_base"),
    )
    none = F.lit(0.0)
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(own.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", none)).alias("base_score"),
        (
            F.col("score") + F.col("rare") + F.coalesce("more_rare", none) - F.col("n_rare") * own.rare_scale
        ).alias("score"),
    )
