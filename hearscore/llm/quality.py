"""A text classifier of subword embeddings.

A document is the mean of the vectors of its features: words, word pairs,
byte n-grams, and marks of words and pairs that the document has had before.
Every feature hashes to a row of one table of learned vectors; a softmax over
two classes follows.  The vectors and the output are trained by numpy
stochastic gradient descent on a sample of labelled documents of bounded size,
whose sparse features are gathered from the executors.

Scoring needs the difference of the two class logits only, so each row of the
trained table becomes one number: a lookup and a sum per feature.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearscore.llm import words as W

BUCKETS = 1 << 17
GRAMS = (3, 5)
# Bytes of text at once: a byte has several features of about 50 bytes each.
_SLICE = 1 << 17
# Labelled documents that the model is trained on, at most.
SAMPLE = 2500

# Marks a packed number that goes on in the next byte.
_ON = 255

_SALT = {"word": 1, "pair": 2, "mark": 3}


def _bucket(hashes: np.ndarray, salt: int) -> np.ndarray:
    return (W.mix(hashes + np.uint64(salt)) % np.uint64(BUCKETS)).astype(np.int32)


def _seen(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the text has had the same key earlier."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((keys, text))
    same = (keys[order][1:] == keys[order][:-1]) & (text[order][1:] == text[order][:-1])
    seen = np.zeros(len(keys), dtype=bool)
    seen[order[1:][same]] = True
    return seen


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features and the number of the text each belongs to.

    Byte n-grams run over white space, never over the end of a text."""
    words = W.words_of(texts)
    data, offsets = W.text_buffer(texts)
    text = words.texts()
    firsts, pair_offsets = words.windows(2)
    pairs = words.run_hashes(firsts, firsts + 2)
    pair_text = np.repeat(np.arange(len(texts)), np.diff(pair_offsets))
    twice = (words.hashes[firsts] == words.hashes[firsts + 1]).astype(np.uint64)
    marks = twice + np.uint64(2) * _seen(pairs, pair_offsets)
    out = [
        (_bucket(words.hashes, _SALT["word"]), text),
        (_bucket(pairs, _SALT["pair"]), pair_text),
        (_bucket(marks, _SALT["mark"]), pair_text),
    ]
    byte_text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    for n in GRAMS:
        if len(data) < n:
            continue
        value = np.full(len(data) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            value = (value << np.uint64(8)) | data[k : len(data) - n + 1 + k]
        whole = byte_text[: len(value)] == byte_text[n - 1 :]
        value = (value[whole] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)
        out.append((value.astype(np.int32), byte_text[: len(whole)][whole]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text", _SLICE):
            buckets, text = features(part.column("text"))
            keys, counts = np.unique(text.astype(np.int64) * BUCKETS + buckets, return_counts=True)
            cut = np.searchsorted(keys, np.arange(len(part) + 1) * BUCKETS)
            steps, places = _packed(_gaps(keys % BUCKETS, cut[:-1]))
            times, at = _packed(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("label"),
                    pa.array([steps[a:b].tobytes() for a, b in zip(places[cut[:-1]], places[cut[1:]])], pa.binary()),
                    pa.array([times[a:b].tobytes() for a, b in zip(at[cut[:-1]], at[cut[1:]])], pa.binary()),
                ],
                names=["doc_id", "label", "buckets", "counts"],
            )


def _gaps(buckets: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Distance of each bucket from the one before; the first of a text counts
    from 0."""
    gaps = np.diff(buckets, prepend=0)
    firsts = firsts[firsts < len(gaps)]
    gaps[firsts] = buckets[firsts]
    return gaps


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes, mostly one each, and the place of each and of the end:
    255 stands for 255 and that the number goes on in the next byte."""
    ends = np.cumsum(values // _ON + 1)
    out = np.full(ends[-1] if len(ends) else 0, _ON, dtype=np.uint8)
    out[ends - 1] = values % _ON
    return out, np.append(0, ends)


def _sums(packed: pa.Scalar) -> np.ndarray:
    """Running sums of packed numbers."""
    own = np.frombuffer(packed.as_buffer(), np.uint8)
    return np.cumsum(own, dtype=np.int64)[own != _ON]


@dataclass
class Model:
    """``logits[b]``: what a feature of bucket b adds, before the mean over
    features, to the log odds of class 1 over class 0."""

    logits: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        buckets, text = features(texts)
        n = np.bincount(text, minlength=len(texts))
        total = np.bincount(text, self.logits[buckets], minlength=len(texts))
        return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + self.bias)))


def fit(
    rows: Sequence[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    size: int = 4,
    epochs: int = 8,
    rate: float = 4.0,
    batch: int = 64,
    seed: int = 7,
) -> Model:
    """Train on sparse documents (buckets and their counts).

    Each step moves the vectors of the features in its batch and the output
    weights; the rate falls linearly to 0.  Without rows all scores are 0.5."""
    if not rows:
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0)
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / size, 1 / size, (BUCKETS, size)).astype(np.float32)
    output = random.normal(0, 0.5, (size, 2)).astype(np.float32)
    share = np.clip(np.bincount(labels, minlength=2) / len(labels), 1e-3, None)
    bias = np.log(share).astype(np.float32)
    wanted = np.eye(2, dtype=np.float32)[labels]
    steps = epochs * -(-len(rows) // batch)
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(rows), batch):
            chosen = order[at : at + batch]
            own = [rows[i] for i in chosen]
            lengths = np.array([len(b) for b, _ in own])
            buckets = np.concatenate([b for b, _ in own])
            weight = np.concatenate([n / max(1, n.sum()) for _, n in own]).astype(np.float32)
            doc = np.repeat(np.arange(len(chosen)), lengths)
            part = vectors[buckets] * weight[:, None]
            mean = np.stack([np.bincount(doc, part[:, k], len(chosen)) for k in range(size)], 1).astype(np.float32)
            logits = mean @ output + bias
            odds = np.exp(logits - logits.max(1, keepdims=True))
            error = (odds / odds.sum(1, keepdims=True) - wanted[chosen]) / len(chosen)
            pace = np.float32(rate * (1 - step / steps))
            back = (error @ output.T)[doc] * weight[:, None] * (pace * len(chosen))
            for k in range(size):
                vectors[:, k] -= np.bincount(buckets, back[:, k], BUCKETS).astype(np.float32)
            output -= pace * mean.T @ error
            bias -= np.float32(0.1) * pace * error.sum(0)
            step += 1
    return Model((vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int = SAMPLE) -> Model:
    """Model of ``labels[label]`` (0 or 1), learned from the documents where
    ``learn`` (over ``doc_id``) holds.

    Of the labelled rows, the ``sample`` with the smallest hash of their id
    are used.  A document with several labels counts with the smallest; null
    labels and labels without a document are left out.
    """
    ids = (
        labels.filter(learn)
        .select("doc_id", F.col(label).cast("int").alias("label"))
        .filter("label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    gathered = (
        docs.select("doc_id", "text")
        .join(F.broadcast(ids), "doc_id")  # at most ``sample`` rows
        .select("doc_id", "text", "label")
        .mapInArrow(_sparse_rows, "doc_id long, label int, buckets binary, counts binary")
        .toArrow()
    )
    # The order of arrival is not fixed; that of the ids is.
    order = pc.sort_indices(gathered.column("doc_id")).to_pylist()
    model = fit(_Rows(gathered, order), gathered.column("label").to_numpy().astype(np.int64)[order])
    del gathered
    _give_back()
    return model


def _give_back() -> None:
    """Give the memory that training has freed back to the system: the driver's
    process would keep it for as long as it lives."""
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _sparse(buckets: pa.Scalar, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    own = np.diff(_sums(counts), prepend=0)
    return _sums(buckets).astype(np.int32), own.astype(np.min_scalar_type(int(own.max(initial=1))))


class _Rows(Sequence):
    """Sparse documents of a table in some order, unpacked only while they are
    looked at: the driver holds about two bytes a feature."""

    def __init__(self, table: pa.Table, order: list[int]):
        self.stored = list(zip(table.column("buckets"), table.column("counts")))
        self.order = order

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return _sparse(*self.stored[self.order[i]])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row; the score of a text without features
    (empty or null) is that of the bias alone.  Only ``doc_id`` and ``text`` are
    read, texts of any length whole; equal texts have equal scores, and a row
    without an id is scored like any other."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", _SLICE):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(shared.value.score(part.column("text")))],
                    names=["doc_id", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double")


def select(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least
    ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", _SLICE):
                yield part.filter(pa.array(shared.value.score(part.column("text")) >= least))

    return docs.mapInArrow(rows, docs.schema)
