"""Language of words, spans and documents.

Words (runs of letters) are scored under every language by a hashed model of
their byte n-grams.  The script of a word's first character narrows the
languages that come into question.  Viterbi over the words of a document, with
a penalty for every switch, then labels spans of mixed text; a document has
the language that most of its letters lie in.

The model is counted on the executors over all labelled documents, so that rare
languages are in it; what returns to the driver is a table of languages by
buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearscore.llm import words as W

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
# Log-likelihood that a switch of language costs.
SWITCH = 8.0

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True

# First code point of a range and the script it belongs to; a
# range ends where the next one starts.
_SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0780, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"),
    (0x0B80, "Tamil"), (0x0C00, "other"), (0x0E00, "Thai"), (0x0E80, "other"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"),
    (0xAC00, "Hangul"), (0xD800, "other"),
)
_SCRIPT_NAMES = sorted({name for _, name in _SCRIPTS})
_SCRIPT_STARTS = np.array([start for start, _ in _SCRIPTS])
_SCRIPT_IDS = np.array([_SCRIPT_NAMES.index(name) for _, name in _SCRIPTS])


@dataclass
class _Lexicon:
    """The distinct words of a slice: script and features of each."""

    inverse: np.ndarray
    script: np.ndarray
    buckets: np.ndarray
    word: np.ndarray

    def __len__(self) -> int:
        return len(self.script)


def _first_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Code points at ``starts`` of UTF-8."""
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    a, b, c, d = (padded[starts + k].astype(np.int64) for k in range(4))
    b, c, d = b & 0x3F, c & 0x3F, d & 0x3F
    return np.select(
        [a < 0x80, a < 0xE0, a < 0xF0],
        [a, (a & 0x1F) << 6 | b, (a & 0x0F) << 12 | b << 6 | c],
        (a & 0x07) << 18 | b << 12 | c << 6 | d,
    )


def _lexicon(words: W.Words) -> _Lexicon:
    _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    starts, ends = words.starts[first], words.ends[first]
    script = _SCRIPT_IDS[np.searchsorted(_SCRIPT_STARTS, _first_points(words.data, starts), side="right") - 1]
    # All distinct words side by side, each between two spaces.
    lengths = ends - starts + 2
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    text = np.full(offsets[-1], 0x20, dtype=np.uint64)
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
    inner = (at > 0) & (at < np.repeat(lengths, lengths) - 1)
    text[inner] = words.data[(at + np.repeat(starts, lengths) - 1)[inner]]
    owner = np.repeat(np.arange(len(starts)), lengths)
    buckets = [(W.mix(words.hashes[first]) % np.uint64(BUCKETS)).astype(np.int32)]
    word = [np.arange(len(starts))]
    for n in GRAMS:
        whole = np.flatnonzero(at + n <= lengths[owner])
        value = np.full(len(whole), n, dtype=np.uint64)
        for k in range(n):
            value = (value << np.uint64(8)) | text[whole + k]
        value = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
        buckets.append(value.astype(np.int32))
        word.append(owner[whole])
    return _Lexicon(inverse, script, np.concatenate(buckets), np.concatenate(word))


def _words(texts: pa.Array) -> W.Words:
    return W.words_of(texts, _LETTERS, lower=True)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature counts of the whole task: buckets, then scripts."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in W.slices(batch, "text"):
            langs = part.column("lang").to_pylist()
            for lang in set(langs):
                mine = pa.array([x == lang for x in langs])
                words = _words(part.column("text").filter(mine))
                if not len(words):
                    continue
                lexicon = _lexicon(words)
                often = np.bincount(lexicon.inverse, minlength=len(lexicon))
                table = counts.setdefault(lang, np.zeros(BUCKETS + len(_SCRIPT_NAMES)))
                table[:BUCKETS] += np.bincount(lexicon.buckets, often[lexicon.word], BUCKETS)
                table[BUCKETS:] += np.bincount(lexicon.script, often, len(_SCRIPT_NAMES))
    for lang, table in counts.items():
        bucket = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(bucket)), pa.array(bucket.astype(np.int32)), pa.array(table[bucket].astype(np.int64))],
            names=["lang", "bucket", "n"],
        )


@dataclass
class Model:
    """Log-likelihoods of ``[bucket, language]`` and which languages are
    written in a script (``[script, language]``)."""

    langs: list[str]
    weights: np.ndarray
    written: np.ndarray

    def word_scores(self, lexicon: _Lexicon) -> np.ndarray:
        scores = np.empty((len(lexicon), len(self.langs)), dtype=np.float32)
        for k in range(len(self.langs)):
            scores[:, k] = np.bincount(lexicon.word, self.weights[lexicon.buckets, k], len(lexicon))
        allowed = self.written[lexicon.script]
        allowed |= ~allowed.any(1, keepdims=True)
        return np.where(allowed, scores, np.float32(-1e6))


def train(docs: DataFrame, learn: Column) -> Model:
    """Model of the non-null ``lang`` of documents, learned from all rows where
    ``learn`` (over ``doc_id``) holds."""
    counts = (
        docs.filter(learn)
        .filter("lang IS NOT NULL AND text IS NOT NULL")
        .select("text", "lang")
        .mapInArrow(_count_rows, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = counts.column("lang").to_pylist()
    langs = sorted(set(names))
    table = np.zeros((BUCKETS + len(_SCRIPT_NAMES), len(langs)))
    column = {lang: k for k, lang in enumerate(langs)}
    table[counts.column("bucket").to_numpy(), [column[x] for x in names]] = counts.column("n").to_numpy()
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    weights = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(langs, weights, scripts >= 0.01 * scripts.sum(0))


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word.  ``scores[word, label]``; texts are
    ``offsets[i]:offsets[i + 1]`` and are worked on side by side."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = offsets[:-1][order], lengths[order]
    # Texts that still have a word at step t come first.
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    kind = np.min_scalar_type(-max(1, scores.shape[1]))
    labels = np.zeros(len(scores), dtype=kind)
    came = np.zeros(len(scores), dtype=kind)
    stays = np.zeros(scores.shape, dtype=bool)
    best = np.zeros((len(lengths), scores.shape[1]), dtype=np.float64)
    for t, n in enumerate(active):
        at, now = begins[:n] + t, best[:n]
        if t:
            top = now.argmax(1)
            other = now[np.arange(n), top][:, None] - switch
            stay = now >= other
            stays[at], came[at] = stay, top
            now = np.where(stay, now, other)
        best[:n] = now + scores[at]
    last = best.argmax(1).astype(kind)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at, label = begins[:n] + t, last[:n]
        labels[at] = label
        if t:
            last[:n] = np.where(stays[at, label], label, came[at])
    return labels


def _letterless(text: str | None) -> bool:
    return text is None or not any(c.isalpha() for c in text)


def _labelled(part: pa.RecordBatch, model: Model, switch: float, spans: bool) -> list[pa.Array]:
    texts = part.column("text")
    words = _words(texts)
    counts, n, k = words.counts, len(part), max(1, len(model.langs))
    if not model.langs:
        nothing = pa.array(["und"] * n), pa.array(np.zeros(n))
        return [*nothing, pa.array([[]] * n, _SPANS)] if spans else [*nothing]
    lexicon = _lexicon(words)
    scores = model.word_scores(lexicon)[lexicon.inverse]
    labels = viterbi(scores, words.offsets, switch)
    # Letters are counted by code points: bytes that don't continue one.
    points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    letters = points[words.ends] - points[words.starts]
    text = words.texts()
    share = np.bincount(text * k + labels, letters, n * k).reshape(n, k)
    total = share.sum(1)
    # Of languages with as many letters, the likelier one.
    likely = np.stack([np.bincount(text, scores[:, j], n) for j in range(k)], 1)
    tied = share == share.max(1, keepdims=True)
    lang = np.where(tied, likely, -np.inf).argmax(1)
    plain = np.concatenate([[0], np.cumsum(words.data < 0x80)])
    has = np.bincount(text, plain[words.ends] - plain[words.starts], n) > 0
    known = np.zeros(n, dtype=bool)
    for i in range(n):
        known[i] = counts[i] > 0 and (has[i] or not _letterless(texts[i].as_py()))
    names = np.array([*model.langs, "und"], dtype=object)
    score = np.where(known, share[np.arange(n), lang] / np.maximum(total, 1), 0.0)
    out = [pa.array(names[np.where(known, lang, k)]), pa.array(score)]
    if spans:
        begins = points[W.text_buffer(texts)[1]]
        lists = [[] for _ in range(n)]
        for i in np.flatnonzero(known):
            a, b = words.offsets[i], words.offsets[i + 1]
            cuts = np.flatnonzero(np.diff(labels[a:b])) + 1 + a
            for first, stop in zip([a, *cuts], [*cuts, b]):
                where = points[words.starts[first]] - begins[i], points[words.ends[stop - 1]] - begins[i]
                lists[i].append({"start": int(where[0]), "end": int(where[1]), "lang": model.langs[labels[first]]})
        out.append(pa.array(lists, _SPANS))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; with ``spans`` also the
    labelled spans (code points, end exclusive).

    ``score`` is the share of the document's letters that lie in spans of the
    predicted language.  A text that is null or has no letter is ``und`` with
    score 0 and no spans.  Only ``doc_id`` and ``text`` are read: a row without
    an id, and each of repeated rows, is labelled like any other."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "lang_pred", "score"] + ["spans"] * spans
        for batch in batches:
            for part in W.slices(batch, "text"):
                found = _labelled(part, shared.value, switch, spans)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found], names=names)

    kind = "doc_id long, lang_pred string, score double"
    if spans:
        kind += ", spans array<struct<start:int,end:int,lang:string>>"
    return docs.select("doc_id", "text").mapInArrow(rows, kind)
