"""SentencePiece models on the tokenizers library.

A model file is parsed from its protobuf wire format and rebuilt as a
tokenizer: normaliser, white-space marker, unigram scores or merges, byte
fallback and decoder.  Ids are those of the sentencepiece library.

A batch isn't encoded text by text.  Where no piece of the vocabulary runs
across a place (before white space, around line breaks), a text can be cut
there without any change of its ids; the distinct cuts of a batch are encoded
once, by all threads, and kept for the next batch of the task.  Ids of whole
texts are then gathered with numpy.  Models whose normaliser rewrites text are
encoded as whole texts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from hearscore.llm import words as W

# Fixed values of the format: kinds of pieces and of models, the marker.
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_UNIGRAM, _BPE = 1, 2
_MARK = "▁"

# Cuts that a task keeps, at most; then it starts anew.
_KEEP = 1 << 20
_TEXTS = 64


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protobuf message: number and raw value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass(frozen=True)
class Spec:
    """What a model file says."""

    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    byte_fallback: bool
    suffix: bool
    charsmap: bytes
    dummy_prefix: bool
    single_spaces: bool
    escape: bool

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == _UNKNOWN)


@lru_cache(maxsize=2)
def parse(model: bytes) -> Spec:
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(model):
        if number == 1:
            own = dict(_fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            pieces.append((own.get(1, b"").decode(), score, own.get(3, _NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    return Spec(
        tuple(pieces),
        trainer.get(3, _UNIGRAM),
        bool(trainer.get(35, 0)),
        bool(trainer.get(24, 0)),
        normalizer.get(2, b""),
        bool(normalizer.get(3, 1)),
        bool(normalizer.get(4, 1)),
        bool(normalizer.get(5, 1)),
    )


def _merges(spec: Spec) -> list[tuple[str, str]]:
    """Merges of a BPE model: every pair of pieces that is itself a piece, by
    the score of the result; of equal scores the longer result comes first,
    as a run of equals is joined from the left."""
    score = {text: s for text, s, kind in spec.pieces if kind in (_NORMAL, _USER)}
    found = []
    for text, s in score.items():
        for cut in range(1, len(text)):
            if text[:cut] in score and text[cut:] in score:
                found.append((-s, -len(text), text[:cut], text[cut:]))
    found.sort(key=lambda m: m[:2])
    return [(a, b) for _, _, a, b in found]


def _lattice(spec: Spec) -> list[tuple[str, float]]:
    """Pieces of a unigram model as text can choose them.  Control, unknown,
    byte and unused pieces get names with a space, which no text with markers
    has; pieces of the user are better than any others of their length."""
    best = max((s for _, s, kind in spec.pieces if kind == _NORMAL), default=0.0)
    score = {_NORMAL: lambda text, s: s, _USER: lambda text, s: len(text) * best - 0.1}
    return [
        (text, score[kind](text, s)) if kind in score else (f" {i}", best) for i, (text, s, kind) in enumerate(spec.pieces)
    ]


def _bare(spec: Spec) -> Tokenizer:
    """The model without normaliser: for text with markers.  That of a unigram
    model gives unknown text as one unknown token with that text."""
    if spec.kind == _UNIGRAM:
        return Tokenizer(models.Unigram(_lattice(spec), unk_id=spec.unknown, byte_fallback=False))
    if spec.kind != _BPE:
        raise ValueError(f"model kind {spec.kind} is neither unigram nor BPE")
    vocabulary = {text: i for i, (text, _, _) in enumerate(spec.pieces)}
    unknown = spec.pieces[spec.unknown][0]
    return Tokenizer(
        models.BPE(vocabulary, _merges(spec), unk_token=unknown, fuse_unk=True, byte_fallback=spec.byte_fallback)
    )


def tokenizer(model: bytes) -> Tokenizer:
    """The whole tokenizer, for single texts and for decoding.  Of a unigram
    model it leaves unknown text as it is: ``Codec`` spells it in bytes."""
    spec = parse(model)
    if spec.suffix or not spec.escape:
        raise ValueError("models with the marker as suffix or without a marker aren't supported")
    made = _bare(spec)
    steps = []
    if spec.charsmap:
        steps.append(normalizers.Precompiled(spec.charsmap))
    if spec.single_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(_MARK))
    made.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", _MARK)])
    ends = [decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []
    made.decoder = decoders.Sequence([decoders.Replace(_MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return made


class Codec:
    """Encodes and decodes batches of texts; one per task."""

    def __init__(self, model: bytes):
        self.spec = parse(model)
        self.whole = tokenizer(model)
        self.bare = _bare(self.spec)
        marked = [text for text, _, kind in self.spec.pieces if kind in (_NORMAL, _USER)]
        #: Bytes that no longer piece holds: cuts may be made around them.
        self.alone = np.zeros(256, dtype=bool)
        held = {c for text in marked if len(text) > 1 for c in text}
        self.alone[[b for b in range(0x20) if chr(b) not in held]] = True
        inside = any(a != _MARK and b == _MARK for text in marked for a, b in zip(text, text[1:]))
        self.cuts = not (inside or self.spec.charsmap or self.spec.single_spaces)
        spelled = [
            bytes([int(text[1:-1], 16)]) if kind == _BYTE else text.replace(_MARK, " ").encode()
            for text, _, kind in self.spec.pieces
        ]
        # A control piece is spelled as nothing, the unknown one as a mark.
        spelled = [b"" if k == 3 else " ⁇ ".encode() if k == _UNKNOWN else s for s, (_, _, k) in zip(spelled, self.spec.pieces)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])
        byte_ids = [i for i, (_, _, kind) in enumerate(self.spec.pieces) if kind == _BYTE]
        self.byte_ids = sorted(byte_ids, key=lambda i: self.spec.pieces[i][0])  # <0x00> to <0xFF>
        self.unknown = self.spec.unknown
        self.falls_back = self.spec.kind == _UNIGRAM and self.spec.byte_fallback and len(byte_ids) == 256
        self._forget()

    def _ids(self, found) -> list[int]:
        """Ids of an encoding, unknown text as the ids of its bytes."""
        ids, unknown = found.ids, self.unknown
        if not self.falls_back or unknown not in ids:
            return ids
        out = []
        for i, text in zip(ids, found.tokens):
            out += [self.byte_ids[b] for b in text.encode()] if i == unknown else [i]
        return out

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Encode cuts that are not known yet; their hashes rise."""
        raw = data.tobytes()
        texts = [raw[a:b].decode().replace(" ", _MARK) for a, b in zip(starts.tolist(), ends.tolist())]
        # Without offsets that is faster, but texts of unknown tokens are lost.
        encode = self.bare.encode_batch if self.falls_back else self.bare.encode_batch_fast
        ids = [self._ids(e) for e in encode(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        place = len(self.pool) + np.cumsum(length) - length
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.int32, int(length.sum()))])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")  # two sorted runs: merged, not sorted
        self.known = known[order]
        self.place = np.concatenate([self.place, place])[order]
        self.length = np.concatenate([self.length, length])[order]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the texts' offsets."""
        if not self.cuts:
            lists = []
            values = texts.fill_null("").to_pylist()
            for at in range(0, len(values), _TEXTS):
                lists += [self._ids(e) for e in self.whole.encode_batch(values[at : at + _TEXTS], add_special_tokens=False)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            return np.array([i for x in lists for i in x], dtype=np.int32), offsets
        # The marker itself in a text is white space, as in the library.
        data, offsets = W.text_buffer(pc.replace_substring(texts, _MARK, " "))
        sizes = np.diff(offsets)
        begins = offsets[:-1][sizes > 0]
        if self.spec.dummy_prefix:
            data = np.insert(data, begins, 0x20)
            begins = begins + np.arange(len(begins))
            offsets = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
        cut = np.zeros(len(data) + 1, dtype=bool)
        space, alone = data == 0x20, self.alone[data]
        cut[1:-1] = space[1:] & ~space[:-1] | alone[1:] | alone[:-1]
        cut[begins] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(data))
        hashes = W.range_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends, 0x9E3779B97F4A7C15)
        if len(self.known) > _KEEP:
            self._forget()
        values, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(values, self.known, assume_unique=True)
        if new.any():
            self._learn(data, starts[first[new]], ends[first[new]], values[new])
        at = np.searchsorted(self.known, values)[inverse]
        length = self.length[at]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.arange(total[-1]) + np.repeat(self.place[at] - total[:-1], length)]
        return ids, total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of ids; bytes that aren't UTF-8 become U+FFFD."""
        length = np.diff(self.spelled_at)[ids]
        total = np.concatenate([[0], np.cumsum(length)])
        data = self.spelled[np.arange(total[-1]) + np.repeat(self.spelled_at[ids] - total[:-1], length)]
        begin, end = total[offsets[:-1]], total[offsets[1:]]
        if self.spec.dummy_prefix:
            begin = begin + ((begin < end) & (np.append(data, 0)[np.minimum(begin, len(data))] == 0x20))
        return pa.array([bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(begin, end)], pa.string())


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def read_model(path: str) -> bytes:
    """A model file, read once by the driver and sent along with the tasks."""
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs``; a null text has null ids, an
    empty one none.  Only ``doc_id`` and ``text`` are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", W.SLICE_BYTES // 2):
                ids, offsets = codec(shared.value).encode(part.column("text"))
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32)), pa.array(ids), mask=part.column("text").is_null()
                )
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, text`` for rows of ``doc_id, ids``; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                lists = part.column("ids")
                length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                offsets = np.concatenate([[0], np.cumsum(length)])
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                texts = codec(shared.value).decode(ids, offsets)
                if lists.null_count:
                    texts = pa.array([None if n else t for n, t in zip(lists.is_null().to_pylist(), texts.to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), texts], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")


def round_trip(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, ids, lossless``: whether the ids decode to the very text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", W.SLICE_BYTES // 2):
                texts = part.column("text")
                ids, offsets = codec(shared.value).encode(texts)
                back = codec(shared.value).decode(ids, offsets).to_pylist()
                same = [a == (b or "") for a, b in zip(back, texts.to_pylist())]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=texts.is_null())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists, pa.array(same)], names=["doc_id", "ids", "lossless"]
                )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, ids array<int>, lossless boolean")
