"""SimHash fingerprints of documents, and groups of those that are close.

A fingerprint has 64 bits: each is the majority over the hashes of a text's
word shingles.  Two fingerprints link when they differ in at most two bits.

1. *Classes.*  Equal fingerprints are one row from here on.
2. *Pivot tables.*  Every fingerprint gets its Hamming distances to 68
   reference fingerprints, 17 for each quarter of the bits.  The references of
   one quarter differ from each other in that quarter alone, so a fingerprint's
   distances to them, taken relative to the first one, change only if a bit of
   that quarter does.
3. *Cells.*  Two bits lie in at most two quarters: linked fingerprints have the
   same relative distances for two quarters at least.  For each of the six
   pairs of quarters a class is put in the cell that these distances name.
4. *Discard and verify.*  No distance to a reference can change by more than
   the bits that differ (triangle inequality).  Within a cell, pairs with a
   coordinate further apart than that are discarded, one coordinate after the
   other; what survives is decided on the fingerprints.
5. *Crowded cells.*  A cell of more than ``_CROWD`` classes isn't held against
   itself.  Its members agree in two quarters, so a linked pair differs in the
   other 32 bits alone and has a fingerprint between them, at most one of these
   bits from either.  Every member names those 33 places; members that meet in
   a place are linked through it.  Exact, and linear in the members.

A cell emits a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearscore.llm import words as W
from hearscore.llm.graph import components
from hearscore.session import stage

SHINGLE = 3
SEED = 42
#: Bits in which linked fingerprints may differ.
DISTANCE = 2

# Classes of a cell that are held against each other.
_CROWD = 512
# Shingles whose bits are counted at once.
_CHUNK = 1 << 15
# Shingles of more bytes are hashed one by one.
_LONG = 512

# The primes of XXH64.
_P1 = np.uint64(0x9E3779B185EBCA87)
_P2 = np.uint64(0xC2B2AE3D27D4EB4F)
_P3 = np.uint64(0x165667B19E3779F9)
_P4 = np.uint64(0x85EBCA77C2B2AE63)
_P5 = np.uint64(0x27D4EB2F165667C5)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(state: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turned(state + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of ``data[start:end]`` for every range, all ranges at a time."""
    data = np.ascontiguousarray(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    halves = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    size = ends - starts
    one = np.array([seed & (2**64 - 1)], np.uint64)
    h = np.repeat(one + _P5, len(starts))
    at = starts.copy()
    striped = np.flatnonzero((size >= 32) & (size <= _LONG))
    if len(striped):
        stripes = size[striped] // 32
        state = [np.repeat(v, len(striped)) for v in (one + _P1 + _P2, one + _P2, one, one - _P1)]
        for k in range(int(stripes.max())):
            on = np.flatnonzero(stripes > k)
            first = starts[striped[on]] + 32 * k
            for q in range(4):
                state[q][on] = _round(state[q][on], lanes[first + 8 * q])
        mixed = _turned(state[0], 1) + _turned(state[1], 7) + _turned(state[2], 12) + _turned(state[3], 18)
        for v in state:
            mixed = (mixed ^ _round(np.zeros_like(v), v)) * _P1 + _P4
        h[striped] = mixed
        at[striped] += 32 * stripes
    h += size.astype(np.uint64)
    rest = np.where(size <= _LONG, ends - at, 0)
    for k in range(3):
        on = np.flatnonzero(rest // 8 > k)
        lane = lanes[at[on] + 8 * k]
        h[on] = _turned(h[on] ^ _round(np.zeros_like(lane), lane), 27) * _P1 + _P4
    at += rest // 8 * 8
    rest = rest % 8
    on = np.flatnonzero(rest >= 4)
    h[on] = _turned(h[on] ^ (halves[at[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[on] += 4
    rest[on] -= 4
    for k in range(3):
        on = np.flatnonzero(rest > k)
        h[on] = _turned(h[on] ^ (padded[at[on] + k].astype(np.uint64) * _P5), 11) * _P1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], seed)
    return h


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprint of every text: a bit is 1 if it is set in over half the
    hashes of its shingles, repeats counted.  A text of fewer words is one
    shingle; one without words has fingerprint 0."""
    words = W.words_of(texts, lower=True)
    first, offsets = words.windows(shingle)
    short = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
    data, starts, ends = W.spaced(words)
    owner = np.concatenate([np.repeat(np.arange(len(texts)), np.diff(offsets)), short])
    begin = np.concatenate([first, words.offsets[short]])
    last = np.concatenate([first + shingle - 1, words.offsets[short + 1] - 1])
    order = np.argsort(owner, kind="stable")
    owner, begin, last = owner[order], begin[order], last[order]
    counts = np.zeros((len(texts), 64), dtype=np.int64)
    for a in range(0, len(owner), _CHUNK):
        part = slice(a, a + _CHUNK)
        hashes = xxh64(data, starts[begin[part]], ends[last[part]])
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[part]
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts[own[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    total = np.bincount(owner, minlength=len(texts))
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def _references() -> np.ndarray:
    """68 fingerprints in four rows of 17: a base, and the base with a half of
    the row's quarter turned over (the 15 patterns of a Hadamard matrix), and
    with all of it.  These distances tell any two quarters apart."""
    base = np.uint64(0x243F6A8885A308D3)
    bit = np.arange(16)
    halves = [sum(1 << int(j) for j in bit if bin(s & int(j)).count("1") % 2) for s in range(1, 16)]
    patterns = np.array([0, *halves, 0xFFFF], dtype=np.uint64)
    shift = np.arange(0, 64, 16, dtype=np.uint64)
    return base ^ (patterns[None, :] << shift[:, None])


_REFERENCES = _references()
_PAIRS = list(combinations(range(4), 2))


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Distances of every fingerprint to every reference, by quarter."""
    return np.bitwise_count(prints[:, None, None] ^ _REFERENCES[None]).astype(np.int8)


def cells(table: np.ndarray) -> np.ndarray:
    """For each fingerprint the six numbers of its cells."""
    relative = (table - table[:, :, :1]).astype(np.int64).view(np.uint64)
    odd = W.mix(np.arange(1, 18, dtype=np.uint64)) | np.uint64(1)
    quarter = (relative * odd).sum(axis=2, dtype=np.uint64)
    return np.stack(
        [
            W.mix(W.mix(quarter[:, a]) * np.uint64(3) + W.mix(quarter[:, b] + np.uint64(k + 1)))
            for k, (a, b) in enumerate(_PAIRS)
        ],
        axis=1,
    )


def links(prints: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links between distinct
    fingerprints.  They are sorted by their first distance, so each meets only
    those whose first distance is near enough; other distances thin them out."""
    table = pivot_table(prints).reshape(len(prints), -1)
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    stop = np.searchsorted(table[:, 0], table[:, 0] + distance, side="right")
    count = stop - np.arange(len(prints)) - 1
    root = np.arange(len(prints))
    edges = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    # A run of rows at a time, so that the pairs at hand stay few.
    cut = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + 1, 1 << 18))
    for a, b in zip(cut, [*cut[1:], len(prints)]):
        one = np.repeat(np.arange(a, b), count[a:b])
        two = np.arange(len(one)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b]) + one + 1
        for column in range(1, table.shape[1]):
            if len(one) == 0:
                break
            near = np.abs(table[one, column] - table[two, column]) <= distance
            one, two = one[near], two[near]
        same = np.bitwise_count(prints[one] ^ prints[two]) <= distance
        for x, y in zip(one[same].tolist(), two[same].tolist()):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                edges.append((int(order[x]), int(order[y])))
    return edges


def _print_rows(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                own = fingerprints(part.column("text"), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own)], names=["doc_id", "print"])

    return rows


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy()
        cell = cells(pivot_table(prints.view(np.uint64)))
        kinds = cell.shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(prints, kinds)),
                pa.array(np.tile(np.arange(kinds, dtype=np.int32), len(prints))),
                pa.array(cell.ravel().view(np.int64)),
            ],
            names=["print", "kind", "cell"],
        )


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[int, int]] = []
        lists = batch.column("prints")
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy()
        for a, b in zip(offsets[:-1], offsets[1:]):
            own = values[a:b]
            out += [(int(own[x]), int(own[y])) for x, y in links(own.view(np.uint64))]
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member of a crowded cell with the fingerprints at most one bit
    from it, bits outside the quarters that the cell's members share."""
    one = np.uint64(1)
    for batch in batches:
        prints = batch.column("print").to_numpy().view(np.uint64)
        kind = batch.column("kind").to_numpy()
        for k, shared in enumerate(_PAIRS):
            own = prints[kind == k]
            free = [b for b in range(64) if b // 16 not in shared]
            turns = np.array([0, *(one << np.uint64(b) for b in free)], dtype=np.uint64)
            for a in range(0, len(own), 1 << 14):
                some = own[a : a + (1 << 14)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((some[:, None] ^ turns).ravel().view(np.int64)),
                        pa.array(np.repeat(some.view(np.int64), len(turns))),
                    ],
                    names=["place", "print"],
                )


def group(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, print`` (the fingerprint as a signed 64-bit number) and
    ``component_id`` for every row of ``docs``; only ``doc_id`` and ``text``
    are read.

    ``component_id`` is the smallest ``doc_id`` reachable by links, itself
    included.  Texts that are null or have no words have fingerprint 0 and are
    linked like any other.  Repeated rows, and different texts of one id, are
    rows of their own, each with the component of its text.  A row without a
    ``doc_id`` links like others but never gives its id to a component: the
    component is null where no row of it has one.
    """
    rows = stage(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_print_rows(shingle), "doc_id long, print long"),
        "fingerprints",
    )
    classes = stage(rows.groupBy("print").agg(F.min("doc_id").alias("doc_id")), "fingerprint_classes")
    celled = stage(classes.select("print").mapInArrow(_cell_rows, "print long, kind int, cell long"), "pivot_cells")
    shared = stage(celled.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "shared_cells")
    found = celled.join(shared, "cell")
    edges = (
        found.filter(F.col("n") <= _CROWD)
        .groupBy("cell")
        .agg(F.collect_list("print").alias("prints"))
        .mapInArrow(_link_rows, "a long, b long")
    )
    places = stage(
        found.filter(F.col("n") > _CROWD).select("print", "kind").mapInArrow(_place_rows, "place long, print long"),
        "places",
    )
    least = places.groupBy("place").agg(F.min("print").alias("a"))
    through = places.join(least, "place").filter("print > a").select("a", F.col("print").alias("b"))
    linked = components(stage(edges.union(through).distinct(), "fingerprint_links")).toDF("print", "root")
    known = classes.join(linked, "print", "left").withColumn("root", F.coalesce("root", "print"))
    known = stage(known, "linked_classes")
    first = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_class = stage(known.join(first, "root").select("print", "component_id"), "class_components")
    return rows.join(by_class, "print").select("doc_id", "print", "component_id")


def written(fingerprint: str = "print"):
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fingerprint)), 16, "0"))
