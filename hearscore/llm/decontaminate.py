"""Passages of test items in training documents.

*Index.*  Training documents are read in segments of bounded size.  A segment's
row holds a positional inverted index: for every term that a test item may use,
the sorted list of its places.  Which terms those are is known by a bitmap of
fixed size over term hashes.  The index is a stored table.

*Search.*  A phrase is a window of consecutive words of an item.  Its terms are
taken from the rarest one in the whole index to the commonest; the list of the
rarest, moved back by its offset in the phrase, gives the starts in question,
and each further list keeps those that it has, too.  All phrases of a block of
items run side by side in numpy.  Large sets of items are searched in blocks of
bounded size, one after the other, over the same index.

A proximity match is a start given by a phrase's rarest term at which each of
its next rarest terms lies within ``slop`` words of its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearscore.llm import words as W
from hearscore.session import stage

WINDOW = 13
# Terms that a proximity match looks at.
ANCHORS = 4

_SLOTS = 1 << 24
# Places between two documents of a segment.
_GAP = 1 << 10
# Words of a block of items, about, and of a piece of a long item.
_BLOCK = 500_000
_PIECE = 100_000
# Places of rarest terms that are held at once, about.
_PLACES = 1 << 18

_INDEX = "doc_ids binary, known binary, lengths binary, terms binary, counts binary, places binary"


def _words(texts: pa.Array) -> W.Words:
    return W.words_of(texts, W.ALNUM, lower=True)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int32)


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(_words(part.column("text")).hashes)))], names=["slot"])


def term_map(items: DataFrame) -> np.ndarray:
    """Bitmap of the hash slots of all terms of the items: 2 MB."""
    slots = items.select("text").mapInArrow(_slot_rows, "slot int").distinct().toArrow()  # at most _SLOTS rows
    bits = np.zeros(_SLOTS, dtype=bool)
    bits[slots.column("slot").to_numpy()] = True
    return np.packbits(bits)


def build_index(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """The index of ``docs`` (``doc_id, text``) over the terms of a bitmap, a
    row per segment.  A document's places start at a multiple of ``_GAP``, at
    least that far from the end of the one before."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for part in W.slices(batch, "text"):
                words = _words(part.column("text"))
                lengths = words.counts
                first = _first_places(lengths)
                place = np.arange(len(words)) + np.repeat(first - words.offsets[:-1], lengths)
                mine = used[_slots(words.hashes)]
                hashes, place = words.hashes[mine], place[mine]
                order = np.argsort(hashes, kind="stable")
                terms_, counts = np.unique(hashes, return_counts=True)
                ids = part.column("doc_id")
                columns = [
                    ids.fill_null(0).to_numpy().astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False),
                    lengths.astype(np.int32), terms_, counts.astype(np.int32), place[order].astype(np.int64),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c.tobytes()], pa.binary()) for c in columns],
                    names=["doc_ids", "known", "lengths", "terms", "counts", "places"],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, _INDEX)


def _first_places(lengths: np.ndarray) -> np.ndarray:
    room = -(-lengths // _GAP) * _GAP + _GAP
    return np.concatenate([[0], np.cumsum(room)])[:-1].astype(np.int64)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of each term, summed over some segments."""
    for batch in batches:
        terms = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.int32)
        values, inverse = np.unique(terms, return_inverse=True)
        total = np.bincount(inverse, counts, len(values)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(total)], names=["term", "n"])


@dataclass
class Phrases:
    """Phrases of one length: terms ``[phrase, offset]``, offsets from the
    rarest term to the commonest, and the number of the item."""

    terms: np.ndarray
    order: np.ndarray
    item: np.ndarray


def phrases(items: list[np.ndarray], counts: dict[int, int], window: int) -> list[Phrases]:
    """The distinct phrases of items (arrays of term hashes)."""
    by_length: dict[int, dict[tuple, set]] = {}
    for number, terms in enumerate(items):
        size = min(window, len(terms))
        for start in range(len(terms) - size + 1) if size else ():
            key = tuple(terms[start : start + size].tolist())
            by_length.setdefault(size, {}).setdefault(key, set()).add(number)
    out = []
    for found in by_length.values():
        pairs = [(key, item) for key, owners in found.items() for item in sorted(owners)]
        terms = np.array([key for key, _ in pairs], dtype=np.uint64)
        often = np.vectorize(lambda t: counts.get(int(t), 0), otypes=[np.int64])(terms)
        out.append(Phrases(terms, np.argsort(often, axis=1, kind="stable"), np.array([item for _, item in pairs])))
    return out


class Segment:
    """The index of one segment."""

    def __init__(self, row: dict):
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        self.lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.int32)
        self.places = np.frombuffer(row["places"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.first = _first_places(self.lengths)
        # Place and list in one number that rises through the whole table.
        self.keys = self.places + (np.repeat(np.arange(len(self.terms)), self.counts) << 40)

    def _lists(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term's list, -1 if the segment hasn't the term."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def parts(self, own: Phrases) -> Iterator[Phrases]:
        """The phrases in runs whose rarest terms have a bounded number of
        places here."""
        lists = self._lists(own.terms[np.arange(len(own.terms)), own.order[:, 0]])
        n = np.append(self.counts, 0)[lists]  # no places of a term that isn't here
        total = np.cumsum(n)
        full = np.arange(_PLACES, (int(total[-1]) if len(n) else 0) + 1, _PLACES)
        cuts = np.unique([0, *(np.searchsorted(total, full) + 1), len(n)])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield Phrases(own.terms[a:b], own.order[a:b], own.item[a:b])

    def _rarest(self, own: Phrases, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and start of every place of its rarest term."""
        some = np.flatnonzero((lists >= 0).all(1))
        offset = own.order[some, 0]
        which = lists[some, offset]
        n = self.counts[which]
        at = np.arange(n.sum()) + np.repeat(self.starts[which] - (np.cumsum(n) - n), n)
        return np.repeat(some, n), self.places[at] - np.repeat(offset, n)

    def exact(self, own: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and start of every occurrence."""
        lists = self._lists(own.terms)
        phrase, start = self._rarest(own, lists)
        for k in range(1, own.terms.shape[1]):
            offset = own.order[phrase, k]
            key = start + offset + (lists[phrase, offset] << 40)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            kept = (self.keys[at] == key) if len(key) else np.zeros(0, bool)
            phrase, start = phrase[kept], start[kept]
        return phrase, start

    def near(self, own: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and start of every proximity match."""
        anchors = Phrases(np.take_along_axis(own.terms, own.order[:, :ANCHORS], 1), own.order[:, :ANCHORS], own.item)
        lists = self._lists(anchors.terms)
        some = np.flatnonzero((lists >= 0).all(1))
        offset, which = anchors.order[some, 0], lists[some, 0]
        n = self.counts[which]
        at = np.arange(n.sum()) + np.repeat(self.starts[which] - (np.cumsum(n) - n), n)
        phrase, start = np.repeat(some, n), self.places[at] - np.repeat(offset, n)
        for k in range(1, anchors.terms.shape[1]):
            low = start + anchors.order[phrase, k] - slop + (lists[phrase, k] << 40)
            at = np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)
            kept = ((self.keys[at] >= low) & (self.keys[at] <= low + 2 * slop)) if len(low) else np.zeros(0, bool)
            phrase, start = phrase[kept], start[kept]
        return phrase, start

    def docs_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1


_FOUND = (
    "segment long, number long, doc_id long, n_words long, "
    "hits array<int>, items array<string>, near array<string>"
)


def _search_rows(shared, slop: int):
    """One row per document of each segment (``segment`` and ``number``): word
    places that are hit, items that occur, items with a proximity match; for
    one block of items."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, groups = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                hits = [set() for _ in segment.doc_ids]
                items = [set() for _ in segment.doc_ids]
                near = [set() for _ in segment.doc_ids]
                for own in (part for whole in groups for part in segment.parts(whole)):
                    size = own.terms.shape[1]
                    phrase, start = segment.exact(own)
                    doc = segment.docs_of(start)
                    for d, s, i in zip(doc.tolist(), (start - segment.first[doc]).tolist(), own.item[phrase].tolist()):
                        hits[d].update(range(s, s + size))
                        items[d].add(names[i])
                    phrase, start = segment.near(own, slop)
                    # The rarest term itself lies in the document.
                    doc = segment.docs_of(start + own.order[phrase, 0])
                    for d, i in set(zip(doc.tolist(), own.item[phrase].tolist())):
                        near[d].add(names[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]] * len(hits), pa.int64()),
                        pa.array(np.arange(len(hits))),
                        pa.array(segment.doc_ids, mask=~segment.known),
                        pa.array(segment.lengths),
                        pa.array([sorted(x) for x in hits], pa.list_(pa.int32())),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        pa.array([sorted(x) for x in near], pa.list_(pa.string())),
                    ],
                    names=["segment", "number", "doc_id", "n_words", "hits", "items", "near"],
                )

    return rows


def _item_rows(window: int):
    """Terms of every item, long ones in pieces that share ``window - 1`` words:
    each window lies in one piece."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _words(batch.column("text"))
            owner, pieces, terms = [], [], []
            for i, (a, b) in enumerate(zip(words.offsets[:-1], words.offsets[1:])):
                starts = range(a, max(b - window + 1, a + 1), _PIECE)
                owner += [i] * len(starts)
                pieces += range(len(starts))
                terms += [words.hashes[s : min(b, s + _PIECE + window - 1)].tobytes() for s in starts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(owner, pa.int64())), pa.array(pieces, pa.int64()), pa.array(terms, pa.binary())],
                names=["item_id", "piece", "terms"],
            )

    return rows


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 2) -> DataFrame:
    """``doc_id, n_words, hits, items, near`` for every row of ``docs``: the
    word places (from 0) inside an occurrence of a window of an item, the ids
    (as strings) of items with occurring windows, and of those with a
    proximity match.

    An item of fewer words than ``window``, but not none, is one window.  Only
    ``doc_id``/``item_id`` and ``text`` are read; a null text has no words; an
    item without an id is left out; items that repeat an id count as one with
    the windows of all.
    """
    spark = docs.sparkSession
    items = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("string"), "text")
    index = build_index(docs, term_map(items)).withColumn("segment", F.monotonically_increasing_id())
    index = stage(index, "postings")
    coded = stage(items.mapInArrow(_item_rows(window), "item_id string, piece long, terms binary"), "items")
    size = coded.agg(F.sum(F.length("terms") / 8)).first()[0] or 0
    blocks = max(1, -(-int(size) // _BLOCK))
    counts = stage(index.select("terms", "counts").mapInArrow(_count_rows, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "counts")
    found = None
    for block in range(blocks):
        own = coded.filter(F.pmod(F.xxhash64("item_id", "piece"), F.lit(blocks)) == block).orderBy("item_id", "terms").collect()
        terms = [np.frombuffer(r.terms, np.uint64) for r in own]
        known = np.unique(np.concatenate([*terms, np.zeros(0, np.uint64)]))
        wanted = spark.createDataFrame([(int(t),) for t in known.view(np.int64)], "term long")
        often = {r.term & (2**64 - 1): r.n for r in counts.join(F.broadcast(wanted), "term").collect()}  # of one block
        shared = spark.sparkContext.broadcast(([r.item_id for r in own], phrases(terms, often, window)))
        more = index.mapInArrow(_search_rows(shared, slop), _FOUND)
        found = more if found is None else stage(_and(found, more), f"found_{block}")
    return found.select("doc_id", "n_words", "hits", "items", "near")


def _and(found: DataFrame, more: DataFrame) -> DataFrame:
    """Results of several blocks of items for the same documents."""
    lists = ("hits", "items", "near")
    more = more.select("segment", "number", *(F.col(c).alias(f"{c}_more") for c in lists))
    both = [F.array_sort(F.array_union(c, f"{c}_more")).alias(c) for c in lists]
    return found.join(more, ["segment", "number"]).select("segment", "number", "doc_id", "n_words", *both)
