"""Removal of passages that repeat across documents.

A window is ``window`` consecutive words.  A word goes if a window over it
also starts in a document with a smaller id.

1. *Candidates.*  Every window names the smallest hash among the ``core`` word
   runs inside it.  Equal windows name the same core, and neighbours mostly
   share one, so a document has about one core per 18 words.  A row per core
   and document also carries a hash of the whole passage whose windows name
   the core.
2. *Confirmed passages.*  Cores in at least two documents recur.  If all their
   passages are equal, the windows of every document but the first go.  Else
   the windows themselves are counted, and those go that have an earlier
   document: only around the borders of what documents share.
3. *Automata.*  Each slice of documents is a shard: the confirmed cores of its
   documents are compiled into an Aho-Corasick automaton over word symbols,
   and every document of the slice is streamed through it.  Each occurrence
   gives the place of the windows around it, which are then settled by 2.

What is shuffled are rows of cores (8 bytes each and ids), rows of windows at
borders, and the texts once for each of the last two steps.  No step holds the
documents of one core together, so it doesn't matter how many share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearscore.llm import words as W
from hearscore.session import stage

WINDOW = 50
CORE = 16

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _named_cores(words: W.Words, window: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every window, offsets by text, hash of the core it names."""
    starts, offsets = words.windows(window)
    runs, _ = words.windows(core)
    if not len(starts):
        return starts, offsets, np.zeros(0, np.uint64)
    hashes = np.full(len(words), _NONE, dtype=np.uint64)
    hashes[runs] = words.run_hashes(runs, runs + core)
    return starts, offsets, W.sliding_min(hashes, window - core + 1)[starts]


def _core_rows(window: int, core: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                words = W.words_of(part.column("text"))
                starts, offsets, named = _named_cores(words, window, core)
                if not len(starts):
                    continue
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                new = np.concatenate([[True], (named[1:] != named[:-1]) | (text[1:] != text[:-1])])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(named)) - 1
                passage = words.run_hashes(starts[first], starts[last] + window)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(text[first])),
                        pa.array(named[first].view(np.int64)),
                        pa.array(passage.view(np.int64)),
                    ],
                    names=["doc_id", "core", "passage"],
                )

    return rows


def _window_rows(window: int, core: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                words = W.words_of(part.column("text"))
                starts, offsets, named = _named_cores(words, window, core)
                wanted = _listed(part.column("open"), np.diff(offsets), named)
                starts = starts[wanted]
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[wanted]
                if len(starts):
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(pa.array(text)),
                            *(
                                pa.array(words.run_hashes(starts, starts + window, k).view(np.int64))
                                for k in (0, 1)
                            ),
                        ],
                        names=["doc_id", "high", "low"],
                    )

    return rows


def _listed(lists: pa.Array, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value stands in the list of its row."""
    row_of = np.repeat(np.arange(len(counts)), counts)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    listed = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    # Row and value in one number; the value is exact again below.
    tag = W.mix(np.arange(len(counts), dtype=np.uint64) + np.uint64(1))
    return np.isin(values ^ tag[row_of], listed ^ np.repeat(tag, lengths))


def _located(words: W.Words, starts: np.ndarray, offsets: np.ndarray, named: np.ndarray,
             wanted: np.ndarray, window: int, core: int) -> np.ndarray:
    """Windows around the occurrences of the cores that ``wanted`` windows
    name, found by an automaton over the words of this slice."""
    symbols = (words.hashes >> np.uint64(33)).astype(np.int64)
    hashes = np.full(len(words), _NONE, dtype=np.uint64)
    runs, _ = words.windows(core)
    hashes[runs] = words.run_hashes(runs, runs + core)
    places = np.flatnonzero(np.isin(hashes, np.unique(named[wanted])))
    _, one = np.unique(hashes[places], return_index=True)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for place in places[one].tolist():
        automaton.add_word(tuple(symbols[place : place + core].tolist()), place)
    automaton.make_automaton()
    near = np.zeros(len(words) + 1, dtype=np.int64)
    for i in range(len(offsets) - 1):
        begin, end = words.offsets[i], words.offsets[i + 1]
        if end - begin < window:
            continue
        found = [at for at, _ in automaton.iter(tuple(symbols[begin:end].tolist()))]
        at = np.asarray(found, dtype=np.int64) + begin - core + 1
        # Windows that hold the whole core start up to window - core before it.
        np.add.at(near, np.maximum(at - (window - core), begin), 1)
        np.add.at(near, at + 1, -1)
    return np.cumsum(near)[starts] > 0


def _kept_rows(window: int, core: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                words = W.words_of(part.column("text"))
                removed = np.zeros(len(words) + 1, dtype=np.int64)
                starts, offsets, named = _named_cores(words, window, core)
                counts = np.diff(offsets)
                if len(starts):
                    whole = _listed(part.column("closed"), counts, named)
                    hashes = words.run_hashes(starts, starts + window)
                    gone = whole | _listed(part.column("windows"), counts, hashes)
                    if gone.any():
                        gone &= _located(words, starts, offsets, named, gone, window, core)
                    np.add.at(removed, starts[gone], 1)
                    np.add.at(removed, starts[gone] + window, -1)
                kept = np.cumsum(removed)[:-1] == 0
                kept_before = np.concatenate([[0], np.cumsum(kept)])
                n_kept = np.diff(kept_before[words.offsets])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(words.counts.astype(np.int64)),
                        pa.array((words.counts - n_kept).astype(np.int64)),
                        _joined(words, kept, n_kept),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return rows


def _joined(words: W.Words, kept: np.ndarray, n_kept: np.ndarray) -> pa.Array:
    """The kept words of every text joined by one space."""
    lengths = (words.ends - words.starts)[kept] + 1  # and a space
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    source = np.arange(total) + np.repeat(words.starts[kept] - (ends - lengths), lengths)
    out = np.full(total, 0x20, dtype=np.uint8)
    inside = np.ones(total, dtype=bool)
    inside[ends - 1] = False
    out[inside] = words.data[source[inside]]
    # The space after the last word of a text goes.
    last = np.cumsum(n_kept)
    stop = np.concatenate([[0], ends])[last]
    drop = stop[n_kept > 0] - 1
    whole = np.ones(total, dtype=bool)
    whole[drop] = False
    offsets = np.concatenate([[0], stop - np.cumsum(n_kept > 0)]).astype(np.int32)
    return pa.Array.from_buffers(
        pa.string(), len(n_kept), [None, pa.py_buffer(offsets), pa.py_buffer(out[whole])]
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, core: int = CORE) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the text that is left, words joined
    by one space) for every row of ``docs``.

    Only ``doc_id`` and ``text`` are read.  Texts that are null or have no
    words give 0, 0 and ''.  A repeated row is judged like the first one;
    windows of one document never remove each other.  A row without a
    ``doc_id`` keeps all its words and removes none of others'.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found = stage(
        docs.filter(F.col("doc_id").isNotNull()).mapInArrow(
            _core_rows(window, core), "doc_id long, core long, passage long"
        ),
        "cores",
    )
    recurring = stage(
        found.groupBy("core")
        .agg(
            F.min("doc_id").alias("first"),
            F.max("doc_id").alias("last"),
            (F.min("passage") != F.max("passage")).alias("open"),
        )
        .filter("first < last"),
        "recurring_cores",
    )
    lists = stage(
        found.join(recurring, "core")
        .filter("open OR doc_id > first")
        .groupBy("doc_id")
        .agg(
            F.collect_set(F.when(F.col("open"), F.col("core"))).alias("open"),
            F.collect_set(F.when(~F.col("open"), F.col("core"))).alias("closed"),
        ),
        "core_lists",
    )
    windows = stage(
        docs.join(lists.filter(F.size("open") > 0).select("doc_id", "open"), "doc_id").mapInArrow(
            _window_rows(window, core), "doc_id long, high long, low long"
        ),
        "windows",
    )
    first = stage(
        windows.groupBy("high", "low")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last")
        .drop("last"),
        "recurring_windows",
    )
    later = (
        windows.join(first, ["high", "low"])
        .filter("doc_id > first")
        .groupBy("doc_id")
        .agg(F.collect_set("high").alias("windows"))
    )
    marks = lists.select("doc_id", "closed").join(later, "doc_id", "left")
    return docs.join(marks, "doc_id", "left").mapInArrow(
        _kept_rows(window, core), "doc_id long, n_words long, n_removed long, kept string"
    )
