"""Token ids packed into rows of a fixed length.

Documents become segments: one each, or as many as a long one needs, without
loss.  Segments are dealt to shards of bounded size by hash; each shard is
packed by best fit, largest first, where a segment tree over capacities finds
the fullest row that still has room.  A packed row holds its ids, the
cumulative lengths of its segments, and where positions start anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearscore.llm import pieces
from hearscore.llm import words as W
from hearscore.session import stage

LENGTH = 2048
# Tokens of a shard, about.
SHARD = 1 << 20

_SCHEMA = (
    "shard long, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<long>, parts array<int>"
)


class Capacities:
    """Open rows by the room they have left: a segment tree whose leaves are
    amounts of room, each node true if any row below it is open."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.open = bytearray(2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.base
        while at and not self.open[at]:
            self.open[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``need``."""
        at = need + self.base
        if not self.open[at]:
            while at > 1 and (at & 1 or not self.open[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if self.open[2 * at] else 2 * at + 1
        room = at - self.base
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.open[at] = 0
            at >>= 1
            while at and not (self.open[2 * at] or self.open[2 * at + 1]):
                self.open[at] = 0
                at >>= 1
        return room, row


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of item numbers; ``sizes`` fall and are 1 to ``length``."""
    left, rows = Capacities(length), []
    for item, size in enumerate(sizes):
        found = left.take(size) if size < length else None
        room, row = found or (length, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(item)
        if room > size:
            left.put(room - size, row)
    return rows


def _segment_rows(model, length: int, end: int | None, width: np.dtype):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", W.SLICE_BYTES // 2):
                ids, offsets = pieces.codec(model.value).encode(part.column("text"))
                if end is not None:
                    full = np.flatnonzero(np.diff(offsets))
                    ids = np.insert(ids, offsets[full + 1], end)
                    offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
                counts = -(-np.diff(offsets) // length)
                doc = np.repeat(np.arange(len(part)), counts)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = offsets[doc] + number * length
                stop = np.minimum(start + length, offsets[doc + 1])
                data = ids.astype(width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc)),
                        pa.array(number.astype(np.int32)),
                        pa.array((stop - start).astype(np.int32)),
                        pa.array([data[a:b].tobytes() for a, b in zip(start, stop)], pa.binary()),
                    ],
                    names=["doc_id", "part", "n", "ids"],
                )

    return rows


def _pack(length: int, width: np.dtype, pad: int):
    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "descending"), ("doc_id", "ascending"), ("part", "ascending"), ("ids", "ascending")])
        n, ids = table.column("n").to_pylist(), table.column("ids").to_pylist()
        docs, parts = table.column("doc_id").to_pylist(), table.column("part").to_pylist()
        number = table.column("shard")[0].as_py()
        out = []
        filler = np.array([pad], dtype=width).tobytes()
        for row, items in enumerate(best_fit(n, length)):
            ends = np.cumsum([n[i] for i in items]).tolist()
            data = b"".join(ids[i] for i in items) + filler * (length - ends[-1])
            out.append(
                {
                    "shard": number, "row": row, "n_tokens": ends[-1], "ids": data, "cu_seqlens": [0, *ends],
                    "position_resets": [0, *ends[:-1]], "doc_ids": [docs[i] for i in items], "parts": [parts[i] for i in items],
                }
            )
        return pa.Table.from_pylist(out, schema=_ARROW)

    return shard


_ARROW = pa.schema(
    [
        ("shard", pa.int64()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())),
    ]
)


def id_width(model: bytes) -> np.dtype:
    """Two bytes little-endian, or four for a large vocabulary."""
    return np.dtype("<u2" if len(pieces.parse(model).pieces) <= 1 << 16 else "<u4")


def pack(
    docs: DataFrame, model: bytes, length: int = LENGTH, end: int | None = 2, pad: int = 0, shard: int = SHARD
) -> DataFrame:
    """Packed rows of the texts of ``docs``: ``shard, row, n_tokens, ids``
    (``length`` ids, those from ``n_tokens`` on are ``pad``; little-endian, see
    ``id_width``), ``cu_seqlens``, ``position_resets``, ``doc_ids`` and
    ``parts`` of its segments.

    ``end`` is appended to every document that has ids.  A document longer
    than a row is cut into parts 0, 1, …, each of ``length`` ids but the last.
    A null or empty text has no ids and no segment; a repeated row is packed
    as often as it occurs.  The result is the same however the input is
    partitioned.
    """
    width = id_width(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    segments = stage(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            _segment_rows(shared, length, end, width), "doc_id long, part int, n int, ids binary"
        ),
        "segments",
    )
    total = segments.agg(F.sum("n")).first()[0] or 0
    shards = -(-total // shard) or 1
    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part", "ids"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack(length, width, pad), _SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet, a folder per shard, rows in order."""
    packed.repartition("shard").sortWithinPartitions("shard", "row").write.partitionBy("shard").parquet(path)
