"""Tab-separated files with a header.

Texts with line breaks inside quotes make it impossible to tell from a line
alone whether a record begins there.  ``scan_tsv`` still reads a large file in
many tasks.  A block (what one task reads of a file) is a state machine with
two states, outside of quotes and inside:

1. every block tells in which state it ends for either state it may start in;
2. these maps are combined along each file, which gives the state every block
   starts in (one row per block, no text);
3. every block is cut into records from its true first boundary; what lies
   before it, and the record still open at the end, are pieces of records that
   cross blocks, and are put together by file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An empty field is NULL and "" is the empty string.  The reader cannot tell
# them apart by itself, so quoted emptiness is read as this mark and put back.
_EMPTY = "\u0001empty\u0001"

# Pieces of records that cross blocks: the end of one, all of a block, the
# beginning of one.
_HEAD, _MIDDLE, _TAIL = 0, 1, 2


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is still open at the end of ``line``, if one was
    (``inside``) or wasn't at its start.  A field is quoted if it starts with a
    quote; a doubled quote in it stands for one."""
    at = 0
    if not inside:
        if line.startswith('"'):
            at = 1
        else:
            at = line.find('\t"') + 2
            if at == 1:
                return False
    while True:
        while True:
            quote = line.find('"', at)
            if quote < 0:
                return True
            at = quote + 1
            if not line.startswith('"', at):
                break
            at += 1
        field = line.find('\t"', at)
        if field < 0:
            return False
        at = field + 2


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one block after the other."""
    keys = batch.column("key").to_numpy()
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield int(keys[a]), batch.slice(a, b - a)


def _quoted(lines: pa.RecordBatch) -> list[int]:
    return np.flatnonzero(pc.match_substring(lines.column("value"), '"').to_numpy(zero_copy_only=False)).tolist()


def _block_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State at the end of each block for either state at its start, from its
    lines with quotes.  A task reads its blocks one after the other."""
    key, states = None, (False, True)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key], pa.int64()), *(pa.array([s]) for s in states)], names=["key", "from_out", "from_in"]
        )

    for batch in batches:
        for own, lines in _runs(batch):
            if own != key:
                if key is not None:
                    yield row()
                key, states = own, (False, True)
            for line in lines.column("value").to_pylist():
                states = tuple(ends_inside(line, state) for state in states)
    if key is not None:
        yield row()


def _starting_inside(lines: DataFrame) -> DataFrame:
    """``key`` of the blocks that start inside of quotes."""
    maps = (
        lines.filter(F.contains("value", F.lit('"')))
        .select("key", "value")
        .mapInArrow(_block_maps, "key long, from_out boolean, from_in boolean")
    )
    blocks = lines.select("key", "file", "block").distinct().join(maps, "key", "left")
    # A block can set the state, turn it round or (without quotes) leave it.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce((F.col("from_out") & ~F.col("from_in")).cast("int"), F.lit(0))
    sets = F.when(F.col("from_out") == F.col("from_in"), F.struct("from_out", "turned"))
    turned = blocks.withColumn("turned", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    state = turned.withColumn("last", F.last(sets, ignorenulls=True).over(before)).select(
        "key",
        F.coalesce(F.col("last.from_out").cast("int"), F.lit(0)).alias("state"),
        (F.col("turned") - F.coalesce("last.turned", F.lit(0))).alias("since"),
    )
    return state.filter((F.col("state") + F.col("since")) % 2 == 1).select("key")


def _records(inside, carried: Sequence[str], header: bool, pieces: bool):
    """Cut lines into records.  Returned are whole records, or (``pieces``) the
    parts of those that cross blocks; not the record a file begins with, if
    that is its header (a part of it is marked)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = inside.value
        # The open record: its lines here, which part of it they are, whether
        # it is the header.
        key, held, part, heading, values = None, None, _TAIL, False, {}

        def batch_of(texts: pa.Array, kind: int | None = None, marked: bool = False) -> pa.RecordBatch:
            n = len(texts)
            fixed = [pa.repeat(v, n) for v in values.values()]
            return pa.RecordBatch.from_arrays(
                [texts, *fixed, pa.repeat(pa.scalar(kind, pa.int32()), n), pa.repeat(marked, n)],
                names=["value", *values, "part", "heading"],
            )

        def left_open() -> Iterator[pa.RecordBatch]:
            if held is not None and pieces:
                yield batch_of(pa.array(["\n".join(held)], pa.string()), _MIDDLE if part == _HEAD else part, heading)

        for batch in batches:
            for own, lines in _runs(batch):
                value, fresh = lines.column("value"), own != key
                if fresh:
                    yield from left_open()
                    key, heading = own, False
                    at = int(np.searchsorted(known, own))
                    held, part = ([], _HEAD) if at < len(known) and known[at] == own else (None, _TAIL)
                    values = {c: lines.column(c)[0] for c in carried}
                top = fresh and header and values["block"].as_py() == 0
                whole, joined, at = np.zeros(len(lines), dtype=bool), [], 0
                for i in _quoted(lines):
                    # Lines without quotes are records or belong to the open one.
                    if held is None:
                        whole[at:i] = True
                    else:
                        held += value.slice(at, i - at).to_pylist()
                    at, line = i + 1, value[i].as_py()
                    if not ends_inside(line, held is not None):
                        if held is None:
                            whole[i] = True
                            continue
                        text = "\n".join([*held, line])
                        if part == _TAIL and not heading:
                            joined.append(text)
                        elif part == _HEAD and pieces:
                            yield batch_of(pa.array([text], pa.string()), _HEAD)
                        held, heading = None, False
                    elif held is None:
                        held, part, heading = [line], _TAIL, top and i == 0
                    else:
                        held.append(line)
                if held is None:
                    whole[at:] = True
                else:
                    held += value.slice(at).to_pylist()
                if top:
                    whole[0] = False
                if not pieces:
                    yield batch_of(value.filter(pa.array(whole)))
                    yield batch_of(pa.array(joined, pa.string()))
        yield from left_open()

    return rows


def _record_lines(spark: SparkSession, path: str | list[str], schema: T.StructType, header: bool) -> tuple[DataFrame, list]:
    """``value``, one record per row, and the columns of partition folders;
    and the names of these."""
    levels = [c for c in spark.read.text(path).columns if c != "value"]
    fields = [schema[c] if c in schema.names else T.StructField(c, T.StringType()) for c in levels]
    kind = T.StructType([T.StructField("value", T.StringType()), *fields])
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = (
        spark.read.schema(kind)
        .option("lineSep", "\n")
        .text(path)
        .select(F.xxhash64(file, block).alias("key"), file.alias("file"), block.alias("block"), "value", *levels)
    )
    # 8 bytes per block that starts inside of quotes.
    found = _starting_inside(lines).toArrow().column("key").to_numpy()
    inside = spark.sparkContext.broadcast(np.sort(found))
    carried = ["file", "block", *levels]
    out = T.StructType(
        [
            kind["value"],
            T.StructField("file", T.StringType()),
            T.StructField("block", T.LongType()),
            *fields,
            T.StructField("part", T.IntegerType()),
            T.StructField("heading", T.BooleanType()),
        ]
    )
    records = lines.mapInArrow(_records(inside, carried, header, False), out).select("value", *levels)
    pieces = lines.mapInArrow(_records(inside, carried, header, True), out)
    # A piece that opens a record is followed by the others of it.
    along = Window.partitionBy("file").orderBy("block", "part")
    number = F.sum((F.col("part") == _TAIL).cast("int")).over(along)
    piece = F.struct("block", "part", "value")
    crossing = (
        pieces.withColumn("number", number)
        .groupBy("file", "number", *levels)
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["value"]), "\n").alias("value"),
            F.bool_or("heading").alias("heading"),
        )
        .filter(~F.col("heading"))
        .select("value", *levels)
    )
    return records.union(crossing), levels


def scan_tsv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    *,
    multi_line: bool = False,
) -> DataFrame:
    """Read UTF-8 files with an explicit schema.  Large files are split over
    tasks; texts with line breaks inside quotes need ``multi_line``.

    With ``multi_line`` lines end in ``\\n`` or ``\\r\\n``.  The files are read
    three times, twice of it through Python; empty lines are left out, and a
    quoted text that is never closed runs to the end of its file.  Missing
    fields are NULL, surplus ones are dropped.
    """
    path = path if isinstance(path, str) else list(path)
    options = {"sep": "\t", "escape": '"', "multiLine": str(multi_line).lower(), "emptyValue": _EMPTY}
    if multi_line:
        records, levels = _record_lines(spark, path, schema, True)
        fields = [f for f in schema.fields if f.name not in levels]
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        record = F.regexp_replace("value", r"\r\z", "")
        parsed = records.filter(record != "").select(F.from_csv(record, kind, options).alias("__row"), *levels)
        table = parsed.select(*(F.col(f"__row.`{f.name}`").alias(f.name) for f in fields), *levels)
    else:
        table = spark.read.options(header=True, **options).schema(schema).csv(path)
    text = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)}
    return table.select(
        *(
            F.when(F.col(f"`{c}`") == _EMPTY, F.lit("")).otherwise(F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`")
            for c in table.columns
        )
    )


def sink_tsv(
    df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """Write with header; with ``partition_by`` one directory per group, of
    which an overwrite replaces only those present in ``df``."""
    writer = df.write.mode(mode).options(
        sep="\t",
        header=True,
        escape='"',
        emptyValue='""',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.csv(path)
