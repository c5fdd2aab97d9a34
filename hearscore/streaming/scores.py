"""Statistics, scores and the hypothesis cache over streams."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearscore.functions import rates
from hearscore.operators.corpus_stats import split_moments
from hearscore.operators.joins import latest_hypotheses
from hearscore.operators.scoring import RUN_KEYS, by_normalisation, count_column, score_clips
from hearscore.schema import CACHE_KEY


# Segments of a level that are merged, and earlier manifests that stay readable.
_FAN = 8
_MANIFESTS_KEPT = 2
_LOG_ORDER = ["hyp_gen_date", "seq", "batch"]

# Results of earlier batches that stay for who is still reading them.
_RESULTS_KEPT = 3


def _batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id:012d}"


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches below ``path`` that are complete."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _run(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    output_mode: str,
    available_now: bool,
) -> StreamingQuery:
    writer = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_statistics(
    samples: DataFrame,
    path: str,
    checkpoint: str,
    *,
    available_now: bool = True,
    **options,
) -> StreamingQuery:
    """Keep the moments of every split of a stream of samples up to date.

    State is one row per split.  Each batch writes the whole (small) result
    under its own number, so a repeated batch replaces itself; read it with
    ``latest_batch``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(path, batch_id))

    return _run(split_moments(samples, **options), write, checkpoint, "complete", available_now)


def _last_writes(rows: DataFrame, clip: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """Of each clip the write that ``rank`` puts last."""
    rest = [c for c in rows.columns if c not in clip and c not in rank]
    last = F.max(F.struct(*rank, *rest)).alias("__last")
    return rows.groupBy(*clip).agg(last).select(*clip, *(F.col(f"__last.{c}").alias(c) for c in (*rank, *rest)))


def _changes(
    arrived: DataFrame, known: DataFrame | None, clip: Sequence[str], rank: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """What the writes that have arrived change: for their clips, the counts of
    the last write less those of the last write known before."""
    rows = arrived.withColumn("__new", F.lit(True))
    if known is not None:
        asked = arrived.select(*(F.col(c).alias(f"__asked_{c}") for c in clip))
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__asked_{c}")) for c in clip))
        rows = rows.unionByName(known.join(asked, same, "left_semi").withColumn("__new", F.lit(False)))
    write = F.struct(*rank, *values)
    both = rows.groupBy(*clip).agg(F.max(write).alias("__last"), F.max(F.when(~F.col("__new"), write)).alias("__old"))

    def change(kind: Callable[[Column], Column], value: str) -> Column:
        return kind(F.col(f"__last.{value}")) - kind(F.col(f"__old.{value}"))

    count = partial(change, lambda c: F.coalesce(c, F.lit(0).cast("long")))
    counted = partial(change, lambda c: c.isNotNull().cast("long"))
    return both.select(*clip, *(count(v).alias(v) for v in values), *(counted(v).alias(f"{v}__rows") for v in values))


def stream_scores(
    eval_input: DataFrame,
    path: str,
    checkpoint: str,
    norm_types: Sequence[str],
    metrics: Sequence[str],
    *,
    keys: Sequence[str] = RUN_KEYS,
    order: Sequence[str] = (),
    tasks: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Score arriving pairs and keep the pooled counts of every group up to
    date.  ``tasks`` spreads batches that arrive in few files.

    A clip (``keys`` and ``sample_idx``) counts once, with its last write:
    ``order`` names the columns that rank writes, as in ``latest_hypotheses``
    (of equal ranks, and without ``order``, what arrives later counts).  A write
    that can't be scored takes an earlier one out.

    Ranks and counts of the writes are kept in a log of segments below
    ``checkpoint`` (``_append_log``), and a batch is compared with those of
    its clips: an aggregate over both, with no Python and no state in memory.
    A batch reads these columns of the log once.

    Each batch adds its changes to the result of the one before and writes it
    under its own number, so a repeated batch replaces itself; read it with
    ``latest_batch``.  Only the last few results are kept.
    """
    wanted = rates.needed_counts(rates.resolve_metrics(metrics))
    values = [count_column(n, c) for n in norm_types for c in wanted]
    clip, rank = [*keys, "sample_idx"], [*order, "__batch", "__at"]
    clips = score_clips(eval_input, norm_types, metrics, tasks=tasks, keep_invalid=True)
    clips = clips.select(*clip, *order, *(F.col(v).cast("long").alias(v) for v in values))
    sums = [F.sum(c).alias(c) for c in ("sample_count", *wanted)]
    log = f"{checkpoint.rstrip('/')}/clips"

    def write(batch: DataFrame, batch_id: int) -> None:
        def settle(arrived: DataFrame, known: DataFrame | None) -> None:
            spark = arrived.sparkSession
            if known is None and batch_id > 0:
                raise RuntimeError(f"{checkpoint} has earlier batches, but no log of their clips")
            changes = _changes(arrived, known, clip, rank, values)
            # Each normalisation has as many values; the first one tells if it counted.
            rows = {count_column(n, "rows"): f"{count_column(n, wanted[0])}__rows" for n in norm_types}
            pooled = changes.groupBy(*keys).agg(
                *(F.sum(v).alias(v) for v in values), *(F.sum(c).alias(made) for made, c in rows.items())
            )
            total = by_normalisation(pooled, norm_types, wanted, keys)
            before = [n for n in _batches(spark, path) if n < batch_id]
            if before:
                total = total.unionByName(spark.read.parquet(_batch_path(path, before[-1])))
            total = total.groupBy(*keys, "norm_type").agg(*sums).filter(F.col("sample_count") > 0)
            # A few rows, one per group and normalisation.
            total.coalesce(1).write.mode("overwrite").parquet(_batch_path(path, batch_id))
            for number in before[:-_RESULTS_KEPT]:
                _delete(spark, _batch_path(path, number))

        # Where a row stands once scored, for those of equal rank in one batch.
        placed = batch.withColumn("__at", F.monotonically_increasing_id())
        _append_log(placed, log, batch_id, "__batch", lambda rows: _last_writes(rows, clip, rank), settle)

    return _run(clips, write, checkpoint, "append", available_now)


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the last batch written below ``path``."""
    return spark.read.parquet(_batch_path(path, _batches(spark, path)[-1]))


def _files(spark: SparkSession, path: str):
    """(file system, function that makes a path of it)."""
    made = spark._jvm.org.apache.hadoop.fs.Path
    return made(path).getFileSystem(spark._jsc.hadoopConfiguration()), made


def _manifests(spark: SparkSession, path: str) -> list[str]:
    files, made = _files(spark, path)
    found = files.globStatus(made(f"{path}/manifest/*.json")) or []
    return sorted(f.getPath().toString() for f in found)


def _read_manifest(spark: SparkSession, name: str) -> dict:
    return json.loads(spark.read.text(name, wholetext=True).first().value)


def _commit_manifest(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """The manifest appears under its name whole or not at all."""
    files, made = _files(spark, path)
    draft, name = made(f"{path}/manifest/_{number}.draft"), made(f"{path}/manifest/{number:012d}.json")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if not files.rename(draft, name):
        raise RuntimeError(f"another writer has committed {name}")


def _append_log(
    batch: DataFrame,
    path: str,
    batch_id: int,
    number: str,
    latest: Callable[[DataFrame], DataFrame],
    settle: Callable[[DataFrame, DataFrame | None], None] | None = None,
) -> None:
    """Add the writes of one batch to the log at ``path``.

    The log is a list of segments, which the newest manifest names.  A segment
    has one row per key (``latest``, which ranks by the batch, column
    ``number``, last); as soon as ``_FAN`` segments of a level are there, they
    are merged to one of the next level.  So a log of n batches has about
    ``_FAN * log(n)`` segments, and a row is rewritten log(n) times.  The
    manifest is replaced after all segments it names are written: readers see
    the state before or after a batch, and one that has been committed already
    is left out when it is repeated.

    ``settle`` gets the new segment and the log before it (None if there is
    none), before the batch is committed: what it writes must replace what a
    run that was cut short has left.
    """
    spark = batch.sparkSession
    names = _manifests(spark, path)
    state = _read_manifest(spark, names[-1]) if names else {"batch": -1, "segments": []}
    if batch_id <= state["batch"]:
        return

    files, made = _files(spark, path)
    own = f"{path}/segments/{batch_id:012d}"
    for left in files.globStatus(made(f"{own}-*")) or []:  # by a run that was cut short
        files.delete(left.getPath(), True)

    def write(rows: DataFrame, level: int) -> dict:
        place = f"{own}-{level}-{uuid.uuid4().hex}"
        rows.write.parquet(place)
        return {"path": place, "level": level}

    def read(some: list[dict]) -> DataFrame:
        return spark.read.parquet(*(s["path"] for s in some))

    arrived = write(latest(batch.withColumn(number, F.lit(batch_id).cast("long"))), 0)
    if settle is not None:
        settle(read([arrived]), read(state["segments"]) if state["segments"] else None)
    segments = [*state["segments"], arrived]
    while len(segments) >= _FAN and len({s["level"] for s in segments[-_FAN:]}) == 1:
        level, merged = segments[-1]["level"] + 1, segments[-1]["path"]
        segments[-_FAN:] = [write(latest(read(segments[-_FAN:])), level)]
        files.delete(made(merged), True)  # of this batch: no manifest names it
    _commit_manifest(spark, path, batch_id, {"batch": batch_id, "segments": segments})

    # What only older manifests name goes, and those manifests.
    kept = [_read_manifest(spark, name) for name in names[-_MANIFESTS_KEPT:]]
    needed = {s["path"] for m in [*kept, {"segments": segments}] for s in m["segments"]}
    for name in names[:-_MANIFESTS_KEPT]:
        for segment in _read_manifest(spark, name)["segments"]:
            if segment["path"] not in needed:
                files.delete(made(segment["path"]), True)
        files.delete(made(name), True)


def append_cache_log(batch: DataFrame, path: str, batch_id: int) -> None:
    """Add the cache writes of one batch to the log at ``path`` (``_append_log``)."""
    _append_log(batch, path, batch_id, "batch", lambda rows: latest_hypotheses(rows, _LOG_ORDER))


def stream_cache_log(
    rows: DataFrame, path: str, checkpoint: str, *, available_now: bool = True
) -> StreamingQuery:
    """Append cache writes to a log (``append_cache_log``).  Of a key, the last
    write is kept (``seq`` ranks writes of one day)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_cache_log(batch, path, batch_id)

    return _run(rows, write, checkpoint, "append", available_now)


def read_cache_log(spark: SparkSession, path: str) -> DataFrame:
    """The cache as of the last batch: one row per key.  Only the segments of
    the newest manifest are opened."""
    state = _read_manifest(spark, _manifests(spark, path)[-1])
    log = spark.read.parquet(*(s["path"] for s in state["segments"]))
    return latest_hypotheses(log, _LOG_ORDER).drop("batch")


def compact_cache_log(spark: SparkSession, path: str, target: str) -> None:
    """Write the merged log as a new table, clustered by key for the join."""
    merged = read_cache_log(spark, path)
    merged.repartition(*CACHE_KEY).write.mode("overwrite").partitionBy(
        "dataset", "codename", "version"
    ).parquet(target)
