"""Stored stages and reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearscore.session import stage


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def materialize(
    spark: SparkSession,
    path: str,
    compute: Callable[[], DataFrame],
    *,
    force: bool = False,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Table at ``path``; computed and written when absent or ``force``."""
    if not force:
        found = stored(spark, path)
        if found is not None:
            return found
    writer = compute().write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)


def fingerprints(rows: DataFrame, keys: Sequence[str], name: str = "mark") -> DataFrame:
    """``keys`` and a text that stands for all rows of a group.

    Rows are hashed and the hashes summed, so neither their order nor that of
    the columns matters, but how often a row occurs does.  Sums are combined
    before the shuffle: a group is one row of it per task.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    values = [
        F.to_json(c) if isinstance(kinds[c], T.MapType) else F.col(c) for c in sorted(kinds) if c not in keys
    ]
    # A null and an absent hash input are alike, so what is null counts as well.
    nulls = [F.isnull(c) for c in sorted(kinds) if c not in keys]

    def total(salt: int) -> Column:
        return F.sum(F.xxhash64(F.lit(salt), *values, *nulls).cast("decimal(20,0)")).cast("string")

    return rows.groupBy(*keys).agg(F.concat_ws("/", F.count("*"), total(1), total(2)).alias(name))


def _same_keys(one: DataFrame, two: DataFrame, keys: Sequence[str]) -> list[Column]:
    return [one[k].eqNullSafe(two[k]) for k in keys]


def _last_runs(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    """``keys, run, schema, mark`` of the groups that are done, each as its last
    run left it."""
    done = stored(spark, f"{path}.groups")
    if done is None:
        return None
    done = spark.read.option("mergeSchema", True).parquet(f"{path}.groups")
    if "mark" not in done.columns:
        done = done.withColumn("mark", F.lit(None).cast("string"))
    last = F.max(F.struct("done", "run", "schema", "mark")).alias("last")
    return done.groupBy(*keys).agg(last).select(*keys, "last.run", "last.schema", "last.mark")


def materialize_groups(
    spark: SparkSession,
    path: str,
    wanted: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    *,
    marks: DataFrame | None = None,
    parameters: object = None,
    force: bool = False,
    rebalance: bool = False,
) -> DataFrame:
    """The same per group: only groups of ``wanted`` (a table of ``keys``)
    that are not done yet are computed and written.

    ``marks`` (``keys, mark``, as ``fingerprints`` makes them of what goes into
    a group) and ``parameters`` tell whether a stored group is still right: one
    whose mark or parameters have changed is computed again.  Without them
    what is stored counts as right.

    Beside the rows, ``<path>.groups`` lists which groups are done, groups
    without rows included, and in which run: a forced group is written by a
    new run, and rows of earlier runs are no longer read.  Keys keep the types
    they have in ``wanted`` and in the computed table.

    ``rebalance`` gathers the rows of a group before they are written, for
    results that come in no order: few files per directory, and a large
    group is still split over several tasks.
    """
    asked = wanted.select(*keys).distinct()
    given = F.lit(None if parameters is None else json.dumps(parameters, sort_keys=True, default=str)).cast("string")
    own = F.lit(None).cast("string")
    if marks is not None:
        marks = marks.select(*keys, "mark")
        asked = asked.join(marks, _same_keys(asked, marks, keys), "left").select(*(asked[k] for k in keys), marks["mark"])
        own = F.coalesce("mark", F.lit(""))
    # Null if there is neither, which is also what older lists say.
    mark = F.when(own.isNotNull() | given.isNotNull(), F.sha2(F.concat_ws("|", own, given), 256))
    asked = stage(asked.select(*keys, mark.alias("mark")), "groups")
    groups, done = asked, _last_runs(spark, path, keys)
    first = done is None
    if not first and not force:
        same = [*_same_keys(asked, done, keys), asked["mark"].eqNullSafe(done["mark"])]
        groups = asked.join(done, same, "left_anti")
    if first or not groups.isEmpty():
        run = uuid.uuid4().hex
        groups = stage(groups, "groups_to_do")
        table = compute(groups.select(*keys))
        # The run is the folder above those of the keys, so that a run that
        # is cut short leaves nothing that would be read.
        (table.hint("rebalance", *keys) if rebalance else table).write.partitionBy(*keys).parquet(f"{path}/run={run}")
        (
            groups.select(*keys, F.lit(run).alias("run"), F.lit(table.schema.json()).alias("schema"), "mark")
            .withColumn("done", F.current_timestamp())
            .coalesce(1)  # one row per group
            .write.mode("append")
            .parquet(f"{path}.groups")
        )
    last = _last_runs(spark, path, keys)
    current = last.join(asked, _same_keys(last, asked, keys), "left_semi")
    schema = T.StructType.fromJson(json.loads(current.agg(F.max_by("schema", "run")).first()[0]))
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("run", T.StringType())])).parquet(path)
    names = {k: f"__{k}" for k in keys}
    current = current.select(*(F.col(k).alias(n) for k, n in names.items()), F.col("run").alias("__run"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], F.col("run") == F.col("__run"))
    return rows.join(current, same, "left_semi").drop("run")


def drop_old_runs(spark: SparkSession, path: str, keys: Sequence[str]) -> int:
    """Delete the runs below ``path`` that no group is read from any more, and
    those that were cut short; how many they were.  Nobody may be writing
    there, or reading what was returned before the last run."""
    last = _last_runs(spark, path, keys)
    needed = set() if last is None else {r.run for r in last.select("run").distinct().collect()}
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run=*")) or []
    old = [f.getPath() for f in found if f.getPath().getName().removeprefix("run=") not in needed]
    for place in old:
        files.delete(place, True)
    return len(old)


def run_date() -> str:
    """UTC day of a run, as output names carry it."""
    return datetime.now(tz=UTC).strftime("%Y%m%d")


def dated_path(base: str, name: str, day: str | None = None) -> str:
    return f"{base.rstrip('/')}/{name}_{day or run_date()}"


def statistics_json(splits: DataFrame, datasets: DataFrame) -> DataFrame:
    """``dataset, file, value``: the JSON document of every dataset.

    A document lists the splits of one dataset, as many as its configuration
    names.  Input is rounded split and dataset statistics.
    """

    def spread(name: str):
        fields = [F.col(f"{name}_{f}").alias(f) for f in ("mean", "std", "min", "max")]
        return F.struct(*fields).alias(f"{name}_stats")

    entry = F.struct(
        "audio_hours", spread("audio_duration"), spread("transcript_length"), "sample_count"
    )
    per_split = splits.groupBy("dataset").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col("split_key"), entry.alias("stats"))))
        ).alias("split_stats")
    )
    document = F.struct(
        F.col("dataset").alias("dataset_name"),
        "total_audio_hours",
        spread("audio_duration"),
        spread("transcript_length"),
        "split_stats",
    )
    return datasets.join(per_split, "dataset").select(
        "dataset",
        F.concat(F.replace("dataset", F.lit("/"), F.lit("_")), F.lit("_statistics")).alias("file"),
        F.to_json(document).alias("value"),
    )


def combined_json(documents: DataFrame, grand: DataFrame) -> DataFrame:
    """One JSON document over all datasets (there are as many as configured)."""
    quoted = F.to_json(F.array("dataset"))
    name = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    summary = grand.select(F.to_json(F.struct("total_datasets", "total_audio_hours"))).scalar()
    members = documents.select(F.concat(name, F.lit(":"), F.col("value")).alias("member"))
    joined = F.array_join(F.array_sort(F.collect_list("member")), ",")
    return members.agg(joined.alias("all")).select(
        F.concat(
            F.lit('{"datasets":{'), F.col("all"), F.lit('},"summary":'), summary, F.lit("}")
        ).alias("value")
    )


def save_statistics(
    spark: SparkSession,
    path: str,
    splits: DataFrame,
    datasets: DataFrame,
    grand: DataFrame,
    *,
    force: bool = False,
) -> None:
    """Write ``<path>/file=<dataset>_statistics`` per dataset (kept if it is
    there, unless ``force``) and ``<path>/file=combined_statistics``, which is
    always renewed."""
    documents = statistics_json(splits, datasets)
    fresh = documents.select("value", "file")
    if not force:
        try:
            there = spark.read.text(path).select(F.col("file").cast("string")).distinct()
            fresh = fresh.join(there, "file", "left_anti").select("value", "file")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNRESOLVED_COLUMN.WITH_SUGGESTION"):
                raise
    combined = combined_json(documents, grand).withColumn("file", F.lit("combined_statistics"))
    (
        fresh.unionByName(combined)
        .repartition("file")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("file")
        .text(path)
    )
