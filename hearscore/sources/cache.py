"""The hypothesis cache: JSON lines ``{audio path: {version: {…}}}``."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearscore.operators.joins import latest_hypotheses
from hearscore.schema import CACHE, CACHE_LINE, CACHE_VALUE

# Order of lines: later files after earlier ones; a text scan splits a file into
# blocks, and rows of one block are numbered in order.
LINE_ORDER = ["hyp_gen_date", "__written", "__block", "__line"]

# A file or, as the sink writes it, a folder of files.
_NAME = r"([^/]+)/([^/]+)\.asr_cache\.jsonl[^/]*(?:/[^/]*)?$"


def _file_name_part(number: int) -> Column:
    """Dataset or codename from the address of a file.  Addresses are
    percent-encoded, names of partition folders twice."""

    def decoded(part: Column) -> Column:
        return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))

    once = decoded(F.regexp_extract("_metadata.file_path", _NAME, number))
    key = ("dataset=", "file=")[number - 1]
    return F.when(F.startswith(once, F.lit(key)), decoded(F.substring(once, len(key) + 1, 1 << 20))).otherwise(once)


def flatten_cache_lines(
    lines: DataFrame, value: Column | str = "value", *, strict: bool = True
) -> DataFrame:
    """Explode JSON lines to one row per path and version, next to the other
    columns of ``lines``.  A broken line is an error, or skipped if not
    ``strict``."""
    parsed = F.from_json(
        F.col(value) if isinstance(value, str) else value,
        CACHE_LINE,
        {"mode": "FAILFAST" if strict else "PERMISSIVE"},
    )
    others = [c for c in lines.columns if c != value]
    paths = lines.select(*others, F.explode(parsed).alias("audio_path", "__versions"))
    versions = paths.select(*others, "audio_path", F.explode("__versions").alias("__v", "__e"))
    fields = [c for c in CACHE_VALUE.names if c not in ("version", "codename", *others)]
    codename = F.col("codename") if "codename" in others else F.col("__e.codename")
    return versions.select(
        *(c for c in others if c != "codename"),
        codename.alias("codename"),
        "audio_path",
        F.col("__v").alias("version"),
        *(F.col(f"__e.{c}").alias(c) for c in fields),
    )


def _cache_text(spark: SparkSession, path: str | list[str], dataset: str | None, codename: str | None) -> DataFrame:
    """Lines of the cache with ``dataset, codename``.  What the sink has
    written has these in its folders, so that files are chosen before any is
    read.  Of other files, those of ``codename`` are chosen by name and those of
    ``dataset`` by their lines' origin.  Filters that come later choose none: they
    don't pass the numbering of the lines."""
    name = F.lit(True) if dataset is None else F.col("dataset") == dataset
    plain = spark.read.text(path).columns
    if {"dataset", "file"} <= set(plain):
        # Named as text, or a dataset called 007 would become a number.
        lines = spark.read.schema(", ".join(f"`{c}` string" for c in plain)).text(path).filter(name)
        if codename is not None:
            lines = lines.filter(F.startswith("file", F.lit(f"{codename}.asr_cache.jsonl")))
        own = F.regexp_extract("file", r"^(.*)\.asr_cache\.jsonl", 1).alias("codename")
        return lines.select("value", "dataset", own, *_order_columns())
    reader = spark.read.option("recursiveFileLookup", True)
    if codename is not None:
        literal = re.sub(r"([\\*?{}\[\]])", r"\\\1", codename)
        reader = reader.option("pathGlobFilter", f"{literal}.asr_cache.jsonl*")
    parts = _file_name_part(1).alias("dataset"), _file_name_part(2).alias("codename")
    return reader.text(path).select("value", *parts, *_order_columns()).filter(name)


def _order_columns() -> list[Column]:
    return [
        F.col("_metadata.file_modification_time").alias("__written"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"),
    ]


def scan_hyp_cache(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    dataset: str | None = None,
    codename: str | None = None,
    strict: bool = True,
    latest: bool = True,
) -> DataFrame:
    """Read cache files ``<dataset>/<codename>.asr_cache.jsonl``, or what
    ``sink_hyp_cache`` has written; by default the last line of a key wins.

    ``dataset`` and ``codename`` read one of each, without the others' files
    where the layout allows."""
    lines = _cache_text(spark, path if isinstance(path, str) else list(path), dataset, codename)
    rows = flatten_cache_lines(lines, strict=strict)
    if latest:
        rows = latest_hypotheses(rows, LINE_ORDER)
    return rows.select(*CACHE.names)


def store_cache_table(cache: DataFrame, name: str, *, buckets: int, path: str | None = None) -> DataFrame:
    """Keep the cache as a table in columns: one folder per dataset and
    codename, bucketed and sorted by path, the last write per key.

    Reading one model reads its folder only, and joins by path
    (``attach_planned_hypotheses(…, bucketed=True)``) neither shuffle nor sort
    the table.  ``path`` puts its files elsewhere than in the warehouse.
    """
    rows = latest_hypotheses(cache.select(*CACHE.names), ["hyp_gen_date"])
    writer = (
        rows.repartition(buckets, "audio_path")  # one file per bucket and folder
        .write.mode("overwrite")
        .partitionBy("dataset", "codename")
        .bucketBy(buckets, "audio_path")
        .sortBy("audio_path")
    )
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return cache.sparkSession.table(name).select(*CACHE.names)


def cache_line(all_versions: Column | str = "versions") -> Column:
    """JSON line of one path from its ``map<version, value>``."""
    versions = F.col(all_versions) if isinstance(all_versions, str) else all_versions
    return F.to_json(F.create_map(F.col("audio_path"), versions))


def cache_lines(cache: DataFrame) -> DataFrame:
    """``dataset, codename, value``: one JSON line per path.  A path has as
    many entries as it has versions, which is a handful: of repeated writes
    only the last one is taken along."""
    cache = latest_hypotheses(cache.select(*CACHE.names), ["hyp_gen_date"])
    value = F.struct(*(F.col(c).alias(c) for c in CACHE_VALUE.names))
    entries = F.array_sort(F.collect_list(F.struct(F.col("version").alias("k"), value.alias("v"))))
    return (
        cache.groupBy("dataset", "codename", "audio_path")
        .agg(F.map_from_entries(entries).alias("versions"))
        .select("dataset", "codename", cache_line().alias("value"))
    )


def stored_hyp_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path``; empty if nothing has been written yet."""
    try:
        return scan_hyp_cache(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def sink_hyp_cache(cache: DataFrame, path: str, *, append: bool = False) -> None:
    """Write the lines, one directory per dataset and codename; the cost
    fields that are NULL are left out, non-ASCII text is kept.  ``append``
    adds files to what is there; of a key, the last one written is read."""
    lines = cache_lines(cache)
    named = lines.select(
        "value", "dataset", F.concat("codename", F.lit(".asr_cache.jsonl")).alias("file")
    )
    named.write.mode("append" if append else "overwrite").partitionBy("dataset", "file").text(path)
