"""Joins of samples with hypotheses, metadata and files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearscore.functions.text import SENTINELS
from hearscore.schema import CACHE_KEY
from hearscore.session import stage

_RESOURCES = {
    "elapsed_time_seconds": "resources_gen_time_seconds",
    "peak_vram_bytes": "resources_peak_vram_bytes",
    "vram_diff_bytes": "resources_vram_diff_bytes",
}


def _path_key(path: str, row_key: str) -> Column:
    """Join key of a path.  Rows without a path can never match, but there
    may be very many of them: each gets a key of its own, so that they spread
    over the shuffle and do not meet in one task."""
    blank = F.col(path).isNull() | (F.col(path) == "")
    return F.when(blank, F.concat(F.lit("\u0000"), F.col(row_key).cast("string"))).otherwise(
        F.col(path)
    )


def attach_hypotheses(samples: DataFrame, cache: DataFrame) -> DataFrame:
    """Left join of planned samples (with ``codename`` and ``version``) to
    the cache on dataset, codename, version and path: the hypothesis and
    three cost columns, NULL where nothing is cached.

    ``cache`` must hold one row per key (``latest_hypotheses``).  A path that
    very many samples share is split by adaptive skew-join handling.
    """
    right = cache.select(
        F.col("dataset").alias("__dataset"),
        F.col("codename").alias("__codename"),
        F.col("version").alias("__version"),
        F.col("audio_path").alias("__path"),
        F.col("asr_hyp").alias("hypothesis"),
        *(F.col(c).alias(name) for c, name in _RESOURCES.items()),
    )
    return samples.join(
        right,
        (F.col("dataset") == F.col("__dataset"))
        & (F.col("codename") == F.col("__codename"))
        & (F.col("version") == F.col("__version"))
        & (_path_key("audio_path", "sample_idx") == F.col("__path")),
        "left",
    ).drop("__dataset", "__codename", "__version", "__path")


def attach_planned_hypotheses(
    samples: DataFrame, runs: DataFrame, cache: DataFrame, *, bucketed: bool = False
) -> DataFrame:
    """One row per sample and run of its split, with the same columns.

    The cache is gathered per path first, one entry per run, and looked up in
    after the join: each text is shuffled once, however many models are run.
    A path has as many entries as there are runs, for ``cache`` must hold one
    row per key (``latest_hypotheses``).  The entries are a stored table: both
    sides of the join are then shuffled for it, and a path that very many
    samples share is split by adaptive skew-join handling.

    A ``bucketed`` cache (``store_cache_table``) is gathered and joined where its
    buckets lie; samples bucketed alike (by ``audio_path``) are not moved
    either, others are dealt to the buckets.  The runs are stored first, so
    that the planner knows how few they are and doesn't shuffle for them.
    """
    if bucketed:
        runs = stage(runs, "runs")
    wanted = runs.select("dataset", "codename", "version").distinct()
    values = [F.col("asr_hyp").alias("hypothesis"), *(F.col(c).alias(name) for c, name in _RESOURCES.items())]
    if bucketed:
        wanted = stage(wanted, "wanted_runs")
    used = cache.join(wanted, ["dataset", "codename", "version"], "left_semi")
    if bucketed:
        # Where the buckets lie is what the aggregate and the join need.
        entries = used.filter("audio_path <> ''").groupBy(F.col("audio_path").alias("__path")).agg(
            F.collect_list(F.struct("dataset", "codename", "version", *values)).alias("__entries")
        )
        placed = samples.join(entries, F.col("audio_path") == F.col("__path"), "left")
    else:
        entries = used.groupBy(F.col("dataset").alias("__dataset"), F.col("audio_path").alias("__path")).agg(
            F.collect_list(F.struct("dataset", "codename", "version", *values)).alias("__entries")
        )
        entries = stage(entries, "hypotheses_by_path")
        same = (F.col("dataset") == F.col("__dataset")) & (_path_key("audio_path", "sample_idx") == F.col("__path"))
        placed = samples.join(entries, same, "left")
    joined = placed.join(runs, ["dataset", "subset", "split"])
    key = ("dataset", "codename", "version")
    mine = F.filter("__entries", lambda e: reduce(lambda a, b: a & b, (e[c] == F.col(c) for c in key)))
    values = F.transform(
        mine, lambda e: F.struct(*(e[c].alias(c) for c in ("hypothesis", *_RESOURCES.values())))
    )
    return joined.select(
        *(c for c in joined.columns if not c.startswith("__")), F.inline_outer(values)
    )


def attach_metadata(
    metrics: DataFrame,
    eval_input: DataFrame,
    on: Sequence[str] = ("dataset", "subset", "split", "version", "system", "sample_idx"),
    *,
    suffix: str = "_right",
) -> DataFrame:
    """Left join of metric rows to further columns of the eval input.

    Keyed by the sample index every metric row meets one input row.  Keyed by
    ``["audio_path"]``, duplicated paths fan out.  Columns that exist on both
    sides get ``suffix`` on the right.
    """
    right = eval_input.select(
        *(F.col(c).alias(f"__{c}") for c in on),
        *(
            F.col(c).alias(c + suffix if c in metrics.columns else c)
            for c in eval_input.columns
            if c not in on
        ),
    )
    same = F.lit(True)
    for c in on:
        same = same & (F.col(c) == F.col(f"__{c}"))
    return metrics.join(right, same, "left").drop(*(f"__{c}" for c in on))


def attach_durations(pairs: DataFrame, durations: DataFrame) -> DataFrame:
    """Left join to ``durations(path, audio_duration)``: 0.0 for clips without
    an entry; of a path listed more than once, the longest."""
    known = stage(
        durations.groupBy(F.col("path").alias("__path")).agg(F.max("audio_duration").alias("audio_duration")),
        "durations",
    )
    joined = pairs.join(known, _path_key("audio_path", "sample_idx") == F.col("__path"), "left")
    return joined.drop("__path").fillna(0.0, ["audio_duration"])


def pending_work(
    samples: DataFrame, cache: DataFrame, *, recreate: bool = False
) -> DataFrame:
    """Planned samples without a usable hypothesis for their version."""
    if recreate:
        return samples
    usable = cache.filter(
        F.col("asr_hyp").isNotNull() & ~F.col("asr_hyp").isin("", *SENTINELS)
    ).select(*CACHE_KEY)
    cached = usable.select(*(F.col(c).alias(f"__{c}") for c in CACHE_KEY))
    same = _path_key("audio_path", "sample_idx") == F.col("__audio_path")
    for c in CACHE_KEY:
        if c != "audio_path":
            same = same & (F.col(c) == F.col(f"__{c}"))
    return samples.join(cached, same, "left_anti")


def latest_hypotheses(
    rows: DataFrame, order: Sequence[str], *, all_versions: bool = True
) -> DataFrame:
    """Last write per key wins; ``order`` ranks the writes.

    An aggregate and not a window: writes of one key are combined before the
    shuffle, however many there are.  With ``all_versions=False`` a write
    also displaces the other versions of its path.
    """
    keys = CACHE_KEY if all_versions else [k for k in CACHE_KEY if k != "version"]
    payload = [c for c in rows.columns if c not in keys and c not in order]
    last = F.max(F.struct(*order, *payload)).alias("__last")
    return (
        rows.groupBy(*keys)
        .agg(last)
        .select(*(F.col(c) if c in keys else F.col(f"__last.{c}") for c in rows.columns))
    )


def _lowest_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk one range of the sorted listing; ``folder, name, near`` for its
    wanted names: the lowest file of those that follow and begin with the name.

    Open names are nested, each a prefix of the next: a file counts for the
    last one and is handed on when that closes.  Names of earlier ranges may
    still be open where a range begins.  They are prefixes of its first entry,
    so all of these are opened, and whoever wanted one takes its file.
    """
    open_names: list[list] = []
    done: list[tuple] = []
    begun = False

    def close() -> None:
        folder, name, near = open_names.pop()
        if near is not None:
            done.append((folder, name, near))
            if open_names:
                above = open_names[-1]
                above[2] = near if above[2] is None else min(above[2], near)

    def result() -> pa.RecordBatch:
        columns = list(zip(*done)) or [(), (), ()]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["folder", "name", "near"])

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("folder", "name", "file"))
        for folder, name, file in zip(*columns):
            if not begun:
                open_names = [[folder, name[:size], None] for size in range(len(name) + 1)]
                begun = True
            while open_names and not (open_names[-1][0] == folder and name.startswith(open_names[-1][1])):
                close()
            if file is None:
                if not open_names or open_names[-1][1] != name:
                    open_names.append([folder, name, None])
            elif open_names:
                last = open_names[-1]
                last[2] = file if last[2] is None else min(last[2], file)
        yield result()
    while open_names:
        close()
    yield result()


def _lowest_with_prefix(listed: DataFrame, missing: DataFrame) -> DataFrame:
    """``folder, name, near``: for each of the ``missing(folder, name)`` that
    has one, the lowest ``file`` below the folder whose name begins with it."""
    steps = F.split("home", "/")
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size(steps)),
        lambda depth: F.array_join(F.slice(steps, F.lit(1), depth), "/"),
    )
    entries = (
        listed.select(
            "file",
            F.substring_index("file", "/", -1).alias("name"),
            F.regexp_replace("file", r"/?[^/]*\z", "").alias("home"),
        )
        .select("file", "name", F.explode(F.array_distinct(ancestors)).alias("folder"))
        .join(missing.select("folder").distinct(), "folder", "left_semi")
        .groupBy("folder", "name")
        .agg(F.min("file").alias("file"))
    )
    asked = missing.select("folder", "name", F.lit(None).cast("string").alias("file")).distinct()
    both = stage(entries.select("folder", "name", "file").union(asked), "sorted_listing")
    return (
        both.repartitionByRange("folder", "name")
        .sortWithinPartitions("folder", "name", F.col("file").asc_nulls_first())
        .mapInArrow(_lowest_files, "folder string, name string, near string")
        .groupBy("folder", "name")
        .agg(F.min("near").alias("near"))
    )


def resolve_audio_paths(
    wanted: DataFrame,
    files: DataFrame,
    path: str = "audio_path",
    *,
    cache_root: str | None = None,
) -> DataFrame:
    """Distinct paths of ``wanted`` with the file that stands for each one:
    ``path, resolved``.

    In this order: the file itself; a file below the same folder whose name
    starts with the wanted name; a file of the same name below
    ``cache_root`` (anywhere if not given); ``''``.  Of several candidates
    the lowest path is taken.

    ``files(path)`` lists existing files.  Names are looked up in one sorted
    listing of files and wanted names, dealt by range: a folder that holds a
    large part of all files is many ranges, and files of one name in many
    folders are one entry per wanted folder before they are sorted.
    """
    paths = wanted.select(F.col(path).alias("path")).distinct()
    listed = files.select(F.col("path").alias("file")).distinct()
    exact = paths.join(listed, paths["path"] == listed["file"], "left")
    found = exact.filter(F.col("file").isNotNull()).select("path", F.col("file").alias("resolved"))
    missing = exact.filter(F.col("file").isNull()).select(
        "path",
        F.substring_index("path", "/", -1).alias("name"),
        F.regexp_replace("path", r"/?[^/]*\z", "").alias("folder"),
    )
    missing = stage(missing, "missing_paths")
    nearby = _lowest_with_prefix(listed, missing)
    anywhere = listed
    if cache_root is not None:
        root = cache_root.rstrip("/") + "/"
        anywhere = anywhere.filter(F.startswith("file", F.lit(root)))
    same_name = anywhere.groupBy(F.substring_index("file", "/", -1).alias("name")).agg(
        F.min("file").alias("far")
    )
    guessed = (
        missing.join(nearby, ["name", "folder"], "left")
        .join(same_name, "name", "left")
        .select("path", F.coalesce("near", "far", F.lit("")).alias("resolved"))
    )
    return found.unionByName(guessed)


def apply_resolved_paths(samples: DataFrame, resolved: DataFrame) -> DataFrame:
    """Replace ``audio_path`` by the file found for it (``''`` if none)."""
    found = resolved.select(F.col("path").alias("__path"), F.col("resolved").alias("__resolved"))
    joined = samples.join(
        found, _path_key("audio_path", "sample_idx") == F.col("__path"), "left"
    )
    return joined.withColumn("audio_path", F.coalesce("__resolved", F.lit(""))).drop(
        "__path", "__resolved"
    )
