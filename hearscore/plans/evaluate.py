"""The evaluation in three stages: transcribe what is missing, prepare the
eval input, compute metrics and summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearscore.functions.rates import METRICS, resolve_metrics
from hearscore.functions.text import check_norm_types
from hearscore.operators.joins import (
    apply_resolved_paths,
    attach_durations,
    attach_planned_hypotheses,
    latest_hypotheses,
    pending_work,
    resolve_audio_paths,
)
from hearscore.operators.scoring import results, running_clips, score_clips
from hearscore.operators.selection import first_n_per_split
from hearscore.operators.summary import group_summary, sort_summary
from hearscore.operators.transcribe import Transcriber, cache_rows, transcribe_batch
from hearscore.plans.run_plan import Corpus, corpus_table
from hearscore.schema import CACHE_COSTS, CACHE_KEY, RESOURCES, SAMPLE, SPLIT_KEYS
from hearscore.session import drop_stage, stage
from hearscore.sources.cache import sink_hyp_cache, stored_hyp_cache
from hearscore.sources.corpora import planned_runs, planned_samples
from hearscore.sources.store import dated_path, fingerprints, materialize_groups, stored
from hearscore.sources.tsv import sink_tsv

# Directory levels of stored stages.
GROUPS = ["dataset", "subset", "split", "codename", "version"]


@dataclass(frozen=True)
class Evaluation:
    """What to compute and where stages are kept.

    ``tasks`` spreads clips over that many tasks before they are scored, for
    stored input with fewer partitions than there are cores."""

    name: str
    base: str
    norm_types: Sequence[str] = ("none", "all", "lowercase", "whitespace", "punctuation", "tags")
    metrics: Sequence[str] = tuple(METRICS)
    metric_mode: str = "running"
    metadata_columns: Sequence[str] = field(default_factory=tuple)
    tasks: int | None = None

    def path(self, stage_name: str) -> str:
        return f"{self.base.rstrip('/')}/{stage_name}/{self.name}"


def capped_samples(samples: DataFrame, corpora: Sequence[Corpus]) -> DataFrame:
    """Samples of the corpora, of each split at most as many of the first as
    its corpus allows."""
    spark = samples.sparkSession
    parts = []
    for cap in dict.fromkeys(c.max_samples_per_subset for c in corpora):
        splits = corpus_table(spark, [c for c in corpora if c.max_samples_per_subset == cap])
        parts.append(first_n_per_split(samples.join(splits, SPLIT_KEYS, "left_semi"), cap))
    return reduce(DataFrame.unionByName, parts)


def missing_clips(planned: DataFrame, cache: DataFrame, *, recreate: bool = False) -> DataFrame:
    """Clips without a usable hypothesis, once per key; texts stay behind."""
    rows = planned.select("dataset", "codename", "audio_path", "version", "sample_idx", "provider", "model")
    return pending_work(rows, cache, recreate=recreate).drop("sample_idx").dropDuplicates(CACHE_KEY)


def transcribe_missing(
    planned: DataFrame,
    cache: DataFrame,
    load: Callable[[], Transcriber],
    *,
    recreate: bool = False,
    tasks: int | None = None,
    day: str | None = None,
) -> DataFrame:
    """New cache rows for planned samples without a usable hypothesis."""
    todo = missing_clips(planned, cache, recreate=recreate)
    return cache_rows(transcribe_batch(todo, load, tasks=tasks), day)


def failure_counts(spark: SparkSession, path: str) -> DataFrame | None:
    """``dataset, codename, audio_path, version, failures``: how often in a row
    each clip has failed so far, of those that have; None before the first."""
    ledger = stored(spark, f"{path}.failures")
    if ledger is None:
        return None
    last = F.max(F.struct("at", "failures")).alias("last")
    return ledger.groupBy(*CACHE_KEY).agg(last).select(*CACHE_KEY, "last.failures").filter("failures > 0")


def _note_failures(made: DataFrame, path: str) -> None:
    """Write down the clips that failed, and those that no longer do."""
    before = failure_counts(made.sparkSession, path)
    now = made.select(*CACHE_KEY, (F.col("asr_hyp") == "").alias("failed"))
    if before is None:
        now = now.withColumn("failures", F.lit(0))
    else:
        same = [now[k].eqNullSafe(before[k]) for k in CACHE_KEY]
        now = now.join(before, same, "left").select(
            *(now[k] for k in CACHE_KEY), "failed", F.coalesce("failures", F.lit(0)).alias("failures")
        )
    changed = now.filter(F.col("failed") | (F.col("failures") > 0)).select(
        *CACHE_KEY, F.when(F.col("failed"), F.col("failures") + 1).otherwise(0).alias("failures"), F.current_timestamp().alias("at")
    )
    stage(changed, "failures").write.mode("append").parquet(f"{path}.failures")


def save_missing(
    planned: DataFrame,
    path: str,
    load: Callable[[], Transcriber],
    *,
    recreate: bool = False,
    tasks: int | None = None,
    batch_size: int = 16,
    clips_per_commit: int = 100_000,
    max_failures: int = 5,
    profile: ResourceProfile | None = None,
    day: str | None = None,
) -> None:
    """Transcribe what the cache at ``path`` lacks and append it there.

    Every ``clips_per_commit`` clips or so are a job of their own whose rows
    are committed before the next one starts: a run that fails halfway keeps
    them, and the next one goes on from there.  Clips without an answer are
    counted in ``<path>.failures``; one that has failed ``max_failures`` times
    in a row isn't tried again, until its rows there are removed.
    """
    spark = planned.sparkSession
    cache = stored_hyp_cache(spark, path)
    todo = missing_clips(planned, cache, recreate=recreate)
    failed = failure_counts(spark, path)
    if failed is not None:
        hopeless = failed.filter(F.col("failures") >= max_failures)
        todo = todo.join(hopeless, [todo[k].eqNullSafe(hopeless[k]) for k in CACHE_KEY], "left_anti")
    todo = stage(todo, "missing_clips")
    commits = -(-todo.count() // clips_per_commit)
    for number in range(commits):
        mine = F.pmod(F.xxhash64(*CACHE_KEY), F.lit(commits)) == number
        made = transcribe_batch(todo.filter(mine), load, tasks=tasks, batch_size=batch_size, profile=profile)
        made = stage(made, "transcribed")
        sink_hyp_cache(cache_rows(made, day), path, append=True)
        _note_failures(made, path)
        drop_stage(made)


def merge_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Cache with new rows; a new row replaces the one of its key."""
    both = cache.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest_hypotheses(both, ["__new"]).select(*cache.columns)


def eval_input(
    samples: DataFrame, plan: DataFrame, cache: DataFrame, metadata_columns: Sequence[str] = ()
) -> DataFrame:
    """Planned samples with their hypotheses and costs."""
    known = [c for c in metadata_columns if c in samples.columns]
    kept = samples.select(*dict.fromkeys([*SAMPLE.names, *known]))
    joined = attach_planned_hypotheses(kept, planned_runs(plan), cache)
    order = [*SAMPLE.names[:5], "provider", "model", "version", "codename", *known]
    return joined.select(*dict.fromkeys(order), "text", "hypothesis", *RESOURCES.names)


def prepare_eval_input(
    spark: SparkSession,
    job: Evaluation,
    samples: DataFrame,
    plan: DataFrame,
    cache: DataFrame,
    *,
    force: bool = False,
) -> DataFrame:
    """Stored eval input of the plan; groups that are there are kept as long
    as their samples, their model's cache and its entry in the plan are the same."""

    def compute(groups: DataFrame) -> DataFrame:
        todo = plan.join(groups, GROUPS, "left_semi")
        return eval_input(samples, todo, cache, job.metadata_columns)

    known = [c for c in job.metadata_columns if c in samples.columns]
    spoken = fingerprints(samples.select(*dict.fromkeys([*SAMPLE.names, *known])), SPLIT_KEYS, "spoken")
    model = ["dataset", "codename", "version"]
    said = fingerprints(cache.select(*model, "audio_path", "asr_hyp", *CACHE_COSTS), model, "said")
    groups = plan.groupBy(*GROUPS).agg(F.max(F.struct("provider", "model")).cast("string").alias("named"))
    marks = groups.join(spoken, SPLIT_KEYS, "left").join(said, model, "left")
    marks = marks.select(*GROUPS, F.concat_ws("|", "named", *(F.coalesce(c, F.lit("")) for c in ("spoken", "said"))).alias("mark"))
    return materialize_groups(
        spark,
        job.path("eval_input"),
        plan,
        compute,
        GROUPS,
        marks=marks,
        parameters=known,
        force=force,
        rebalance=True,
    )


def sample_results(
    pairs: DataFrame,
    norm_types: Sequence[str],
    metrics: Sequence[str],
    *,
    mode: str = "running",
    tasks: int | None = None,
    counts: bool = False,
) -> DataFrame:
    """Per-sample result table of an eval input.

    Clip counts are stored once: the running values need them twice, and
    scoring is the costly part.
    """
    check_norm_types(norm_types)
    if mode == "running":
        clips = running_clips(pairs, norm_types, metrics, tasks=tasks)
    else:
        clips = score_clips(pairs, norm_types, metrics, tasks=tasks)
    return results(clips, norm_types, metrics, mode=mode, counts=counts)


def generate_metrics(
    spark: SparkSession,
    job: Evaluation,
    pairs: DataFrame,
    *,
    durations: DataFrame | None = None,
    force: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(per-sample results, sorted summary) of a stored eval input.

    ``durations(path, audio_duration)`` adds the length of each clip; clips
    without an entry get 0.0.  Stored groups are kept as long as their pairs
    and what is computed of them are the same.
    """
    metrics = resolve_metrics(job.metrics)
    if durations is not None:
        pairs = attach_durations(pairs, durations)

    def compute(groups: DataFrame) -> DataFrame:
        chosen = pairs.join(groups, GROUPS, "left_semi")
        table = sample_results(
            chosen,
            job.norm_types,
            metrics,
            mode=job.metric_mode,
            tasks=job.tasks,
        )
        return table.withColumn("codename", F.col("system"))

    table = materialize_groups(
        spark,
        job.path("eval_output"),
        pairs,
        compute,
        GROUPS,
        marks=fingerprints(pairs, GROUPS),
        parameters=[list(job.norm_types), metrics, job.metric_mode],
        force=force,
    ).drop("codename")
    summary = sort_summary(group_summary(table, metrics, job.metadata_columns))
    return table, summary


def write_reports(job: Evaluation, table: DataFrame, summary: DataFrame, day: str | None = None):
    """Dated TSV reports: all rows by dataset, and the averages."""
    base = job.path("reports")
    sink_tsv(table, dated_path(base, "eval_output_all", day), partition_by=["dataset"])
    sink_tsv(
        sort_summary(summary), dated_path(base, "avg_eval_output_all", day), partition_by=["dataset"]
    )


def evaluate(
    spark: SparkSession,
    job: Evaluation,
    samples: DataFrame,
    plan: DataFrame,
    cache: DataFrame | str,
    *,
    load: Callable[[], Transcriber] | None = None,
    recreate: bool = False,
    corpora: Sequence[Corpus] = (),
    files: DataFrame | None = None,
    durations: DataFrame | None = None,
    force_prepare: bool = False,
    force_metrics: bool = False,
    **transcribing,
) -> tuple[DataFrame, DataFrame]:
    """All stages; without a transcriber the first one is left out.

    ``cache`` is a table of hypotheses, or the folder where they are kept:
    then new ones are saved there (``save_missing``, which takes
    ``transcribing``).  ``corpora`` caps the samples and adds metadata columns;
    ``files(path)`` resolves audio paths first, and clips without a file are
    not transcribed; ``durations(path, audio_duration)`` adds lengths.
    """
    if corpora:
        samples = capped_samples(samples, corpora)
        extra = [c for corpus in corpora for c in corpus.metadata_columns]
        job = replace(job, metadata_columns=tuple(dict.fromkeys([*job.metadata_columns, *extra])))
    if files is not None:
        resolved = resolve_audio_paths(samples, files)
        samples = stage(apply_resolved_paths(samples, resolved), "resolved_samples")
    kept = cache if isinstance(cache, str) else None
    if load is not None:
        planned = planned_samples(samples, plan)
        if kept is not None:
            save_missing(planned, kept, load, recreate=recreate, **transcribing)
        else:
            new = transcribe_missing(planned, cache, load, recreate=recreate, **transcribing)
            cache = merge_cache(cache, stage(new, "new_hypotheses"))
    if kept is not None:
        cache = stored_hyp_cache(spark, kept)
    pairs = prepare_eval_input(spark, job, samples, plan, cache, force=force_prepare)
    return generate_metrics(spark, job, pairs, durations=durations, force=force_metrics)


