"""Corpus statistics: durations and transcript lengths.

Rows are aggregated once, per (dataset, subset, split), into mergeable
moments.  The dataset and overall levels combine those few rows, so three
levels cost one pass over the samples and no expanded copies of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearscore.functions.rates import round_half_even_exact
from hearscore.functions.text import word_count
from hearscore.schema import SPLIT_KEYS

FIELDS = ("mean", "std", "min", "max")


def sample_duration(
    array: Column, rate: Column | None = None, row_rate: Column | None = None
) -> Column:
    """Seconds of an audio array, two decimals: the row's own sampling rate,
    else that of the audio struct, else 16 kHz; 0.0 where it cannot be told."""
    rates = [r for r in (row_rate, rate) if r is not None]
    seconds = F.try_divide(
        F.size(array).cast("double"), F.coalesce(*rates, F.lit(16000)).cast("double")
    )
    usable = array.isNotNull() & seconds.isNotNull()
    return F.when(usable, round_half_even_exact(seconds)).otherwise(F.lit(0.0))


def exclude_empty_transcripts(
    marker: str, split: str = "test"
) -> Callable[[Column, Column, Column], Column]:
    """Rule for rows left out of the lengths of a whole dataset: empty
    transcripts of a ``split`` that is published without transcripts, in
    datasets whose name holds ``marker`` (in any case)."""

    def rule(dataset: Column, split_column: Column, words: Column) -> Column:
        return F.contains(F.lower(dataset), F.lit(marker.lower())) & (split_column == split) & (words == 0)

    return rule


def running_stats(value: Column, name: str) -> list[Column]:
    """Mean, population deviation, minimum and maximum, 0.0 for no values."""
    functions = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    return [
        F.coalesce(functions[f](value).cast("double"), F.lit(0.0)).alias(f"{name}_{f}")
        for f in FIELDS
    ]


def _moments(value: Column, name: str) -> list[Column]:
    return [
        F.count(value).alias(f"{name}_n"),
        F.avg(value).alias(f"{name}_avg"),
        F.var_pop(value).alias(f"{name}_var"),
        F.min(value).cast("double").alias(f"{name}_lo"),
        F.max(value).cast("double").alias(f"{name}_hi"),
    ]


def split_moments(
    samples: DataFrame,
    *,
    text: str = "text",
    duration: str = "duration",
    exclude: Callable[[Column, Column, Column], Column] | None = None,
    keys: Sequence[str] = SPLIT_KEYS,
) -> DataFrame:
    """Mergeable moments per split; ``len_all`` counts every transcript,
    ``len`` those that count for the dataset level."""
    words = samples.select(
        *keys, word_count(text).alias("__words"), F.col(duration).alias("__seconds")
    )
    seconds = F.when(F.col("__seconds") > 0, F.col("__seconds"))
    length = F.col("__words")
    counted = length
    if exclude is not None:
        counted = F.when(~exclude(F.col("dataset"), F.col("split"), length), length)
    return words.groupBy(*keys).agg(
        F.count("*").alias("sample_count"),
        F.coalesce(F.sum(seconds), F.lit(0.0)).alias("audio_seconds"),
        *_moments(seconds, "dur"),
        *_moments(length, "len_all"),
        *_moments(counted, "len"),
    )


def _pooled(parts: Column) -> Column:
    """``n, mean, m2`` of several groups' moments, two at a time: what a group
    adds to the squared deviations follows from the distance of the means, so
    nothing large is subtracted from something large."""
    kind = "struct<n:double,mean:double,m2:double>"

    def merge(s: Column, x: Column) -> Column:
        total, apart = s["n"] + x["n"], x["avg"] - s["mean"]
        both = F.struct(
            total.alias("n"),
            (s["mean"] + apart * x["n"] / total).alias("mean"),
            (s["m2"] + x["n"] * x["var"] + apart * apart * s["n"] * x["n"] / total).alias("m2"),
        )
        return F.when(x["n"] > 0, both.cast(kind)).otherwise(s)

    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")).cast(kind)
    return F.aggregate(parts, none, merge)


def _parts(name: str) -> Column:
    """The moments of a group's members, few rows, in an order of their own."""
    n, avg, var = (F.col(f"{name}_{p}").cast("double").alias(p) for p in ("n", "avg", "var"))
    return F.array_sort(F.collect_list(F.struct(n, avg, var))).alias(f"{name}_parts")


def _merge(name: str, out: str) -> list[Column]:
    """Statistics of the pooled moments ``<name>_pool``."""
    pool = F.col(f"{name}_pool")
    std = F.sqrt(F.try_divide(pool["m2"], pool["n"]))
    return [
        pool["mean"].alias(f"{out}_mean"),
        F.coalesce(F.when(pool["n"] > 1, std), F.lit(0.0)).alias(f"{out}_std"),
        F.coalesce(f"{name}_lo", F.lit(0.0)).alias(f"{out}_min"),
        F.coalesce(f"{name}_hi", F.lit(0.0)).alias(f"{out}_max"),
    ]


def _stats(name: str, out: str) -> list[Column]:
    part = {
        "mean": F.col(f"{name}_avg"),
        "std": F.sqrt(F.col(f"{name}_var")),
        "min": F.col(f"{name}_lo"),
        "max": F.col(f"{name}_hi"),
    }
    return [F.coalesce(part[f], F.lit(0.0)).alias(f"{out}_{f}") for f in FIELDS]


def split_statistics(moments: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """One row per split; ``planned`` (dataset, subset, split) adds a row of
    zeros for each planned split without samples."""
    if planned is not None:
        moments = planned.select(*SPLIT_KEYS).join(moments, SPLIT_KEYS, "left")
    return moments.select(
        *SPLIT_KEYS,
        F.concat_ws("-", "subset", "split").alias("split_key"),
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        (F.coalesce("audio_seconds", F.lit(0.0)) / 3600).alias("audio_hours"),
        *_stats("dur", "audio_duration"),
        *_stats("len_all", "transcript_length"),
    )


def dataset_statistics(moments: DataFrame) -> DataFrame:
    names = ("dur", "len")
    ends = [f(f"{m}_{e}").alias(f"{m}_{e}") for m in names for f, e in ((F.min, "lo"), (F.max, "hi"))]
    pooled = moments.groupBy("dataset").agg(
        F.sum("sample_count").alias("sample_count"),
        (F.sum("audio_seconds") / 3600).alias("total_audio_hours"),
        *ends,
        *map(_parts, names),
    )
    pooled = pooled.withColumns({f"{m}_pool": _pooled(F.col(f"{m}_parts")) for m in names})
    return pooled.select(
        "dataset",
        "sample_count",
        "total_audio_hours",
        *_merge("dur", "audio_duration"),
        *_merge("len", "transcript_length"),
    )


def grand_summary(moments: DataFrame) -> DataFrame:
    """Number of datasets and their hours, summed before rounding."""
    hours = moments.groupBy("dataset").agg(F.sum("audio_seconds").alias("seconds"))
    return hours.agg(
        F.count("*").alias("total_datasets"),
        F.coalesce(F.sum(F.col("seconds") / 3600), F.lit(0.0)).alias("total_audio_hours"),
    )


def rounded(stats: DataFrame, digits: int = 2) -> DataFrame:
    """Every DOUBLE column rounded for a report."""
    doubles = {name for name, kind in stats.dtypes if kind == "double"}
    return stats.select(
        *(round_half_even_exact(F.col(c), digits).alias(c) if c in doubles else F.col(c) for c in stats.columns)
    )


def summary_report(stats: DataFrame, label: str, hours: str) -> DataFrame:
    """Printable line per row of split or dataset statistics."""

    def two(name: str) -> Column:
        # Rounded first: the formatter would round the printed decimal.
        return round_half_even_exact(F.col(name))

    def spread(name: str, pattern: str) -> Column:
        return F.format_string(pattern, two(f"{name}_mean"), two(f"{name}_std"))

    return stats.select(
        F.col(label).alias("entry"),
        F.col("sample_count").alias("samples"),
        F.format_string("%.2f", two(hours)).alias("audio_hours"),
        spread("audio_duration", "%.2fs ± %.2fs").alias("avg_duration"),
        spread("transcript_length", "%.2f ± %.2f words").alias("avg_transcript"),
    )
