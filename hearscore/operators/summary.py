"""Group summaries of result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearscore.operators.selection import metric_columns
from hearscore.schema import SUMMARY_KEYS


def group_summary(
    results: DataFrame,
    metrics: Sequence[str] | None = None,
    metadata_columns: Sequence[str] | None = None,
    *,
    by_version: bool = False,
) -> DataFrame:
    """Row count, mean and sample deviation of every metric and resource.

    ``metrics`` defaults to the numeric columns that are neither fixed nor
    metadata.  A deviation over one row is NULL; NULL values are skipped.
    """
    found, resources = metric_columns(results, metadata_columns)
    keys = [*SUMMARY_KEYS, *(["version"] if by_version else [])]
    aggregates = [F.count("*").alias("sample_count")]
    for name in [*(found if metrics is None else metrics), *resources]:
        aggregates += [F.avg(name).alias(f"avg_{name}"), F.stddev_samp(name).alias(f"std_{name}")]
    return results.groupBy(*keys).agg(*aggregates)


def sort_summary(summary: DataFrame) -> DataFrame:
    """Report order; the system breaks ties."""
    return summary.orderBy("subset", "split", "norm_type", "system")


def union_results(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, matched by column name; the columns must agree."""
    first = parts[0]
    for part in parts[1:]:
        if sorted(part.columns) != sorted(first.columns):
            raise ValueError("result tables with different columns")
    return reduce(DataFrame.unionByName, parts)


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def run_success_rate(hypotheses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of clips with a non-empty hypothesis, in whole percent (NULL for
    a run without clips)."""
    done = F.count_if(F.coalesce(F.col("hypothesis"), F.lit("")) != "")
    return (
        hypotheses.groupBy(*keys)
        .agg(F.count("*").alias("total"), done.alias("successful"))
        .withColumn(
            "success_percent",
            F.floor(F.try_divide(F.col("successful"), F.col("total")) * 100.0).cast("long"),
        )
    )
