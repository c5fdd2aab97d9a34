"""Corpus profile: statistics of splits, datasets and everything."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearscore.operators.corpus_stats import (
    dataset_statistics,
    grand_summary,
    split_moments,
    split_statistics,
)
from hearscore.schema import SPLITS
from hearscore.session import stage


@dataclass(frozen=True)
class Profile:
    splits: DataFrame
    datasets: DataFrame
    grand: DataFrame


def planned_splits(
    samples: DataFrame, splits: Sequence[str] = SPLITS
) -> DataFrame:
    """Every (dataset, subset) with each of ``splits``."""
    names = F.explode(F.array(*(F.lit(s) for s in splits))).alias("split")
    return samples.select("dataset", "subset").distinct().select("dataset", "subset", names)


def profile_corpus(
    samples: DataFrame,
    planned: DataFrame | None = None,
    *,
    text: str = "text",
    duration: str = "duration",
    exclude: Callable[[Column, Column, Column], Column] | None = None,
) -> Profile:
    """Statistics on three levels from one pass over the samples.

    ``exclude`` names rows that do not count for the lengths of a dataset,
    such as ``exclude_empty_transcripts("name")``.
    """
    moments = stage(
        split_moments(samples, text=text, duration=duration, exclude=exclude), "split_moments"
    )
    return Profile(
        split_statistics(moments, planned), dataset_statistics(moments), grand_summary(moments)
    )
