"""Reading corpora."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_corpus(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType | None = None,
    *,
    fmt: str = "parquet",
    dataset: str | None = None,
    **options: str,
) -> DataFrame:
    """All subsets and splits of a corpus as one table.

    ``subset`` and ``split`` are columns or directory levels
    (``subset=…/split=…``); a lookup then reads only the directories it needs.
    """
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    corpus = reader.load(paths if isinstance(paths, str) else list(paths))
    if dataset is not None:
        corpus = corpus.withColumn("dataset", F.lit(dataset))
    return corpus


def union_corpora(*corpora: DataFrame) -> DataFrame:
    """Several corpora under one another; columns one of them lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), corpora)


def planned_runs(plan: DataFrame) -> DataFrame:
    """Every (dataset, subset, split) with the models it is planned for."""
    runs = plan.select(
        "dataset", "subset", "split", "provider", "model", "version", "codename"
    )
    return runs.distinct() if "norm_type" in plan.columns else runs


def planned_samples(samples: DataFrame, plan: DataFrame) -> DataFrame:
    """Samples of every planned (dataset, subset, split), once per model of
    the plan: with ``provider, model, version, codename``."""
    return samples.join(planned_runs(plan), ["dataset", "subset", "split"])
