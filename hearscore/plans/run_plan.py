"""What is to be run: models x corpora x normalisations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearscore.functions.text import check_norm_types, codename, dataset_short_name
from hearscore.schema import SPLITS


@dataclass(frozen=True)
class ModelGroup:
    """Models of one kind; ``providers`` and ``versions`` have one value per
    model, or a single value for all of them."""

    name: str
    models: Sequence[str]
    providers: Sequence[str] | str
    versions: Sequence[str] | str


@dataclass(frozen=True)
class Corpus:
    """Subsets and splits to evaluate.  Of each, at most the first
    ``max_samples_per_subset`` samples (None: all); ``metadata_columns`` are
    carried through to the results."""

    name: str
    subsets: Sequence[str]
    splits: Sequence[str] | str = "ALL"
    max_samples_per_subset: int | None = None
    metadata_columns: Sequence[str] = field(default_factory=tuple)


def matching_values(group: ModelGroup, attribute: str) -> list[str]:
    """One value per model of the group."""
    values = getattr(group, attribute)
    values = [values] if isinstance(values, str) else list(values)
    if len(values) == 1:
        return values * len(group.models)
    if len(values) != len(group.models):
        raise ValueError(
            f"group {group.name!r}: {len(values)} {attribute} for {len(group.models)} models"
        )
    return values


def expand_splits(splits: Sequence[str] | str) -> list[str]:
    if isinstance(splits, str):
        return list(SPLITS) if splits.upper() == "ALL" else [splits]
    return list(splits)


def _local_table(
    spark: SparkSession, rows: Sequence[tuple[str, ...]], names: Sequence[str]
) -> DataFrame:
    """Small table of strings whose size the optimizer knows (an Arrow table
    becomes a local relation, a list of rows would not)."""
    columns = [pa.array([row[i] for row in rows], pa.string()) for i in range(len(names))]
    return spark.createDataFrame(pa.table(columns, names=list(names)))


def model_table(
    spark: SparkSession, groups: Sequence[ModelGroup], language: str = "pl-PL"
) -> DataFrame:
    rows = [
        (g.name, provider, model, version, language)
        for g in groups
        for model, provider, version in zip(
            g.models,
            matching_values(g, "providers"),
            matching_values(g, "versions"),
            strict=True,
        )
    ]
    names = ["model_group", "provider", "model", "version", "language"]
    return with_codename(_local_table(spark, rows, names))


def with_codename(models: DataFrame) -> DataFrame:
    return models.withColumn("codename", codename("provider", "model", "language")).drop("language")


def spread_models(groups: DataFrame, language: Column | str = "pl-PL") -> DataFrame:
    """The same from a table of groups (``name, models, providers, versions``
    with array columns): arrays are zipped, a single value serves all models
    and any other length is an error."""

    def fit(column: str) -> Column:
        size = F.size("models")
        return (
            F.when(F.size(column) == size, F.col(column))
            .when(F.size(column) == 1, F.array_repeat(F.element_at(column, 1), size))
            .otherwise(
                F.raise_error(F.concat(F.lit(f"group without matching {column}: "), F.col("name")))
            )
        )

    zipped = F.arrays_zip(
        F.col("models").alias("model"),
        fit("providers").alias("provider"),
        fit("versions").alias("version"),
    )
    lang = F.lit(language) if isinstance(language, str) else language
    return with_codename(
        groups.select(F.col("name").alias("model_group"), F.explode(zipped).alias("m")).select(
            "model_group",
            F.col("m.provider").alias("provider"),
            F.col("m.model").alias("model"),
            F.col("m.version").alias("version"),
            lang.alias("language"),
        )
    )


def corpus_table(spark: SparkSession, corpora: Sequence[Corpus]) -> DataFrame:
    rows = [
        (c.name, subset, split)
        for c in corpora
        for subset in c.subsets
        for split in expand_splits(c.splits)
    ]
    table = _local_table(spark, rows, ["name", "subset", "split"])
    return table.select(dataset_short_name("name").alias("dataset"), "subset", "split")


def run_plan(
    models: DataFrame, corpora: DataFrame, norm_types: Sequence[str] | None = None
) -> DataFrame:
    """Every model on every (dataset, subset, split), and on every
    normalisation if given.

    The grid is the feature: both sides are as few rows as the configuration
    names.
    """
    grid = models.crossJoin(corpora.select("dataset", "subset", "split"))
    if norm_types is None:
        return grid
    names = F.array(*(F.lit(n) for n in check_norm_types(norm_types)))
    return grid.withColumn("norm_type", F.explode(names))
