"""Choosing samples and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearscore.functions.text import is_valid_pair
from hearscore.operators.ordered import lowest_rows
from hearscore.schema import SPLIT_KEYS

# Fixed value: columns of the result table that are never metrics.
FIXED_COLUMNS = (
    "dataset",
    "subset",
    "split",
    "id",
    "ref_type",
    "norm_type",
    "system",
    "reference",
    "hypothesis",
    "provider",
    "version",
    "model",
    "audio_path",
    "audio_duration",
)


def subset_lookup(samples: DataFrame, subset: str, split: str) -> DataFrame:
    """One (subset, split); partition pruning applies when both are
    partition columns.  A pair without rows is an error."""
    found = samples.filter((F.col("subset") == subset) & (F.col("split") == split))
    if found.isEmpty():
        raise KeyError(f"no such subset: {subset}/{split}")
    return found


def subset_lookup_many(samples: DataFrame, wanted: DataFrame) -> DataFrame:
    """Samples of the (subset, split) pairs listed in ``wanted``; pairs that
    do not exist are skipped."""
    return samples.join(wanted, ["subset", "split"], "left_semi")


def first_n_per_split(samples: DataFrame, n: int | None, order: str = "sample_idx") -> DataFrame:
    """First ``n`` samples of each split in source order (``None``: all)."""
    if n is None:
        return samples
    # Buckets of 4096 consecutive order values: small enough that little more
    # than the cap is ranked, large enough that there are few of them.
    bucket = F.shiftright(F.col(order), 12)
    return lowest_rows(samples, SPLIT_KEYS, bucket, [order], n)


def seeded_sample_per_split(
    samples: DataFrame, n: int | None, seed: int = 42, key: str = "sample_idx"
) -> DataFrame:
    """``n`` samples of each split in an order shuffled by ``seed``
    (``None`` or 0: all).  The order depends on the key and the seed only, so
    repartitioning or a lost task does not change the sample."""
    if not n:
        return samples
    ticket = F.md5(F.concat_ws("/", F.col(key).cast("string"), F.lit(str(seed))))
    drawn = samples.withColumn("__ticket", ticket)
    bucket = F.conv(F.substring("__ticket", 1, 5), 16, 10).cast("long")
    # Tickets are spread evenly over 2 ** 20 buckets: two levels of 2 ** 18.
    return lowest_rows(
        drawn, SPLIT_KEYS, bucket, ["__ticket", key], n, levels=2
    ).drop("__ticket")


def tag_model_columns(
    df: DataFrame, provider: str, model: str, version: str, codename: str
) -> DataFrame:
    return df.select(
        "*",
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
        F.lit(version).alias("version"),
        F.lit(codename).alias("codename"),
    )


def select_reference_columns(
    df: DataFrame,
    text_column: str,
    metadata_columns: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``keep``, then metadata and text columns; those absent are skipped."""
    wanted = dict.fromkeys([*keep, *(metadata_columns or ()), text_column])
    return df.select(*(c for c in wanted if c in df.columns))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found in the input: {', '.join(missing)}")
    return df


def valid_pairs(
    df: DataFrame, ref: str = "text", hyp: str = "hypothesis", *, check: bool = True
) -> DataFrame:
    """Rows that can be scored, both texts as strings."""
    if check:
        require_columns(df, ref, hyp)
    return cast_text(df.filter(is_valid_pair(ref, hyp)), ref, hyp)


def cast_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def non_empty_pairs(df: DataFrame, ref: str = "reference", hyp: str = "hypothesis") -> DataFrame:
    return df.filter((F.col(ref) != "") & (F.col(hyp) != ""))


def drop_join_columns(df: DataFrame, *extra: str) -> DataFrame:
    return df.drop("audio_path", "text", "codename", *extra)


def metric_columns(
    df: DataFrame, metadata_columns: Sequence[str] | None = None
) -> tuple[list[str], list[str]]:
    """(metric, resource) columns of a result table: numeric ones that are
    neither fixed nor metadata, resources by their prefix."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    skip = {*FIXED_COLUMNS, "sample_idx", *(metadata_columns or ())}
    resources = [c for c in numeric if c.startswith("resources_")]
    return [c for c in numeric if c not in skip and c not in resources], resources
