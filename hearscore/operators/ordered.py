"""Ordered work within groups of any size.

A plain window over ``partitionBy(group)`` sorts a whole group in one task.
Here a group is cut into buckets of consecutive order values (``order >>
bits``), so that, with order values unique in a group, no window partition
holds more than ``2 ** bits`` rows; the sums of whole buckets are summed up
the same way, level by level, until one bucket spans everything.  With the
default, one level serves 262 thousand order values, two serve 7e10.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearscore.session import stage

BITS = 18


def levels_for(df: DataFrame, order: str, bits: int = BITS) -> int:
    """Levels needed for the order values present (one aggregate row)."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    reach = max(abs(low or 0), abs(high or 0))
    levels = 1
    while reach >> (bits * levels):
        levels += 1
    return levels


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[str],
    *,
    bits: int = BITS,
    levels: int | None = None,
    suffix: str = "_so_far",
) -> DataFrame:
    """Add ``<value><suffix>``: the sum over rows of the group up to this one.

    ``df`` is read once for the bucket sums and once for the rows, so pass a
    stored table when it is costly to compute.  Sums of integers are exact.
    """
    if levels is None:
        levels = levels_for(df, order, bits)
    if levels == 1:
        frame = _up_to_here(keys, [order])
        return df.select("*", *(F.sum(v).over(frame).alias(v + suffix) for v in values))

    bucket, offset = f"__bucket{levels}", f"__offset{levels}"
    rows = df.withColumn(bucket, F.shiftright(F.col(order), bits))
    totals = rows.groupBy(*keys, bucket).agg(*(F.sum(v).alias(v) for v in values))
    before = running_totals(
        totals, keys, bucket, values, bits=bits, levels=levels - 1, suffix="__upto"
    )
    # What precedes a bucket joins its rows as one more row, sorted first:
    # no join, and groups with NULL keys stay whole.
    heads = before.select(
        *keys, bucket, *((F.col(v + "__upto") - F.col(v)).alias(v) for v in values)
    ).withColumn(offset, F.lit(0))
    merged = rows.withColumn(offset, F.lit(1)).unionByName(heads, allowMissingColumns=True)
    frame = _up_to_here([*keys, bucket], [offset, order])
    return (
        merged.select("*", *(F.sum(v).over(frame).alias(v + suffix) for v in values))
        .filter(F.col(offset) == 1)
        .drop(bucket, offset)
    )


def _up_to_here(keys: Sequence[str], order: Sequence[str]):
    return (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def lowest_rows(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    count: int,
    *,
    bits: int = BITS,
    levels: int | None = None,
) -> DataFrame:
    """The first ``count`` rows of every group by ``order``.

    ``bucket`` must grow with the order.  Rows of buckets that lie wholly
    beyond the cap are dropped before anything is shuffled, so a group ranks
    at most ``count`` rows plus the rest of one bucket.
    """
    marked = df.withColumn("__b", bucket)
    sizes = marked.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    if levels is None:
        levels = levels_for(marked, "__b", bits)
    wanted = (
        running_totals(sizes, keys, "__b", ["__n"], bits=bits, levels=levels)
        .withColumn("__left", F.lit(count) - (F.col("__n_so_far") - F.col("__n")))
        .filter(F.col("__left") > 0)
        .select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__b").alias("__kb"), "__left")
    )
    # Stored, its size is known: the planner broadcasts it if it is small, and
    # only the rows that are kept are shuffled.
    wanted = stage(wanted, "wanted_buckets")
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys],
        F.col("__b").eqNullSafe(F.col("__kb")),
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order))
    return (
        marked.join(wanted, same)
        .withColumn("__rank", rank)
        .filter(F.col("__rank") <= F.col("__left"))
        .select(*df.columns)
    )
