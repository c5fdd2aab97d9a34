"""Error rates from pooled edit counts, and the registry of metric names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_COUNTS = ("hits", "subs", "dels", "ins")
CHAR_COUNTS = ("char_edits", "char_len")


def _d(c: Column) -> Column:
    return c.cast("double")


def wer(counts: Callable[[str], Column]) -> Column:
    edits = counts("subs") + counts("dels") + counts("ins")
    return F.try_divide(_d(edits), _d(counts("hits") + counts("subs") + counts("dels")))


def cer(counts: Callable[[str], Column]) -> Column:
    return F.try_divide(_d(counts("char_edits")), _d(counts("char_len")))


def mer(counts: Callable[[str], Column]) -> Column:
    edits = counts("subs") + counts("dels") + counts("ins")
    return F.try_divide(_d(edits), _d(counts("hits") + edits))


def wil(counts: Callable[[str], Column]) -> Column:
    hits = _d(counts("hits"))
    n_ref = _d(counts("hits") + counts("subs") + counts("dels"))
    n_hyp = _d(counts("hits") + counts("subs") + counts("ins"))
    kept = F.when(n_hyp == 0, F.lit(0.0)).otherwise(
        F.try_divide(hits, n_ref) * F.try_divide(hits, n_hyp)
    )
    return F.when(n_ref > 0, F.lit(1.0) - kept)


# Metric names, in report order, with the counts that each one needs.
METRICS: dict[str, tuple[Callable[[Callable[[str], Column]], Column], tuple[str, ...]]] = {
    "WER": (wer, WORD_COUNTS),
    "CER": (cer, CHAR_COUNTS),
    "MER": (mer, WORD_COUNTS),
    "WIL": (wil, WORD_COUNTS),
}


def resolve_metrics(names: Sequence[str]) -> list[str]:
    """Upper-cased metric names; an unknown one is an error."""
    out = []
    for name in names:
        if name.upper() not in METRICS:
            raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
        out.append(name.upper())
    return out


def needed_counts(metrics: Sequence[str]) -> list[str]:
    wanted = {c for m in resolve_metrics(metrics) for c in METRICS[m][1]}
    return [c for c in (*WORD_COUNTS, *CHAR_COUNTS) if c in wanted]


def rate(metric: str, counts: Callable[[str], Column] | None = None) -> Column:
    """Metric as a fraction; ``counts`` maps a count name to a column (the
    column of the same name unless given).  NULL for an empty reference."""
    (name,) = resolve_metrics([metric])
    return METRICS[name][0](counts or F.col)


def round_half_even_exact(value: Column, digits: int = 2) -> Column:
    """Decimal rounding of the exact binary value, ties to even.

    ``round`` and ``bround`` work on the printed decimal, so 2.675 (which is
    stored just below its print) goes up; here it goes down, as it does in
    Python.  The product with the power of ten is split into a rounded part
    and its exact error, and the error decides what looks like a tie.
    """
    scale = float(10**digits)
    split = F.lit(134217729.0) * value
    high = split - (split - value)
    low = value - high
    product = value * F.lit(scale)
    error = (high * F.lit(scale) - product) + low * F.lit(scale)
    floor = F.floor(product).cast("double")
    part = product - floor
    up = (
        F.when(part != 0.5, part > 0.5)
        .when(error != 0.0, error > 0.0)
        .otherwise(F.pmod(floor, F.lit(2.0)) == 1.0)
    )
    return (floor + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(scale)


def percent(metric: str, counts: Callable[[str], Column] | None = None) -> Column:
    """Metric in percent with two decimals, the form that is stored."""
    return round_half_even_exact(rate(metric, counts) * F.lit(100.0))


def with_percents(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add columns of rates in percent with two decimals.

    The rates get a projection of their own: rounding mentions its input many
    times, and an input that is a column keeps the expressions small enough
    for code generation.
    """
    raw = {f"__{name}": value * F.lit(100.0) for name, value in values.items()}
    exact = {name: round_half_even_exact(F.col(f"__{name}")) for name in values}
    return df.withColumns(raw).withColumns(exact).drop(*raw)
