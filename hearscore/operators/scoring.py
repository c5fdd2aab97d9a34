"""From eval input to edit counts and rates.

One row per clip carries the counts of all normalisations side by side
(``__n_<norm>_<count>``): the texts are read, joined and shuffled once and not
once per normalisation.  The long form, one row per normalisation, is made at
the end with native expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearscore.functions import rates
from hearscore.functions.align import edit_counts_of_variants
from hearscore.functions.text import check_norm_types, clip_id, is_valid_pair, normalise
from hearscore.operators.ordered import BITS, running_totals
from hearscore.operators.selection import cast_text, non_empty_pairs, require_columns, valid_pairs
from hearscore.session import bucketed_stage

RUN_KEYS = ["dataset", "subset", "split", "codename", "version"]


def fan_out(
    pairs: DataFrame, norm_types: Sequence[str], ref: str = "text", hyp: str = "hypothesis"
) -> DataFrame:
    """One row per normalisation, with ``norm_type, reference, hypothesis``
    in place of the two texts; pairs with an empty side are left out."""
    variants = [
        F.struct(
            F.lit(n).alias("norm_type"),
            normalise(ref, n).alias("reference"),
            normalise(hyp, n).alias("hypothesis"),
        )
        for n in check_norm_types(norm_types)
    ]
    kept = [c for c in pairs.columns if c not in (ref, hyp)]
    return non_empty_pairs(pairs.select(*kept, F.inline(F.array(*variants))))


def count_column(norm_type: str, count: str) -> str:
    """Own column of a count; input columns have no leading underscores."""
    return f"__n_{norm_type}_{count}"


def counts_of(norm_type: str) -> Callable[[str], Column]:
    return lambda count: F.col(count_column(norm_type, count))


def score_clips(
    eval_input: DataFrame,
    norm_types: Sequence[str],
    metrics: Sequence[str],
    *,
    tasks: int | None = None,
    ref: str = "text",
    hyp: str = "hypothesis",
    keep_invalid: bool = False,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Eval input rows that can be scored, with the counts of every
    normalisation; those of a normalisation that leaves a side empty are NULL.
    ``keep_invalid`` keeps the other rows, without hypothesis and counts.

    ``tasks`` spreads the rows over that many tasks first: for input that
    has fewer partitions than there are cores (scoring is CPU work); rows alike
    in ``spread_by`` come together.
    """
    norm_types = check_norm_types(norm_types)
    wanted = rates.needed_counts(metrics)
    if keep_invalid:
        rows = eval_input.withColumn(hyp, F.when(is_valid_pair(ref, hyp), F.col(hyp)))
        rows = cast_text(require_columns(rows, ref, hyp), ref, hyp)
    else:
        rows = valid_pairs(eval_input, ref, hyp)
    if tasks:
        rows = rows.repartition(tasks, *spread_by)
    # Each text is made once, in a projection of its own.
    made = {f"__r_{n}": normalise(ref, n) for n in norm_types}
    made |= {f"__h_{n}": normalise(hyp, n) for n in norm_types}
    variants = [
        F.when(
            (F.col(f"__r_{n}") != "") & (F.col(f"__h_{n}") != ""),
            F.struct(F.col(f"__r_{n}").alias("reference"), F.col(f"__h_{n}").alias("hypothesis")),
        )
        for n in norm_types
    ]
    counts = edit_counts_of_variants(
        F.array(*variants), words="hits" in wanted, chars="char_len" in wanted
    )
    return rows.withColumns(made).withColumn("__counts", counts).select(
        *rows.columns,
        *(
            F.col("__counts")[i][c].alias(count_column(n, c))
            for i, n in enumerate(norm_types)
            for c in wanted
        ),
    )


def with_running_counts(
    clips: DataFrame, norm_types: Sequence[str], metrics: Sequence[str], *, bits: int = BITS
) -> DataFrame:
    """Add the counts pooled over the clips of the run up to each one
    (``…_so_far``).  ``clips`` is read twice: pass a stored table."""
    values = [count_column(n, c) for n in norm_types for c in rates.needed_counts(metrics)]
    return running_totals(clips, RUN_KEYS, "sample_idx", values, bits=bits)


# Clips of a bucket: what is joined to them is held in memory, some hundred bytes each.
_CLIPS = 500_000


def running_clips(
    eval_input: DataFrame, norm_types: Sequence[str], metrics: Sequence[str], *, tasks: int | None = None, bits: int = BITS
) -> DataFrame:
    """``score_clips`` with ``with_running_counts``, for clips that are unique by
    run and ``sample_idx``; the texts don't travel for the running values.

    Clips are dealt by a hash of that key before they are scored, and stored as
    a table with these buckets.  Windows run over the counts alone; their sums
    are dealt to the buckets and joined there.  The texts aren't shuffled for
    that, and not sorted unless buckets are too large to hold their sums.
    """
    key = [*RUN_KEYS, "sample_idx"]
    rows = eval_input.withColumn("__row", F.xxhash64(*key)).withColumn("__check", F.xxhash64(F.lit(1), *key))
    buckets = tasks or int(eval_input.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clips = score_clips(rows, norm_types, metrics, tasks=buckets, spread_by=["__row"])
    clips = bucketed_stage(clips, "clip_counts", buckets, "__row")
    values = [count_column(n, c) for n in norm_types for c in rates.needed_counts(metrics)]
    narrow = clips.select(*key, "__row", "__check", *values)
    sums = running_totals(narrow, RUN_KEYS, "sample_idx", values, bits=bits).select(
        F.col("__row").alias("__at"), F.col("__check").alias("__of"), *(f"{v}_so_far" for v in values)
    )
    # Two hashes tell clips apart; only the first one is a key of the buckets.
    same = (F.col("__row") == F.col("__at")) & (F.col("__check") <= F.col("__of")) & (F.col("__check") >= F.col("__of"))
    few = clips.count() <= buckets * _CLIPS
    joined = clips.join(sums.hint("shuffle_hash" if few else "merge"), same)
    return joined.drop("__row", "__check", "__at", "__of")


def results(
    clips: DataFrame,
    norm_types: Sequence[str],
    metrics: Sequence[str],
    *,
    mode: str = "running",
    ref: str = "text",
    hyp: str = "hypothesis",
    counts: bool = False,
    texts: bool = True,
) -> DataFrame:
    """Long result table: one row per clip and normalisation.

    ``mode="running"`` stores under each metric name the value pooled over
    the run so far, and needs ``with_running_counts``; ``mode="sample"``
    stores the value of the clip alone.  ``<metric>_sample`` is always the
    latter.  Values are percentages with two decimals.  Without ``texts`` the
    normalised texts are not made (a summary does not need them).
    """
    if mode not in ("running", "sample"):
        raise ValueError(f"unknown metric mode {mode!r}")
    metrics = rates.resolve_metrics(metrics)
    wanted = rates.needed_counts(metrics)
    sums = [f"{c}_so_far" for c in wanted] if mode == "running" else []

    def variant(n: str) -> Column:
        made = [normalise(ref, n).alias("reference"), normalise(hyp, n).alias("hypothesis")]
        return F.struct(
            F.lit(n).alias("norm_type"),
            *(made if texts else []),
            *(F.col(count_column(n, c)).alias(c) for c in (*wanted, *sums)),
        )

    own = {count_column(n, c) for n in norm_types for c in (*wanted, *(f"{w}_so_far" for w in wanted))}
    kept = [c for c in clips.columns if c not in {ref, hyp, "codename", *own}]
    lead = ["dataset", "subset", "split", "sample_idx", "id", "ref_type", "norm_type", "system"]
    long = clips.select(
        *kept,
        clip_id("audio_path").alias("id"),
        F.lit(ref).alias("ref_type"),
        F.col("codename").alias("system"),
        F.inline(F.array(*(variant(n) for n in norm_types))),
    ).filter(F.col(wanted[-1]).isNotNull())

    def pooled(count: str) -> Column:
        return F.col(f"{count}_so_far" if sums else count)

    main = {m: rates.rate(m, pooled) for m in metrics}
    single = {f"{m}_sample": rates.rate(m) for m in metrics}
    table = rates.with_percents(long, main | single).drop(*sums)
    if not counts:
        table = table.drop(*wanted)
    order = [*lead, *(["reference", "hypothesis"] if texts else []), "audio_path"]
    return table.select(*order, *(c for c in table.columns if c not in order))


def corpus_counts(
    clips: DataFrame,
    norm_types: Sequence[str],
    metrics: Sequence[str],
    keys: Sequence[str] = ("dataset", "subset", "split", "codename", "version"),
) -> DataFrame:
    """Counts pooled per group and normalisation.  The sums are combined
    before the shuffle, so the size of a group does not matter."""
    wanted = rates.needed_counts(metrics)
    first = wanted[0]
    pooled = clips.groupBy(*keys).agg(
        *(
            F.sum(count_column(n, c)).alias(count_column(n, c)) for n in norm_types for c in wanted
        ),
        *(F.count(count_column(n, first)).alias(count_column(n, "rows")) for n in norm_types),
    )
    return by_normalisation(pooled, norm_types, wanted, keys).filter(F.col("sample_count") > 0)


def by_normalisation(
    pooled: DataFrame, norm_types: Sequence[str], wanted: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Pooled counts that stand side by side as one row per normalisation."""
    return pooled.select(
        *keys,
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(n).alias("norm_type"),
                        counts_of(n)("rows").alias("sample_count"),
                        *(counts_of(n)(c).alias(c) for c in wanted),
                    )
                    for n in norm_types
                )
            )
        ),
    )


def corpus_metrics(
    clips: DataFrame,
    norm_types: Sequence[str],
    metrics: Sequence[str],
    keys: Sequence[str] = ("dataset", "subset", "split", "codename", "version"),
) -> DataFrame:
    """Metrics of whole groups from pooled counts, in percent."""
    pooled = corpus_counts(clips, norm_types, metrics, keys)
    return rates.with_percents(pooled, {m: rates.rate(m) for m in rates.resolve_metrics(metrics)})
