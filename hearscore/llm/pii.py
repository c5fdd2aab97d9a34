"""Personal data in texts, with DataFrame and SQL functions only.

Four kinds (e-mail addresses, IP addresses, card and phone numbers) are found
by fixed rules and always kept.  Beside them, generators of high recall propose
looser spans that may overlap: contacts, numbers, secrets.  Boosted trees judge
these by format and context.  They learn, from a sample of bounded size, which
proposals satisfy a looser rule than the fixed ones: contacts that are e-mail
addresses once "(at)" and "(dot)" are undone, numbers that are phone numbers or
follow a word such as "tel", secrets that follow a telling key.  A threshold per
generator, set on documents left out of training, selects what is added.  What
no rule settles (written like a phone number, but no word says so) is neither
trained on nor counted for a threshold; the trees judge it by its format.

All rules are evaluated within the row of a document: no text is shuffled.
Quantifiers that could try one stretch again and again are possessive and start
at the beginning of a run, which finds the same matches in linear time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearscore.session import stage

# Kinds in the order of the output.
BASE = ("email", "ip", "card", "phone")
ADDED = ("contact", "number", "secret")
KINDS = BASE + ADDED

_LOCAL = "[A-Za-z0-9._%+-]"
_TOKEN = "[A-Za-z0-9_+/-]"
_PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "contact": (
        rf"(?i)(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{{1,63}}+"
        r"(?:(?:\.|\x20\.\x20|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]{2,63}+)+"
    ),
    "number": r"[+(]?[0-9][0-9\x20()./-]{4,40}[0-9]",
    "secret": rf"(?<!{_TOKEN})(?=[A-Za-z_+/-]{{0,64}}+[0-9]){_TOKEN}{{12,}}+",
}
# What a text must have for a pattern to match.
_NEEDS = {"email": "@", "phone": "+"}
_DIGIT = "[0-9]"

# Proposals that the trees are trained on, at most; precision that a threshold
# must reach on left-out documents.
SAMPLE = 20_000
PRECISION = 0.98
_BLOCK = 256


def _sums_before(lengths: Column) -> Column:
    """For an array of numbers, the sum of all earlier ones at each place: sums
    within blocks and over blocks, so that the work stays linear."""

    def running(values: Column) -> Column:
        step = F.aggregate(
            values,
            F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out")),
            lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")),
        )
        return step["out"]

    starts = F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(_BLOCK))
    blocks = F.transform(starts, lambda i: F.slice(lengths, i, _BLOCK))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
    return F.flatten(
        F.transform(
            F.arrays_zip(blocks.alias("block"), running(totals).alias("before")),
            lambda z: F.transform(running(z["block"]), lambda x: x + z["before"]),
        )
    )


def _located(text: Column, kind: str) -> Column:
    """Matches of a pattern with their places in code points and what stands
    around them: the gaps between matches give the places."""
    pattern = F.lit(_PATTERNS[kind])
    # n matches have n + 1 gaps; the last gap is followed by nothing.
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, _PATTERNS[kind], -1)
    rows = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    before = _sums_before(F.transform(rows, lambda r: F.char_length(r["gap"]) + F.char_length(r["m"])))
    found = F.transform(
        F.arrays_zip(rows.alias("row"), before.alias("before"), F.slice(gaps, 2, F.size(matches)).alias("next")),
        lambda z: F.struct(
            (z["before"] + F.char_length(z["row"]["gap"])).alias("start"),
            (z["before"] + F.char_length(z["row"]["gap"]) + F.char_length(z["row"]["m"])).alias("stop"),
            z["row"]["m"].alias("m"),
            F.right(z["row"]["gap"], F.lit(24)).alias("left"),
            F.left(z["next"], F.lit(4)).alias("right"),
        ),
    )
    need = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike(_DIGIT)
    if kind == "contact":
        need = text.rlike(r"(?i)@|[(\[]at[)\]]")
    none = F.array().cast("array<struct<start:int,stop:int,m:string,left:string,right:string>>")
    return F.when(need, found).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits ends with its check digit."""
    last = F.reverse(digits)
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.struct(i.alias("i"), F.substr(last, i, F.lit(1)).cast("int").alias("d")))
    total = F.aggregate(
        values,
        F.lit(0),
        lambda s, x: s + F.when(x["i"] % 2 == 1, x["d"]).when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2),
    )
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _holds_base(match: Column, kinds: tuple[str, ...] = BASE) -> Column:
    """Whether a string has a span of one of the fixed kinds."""

    def holds(kind: str) -> Column:
        return F.exists(F.regexp_extract_all(match, F.lit(_PATTERNS[kind]), F.lit(0)), lambda m: _valid(kind, m))

    return reduce(lambda a, b: a | b, map(holds, kinds))


_KEYED = r"(?i)(?:pass|pwd|token|secret|key|auth)[a-z_]*+[\x22\x27]?\x20?[:=]\x20?[\x22\x27]?$"

# Words that announce a phone number, and such that announce another one.
_CALLED = (
    r"(?i)(?<!\p{L})(?:t[eé]l|t[eé]l[eé](?:ph|f)on[a-z]*+|phone|mobile|cell|handy|fax|call|dial|sms|whatsapp)"
    r"(?:\x20(?:no|nr|number|us|me|now|at|on|is))*+\.?\x20?[:=#]?\x20?[\x22\x27]?$"
)
_OTHERWISE = r"(?i)(?:(?<!\p{L})(?:isbn|issn|doi|id|order|page|version|section|sku|item|ref|invoice)(?:\x20(?:no|nr|number))?+\.?\x20?[:=#]?\x20?|[$€£#])$"
_DATED = r"^(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![0-9])|^[0-9]+(?:\.[0-9]+){3}$"
_GROUPED = r"^\(|[0-9][\x20)./-]+[0-9]+[\x20./-]+[0-9]"


def _sure_contact(match: Column) -> Column:
    """Whether a string is an e-mail address once its signs are undone."""
    plain = F.regexp_replace(match, r"(?i)\x20?(?:@|\(at\)|\[at\])\x20?", "@")
    plain = F.regexp_replace(plain, r"(?i)\x20?(?:\.|\(dot\)|\[dot\])\x20?", ".")
    return plain.rlike(rf"^{_LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}$")


def _sure_number(c: Column) -> Column:
    """Whether a number is one to call: null if nothing tells."""
    phone_like = F.length(_digits(c["m"])).between(7, 15) & ~c["m"].rlike(_DATED)
    return (
        F.when(_holds_base(c["m"], ("phone",)), True)
        .when(_holds_base(c["m"], ("ip", "card")), None)
        .when(~phone_like | c["left"].rlike(_OTHERWISE), False)
        .when(c["left"].rlike(_CALLED), True)
        .when(c["m"].rlike(_GROUPED), None)
        .otherwise(False)
    )


def _count(text: Column, what: str) -> Column:
    return F.regexp_count(text, F.lit(what)).cast("double")


def _features(c: Column, kind: str) -> dict[str, Column]:
    """Format and context, without what defines the fixed rules (@, +, check
    digits): a looser form must not differ by that."""
    m = c["m"]
    shared = {
        "length": F.char_length(m).cast("double"),
        "digits": _count(m, "[0-9]"),
        "lower": _count(m, "[a-z]"),
        "upper": _count(m, "[A-Z]"),
        "spaces": _count(m, r"\x20"),
        "dots": _count(m, r"\."),
        "hyphens": _count(m, "-"),
        "brackets": _count(m, r"[()\[\]]"),
        "kinds_of_characters": F.size(F.array_distinct(F.split(m, ""))).cast("double"),
        "groups": _count(m, "[0-9]+"),
        "left_word": c["left"].rlike(r"[A-Za-z]\x20?$").cast("double"),
        "left_mark": c["left"].rlike(r"[:=#(\x22]\x20?$").cast("double"),
        "right_word": c["right"].rlike(r"^\x20?[a-z]").cast("double"),
        "right_end": c["right"].rlike(r"^(?:$|[\n.,;)\x22])").cast("double"),
    }
    return shared | {f"is_{k}": F.lit(float(k == kind)) for k in ADDED}


def _proposals(text: Column, kind: str) -> Column:
    """Proposals of a generator: place, features, whether they are known to be
    (``sure``; null if nothing tells), and whether they hold a base span."""

    def one(c: Column) -> Column:
        if kind == "secret":
            sure, held = c["left"].rlike(_KEYED), F.lit(False)
        else:
            sure, held = _sure_contact(c["m"]) if kind == "contact" else _sure_number(c), _holds_base(c["m"])
        return F.struct(
            F.lit(kind).alias("kind"),
            c["start"].alias("start"),
            c["stop"].alias("stop"),
            sure.alias("sure"),
            held.alias("held"),
            *(value.alias(name) for name, value in _features(c, kind).items()),
        )

    return F.transform(_located(text, kind), one)


def _span(kind: str, c: Column) -> Column:
    return F.struct(
        c["start"].alias("start"), F.lit(KINDS.index(kind)).alias("no"), c["stop"].alias("stop"), F.lit(kind).alias("kind")
    )


def _scan(docs: DataFrame) -> DataFrame:
    """Base spans and proposals of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), text.alias("t"))

    def base(kind: str) -> Column:
        valid = F.filter(_located(F.col("t"), kind), lambda c: _valid(kind, c["m"]))
        return F.transform(valid, lambda c: _span(kind, c))

    return rows.select(
        "doc_id", "hash", F.array_sort(F.concat(*map(base, BASE))).alias("base"), F.concat(*(_proposals(F.col("t"), k) for k in ADDED)).alias("proposals")
    )


# Names of the features, in the order of ``_features``.
_NAMES = [
    "length", "digits", "lower", "upper", "spaces", "dots", "hyphens", "brackets",
    "kinds_of_characters", "groups", "left_word", "left_mark", "right_word", "right_end",
    *(f"is_{k}" for k in ADDED),
]


def _judged(proposals: DataFrame, sample: int, precision: float) -> DataFrame | None:
    """Proposals that the trees select, or None if there is nothing to learn
    from."""
    rows = VectorAssembler(inputCols=_NAMES, outputCol="features").transform(
        proposals.withColumn("label", F.col("sure").cast("double"))
    )
    left_out = F.pmod(F.xxhash64("doc_id", "hash"), F.lit(5)) == 0
    learn = (
        rows.filter(~left_out & F.col("label").isNotNull())
        .select("doc_id", "hash", "kind", "start", "features", "label")
        .orderBy(F.xxhash64("doc_id", "hash", "start"), "start", "kind")
        .limit(sample)
    )
    learn = stage(learn, "pii_sample")
    if {r.label for r in learn.select("label").distinct().collect()} != {0.0, 1.0}:
        return None
    trees = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=7, maxBins=32).fit(learn)
    scored = trees.transform(rows).withColumn("p", vector_to_array("probability")[1])
    bins = (
        scored.filter(left_out & F.col("label").isNotNull())
        .groupBy("kind", F.floor(F.col("p") * 100).alias("bin"))
        .agg(F.sum("label").alias("good"), F.count("*").alias("n"))
        .collect()  # at most 101 rows per generator
    )
    keep = F.lit(False)
    for kind in ADDED:
        good = n = 0.0
        least = None
        for r in sorted((r for r in bins if r.kind == kind), key=lambda r: -r.bin):
            good, n = good + r.good, n + r.n
            if good >= precision * n:
                least = r.bin / 100
        if least is not None:
            keep |= (F.col("kind") == kind) & (F.col("p") >= max(least, 0.5))
    # What holds a span of a fixed kind is found already.
    return scored.filter(keep & ~F.col("held"))


def find(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> DataFrame:
    """``doc_id, hash, base, spans`` for every row: arrays of (start, no, stop,
    kind) in order; places are code points, ``stop`` is exclusive, ``no`` is
    the place of the kind in ``KINDS``; ``hash`` is that of the text.

    ``spans`` are the base spans and those the trees add.  Only ``doc_id`` and
    ``text`` are read; a null text is empty.
    """
    rows = stage(_scan(docs), "pii")
    proposals = rows.filter(F.size("proposals") > 0).select("doc_id", "hash", F.inline("proposals"))
    added = _judged(proposals, sample, precision)
    if added is None:
        return rows.select("doc_id", "hash", "base", F.col("base").alias("spans"))
    number = F.element_at(F.create_map(*(x for k in ADDED for x in (F.lit(k), F.lit(KINDS.index(k))))), F.col("kind"))
    span = F.struct("start", number.alias("no"), "stop", "kind")
    more = (
        added.groupBy(F.col("doc_id").alias("id"), F.col("hash").alias("of"))
        .agg(F.collect_set(span).alias("more"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("of"))  # null ids match as well
    return rows.join(more, same, "left").select(
        "doc_id",
        "hash",
        "base",
        F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"),
    )


def written(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by ``[kind]``; a span that begins in
    an earlier one extends it."""
    kind = "struct<at:int,out:array<string>>"
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(kind),
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(
                x["stop"].alias("at"),
                F.concat(
                    s["out"],
                    F.array(F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.concat(F.lit("["), x["kind"], F.lit("]"))),
                ).alias("out"),
            ).cast(kind),
        ).otherwise(F.struct(F.greatest(s["at"], x["stop"]).alias("at"), s["out"].alias("out")).cast(kind)),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, s["at"] + 1)),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans of their texts replaced by ``[kind]``; a column
    ``n_chars`` follows the text."""
    found = (
        find(docs)
        .filter(F.size("spans") > 0)
        .dropDuplicates(["doc_id", "hash"])
        .select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.col("spans").alias("__spans"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("__spans")))
    # In a step of its own: within lambdas, a name is that of the new column.
    rows = docs.join(found, same, "left").withColumn("__text", text)
    new = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        length = F.char_length("__text").cast("long")
        new["n_chars"] = F.when(F.col("__spans").isNotNull(), length).otherwise(F.col("n_chars"))
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))
