import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearscore.functions import align, rates, text


def brute_alignment(ref, hyp):
    """Edits and hits under the fixed path rule, on the trimmed pair."""
    head = 0
    while head < min(len(ref), len(hyp)) and ref[head] == hyp[head]:
        head += 1
    r, h = ref[head:], hyp[head:]
    tail = 0
    while tail < min(len(r), len(h)) and r[-1 - tail] == h[-1 - tail]:
        tail += 1
    r, h = r[: len(r) - tail], h[: len(h) - tail]
    cost = [[i + j if not i or not j else 0 for j in range(len(h) + 1)] for i in range(len(r) + 1)]
    for i in range(1, len(r) + 1):
        for j in range(1, len(h) + 1):
            cost[i][j] = min(
                cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (r[i - 1] != h[j - 1])
            )
    i, j, hits = len(r), len(h), head + tail
    while i and j:
        if cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
        elif cost[i][j - 1] == cost[i - 1][j - 1] - 1:
            j -= 1
        else:
            hits += r[i - 1] == h[j - 1]
            i, j = i - 1, j - 1
    return cost[len(r)][len(h)], hits


WORDS = st.lists(st.sampled_from("abcd"), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), max_size=30))
def test_alignment_agrees_with_back_trace(pairs):
    for (ref, hyp), (hits, subs, dels, ins) in zip(
        pairs, align.align_token_pairs(pairs), strict=True
    ):
        assert (subs + dels + ins, hits) == brute_alignment(ref, hyp)
        assert hits + subs + dels == len(ref)
        assert hits + subs + ins == len(hyp)
        assert min(hits, subs, dels, ins) >= 0


def full_table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


SHORT = st.text("abcżó 😀", max_size=90)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(SHORT, SHORT), max_size=12))
def test_char_distances_agree_with_full_table(pairs):
    assert list(align.char_distances(pairs)) == [full_table(a, b) for a, b in pairs]


def test_char_distances_of_mixed_lengths():
    """Lengths around the 64-row blocks, and more pairs than one group."""
    rnd = random.Random(9)

    def word(size):
        return "".join(rnd.choice("abcd ") for _ in range(size))

    sizes = [0, 1, 2, 63, 64, 65, 127, 128, 129, 191, 192, 193, 300]
    pairs = [(word(n), word(m)) for n in sizes for m in sizes]
    for _ in range(60):
        base = word(rnd.randrange(700))
        pairs.append((base, "".join(c for c in base if rnd.random() > 0.1)))
    pairs += [(word(40), word(40))] * 50
    assert list(align.char_distances(pairs)) == [full_table(a, b) for a, b in pairs]
    many = pairs * 40
    assert list(align.char_distances(many)) == list(align.char_distances(pairs)) * 40


def test_long_pairs_beyond_one_group():
    rnd = random.Random(5)
    long = [rnd.choice("abcdefgh") for _ in range(700)]
    other = [w for w in long if rnd.random() > 0.1]
    pairs = [(long, other)] + [(list("ab"), list("ba"))] * 50
    out = align.align_token_pairs(pairs)
    assert (out[0, 1:].sum(), out[0, 0]) == brute_alignment(long, other)
    assert (out[1:] == out[1]).all()


def edited_words(rnd, words, share, vocabulary):
    out = []
    for w in words:
        kind = rnd.random() / share if share else 9
        if kind < 0.3:
            continue
        out.append(rnd.choice(vocabulary) if kind < 0.7 else w)
        if 0.7 <= kind < 1:
            out.append(rnd.choice(vocabulary))
    return out


@pytest.mark.parametrize("band", [1, 2, align._BAND])
def test_band_gives_the_path_of_the_whole_table(monkeypatch, band):
    """Distances, hits and so the tie-break, on pairs near and far."""
    monkeypatch.setattr(align, "_BAND", band)
    rnd, pairs = random.Random(band), []
    while len(pairs) < 7000:
        n = rnd.choice([3, 8, 20, 60])
        vocabulary = list(range(rnd.choice([2, 3, 9, 200])))
        words = [rnd.choice(vocabulary) for _ in range(n)]
        pairs.append((words, edited_words(rnd, words, rnd.choice([0, 0.05, 0.3, 1]), vocabulary)))
    coded = [tuple(np.array(side, np.int32) for side in pair) for pair in pairs]
    found = align.align_coded(coded)
    full = [(i, r, h) for i, (r, h) in enumerate(coded) if len(r) and len(h)]
    for at in range(0, len(full), 500):
        group = full[at : at + 500]
        edits, hits, _ = align._align_group([(r, h) for _, r, h in group])
        rows = found[[i for i, _, _ in group]]
        assert (rows[:, 1:].sum(1) == edits).all()
        whole = align.align_coded([(r, h) for _, r, h in group])
        assert (rows == whole).all()
    for i in range(0, 7000, 35):
        assert (found[i, 1:].sum(), found[i, 0]) == brute_alignment(*pairs[i])


def test_long_pairs_cost_what_differs(monkeypatch):
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(500)]
    words = [rnd.choice(vocabulary) for _ in range(50_000)]
    other = edited_words(rnd, words, 0.01, vocabulary)
    cells, plain = [], align._align_group

    def counted(pairs, band=None):
        found = plain(pairs, band)
        cells.append(found[2])
        return found

    monkeypatch.setattr(align, "_align_group", counted)
    ((hits, subs, dels, ins),) = align.align_token_pairs([(words, other)])
    assert hits + subs + dels == len(words) and hits + subs + ins == len(other)
    assert 350 < subs + dels + ins < 650
    assert sum(cells) < 50_000 * 50_000 / 30


def test_words_are_those_of_the_metrics():
    rnd = random.Random(2)
    parts = ["a", "b", "żó", "😀", " ", "  ", "\t", "\n", "\u00a0", "\u2003", "\x1c", "\x85", "\u3000 ", "\u200b", "-"]
    texts = ["", " ", "\t", " a ", *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000))]
    codes, offsets = align.word_codes(pa.array(texts))
    names: dict = {}
    for text, a, b in zip(texts, offsets[:-1], offsets[1:]):
        words = align.score_tokens(text)
        assert [names.setdefault(int(c), w) for c, w in zip(codes[a:b], words)] == words and b - a == len(words), repr(text)
    assert len(set(names.values())) == len(names)


# (reference, hypothesis, H S D I, WER, CER, MER, WIL)
GOLDEN = [
    ("a b c d", "a x c", (2, 1, 1, 0), 50.0, 42.86, 50.0, 66.67),
    ("a b", "b c", (0, 2, 0, 0), 100.0, 66.67, 100.0, 100.0),
    ("ala ma kota", "ala kota ma psa", (2, 1, 0, 1), 66.67, 72.73, 50.0, 66.67),
    ("dzień dobry", "dzien dobry", (1, 1, 0, 0), 50.0, 9.09, 50.0, 75.0),
    ("one two three", "one two three", (3, 0, 0, 0), 0.0, 0.0, 0.0, 0.0),
    ("żółw", "zolw idzie", (0, 1, 0, 1), 200.0, 225.0, 100.0, 100.0),
    ("b c a", "a b", (1, 0, 2, 1), 100.0, 80.0, 75.0, 83.33),
]


def test_counts_and_rates_of_golden_rows(spark):
    rows = [(i, r, h) for i, (r, h, *_) in enumerate(GOLDEN)] + [(99, None, "a"), (100, "a", None)]
    df = spark.createDataFrame(rows, "i int, r string, h string").withColumn(
        "c", align.edit_counts("r", "h")
    )
    found = df.select("i", "c", "c.*").select(
        "i", "c", *(rates.percent(m).alias(m) for m in rates.METRICS)
    )
    for row in found.collect():
        if row.i >= 99:
            assert row.c is None
            continue
        _, _, counts, *values = GOLDEN[row.i]
        assert tuple(row.c)[:4] == counts
        assert [row.WER, row.CER, row.MER, row.WIL] == values


def test_words_split_on_spaces_and_runs_only():
    assert align.score_tokens("a\tb  c\n\nd  e\nf ") == ["a\tb", "c", "d", "e\nf"]


def test_empty_reference_has_no_rate(spark):
    df = spark.createDataFrame([(" ", "a b")], "r string, h string")
    row = df.select(align.edit_counts("r", "h").alias("c")).select("c.*").select(
        "ins", *(rates.rate(m).alias(m) for m in rates.METRICS)
    ).first()
    assert row.ins == 2
    assert (row.WER, row.CER, row.WIL) == (None, None, None)


def test_rounding_is_that_of_python(spark):
    rnd = random.Random(1)
    values = [0.125, 2.675, 1.005, 0.0, 100.0, 33.335, 1e6 + 0.125, 0.375, 66.665]
    values += [rnd.randrange(10**6) / 1000 for _ in range(3000)]
    values += [rnd.randrange(500) / rnd.randrange(1, 500) * 100 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", rates.round_half_even_exact(F.col("v")).alias("r")).collect():
        assert row.r == round(row.v, 2)


def test_metric_names():
    assert rates.resolve_metrics(["wer", "Cer"]) == ["WER", "CER"]
    with pytest.raises(ValueError):
        rates.resolve_metrics(["bleu"])


# What the normalisations mean, in plain Python.
def py_whitespace(s):
    s = re.sub(r"[ \t\n\r\x0b\x0c]", " ", s)
    return re.sub(r"\s\s+", " ", s).strip()


def py_punctuation(s):
    import unicodedata

    return "".join(c for c in s if not unicodedata.category(c).startswith("P"))


def py_tags(s):
    tags = ("<unk>", "<silence>", "trunc")
    return " ".join(w for w in s.split() if not any(t in w.lower() for t in tags))


PLAIN = {
    "none": lambda s: s,
    "lowercase": str.lower,
    "whitespace": py_whitespace,
    "punctuation": py_punctuation,
    "tags": py_tags,
    "all": lambda s: py_tags(py_punctuation(py_whitespace(s.lower()))),
}
TEXTS = [
    "this is <unk>",
    "a word_trunc TRUNCATE word<unk>word b",
    "a-b, „c” <unk> $5_x…",
    "A - B <UNK> un_trunc",
    "a\t\tb   c",
    "\x1c\x1d x\x1fy  　z \n",
    "",
    "  ",
    "?!",
    "Zażółć GĘŚLĄ jaźń — „ok”",
]


def test_normalisations(spark):
    texts = TEXTS + [r.text for r in spark.read.parquet(
        "/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", *(text.normalise("t", n).alias(n) for n in PLAIN)).collect()
    for row in found:
        for name, plain in PLAIN.items():
            assert row[name] == plain(row.t), (name, row.t)


def test_norm_names():
    with pytest.raises(ValueError):
        text.check_norm_types(["stem"])
    with pytest.raises(NotImplementedError):
        text.check_norm_types(["dictionary"])


def _one(spark, value, column):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ('"say ""hi"""', 'say "hi".'),
        ("Really?", "Really?"),
        ('"', '".'),
        (None, None),
        ('"a\nb"', '"a\nb".'),
        ("", "."),
        ("a\n", "a\n."),
    ],
)
def test_cleanup(spark, raw, clean):
    assert _one(spark, raw, text.transcript_cleanup) == clean


@pytest.mark.parametrize(
    ("path", "name"),
    [
        ("a/b.wav", "b.wav"),
        ("b.wav", "b.wav"),
        ("a/b/", "b"),
        ("a/./", "a"),
        ("a/..", ".."),
        (".", ""),
        ("/", ""),
        ("", ""),
        ("a/.b", ".b"),
    ],
)
def test_clip_id(spark, path, name):
    assert _one(spark, path, text.clip_id) == name


def test_names_and_counts(spark):
    lit = F.lit
    row = spark.range(1).select(
        text.codename(lit("openai"), lit("whisper/Small"), lit("pl-PL")).alias("code"),
        text.display_name(lit("openai"), lit("tiny")).alias("shown"),
        text.dataset_short_name(lit("hub/corpus-v2")).alias("short"),
        text.default_version(lit("2024-12-31").cast("date")).alias("version"),
        text.word_count(lit(None).cast("string")).alias("none"),
        text.word_count(lit(" a b \n c")).alias("three"),
        text.hypothesis_or_sentinel(lit(" \n a ")).alias("said"),
        text.hypothesis_or_sentinel(lit("  ")).alias("empty"),
        text.hypothesis_or_sentinel(lit(None).cast("string")).alias("invalid"),
    ).first()
    assert tuple(row) == (
        "openai_whisper_small_pl-pl", "OPENAI - TINY", "corpus-v2", "2024Q4", 0, 3, "a ", "EMPTY",
        "INVALID",
    )


def test_long_batches_are_scored_in_slices(monkeypatch):
    """What is scored at a time doesn't grow with the batch; the counts are
    those of the batch as a whole, NULL where a side is."""
    r = random.Random(8)
    said = [None if r.random() < 0.1 else " ".join(r.choice("abc") for _ in range(r.randint(0, 40))) for _ in range(600)]
    ref, hyp = pa.array(said[:300], pa.string()), pa.array(said[300:], pa.string())
    pairs = [(a, b) for a, b in zip(said[:300], said[300:]) if a is not None and b is not None]
    want = iter(align.count_pairs(pairs, True, True).to_pylist())
    sizes, whole = [], align.count_pairs

    def count(pairs, words, chars):
        sizes.append(sum(len(a) + len(b) for a, b in pairs))
        return whole(pairs, words, chars)

    monkeypatch.setattr(align, "count_pairs", count)
    monkeypatch.setattr(align, "_SLICE_BYTES", 500)
    found = align.count_in_slices(ref, hyp, True, True).to_pylist()
    assert max(sizes) <= 500 and sum(sizes) == sum(len(a) + len(b) for a, b in pairs)
    for a, b, counts in zip(said[:300], said[300:], found):
        assert counts == (None if a is None or b is None else next(want))
    assert align.count_in_slices(ref[:0], hyp[:0], True, True).to_pylist() == []
