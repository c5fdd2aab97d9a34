import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hearscore.llm import perplexity
from hearscore.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def brute(rows, held):
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    out = {}
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in own)
        out.setdefault(i, []).append((held(i), len(own), sum(counts[t] > 0 for t in own), total, base))
    return out


def compare(rows, want):
    assert len(rows) == sum(map(len, want.values()))
    for r in rows:
        held, n, known, total, base = want[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op8_lm_scoring"](spark, SF).collect()
    compare(got, brute(rows, lambda i: zlib.crc32(str(i).encode()) % 10 == 0))
    held = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.1  # log10 per token, on texts it hasn't learned from


def test_small_tables_hold_few_counts(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "LOOKUP", 12)
    rows = [(k, " ".join(f"w{(k * j) % (7 + j)}" for j in range(k % 40))) for k in range(80)]
    rows += [(81, None), (82, ""), (83, "new words w1 new"), (84, "Same é"), (84, "Same é")]
    docs = spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, word string, row double")
    got = perplexity.score(docs, perplexity.F.col("doc_id") % 10 == 3).collect()
    compare(got, brute(rows, lambda i: i % 10 == 3))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert perplexity.score(docs, perplexity.F.lit(False)).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = perplexity.score(one, perplexity.F.lit(True)).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)


def test_probabilities_sum_to_one():
    r = np.random.default_rng(1)
    size = 50
    counts = r.integers(5, 50, size).astype(float)
    classes = np.full(1 << 16, perplexity.CLASSES - 1, dtype=np.uint8)
    classes[:size] = perplexity.group_words(r.integers(0, 9, (size, 16)).astype(float), counts)
    classes[perplexity._START] = perplexity.CLASSES
    mass = np.bincount(classes[:size], counts, perplexity.CLASSES)
    within = np.zeros(1 << 16)
    within[:size] = np.log10(counts / mass[classes[:size]])
    weights = r.normal(size=(int(perplexity._AT[-1]), perplexity.CLASSES)).astype(np.float32)
    model = perplexity.Model(classes, within, r.normal(size=perplexity.CLASSES).astype(np.float32), weights)
    core = np.array([3, 8, 4], dtype=np.uint16)
    odds, total = model.odds(model.features(core, np.array([0, 3])))
    share = odds / total[:, None]
    assert share.sum(1) == pytest.approx(np.ones(3))
    for k in np.unique(classes[:size]):
        assert (10 ** within[:size])[classes[:size] == k].sum() == pytest.approx(1)


def test_shifts_stay_in_a_text():
    core = np.array([1, 2, 3, 4, 5], dtype=np.uint16)
    start = perplexity._START
    assert perplexity._shifted(core, np.array([0, 3, 4, 5]), 1).tolist() == [start, 1, 2, start, start]
    assert perplexity._shifted(core, np.array([0, 3, 5]), 2).tolist() == [start, start, 1, start, start]
