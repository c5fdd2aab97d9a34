import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from hearscore.llm import ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def brute(docs, items, top=50):
    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    bags = [b for b in bags if b[2]]
    n_docs, n_terms = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    rows = []
    for item, own in asked.items():
        scored = []
        for d, bag, n in bags:
            m = 100 - 50 + 50 * n * n_docs // n_terms
            score = 0
            for t in own & set(bag):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0 and d is not None:
                scored.append((-score, d))
        rows += [(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(rows)


def found(spark, docs, items, top=50):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, term string, rank int")
    items = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")
    return sorted(map(tuple, ranked.rank(docs, items, top).collect()))


def corpus(r, n, words=400):
    vocabulary = [f"w{int(words * r.random() ** 3)}" for _ in range(4 * words)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 20, 60, 200])))) for i in range(n)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 5, 20])))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many segments, blocks of items, steps and long lists
        for name, value in {"_SEGMENT": 6000, "_STEP": 5, "_BLOCK": 4, "_SHORT": 40, "_TERMS": 20}.items():
            monkeypatch.setattr(ranked, name, value)
    docs, items = corpus(random.Random(4), 500)
    docs += [(900, None), (901, ""), (902, "--- !"), (3, docs[3][1]), (3, docs[8][1]), (None, docs[5][1]), (904, "W1, É w2")]
    docs += [(1000 + i, docs[17][1]) for i in range(70)]  # equal scores beyond the last rank
    items += [(50, None), (51, "..."), (52, "zebra"), (53, docs[17][1]), (53, "w5"), (None, "w1 w2"), (54, "É")]
    want = brute(docs, items)
    assert {r for _, r, _, _ in want} == set(range(1, 51))
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, 3) == brute(docs, items, 3)


def test_a_term_in_every_document(spark):
    docs = [(i, "same " * (i % 7 + 1) + f"own{i}") for i in range(300)]
    assert found(spark, docs, [(1, "same"), (2, "same own5")]) == brute(docs, [(1, "same"), (2, "same own5")])


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, "a b")], [(1, "c")]) == []


def lists_of(r, n_docs, lengths, measure, m):
    lists = []
    for length in lengths:
        docs = np.sort(r.choice(n_docs, length, replace=False))
        tfs = r.integers(1, 9, length).astype(np.int32)
        weight = int(3000 / (1 + length / 50))
        gains = measure.gain(weight, tfs, m[docs])
        bounds = np.maximum.reduceat(gains, np.arange(0, length, ranked._BLOCK))
        lists.append(ranked.Postings(docs, bounds, tfs, weight))
    return lists


def test_skips_and_finds_the_best():
    r = np.random.default_rng(3)
    n_docs = 20_000
    n = r.integers(5, 400, n_docs)
    measure = ranked.Measure(n_docs, int(n.sum()))
    m = measure.lengths(n)
    named = np.ones(n_docs, dtype=bool)
    for lengths in ([15_000, 9_000, 300, 40], [12_000], [60, 60, 10], [20_000, 18_000, 16_000]):
        lists = lists_of(r, n_docs, lengths, measure, m)
        best = ranked.Best(10)
        seen = ranked.search_segment(lists, m, np.arange(n_docs) * 3, named, measure, best)
        total = np.zeros(n_docs, np.int64)
        for one in lists:
            total[one.docs] += one.scores(slice(None), m, measure)
        order = np.lexsort((np.arange(n_docs), -total))[:10]
        assert best.ids.tolist() == (order * 3).tolist() and best.scores.tolist() == total[order].tolist()
        if lengths[-1] == 40:
            assert seen < 4000  # long lists are skipped over


def test_lengths_of_a_huge_corpus():
    measure = ranked.Measure(10**13, 10**16)
    n = np.array([3, 40_000_000])
    assert measure.lengths(n).tolist() == [50 + 50 * int(x) * 10**13 // 10**16 for x in n]
