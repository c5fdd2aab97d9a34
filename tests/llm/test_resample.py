import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hearscore.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, runs=1):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, share=10, min_words=20, runs=1, buckets=10_000, seed=2024):
    def count(texts):
        return Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in grams(t, runs))

    s, t = count(x for _, x in docs), count(target)
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)
    ]
    rows = []
    for d, text in docs:
        own = [zlib.crc32(g.encode()) % buckets for g in grams(text, runs)]
        weight = sum(gain[b] for b in own)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(own), weight, score, None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= min_words and r[0] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for k, row in enumerate(able[: share * len(able) // 100]):
        row[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def found(spark, docs, target, **kind):
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id long, text string, score string, block int")
    target = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    return sorted(map(tuple, resample.resample(docs, target, **kind).collect()), key=str)


def corpus(r, n):
    docs = []
    for i in range(n):
        own = [f"w{int(300 * r.random() ** 2)}" for _ in range(r.choice([0, 3, 19, 20, 21, 60, 200]))]
        docs.append((i, "-".join(own).title()))
    return docs, [" ".join(f"W{r.randint(0, 60)}" for _ in range(30)) for _ in range(20)]


@pytest.mark.parametrize("kind", [{}, {"share": 55, "runs": 2, "buckets": 97, "min_words": 3}])
def test_against_brute_force(spark, kind):
    docs, target = corpus(random.Random(2), 400)
    docs += [(900, None), (901, ""), (902, "é Ü x"), (-(2**62), docs[5][1]), (2**63 - 1, docs[6][1]), (None, docs[6][1])]
    docs += [(6, docs[6][1]), (6, docs[6][1]), (None, None), (903, "y" * 500 + " z")]
    target += [None, ""]
    want = brute(docs, target, **kind)
    assert sum(r[4] is not None for r in want) > 20
    assert found(spark, docs, target, **kind) == want


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [], ["a"]) == []
    docs = [(1, "a b " * 30), (2, "c " * 30)]
    assert found(spark, docs, [], share=100) == brute(docs, [], share=100)


def test_crc(monkeypatch):
    r = random.Random(3)
    parts = [r.randbytes(n) for n in [0, 1, 2, 3, 4, 5, 5, 5, 8, 63, 64, 65, 66, 300, 0, 7]]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    assert resample.crc32(data, starts, ends).tolist() == [zlib.crc32(p) for p in parts]
    none = np.zeros(0, np.int64)
    assert len(resample.crc32(data, none, none)) == 0


def test_features():
    texts = ["A b a", None, "", "x"]
    found, offsets, n_words = resample.features(pa.array(texts), 2, 1000)
    assert offsets.tolist() == [0, 5, 5, 5, 6] and n_words.tolist() == [3, 0, 0, 1]
    assert Counter(found[:5].tolist()) == Counter(zlib.crc32(g) % 1000 for g in [b"a", b"b", b"a", b"a b", b"b a"])


@pytest.mark.parametrize("block", [7, 64])
def test_radix_ranks(spark, block):
    """Few rows in blocks of few, digits of few bits, ties, extremes."""
    r = random.Random(block)
    wide = [-(2**63), 2**63 - 1, 0, -1]
    rows = [(r.choice([-5, 0, 3, 900, -70_000]), r.choice([*wide, *range(9)]), i % 4) for i in range(300)]
    table = spark.createDataFrame(rows, "score long, id long, kind int")
    got = resample.radix_ranks(table, [("score", True), ("id", False), ("kind", True)], block, 4).collect()
    assert sorted(x.position for x in got) == list(range(300))
    got = [(x.score, x.id, x.kind) for x in sorted(got, key=lambda x: x.position)]
    assert got == sorted(rows, key=lambda x: (-x[0], x[1], -x[2]))


def test_radix_ranks_of_equal_rows(spark):
    table = spark.createDataFrame([(1,)] * 20, "score long")
    assert sorted(x.position for x in resample.radix_ranks(table, [("score", True)], 6).collect()) == list(range(20))
