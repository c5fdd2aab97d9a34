import hashlib
import re

import pytest

from hearscore.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - size + 1):
            if i is not None and first[tuple(w[s : s + size])] < i:
                gone.update(range(s, s + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=str)


def found(spark, rows, **sizes):
    docs = spark.createDataFrame(
        [(i, t, 1, "x") for i, t in rows], "doc_id long, text string, core int, passage string"
    )
    return sorted(map(tuple, substring.remove_repeats(docs, **sizes).collect()), key=str)


def test_against_brute_force(spark):
    import random

    r = random.Random(3)
    vocabulary = [f"w{k}é" if k % 5 == 0 else f"w{k}" for k in range(60)]
    phrases = [[r.choice(vocabulary) for _ in range(r.randint(5, 30))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(r.randint(0, 6)):
            piece = r.choice(phrases) if r.random() < 0.6 else [r.choice(vocabulary) for _ in range(r.randint(1, 12))]
            cut = r.randint(0, 4)
            words += piece[cut:] if r.random() < 0.4 else piece
        rows.append((i, r.choice([" ", "\n", " \t "]).join(words)))
    rows += [(3, rows[3][1]), (None, rows[4][1]), (70, None), (71, ""), (72, "  \n")]
    rows.append((73, " ".join(phrases[0] * 50)))
    assert found(spark, rows, window=8, core=3) == brute(rows, 8)


def test_default_window_and_copies(spark):
    long = " ".join(f"t{k}" for k in range(4000))
    rows = [(5, long), (2, "a b " + long + " z"), (9, long), (11, " ".join(long.split()[100:149]))]
    assert found(spark, rows) == brute(rows, 50)


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.fixture(scope="module")
def small(spark):
    path = "/root/testdata/sf0.001"
    return path, [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


def test_query(spark, small):
    from hearscore.llm.queries import QUERIES

    path, rows = small
    got = sorted(map(tuple, QUERIES["op1_substring_dedup"](spark, path).collect()))
    want = [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(rows, 50)]
    assert got == sorted(want)
