import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hearscore.llm import decontaminate
from hearscore.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    wanted = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if n else ():
            wanted.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    sizes = {len(k) for k in wanted}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (own := wanted.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= own
        out.append((d, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=str)


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, terms int"),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, places int"),
    )


def made(seed):
    r = random.Random(seed)
    vocabulary = ["The", "of", "and", "é", "naïve", "X9", *(f"w{k}" for k in range(25))]
    say = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(n))
    items = [(k, say(r.choice([1, 3, 5, 6, 12, 20]))) for k in range(9)] + [(20, None), (21, "..."), (4, say(8))]
    docs = []
    for d in range(80):
        text = say(r.randint(0, 30))
        for _ in range(r.randint(0, 3)):
            w = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(w) - 2))
            text += " " + " ".join(w[a : a + r.randint(2, 20)]) + " " + say(r.randint(0, 9))
        docs.append((d, text))
    return docs + [(3, docs[3][1]), (None, docs[5][1]), (99, None), (98, "")], items


@pytest.mark.parametrize("block", [500_000, 30])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "_BLOCK", block)
    docs, items = made(7)
    got = decontaminate.search(*tables(spark, docs, items), window=5)
    rows = sorted(((r.doc_id, r.n_words, r.hits, r.items) for r in got.collect()), key=str)
    assert rows == brute(docs, items, 5)


def brute_near(docs, items, window, slop):
    """Proximity matches by trying every place of every document."""
    bags = [(d, words(t)) for d, t in docs]
    often = Counter(w for _, bag in bags for w in bag)
    out = []
    for d, bag in bags:
        near = set()
        for i, t in items:
            w = words(t)
            n = min(window, len(w))
            for s in range(len(w) - n + 1) if n else ():
                phrase = w[s : s + n]
                order = sorted(range(n), key=lambda k: often[phrase[k]])[: decontaminate.ANCHORS]
                for at in range(len(bag)):
                    if bag[at] == phrase[order[0]]:
                        start = at - order[0]
                        if all(
                            any(phrase[k] == bag[x] for x in range(max(0, start + k - slop), min(len(bag), start + k + slop + 1)))
                            for k in order[1:]
                        ):
                            near.add(str(i))
        out.append((d, sorted(near)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [1, 50, 1 << 18])
def test_bounded_steps(spark, monkeypatch, bound):
    """Phrases in runs of few places, items in pieces: the same results."""
    monkeypatch.setattr(decontaminate, "_PLACES", bound)
    monkeypatch.setattr(decontaminate, "_PIECE", 2 if bound < 100 else 100_000)
    monkeypatch.setattr(decontaminate, "_BLOCK", 40 if bound < 100 else 500_000)
    docs, items = made(3)
    docs, items = docs[:30], [x for x in items if x[0] != 4]
    got = decontaminate.search(*tables(spark, docs, items), window=5, slop=1).collect()
    assert sorted(((r.doc_id, r.n_words, r.hits, r.items) for r in got), key=str) == brute(docs, items, 5)
    assert sorted(((r.doc_id, r.near) for r in got), key=str) == brute_near(docs, items, 5, 1)


def test_few_words_many_places():
    """A slice of 50 words over and over against a long item of them."""
    r = random.Random(1)
    text = " ".join(f"w{r.randint(0, 49)}" for _ in range(200_000))
    item = " ".join(f"w{r.randint(0, 49)}" for _ in range(3000))
    found = decontaminate._words(pa.array([text]))
    order = np.argsort(found.hashes, kind="stable")
    known, counts = np.unique(found.hashes, return_counts=True)
    place = np.arange(len(found)) + decontaminate._first_places(found.counts)[0]
    kinds = {"doc_ids": np.int64, "known": bool, "lengths": np.int32, "terms": np.uint64, "counts": np.int32, "places": np.int64}
    values = ([1], [True], found.counts, known, counts, place[order])
    row = {c: np.asarray(v, dtype=kind).tobytes() for (c, kind), v in zip(kinds.items(), values)}
    segment = decontaminate.Segment(row)
    terms = decontaminate._words(pa.array([item])).hashes
    (own,) = decontaminate.phrases([terms], {}, 13)
    tracemalloc.start()
    found = sum(len(segment.exact(part)[0]) + len(segment.near(part, 2)[0]) for part in segment.parts(own))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found >= 0 and peak < 150 << 20


def test_proximity(spark):
    item = "alpha beta gamma delta"
    docs = [(1, "so alpha beta x gamma y delta z"), (2, "alpha a b c d e beta gamma delta"), (3, item), (4, "beta gamma")]
    got = decontaminate.search(*tables(spark, docs, [(7, item)]), slop=2)
    rows = {r.doc_id: (r.items, r.near) for r in got.collect()}
    assert rows == {1: ([], ["7"]), 2: ([], []), 3: (["7"], ["7"]), 4: ([], [])}


def test_empty_tables(spark):
    docs, items = made(2)
    none = tables(spark, [], [])
    full = tables(spark, docs, items)
    assert decontaminate.search(none[0], full[1]).collect() == []
    assert all(not r.hits and not r.items for r in decontaminate.search(full[0], none[1]).collect())


def test_long_text(spark):
    long = " ".join(f"w{k % 997}" for k in range(60000))
    docs = [(1, long), (2, "w1 w2")]
    items = [(1, " ".join(f"w{k}" for k in range(40, 60)))]
    got = {r.doc_id: r for r in decontaminate.search(*tables(spark, docs, items)).collect()}
    assert len(got[1].hits) == 20 * 61 and got[1].n_words == 60000 and got[2].hits == []


def test_query(spark):
    path = "/root/testdata/sf0.001"
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{path}/{name}.parquet").select(key, "text").collect()]
    want = brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    got = sorted(QUERIES["op4_benchmark_decontamination"](spark, path).collect(), key=lambda r: str(r.doc_id))
    want.sort(key=lambda r: str(r[0]))
    assert len(got) == len(want)
    for r, (d, n, hits, found) in zip(got, want):
        assert (r.doc_id, r.n_words, r.n_hit, r.n_items) == (d, n, len(hits), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.contaminated == (len(hits) > 0 and 20 * len(hits) >= n)
