import random
import re

import numpy as np
import pyarrow as pa
import pytest

from hearscore.llm import graph, jaccard
from hearscore.llm import words as W
from hearscore.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, similarity=90):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(a), find(i)) for i, a in sets)


def found(spark, rows, **kind):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class string, n int")
    return sorted(map(tuple, jaccard.link(docs, **kind).collect()), key=str)


def near_copies(r, n):
    """Texts of many sizes and copies with a few edits: similarities around
    the threshold, and chains of links."""
    rows = []
    while len(rows) < n:
        size = r.choice([1, 2, 3, 8, 11, 12, 30, 60, 61, 150, 400])
        words = [f"w{r.randint(0, 400)}" for _ in range(size)]
        for _ in range(r.choice([1, 1, 4, 12])):
            edited = list(words)
            for _ in range(r.randint(0, max(1, size // 40))):
                at = r.randrange(len(edited))
                if r.random() < 0.5:
                    edited[at] = f"e{r.randint(0, 9999)}"
                else:
                    edited.insert(at, f"e{r.randint(0, 9999)}")
            rows.append(" ".join(edited))
            if r.random() < 0.3:
                words = edited
    r.shuffle(rows)
    return list(enumerate(rows[:n]))


def test_against_brute_force(spark):
    rows = near_copies(random.Random(11), 260)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One TWO"), (904, "one two"), (905, rows[0][1])]
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(want) - 40
    assert found(spark, rows) == sorted(want, key=str)


def test_blocks_of_large_clusters(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_ROWS", 6)
    rows = near_copies(random.Random(5), 120)
    base = [f"b{k}" for k in range(80)]
    r = random.Random(8)
    for k in range(40):
        edited = list(base)
        for _ in range(r.randint(0, 3)):
            edited[r.randrange(80)] = f"z{r.randint(0, 999)}"
        rows.append((500 + k, " ".join(edited)))
    assert found(spark, rows) == sorted(brute(rows), key=str)


def linked_sets(r, size, similarity):
    """Two sets as far apart as a link allows, or nearer."""
    a = r.integers(1, 2**63, size).astype(np.uint64)
    low = -(-similarity * size // 100)
    kept = a[r.integers(0, size - low + 1) :]
    most = max(0, 100 * len(kept) // similarity - size)
    b = np.concatenate([kept, r.integers(1, 2**63, r.integers(0, most + 1)).astype(np.uint64)])
    assert 100 * len(kept) >= similarity * (size + len(b) - len(kept))
    return a, b


@pytest.mark.parametrize("similarity", [30, 50, 60, 80, 90, 100])
def test_linked_sets_share_first_columns(similarity):
    r = np.random.default_rng(similarity)
    for size in [1, 2, 3, 9, 10, 17, 26, 43, 90, 300, 371, 1000]:
        for _ in range(30):
            a, b = linked_sets(r, size, similarity)
            least = jaccard.least_overlap(len(a), len(b), similarity)
            assert len(np.intersect1d(a, b)) >= least
            extra = jaccard.least_shared(min(len(a), len(b)))
            # Any order will do.
            tops = [set(np.sort(W.mix(x))[: len(x) - least + extra].tolist()) for x in (a, b)]
            assert len(tops[0] & tops[1]) >= min(extra, least)
            for x in (a, b):
                assert len(x) - least + extra <= jaccard.first_columns(len(x), similarity) or len(x) <= jaccard.first_columns(len(x), similarity)
                assert extra >= jaccard.least_shared(-(-similarity * len(x) // 100))


@pytest.mark.parametrize("similarity", [50, 60, 80, 95])
@pytest.mark.parametrize("full", [64, 2])
def test_other_similarities(spark, monkeypatch, similarity, full):
    monkeypatch.setattr(jaccard, "_FULL", full)
    r = random.Random(similarity)
    rows = near_copies(r, 120)
    for size in (10, 26, 60, 200):  # lengths far apart
        words = [f"v{r.randint(0, 9000)}" for _ in range(size)]
        for _ in range(5):
            more = [f"u{r.randint(0, 9000)}" for _ in range(r.randint(0, size))]
            rows.append((2000 + len(rows), " ".join(words + more)))
    want = brute(rows, similarity)
    assert found(spark, rows, similarity=similarity) == sorted(want, key=str)


def test_pairs_of_columns():
    """Counts of a batch are those of all pairs of its columns."""
    r = np.random.default_rng(7)
    columns = [r.choice(40, k, replace=False) for k in (1, 2, 2, 3, 9, 9, 20)]
    member = [[{"class": int(c), "n": 100, "place": 0} for c in own] for own in columns]
    kind = pa.list_(pa.struct([("class", pa.int64()), ("n", pa.int64()), ("place", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(member, kind)], names=["members"])
    got = {}
    for part in jaccard._pair_rows(90)([batch]):
        for row in part.to_pylist():
            assert (row["a"], row["b"]) not in got and row["a"] < row["b"]
            got[row["a"], row["b"]] = row["both"]
    want = {}
    for own in columns:
        for x in own:
            for y in own:
                if x < y:
                    want[int(x), int(y)] = want.get((int(x), int(y)), 0) + 1
    assert got == want


def test_columns_in_common_do_not_gather_documents(spark):
    """Documents that share passages but don't link stay out of clusters."""
    r = random.Random(12)
    shared = [" ".join(f"s{k}x{i}" for i in range(40)) for k in range(3)]
    rows = [(i, " ".join([*(f"t{r.randint(0, 10**6)}" for _ in range(200)), shared[i % 3]])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = spark.sparkContext.broadcast(jaccard._column_counts(docs, 3))
    kind = "doc_id long, key long, class long, n long, column long, place long"
    first = jaccard._keyed(docs).mapInArrow(jaccard._first_rows(3, 80, counts), kind).filter("column IS NOT NULL")
    assert jaccard._candidates(first.select("column", "class", "n", "place"), 80).count() == 0


def test_overlaps():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, n)).astype(np.uint64) for n in (1, 5, 30, 80, 80)]
    got = jaccard.overlaps(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(a, b))


def test_empty_and_odd(spark):
    assert found(spark, []) == []
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, None), (None, "e"), (None, "")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.link(docs).collect()), key=str) == [
        (4, 0, 4), (4, 2, 4), (None, 0, None), (None, 1, None), (None, 2, 4)
    ]
    for similarity in (0, 101):
        with pytest.raises(ValueError):
            jaccard.link(docs, similarity=similarity)


def test_texts_of_one_id(spark):
    rows = [(5, "a b c"), (5, "d e f"), (3, "a b c"), (1, "d e f"), (5, None), (7, "g")]
    assert sorted(set(found(spark, rows))) == [(1, 1, 1), (3, 1, 1), (5, 0, 1), (5, 1, 1), (7, 1, 7)]


def test_distinct(spark):
    a, b = "one text of some words", "another text of other words"
    rows = [(1, a), (1, a), (None, a), (None, a), (2, a), (2, b), (3, a), (4, None), (4, None), (5, " "), (None, "n o"), (None, "n o")]
    docs = spark.createDataFrame([(i, t, k, {"k": k}) for k, (i, t) in enumerate(rows)], "doc_id long, text string, key int, `class` map<string,int>")
    kept = jaccard.distinct(docs)
    assert kept.columns == docs.columns
    got = sorted([(r.doc_id, r.text, r.key) for r in kept.collect()], key=str)
    assert got == sorted([(1, a, 0), (2, b, 5), (4, None, 7), (4, None, 8), (5, " ", 9), (None, "n o", 10)], key=str)
    assert jaccard.distinct(docs.limit(0)).collect() == []


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_components_of_many_shapes(spark):
    """Chains, trees and stars whose numbers are in no order."""
    r = random.Random(17)
    for size in (3, 8, 40):
        number = r.sample(range(10_000), size * 9)
        edges, want = [], {}
        for k in range(9):
            own = number[k * size : (k + 1) * size]
            for i in range(1, size):
                other = own[i - 1] if k % 3 == 0 else own[0] if k % 3 == 1 else own[r.randrange(i)]
                edges.append((own[i], other))
            want |= {x: min(own) for x in own}
        got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == want


def test_a_step_of_components_joins_once(spark, monkeypatch):
    """The driver plans and runs each join of a round one time."""
    joins, stored = {}, graph.stage

    def counted(df, label):
        joins[label] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return stored(df, label)

    monkeypatch.setattr(graph, "stage", counted)
    edges = spark.createDataFrame([(1, 2), (3, 2), (7, 9), (5, 5)], "a long, b long")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7, 5: 5}
    assert joins["small_star"] == joins["large_star"] == 1


def test_shingle_sets():
    texts = ["a b c d", "A B c", "a b", "", None, "x x x x x"]
    hashes, offsets = jaccard.shingle_sets(pa.array(texts), 3)
    assert np.diff(offsets).tolist() == [2, 1, 1, 0, 0, 1]
    assert hashes[offsets[1]] in hashes[: offsets[1]]


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op5_ngram_jaccard_join"](spark, path).collect())) == brute(rows)
