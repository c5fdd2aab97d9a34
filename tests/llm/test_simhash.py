import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from hearscore.llm import simhash
from hearscore.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """Component of every (id, fingerprint), by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


def brute(rows):
    prints = [(d, brute_print(t)) for d, t in rows]
    return sorted(((d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_groups(prints))), key=str)


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, print string, cell int")
    got = simhash.group(docs).select("doc_id", simhash.written(), "component_id")
    return sorted(map(tuple, got.collect()), key=str)


def edited_texts(r, n):
    rows = []
    while len(rows) < n:
        words = [f"W{r.randint(0, 500)}" for _ in range(r.choice([1, 2, 3, 5, 40, 90, 200, 200, 300]))]
        for _ in range(r.choice([1, 2, 6])):
            own = list(words)
            for _ in range(r.choice([0, 1, 1, 2])):
                own[r.randrange(len(own))] = f"é{r.randint(0, 99)}"
            rows.append("  ".join(own))
    return list(enumerate(rows[:n]))


@pytest.mark.parametrize("long", [simhash._LONG, 40])
def test_hash(monkeypatch, long):
    monkeypatch.setattr(simhash, "_LONG", long)
    r = random.Random(1)
    parts = [r.randbytes(n) for n in [*range(0, 80), 95, 96, 97, 300, 511, 512, 513, 2000]]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    for seed in (0, 42, 2**63 + 5):
        assert simhash.xxh64(data, starts, ends, seed).tolist() == [xxhash.xxh64_intdigest(p, seed) for p in parts]


def test_fingerprints(monkeypatch):
    texts = [t for _, t in edited_texts(random.Random(3), 60)] + [None, "", " \n", "A b", "a\tB", "x" * 3000 + " y z"]
    want = [brute_print(t) for t in texts]
    assert simhash.fingerprints(pa.array(texts)).tolist() == want
    monkeypatch.setattr(simhash, "_CHUNK", 7)  # texts over several chunks
    assert simhash.fingerprints(pa.array(texts)).tolist() == want


def test_linked_fingerprints_share_a_cell():
    r = random.Random(5)
    for _ in range(400):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 2)):
            b ^= 1 << bit
        table = simhash.pivot_table(np.array([a, b], np.uint64))
        one, two = simhash.cells(table)
        assert set(one) & set(two)
        assert np.abs(table[0] - table[1]).max() <= 2


def test_cells_tell_quarters_apart():
    """Fingerprints share a cell just if they agree in its two quarters."""
    r = np.random.default_rng(6)
    a = r.integers(0, 2**63, 3000).astype(np.uint64)
    a[1500:] = a[:1500] ^ (r.integers(1, 2**16, 1500).astype(np.uint64) << np.uint64(16))
    cells = simhash.cells(simhash.pivot_table(a))
    same = cells[:1500] == cells[1500:]
    assert (same == [1 not in pair for pair in simhash._PAIRS]).all()


def test_links_of_a_cell():
    r = random.Random(8)
    base = r.getrandbits(64)
    prints = {base}
    while len(prints) < 200:
        p = base
        for bit in r.sample(range(64), r.randint(1, 5)):
            p ^= 1 << bit
        prints.add(p)
    prints = sorted(prints)
    groups = brute_groups(list(enumerate(prints)))
    root = list(range(len(prints)))
    for x, y in simhash.links(np.array(prints, np.uint64)):
        assert bin(prints[x] ^ prints[y]).count("1") <= 2
        root = [min(root[x], root[y]) if c in (root[x], root[y]) else c for c in root]
    assert root == groups


@pytest.mark.parametrize("crowd", [simhash._CROWD, 3])
def test_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "_CROWD", crowd)
    rows = edited_texts(random.Random(9), 300)
    rows += [(900, None), (901, ""), (902, "One TWO"), (902, "one two"), (903, rows[0][1]), (7, rows[1][1]), (None, rows[2][1])]
    rows += [(None, "nobody else says this at all here")]
    want = brute(rows)
    assert len({c for _, _, c in want}) < len({p for _, p, _ in want})
    assert found(spark, rows) == want


def test_crowded_neighbourhood(spark, monkeypatch):
    """Fingerprints of one neighbourhood, given to the cells as they are."""
    monkeypatch.setattr(simhash, "_CROWD", 20)
    r = random.Random(10)
    centre = r.getrandbits(64)
    prints = []
    for i in range(400):
        p = centre
        for bit in r.sample(range(40), r.randint(0, 4)):
            p ^= 1 << bit
        prints.append((i, p))

    def given(batches):
        for batch in batches:
            own = np.array([int(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own)], names=["doc_id", "print"])

    monkeypatch.setattr(simhash, "_print_rows", lambda shingle: given)
    docs = spark.createDataFrame([(i, f"{p}") for i, p in prints], "doc_id long, text string")
    got = {row.doc_id: row.component_id for row in simhash.group(docs).collect()}
    want = brute_groups(prints)
    assert len(set(want)) > 1 and [got[i] for i, _ in prints] == want


def test_empty_table(spark):
    assert found(spark, []) == []


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_simhash"](spark, path).select("doc_id", "fingerprint", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
