import numpy as np
import pytest

from hearscore.llm import neighbours
from hearscore.llm.queries import QUERIES


def brute(rows, k=10):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, np.array(v, dtype=np.float64))
    out = {}
    for i, q in ok.items():
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in ok.items() if j != i and len(v) == len(q))
            out[i] = near[:k]
    return out


def found(spark, rows, **kind):
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, cell int")
    out = {}
    for r in neighbours.search(table, neighbours.F.col("vec_id") % 100 == 0, **kind).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    path = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {}
    for r in QUERIES["op3_approximate_neighbours"](spark, path).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got.keys() == want.keys()
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    hits = 0
    for q, near in got.items():
        assert len(near) == 10 and near == sorted(near)
        hits += len({j for _, j in near} & {j for _, j in want[q]})
        for score, j in near:
            assert score == pytest.approx(np.linalg.norm(vectors[q] - vectors[j]), rel=1e-12)
    assert hits / (10 * len(want)) >= 0.93


def test_copies_and_few_rows(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(0, 60)] + [(100, same), (200, [0.0, 1.0, 5.0]), (201, [0.0, 1.0, 5.0]), (300, [1.0, 2.0])]
    want = brute(rows)
    got = found(spark, rows)
    assert got[0] == want[0] and [j for _, j in got[0]] == list(range(1, 11))
    assert got[100] == want[100] and got[200] == want[200]
    assert 300 not in got


def test_fewer_candidates_than_asked(spark):
    r = np.random.default_rng(3)
    rows = [(i * 50, r.normal(size=8).tolist()) for i in range(7)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    want, got = brute(rows), found(spark, rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [j for _, j in got[q]] == [j for _, j in want[q]]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]])


def test_pieces(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_PIECE", 5)
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=4)]) for i in range(250)]
    got, want = found(spark, rows, probes=8), brute(rows)
    assert {q: [j for _, j in near] for q, near in got.items()} == {q: [j for _, j in near] for q, near in want.items()}


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0])]
    assert found(spark, rows) == {0: [(pytest.approx(2**0.5), 7)]}
    assert found(spark, []) == {}


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 48))
    turned = neighbours.rotate(x, 3)
    assert np.linalg.norm(turned, axis=1) == pytest.approx(np.linalg.norm(x, axis=1))
    assert turned @ turned.T == pytest.approx(x @ x.T)
