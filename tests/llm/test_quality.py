import zlib

import numpy as np
import pyarrow as pa
import pytest

from hearscore.llm import quality
from hearscore.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op2_quality_classifier"](spark, SF).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) >= 0.93
    assert np.mean([b for a, b in held if a == 0]) <= 0.3


def test_score_is_the_mean_over_features():
    random = np.random.default_rng(1)
    model = quality.Model(random.normal(size=quality.BUCKETS).astype(np.float32), 0.25)
    texts = ["ab cd ab cd", "", None, "é", "xyz " * 9000, "ab cd ab cd"]
    got = model.score(pa.array(texts))
    for text, value in zip(texts, got):
        buckets, _ = quality.features(pa.array([text], pa.string()))
        mean = model.logits[buckets].astype(float).sum() / max(1, len(buckets))
        assert value == pytest.approx(1 / (1 + np.exp(-(mean + 0.25))))
    assert got[1] == got[2] == pytest.approx(1 / (1 + np.exp(-0.25)))
    assert got[0] == got[5]


def test_features_of_a_text():
    words, pairs, grams = 4, 3, (11 - 2) + (11 - 4)
    buckets, text = quality.features(pa.array(["ab cd ab cd", "q"]))
    assert (text == 0).sum() == words + pairs + pairs + grams
    assert (text == 1).sum() == 1
    # The third pair repeats the first one, and is marked so.
    assert len(set(buckets[5:8])) == 2


def test_odd_tables(spark):
    kinds = "doc_id long, text string, score double, label string"
    odd = spark.createDataFrame([(1, "good words", 1.0, "x"), (1, None, None, None), (None, "", None, None)], kinds)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, None)], "doc_id long, quality int")
    learn = quality.F.lit(True)
    model = quality.train(odd, labels, "quality", learn)
    assert len(quality.score(odd, model).collect()) == 3
    none = quality.train(odd.limit(0), labels.limit(0), "quality", learn)
    assert quality.score(odd.limit(0), none).collect() == []
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}


def test_counts_are_kept_whole(spark):
    """A feature that a text repeats more often than two bytes can tell."""
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2, 3]), pa.array([1, 0, 1]), pa.array(["a " * 70_000, "b c", None])], names=["doc_id", "label", "text"]
    )
    out = pa.Table.from_batches(quality._sparse_rows([batch]))
    rows = [quality._sparse(b, c) for b, c in zip(out.column("buckets"), out.column("counts"))]
    buckets, text = quality.features(batch.column("text"))
    for i, (own, counts) in enumerate(rows):
        values, want = np.unique(buckets[text == i], return_counts=True)
        assert own.tolist() == values.tolist() and counts.tolist() == want.tolist()
    assert rows[0][1].max() > 65_535 and rows[1][1].dtype == np.uint8


def test_gathered_features_take_two_bytes():
    """The driver receives and holds all features of the sample: a byte for a
    bucket and one for its count, but for few."""
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in r.integers(0, 5000, 900)) for _ in range(8)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(8)), pa.array([0, 1] * 4), pa.array(texts)], names=["doc_id", "label", "text"]
    )
    out = pa.Table.from_batches(quality._sparse_rows([batch]))
    rows = quality._Rows(out, [7, 6, 5, 4, 3, 2, 1, 0])
    sizes = [len(b) for b, _ in rows]
    held = sum(len(x.as_py()) for c in ("buckets", "counts") for x in out.column(c))
    assert len(rows) == 8 and min(sizes) > 2000 and held < 2.2 * sum(sizes)


def test_packed_rows_are_undone():
    """Distances and counts below, at and above what a byte holds; texts without features."""
    texts = [[], [0], [quality.BUCKETS - 1], [], [0, 1, 254, 508, 509, 764, 1274, 1529], [255], [3, 258, 514], []]
    cut = np.cumsum([0, *map(len, texts)])
    every = np.array([b for own in texts for b in own])
    times = np.array([1, 254, 255, 256, 510, 1, 70_000, 2, 1, 1, 1, 1, 1, 1])
    steps, places = quality._packed(quality._gaps(every, cut[:-1]))
    counts, at = quality._packed(times)
    for a, b, own in zip(cut[:-1], cut[1:], texts):
        packed = [pa.scalar(v[p[a] : p[b]].tobytes(), pa.binary()) for v, p in ((steps, places), (counts, at))]
        found = quality._sparse(*packed)
        assert found[0].tolist() == own and found[1].tolist() == times[a:b].tolist()
    none = np.zeros(0, np.int64)
    assert [len(x) for x in quality._packed(quality._gaps(none, np.zeros(3, np.int64)))] == [0, 1]


def test_features_are_made_in_small_slices(monkeypatch):
    """A task holds the features of a few texts at a time."""
    held, features = [], quality.features

    def counted(texts):
        buckets, text = features(texts)
        held.append(len(buckets))
        return buckets, text

    monkeypatch.setattr(quality, "features", counted)
    texts = [f"{i} " + "a few words and more " * 50 for i in range(900)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(900)), pa.array([1] * 900), pa.array(texts)], names=["doc_id", "label", "text"]
    )
    assert sum(len(part) for part in quality._sparse_rows([batch])) == 900
    assert max(held) < 500_000 < sum(held)
