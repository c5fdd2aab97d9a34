import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearscore.llm import language
from hearscore.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(scores, switch):
    best = max(
        itertools.product(range(scores.shape[1]), repeat=len(scores)),
        key=lambda p: sum(scores[i, x] for i, x in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:])),
    )
    return list(best)


def test_viterbi_against_all_paths():
    random = np.random.default_rng(5)
    lengths = [3, 0, 6, 1, 5]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    scores = random.normal(0, 3, (offsets[-1], 3))
    got = language.viterbi(scores, offsets, 2.0)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if a < b:
            assert got[a:b].tolist() == brute(scores[a:b], 2.0)


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_language_id"](spark, SF).collect()
    assert len(rows) == len(docs)
    held = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert np.mean(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(
        [("the then there with this", "en"), ("les elles nous même après", "fr"), ("привет это мир", "ru")] * 20
    )]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return language.train(docs, language.F.lit(True))


def test_spans_of_mixed_text(spark, model):
    text = "the then there with this " * 4 + "nous même elles après " * 4 + "привет это мир"
    docs = spark.createDataFrame([(1, text, 7)], "doc_id long, text string, spans int")
    row = language.identify(docs, model, spans=True).collect()[0]
    assert [s.lang for s in row.spans] == ["en", "fr", "ru"]
    assert [text[s.start : s.end].split()[0] for s in row.spans] == ["the", "nous", "привет"]
    assert row.lang_pred == "en" and 0.3 < row.score < 0.7


def test_script_narrows(model):
    words = language._words(pa.array(["привет the"]))
    scores = model.word_scores(language._lexicon(words))[language._lexicon(words).inverse]
    russian = model.langs.index("ru")
    assert scores[0].argmax() == russian and (np.delete(scores[0], russian) < -1e5).all()
    assert scores[1, russian] < -1e5


def test_odd_rows(spark, model):
    texts = [None, "", " 12 — « 3", "é", "the " * 30000, "the " * 30000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3
    assert rows[3].lang_pred in model.langs and rows[4].lang_pred == "en" and rows[4].score == rows[5].score
    assert language.identify(docs.limit(0), model).collect() == []
    none = language.train(docs.withColumn("lang", language.F.lit(None).cast("string")), language.F.lit(True))
    assert {r.lang_pred for r in language.identify(docs, none, spans=True).collect()} == {"und"}


@pytest.mark.parametrize("n_labels", [1, 127, 128, 129, 300])
def test_viterbi_with_many_labels(n_labels):
    r = np.random.default_rng(n_labels)
    offsets = np.array([0, 7, 7, 20, 21])
    scores = np.full((21, n_labels), -9.0)
    # Every word's best label is so much better that switching pays.
    want = r.integers(0, n_labels, 21)
    scores[np.arange(21), want] = 0
    got = language.viterbi(scores, offsets, 1.0)
    assert got.tolist() == want.tolist()


def test_ids_and_clashing_columns(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en")] * 20)]
    learned = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(learned, F.lit(True))
    odd = [(None, "the cat", "x", 1.0), (3, "die katze", "y", 2.0), (3, "die katze", "y", 2.0), (None, None, None, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang_pred string, score double")
    got = [(x.doc_id, x.lang_pred) for x in language.identify(docs, model).collect()]
    assert sorted(got, key=str) == [(3, "de"), (3, "de"), (None, "en"), (None, "und")]
