import random
import re

import pytest
import sentencepiece
from test_decontaminate import brute as hits_of
from test_pii import brute as spans_of
from test_pipeline_near import first_of_groups

import corpus_pipeline
from hearscore.llm import quality, queries
from hearscore.session import stage

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and returned."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, docs, SF), name)
        out.append((docs, after))
        docs = after
    return out


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_columns(stages):
    columns = stages[0][0].columns
    assert all(after.columns == columns for _, after in stages[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "pii", "sentencepiece"
    ]


def test_quality(spark, stages):
    before, after = stages[0]
    scores = quality.score(before, queries.quality_model(spark, before, SF)).collect()
    assert rows_of(after, "doc_id") == sorted((r.doc_id,) for r in scores if r.score >= 0.7)
    assert 0 < after.count() < before.count()


def test_one_of_each_group(stages):
    before, after = stages[1]
    kept = [(i,) for i in first_of_groups(rows_of(before, "doc_id", "text"))]
    assert rows_of(after, "doc_id") == kept and len(kept) < before.count()


def test_decisions_are_on_texts(spark):
    """Null and repeated ids: equal texts leave one row, others stay."""
    r = random.Random(4)
    a, b = (" ".join(f"{c}{r.randint(0, 999)}" for _ in range(60)) for c in "ab")
    rows = [(1, a), (1, a), (None, a), (None, a), (2, a), (2, b), (3, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in rows], f"{KIND}, __key string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id", "text") == [(1, a), (2, b)]

    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, item), (None, b), (5, item), (5, b), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], f"{KIND}, contaminated string")
    kept = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted([(None, b), (5, b), (6, None)], key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], KIND)
    for name, step in corpus_pipeline.STAGES[1:]:
        after = step(spark, docs, SF)
        assert after.collect() == [] and (name == "sentencepiece" or after.columns == docs.columns)


def test_contaminated(spark, stages):
    before, after = stages[2]
    items = rows_of(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text")
    found = hits_of(rows_of(before, "doc_id", "text"), items)
    assert rows_of(after, "doc_id") == sorted((d,) for d, n, hits, _ in found if not hits or 20 * len(hits) < n)


def test_personal_data(stages):
    before, after = stages[3]
    texts = dict(rows_of(before, "doc_id", "text"))
    for doc, text, n in rows_of(after, "doc_id", "text", "n_chars"):
        old, at, pattern = texts.pop(doc), 0, ""
        for a, _, b, kind in spans_of(old):
            if a >= at:
                pattern += "(.*)" + re.escape(f"[{kind}]")
            at = max(at, b)
        assert old == text or len(text) == n
        assert not any(old[a:b] in text for a, _, b, _ in spans_of(old))
        assert re.fullmatch(pattern + "(.*)", text, re.DOTALL)
    assert not texts


def test_ids(stages):
    before, after = stages[4]
    own = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    want = [(i, own.encode(t), True) for i, t in rows_of(before, "doc_id", "text")]
    assert rows_of(after, "doc_id", "ids", "lossless") == want


def test_run(spark, stages):
    assert rows_of(corpus_pipeline.run(spark, SF), "doc_id", "ids") == rows_of(stages[-1][1], "doc_id", "ids")
