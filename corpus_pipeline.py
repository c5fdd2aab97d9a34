"""A corpus made ready for training, stage by stage.

Every stage works on all that the one before kept: documents of low quality
go, of each group of near duplicates one document stays, documents with
passages of test items go, personal data is replaced, and texts become ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearscore.llm import jaccard, pieces, pii, queries, quality
from hearscore.session import stage


# Near copies: words of a shingle, percent of shared shingles.  The query of the
# join has other values.
SHINGLE = 5
SIMILARITY = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels
    of those that this stage is given."""
    return quality.select(docs, queries.quality_model(spark, docs, sf_dir), queries.GOOD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts and of those whose sets of five-word shingles link, one;
    rows without an id are judged like others."""
    return jaccard.distinct(docs, SHINGLE, SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents a twentieth of whose words, or more, lie in windows of test
    items go.  Texts are judged, not ids: rows without an id, and several texts
    of one id, each get their own decision."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = queries.decontaminated(texts, queries.table(spark, sf_dir, "benchmark"))
    gone = found.filter("contaminated").select("doc_id").distinct()
    return docs.join(gone, F.xxhash64(docs["text"]) == gone["doc_id"], "left_anti")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and whether they decode to its text."""
    return queries.coded(pieces.round_trip(docs, queries.piece_model()))


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("sentencepiece", encode),
]

# The classifier and the trees can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
