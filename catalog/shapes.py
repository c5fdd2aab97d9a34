"""The given tables in the shapes that the engine works on.

``conversations`` become samples; hypotheses are made from their texts by
dropping and altering words at fixed intervals, so that any engine can make
the same ones; ``documents`` become a corpus to profile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearscore.operators.corpus_stats import sample_duration
from hearscore.plans.evaluate import eval_input
from hearscore.plans.run_plan import (
    Corpus,
    ModelGroup,
    corpus_table,
    model_table,
    run_plan,
)
from hearscore.schema import CACHE, SAMPLE

# Fixed values: (provider, model, version, every n-th word dropped, every
# n-th word altered).
RUNS = (
    ("openai", "whisper/Small", "2025Q1", 11, 13),
    ("meta", "w2v Large", "2025Q1", 9, 17),
    ("openai", "whisper/Small", "2024Q1", 7, 19),
)
GROUPS = (
    ModelGroup("whisper_local", ["whisper/Small"], "openai", "2025Q1"),
    ModelGroup("w2v", ["w2v Large"], ["meta"], ["2025Q1"]),
)
CORPUS = Corpus("corpora/conv", ["user", "assistant", "system"], "ALL")
CODENAMES = {"openai": "openai_whisper_small_pl-pl", "meta": "meta_w2v large_pl-pl"}

_WORDS = r"[ \t\n\r\x0B\f]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The given tables are one scan task each; CPU-heavy work spreads them first.
TASKS = 16


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).repartition(TASKS)


def samples_of(conversations: DataFrame) -> DataFrame:
    split = F.element_at(
        F.array(F.lit("train"), F.lit("validation"), F.lit("test")),
        (F.col("conv_id") % 3 + 1).cast("int"),
    )
    path = F.concat(
        F.lit("clips/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".wav")
    )
    return conversations.select(
        F.lit("conv").alias("dataset"),
        F.col("role").alias("subset"),
        split.alias("split"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("sample_idx"),
        path.alias("audio_path"),
        "text",
        "conv_id",
        "turn",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_of(table(spark, sf_dir, "conversations"))


def _altered(words: Column, drop: int, alter: int) -> Column:
    conv, turn = F.col("conv_id"), F.col("turn")
    said = F.transform(
        words,
        lambda w, i: F.when((i * 7 + conv + turn) % drop == 0, F.lit(""))
        .when((i * 5 + conv) % alter == 0, F.concat(w, F.lit("x")))
        .otherwise(w),
    )
    return F.array_join(F.filter(said, lambda w: w != ""), " ")


def cache_of(samples: DataFrame, runs: Sequence[tuple] = RUNS) -> DataFrame:
    """Hypotheses of every run for every clip; some are sentinels, some are
    missing, and odd turns have no memory figures."""
    words = F.filter(F.split("text", _WORDS), lambda w: w != "")
    n = F.size("words")
    entries = [
        F.struct(
            F.lit(provider).alias("provider"),
            F.lit(model).alias("model"),
            F.lit(version).alias("version"),
            F.lit(CODENAMES[provider]).alias("codename"),
            _altered(F.col("words"), drop, alter).alias("said"),
        )
        for provider, model, version, drop, alter in runs
    ]
    even = F.col("turn") % 2 == 0
    return (
        samples.filter(F.col("conv_id") % 23 != 0)
        .withColumn("words", words)
        .select(
            "dataset", "audio_path", "conv_id", "turn", n.alias("n"), F.inline(F.array(*entries))
        )
        .select(
            "dataset",
            "codename",
            "audio_path",
            "version",
            F.when(F.col("conv_id") % 17 == 0, F.lit("EMPTY"))
            .when(F.col("conv_id") % 19 == 0, F.lit("INVALID"))
            .otherwise(F.col("said"))
            .alias("asr_hyp"),
            "provider",
            "model",
            F.lit("20250101").alias("hyp_gen_date"),
            (F.col("n").cast("double") / 20).alias("elapsed_time_seconds"),
            F.when(even, (F.col("n") * 1000 + 1000000).cast("long")).alias("peak_vram_bytes"),
            F.when(even, (F.col("n") * 10).cast("long")).alias("vram_diff_bytes"),
        )
        .select(*CACHE.names)
    )


def plan(spark: SparkSession) -> DataFrame:
    return run_plan(model_table(spark, GROUPS), corpus_table(spark, [CORPUS]))


def pairs(spark: SparkSession, sf_dir: str, metadata: Sequence[str] = ()) -> DataFrame:
    """Eval input of both systems."""
    rows = samples(spark, sf_dir)
    return eval_input(rows, plan(spark), cache_of(rows), metadata)


def stream_pairs(samples: DataFrame) -> DataFrame:
    """Eval input of one system made without a join, for a stream."""
    words = F.filter(F.split("text", _WORDS), lambda w: w != "")
    _, _, version, drop, alter = RUNS[0]
    return samples.withColumn("words", words).select(
        *SAMPLE.names,
        F.lit(CODENAMES["openai"]).alias("codename"),
        F.lit(version).alias("version"),
        _altered(F.col("words"), drop, alter).alias("hypothesis"),
    )


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a corpus: language as dataset (one withholds its test
    transcripts), source as subset; the audio array is an embedding, at
    sampling rates that differ by document."""
    documents = spread_table(spark, sf_dir, "documents")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    dataset = F.when(F.col("lang") == "fr", F.lit("Withheld-fr")).otherwise(F.col("lang"))
    split = F.element_at(
        F.array(F.lit("train"), F.lit("validation"), F.lit("test")),
        (F.col("doc_id") % 3 + 1).cast("int"),
    )
    rate = F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (F.col("doc_id") % 8 + 1).cast("int"))
    return documents.join(vectors, F.col("doc_id") == F.col("vec_id"), "left").select(
        dataset.alias("dataset"),
        F.col("source").alias("subset"),
        split.alias("split"),
        F.col("doc_id").alias("sample_idx"),
        "text",
        sample_duration(F.col("embedding"), F.lit(None).cast("int"), rate).alias("duration"),
    )


def write_files(files: DataFrame, folder: str) -> None:
    """Write ``name, content`` rows as single files below a folder."""

    def put(rows) -> None:
        for row in rows:
            place, path = FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
            target = f"{path}/{row.name}"
            place.create_dir(target.rsplit("/", 1)[0])
            with place.open_output_stream(target) as out:
                out.write(bytes(row.content))

    files.foreachPartition(put)
