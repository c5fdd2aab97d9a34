"""One registered query per operator.  Each reads whole tables below
``sf_dir`` and gives columns whose names match its SQL in ``oracle``."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import shapes
from catalog.stub import StubTranscriber
from hearscore.functions import align, rates, text
from hearscore.operators import corpus_stats, joins, scoring, selection, summary
from hearscore.operators.transcribe import transcribe_batch
from hearscore.plans import evaluate, profile, run_plan
from hearscore.schema import EVAL_INPUT, SAMPLE, SPLIT_KEYS
from hearscore.session import stage, stage_path
from hearscore.sources import audio as audio_files
from hearscore.sources import cache as cache_files
from hearscore.sources import corpora, store, tsv
from hearscore.streaming import scores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ALL_NORMS = ("none", "all", "lowercase", "whitespace", "punctuation", "tags")
NORMS = ("none", "all")
METRICS = tuple(rates.METRICS)


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _clips(
    spark: SparkSession, sf_dir: str, norms: Sequence[str] = NORMS, metrics: Sequence[str] = METRICS
) -> DataFrame:
    pairs = shapes.pairs(spark, sf_dir)
    return scoring.score_clips(pairs, norms, metrics, tasks=shapes.TASKS)


def _long_counts(spark: SparkSession, sf_dir: str, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Counts of each clip under the normalisation ``all``."""
    wanted = rates.needed_counts(metrics)
    clips = _clips(spark, sf_dir, ["all"], metrics)
    return clips.select(
        "sample_idx", "codename", *(scoring.counts_of("all")(c).alias(c) for c in wanted)
    ).filter(F.col(wanted[0]).isNotNull())


def _rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Means and deviations depend on the order of summation in their last
    bits; keep what does not."""
    doubles = {c for c, kind in df.dtypes if kind == "double"}
    return df.select(*(F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns))


# --- sources, sinks, sampling ----------------------------------------------


@register
def scan_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = corpora.scan_corpus(spark, f"{sf_dir}/documents.parquet", dataset="documents")
    return documents.groupBy("dataset", "lang", "source").agg(
        F.count("*").alias("n_rows"), F.sum(F.char_length("text")).alias("n_characters")
    )


@register
def subset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shapes.samples(spark, sf_dir)
    one = selection.subset_lookup(rows, "user", "train")
    wanted = rows.filter(F.col("subset") == "system").select("subset", "split")
    many = selection.subset_lookup_many(rows, wanted)
    return one.unionByName(many).select("subset", "split", "sample_idx", "audio_path")


@register
def first_n_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shapes.samples(spark, sf_dir)
    return selection.first_n_per_split(rows, 20).select(*SPLIT_KEYS, "sample_idx", "text")


@register
def seeded_sample_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shapes.samples(spark, sf_dir)
    return selection.seeded_sample_per_split(rows, 20, 42).select(*SPLIT_KEYS, "sample_idx")


@register
def scan_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = shapes.table(spark, sf_dir, "documents")
    path = stage_path(spark, "tsv")
    tsv.sink_tsv(documents, path)
    back = tsv.scan_tsv(spark, path, documents.schema, multi_line=True)
    return back.select("doc_id", "lang", "source", F.md5("text").alias("digest"))


@register
def sink_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "tsv")
    levels = ["dataset", "subset", "split", "version"]
    tsv.sink_tsv(shapes.pairs(spark, sf_dir), path, partition_by=levels)
    back = tsv.scan_tsv(spark, path, EVAL_INPUT, multi_line=True)
    return back.select(*levels, "codename", "sample_idx", "text", "hypothesis", *_RESOURCES)


_RESOURCES = (
    "resources_gen_time_seconds",
    "resources_peak_vram_bytes",
    "resources_vram_diff_bytes",
)


@register
def scan_hyp_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache in one JSON file per dataset and system."""
    cache = shapes.cache_of(shapes.samples(spark, sf_dir))
    path = stage_path(spark, "hyp_cache")
    lines = cache_files.cache_lines(cache).persist()
    for name in shapes.CODENAMES.values():
        own = lines.filter(F.col("codename") == name).select("value")
        own.write.text(f"{path}/conv/{name}.asr_cache.jsonl")
    lines.unpersist()
    return cache_files.scan_hyp_cache(spark, path)


@register
def sink_hyp_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = shapes.cache_of(shapes.samples(spark, sf_dir))
    path = stage_path(spark, "hyp_cache")
    cache_files.sink_hyp_cache(cache, path)
    return cache_files.scan_hyp_cache(spark, path)


def _profile(spark: SparkSession, sf_dir: str) -> profile.Profile:
    rows = shapes.profiled(spark, sf_dir)
    planned = profile.planned_splits(rows, ["train", "validation", "test", "dev"])
    rule = corpus_stats.exclude_empty_transcripts("withheld")
    return profile.profile_corpus(rows, planned, exclude=rule)


@register
def sink_stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _profile(spark, sf_dir)
    path = stage_path(spark, "stats_json")
    parts = [corpus_stats.rounded(df) for df in (found.splits, found.datasets)]
    for _ in range(2):  # the second call keeps the documents of the first
        store.save_statistics(spark, path, *parts, found.grand)
    length = "struct<mean: double, std: double, min: double, max: double>"
    document = spark.read.text(path).select(
        "file",
        F.from_json(
            "value",
            f"dataset_name string, total_audio_hours double, transcript_length_stats {length}, "
            "split_stats map<string, struct<sample_count: bigint>>",
        ).alias("j"),
    )
    return document.filter(F.col("file") != "combined_statistics").select(
        "file",
        F.col("j.dataset_name").alias("dataset_name"),
        F.col("j.transcript_length_stats.max").alias("longest"),
        F.aggregate(
            F.map_values("j.split_stats"), F.lit(0).cast("bigint"), lambda a, s: a + s["sample_count"]
        ).alias("sample_count"),
    )


@register
def audio_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAV files made from the embeddings; every 13th is not one."""

    def little_endian(n: Column) -> Column:
        digits = F.lpad(F.hex(n), 8, "0")
        return F.concat(*(F.substring(digits, i, 2) for i in (7, 5, 3, 1)))

    frames = (F.size("embedding") * (F.col("vec_id") % 40)).cast("long")
    rate = (F.lit(100) + F.col("vec_id") % 50).cast("long")
    data = F.unhex(
        F.concat(
            F.lit("52494646"),
            little_endian(frames * 2 + 36),
            F.lit("57415645666D74201000000001000100"),
            little_endian(rate),
            little_endian(rate * 2),
            F.lit("0200100064617461"),
            little_endian(frames * 2),
            F.repeat(F.lit("0000"), frames.cast("int")),
        )
    )
    files = shapes.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("clips/"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("name"),
        F.when(F.col("vec_id") % 13 == 0, F.lit("no audio").cast("binary"))
        .otherwise(data)
        .alias("content"),
    )
    folder = stage_path(spark, "audio")
    shapes.write_files(files, folder)
    found = audio_files.audio_manifest(spark, folder)
    return found.withColumn("path", F.regexp_extract("path", "clips/[^/]*$", 0))


@register
def materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "materialized")
    rows = shapes.samples(spark, sf_dir)
    counts = rows.groupBy(*SPLIT_KEYS).agg(F.count("*").alias("n_rows"))
    first = rows.filter(F.col("split") == "test").select(*SPLIT_KEYS)
    for wanted in (first, rows.select(*SPLIT_KEYS)):  # the rest is added to what is there
        table = store.materialize_groups(
            spark, path, wanted, lambda g: counts.join(g, SPLIT_KEYS, "left_semi"), SPLIT_KEYS
        )
    return table.select(*SPLIT_KEYS, "n_rows")


@register
def refreshed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per split, stored; then the test splits lose rows and the counts
    are asked for again: those of other splits are read."""
    path = stage_path(spark, "refreshed")
    rows = shapes.samples(spark, sf_dir)
    for now in (rows, rows.filter("split <> 'test' OR conv_id % 2 = 0")):
        counts = now.groupBy(*SPLIT_KEYS).agg(F.count("*").alias("n_rows"))
        table = store.materialize_groups(
            spark,
            path,
            now,
            lambda g, counts=counts: counts.join(g, SPLIT_KEYS, "left_semi"),
            SPLIT_KEYS,
            marks=store.fingerprints(now, SPLIT_KEYS),
        )
    runs = spark.read.parquet(f"{path}.groups").groupBy(*SPLIT_KEYS).agg(F.count("*").alias("n_runs"))
    return table.join(runs, SPLIT_KEYS).select(*SPLIT_KEYS, "n_rows", "n_runs")


@register
def dated_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = stage_path(spark, "dated")
    path = store.dated_path(base, "rows_per_split", "20250131")
    counts = shapes.samples(spark, sf_dir).groupBy(*SPLIT_KEYS).agg(F.count("*").alias("n_rows"))
    tsv.sink_tsv(counts, path)
    back = tsv.scan_tsv(spark, path, counts.schema)
    day = F.regexp_extract(F.input_file_name(), r"rows_per_split_(\d{8})/", 1)
    return back.withColumn("run_date", day)


# --- projections, filters, predicates ---------------------------------------


@register
def tag_model_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shapes.samples(spark, sf_dir).select("sample_idx", "audio_path")
    return selection.tag_model_columns(rows, "openai", "whisper/Small", "2025Q1", "whisper")


@register
def select_reference_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shapes.samples(spark, sf_dir)
    return selection.select_reference_columns(
        rows, "text", ["turn", "speaker_age", "conv_id"], keep=["audio_path"]
    )


@register
def valid_hypothesis_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.valid_pairs(shapes.pairs(spark, sf_dir))
    return rows.select("codename", "sample_idx", "text", "hypothesis")


@register
def cast_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = shapes.table(spark, sf_dir, "events")
    rows = events.select("event_id", F.col("event_id").alias("text"), F.col("user_id").alias("hyp"))
    return selection.cast_text(rows, "text", "hyp")


@register
def non_empty_after_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 5th clip has only a tag as its reference, every 7th only
    punctuation: each normalisation keeps other rows."""
    rows = _with_odd_references(spark, sf_dir)
    return (
        scoring.fan_out(rows, ALL_NORMS)
        .groupBy("codename", "norm_type")
        .agg(F.count("*").alias("n_rows"), F.sum("sample_idx").alias("index_sum"))
    )


def _with_odd_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversation = F.floor(F.col("sample_idx") / 100)
    odd = (
        F.when(conversation % 5 == 0, F.lit("<UNK>"))
        .when(conversation % 7 == 0, F.lit("?!"))
        .otherwise(F.col("text"))
    )
    return selection.valid_pairs(shapes.pairs(spark, sf_dir)).withColumn("text", odd)


@register
def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = selection.require_columns(shapes.pairs(spark, sf_dir), "text", "hypothesis")
    return (
        selection.valid_pairs(pairs)
        .groupBy("codename")
        .agg(
            F.count("*").alias("n_rows"),
            F.count("text").alias("n_references"),
            F.count("hypothesis").alias("n_hypotheses"),
        )
    )


@register
def drop_join_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.drop_join_columns(shapes.pairs(spark, sf_dir), "hypothesis")


@register
def dynamic_metric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a value in every column found to be a metric or resource."""
    clips = _clips(spark, sf_dir, ["all"], ["WER", "CER"])
    table = scoring.results(clips, ["all"], ["WER", "CER"], mode="sample", texts=False)
    metrics, resources = selection.metric_columns(table)
    kinds = [(c, "metric") for c in metrics] + [(c, "resource") for c in resources]
    counted = table.agg(*(F.count(c).alias(c) for c, _ in kinds))
    return counted.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.lit(kind).alias("kind"),
                        F.col(c).alias("n_values"),
                    )
                    for c, kind in kinds
                )
            )
        )
    )


# --- text and names ----------------------------------------------------------


def _stressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, some with tags or quotes added."""
    said = F.concat(
        F.when(F.col("doc_id") % 11 == 0, F.lit('"')).otherwise(F.lit("")),
        F.col("text"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(" <UNK>")).otherwise(F.lit("")),
        F.when(F.col("doc_id") % 7 == 0, F.lit("\u00a0 word_trunc \tend")).otherwise(F.lit("")),
        F.when(F.col("doc_id") % 11 == 0, F.lit('"')).otherwise(F.lit("")),
    )
    return shapes.spread_table(spark, sf_dir, "documents").select("doc_id", said.alias("text"))


def _register_norm(norm_type: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        clean = text.normalise("text", norm_type)
        return _stressed(spark, sf_dir).select("doc_id", clean.alias("clean_text"))

    query.__name__ = f"norm_{norm_type}"
    register(query)


for _norm in ("none", "lowercase", "whitespace", "punctuation", "tags", "all"):
    _register_norm(_norm)


@register
def norm_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.valid_pairs(shapes.pairs(spark, sf_dir))
    return scoring.fan_out(rows, ALL_NORMS).select(
        "codename", "sample_idx", "norm_type", "reference", "hypothesis"
    )


@register
def clip_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shapes.table(spark, sf_dir, "pages")
    return pages.select("page_id", text.clip_id("url").alias("id"))


@register
def codename(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = shapes.table(spark, sf_dir, "documents")
    model = F.concat(F.lit("Models/"), F.col("source"))
    return documents.select(
        "doc_id",
        text.codename("source", model, "lang").alias("codename"),
        text.display_name("source", model).alias("display_name"),
    )


@register
def dataset_short_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shapes.table(spark, sf_dir, "pages")
    return pages.select("page_id", text.dataset_short_name("url").alias("dataset"))


@register
def default_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = shapes.table(spark, sf_dir, "events")
    return events.groupBy(text.default_version("ts").alias("version")).agg(
        F.count("*").alias("n_rows")
    )


@register
def transcript_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = shapes.table(spark, sf_dir, "conversations")
    quoted = F.when(
        F.col("turn") % 3 == 0,
        F.concat(F.lit('"'), F.rtrim("text", F.lit(".")), F.lit(' ""so""'), F.lit('"')),
    ).otherwise(F.rtrim("text", F.lit(".")))
    return conversations.select(
        "conv_id", "turn", text.transcript_cleanup(quoted).alias("clean_text")
    )


@register
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stressed(spark, sf_dir).select("doc_id", text.word_count("text").alias("n_words"))


@register
def sample_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.col("vec_id")
    row_rate = F.when(vec % 11 == 0, F.lit(0)).when(vec % 5 > 0, F.lit(8) + F.col("label"))
    struct_rate = F.when(vec % 7 > 0, F.lit(6))
    return shapes.table(spark, sf_dir, "embeddings").select(
        "vec_id", corpus_stats.sample_duration(F.col("embedding"), struct_rate, row_rate).alias("duration")
    )


@register
def left_trim_hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = (
        F.when(F.col("turn") == 3, F.lit(" \t\u00a0"))
        .when(F.col("turn") != 4, F.concat(F.lit("\n \u00a0"), F.col("text"), F.lit(" ")))
    )
    return shapes.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.hypothesis_or_sentinel(said).alias("asr_hyp")
    )


# --- metrics -----------------------------------------------------------------


@register
def word_alignment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.valid_pairs(shapes.pairs(spark, sf_dir))
    rows = rows.repartition(shapes.TASKS)
    counts = align.edit_counts("text", "hypothesis", chars=False)
    return rows.withColumn("c", counts).select(
        "codename", "sample_idx", *(F.col(f"c.{n}").alias(n) for n in rates.WORD_COUNTS)
    )


def _register_metric(name: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _long_counts(spark, sf_dir, [name])
        return rows.select("codename", "sample_idx", rates.rate(name).alias(name.lower()))

    query.__name__ = name.lower()
    register(query)


for _metric in METRICS:
    _register_metric(_metric)


@register
def metric_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled value of each registered metric, by name in any case."""
    names = rates.resolve_metrics(["wer", "Cer", "MER", "wil"])
    pooled = _long_counts(spark, sf_dir).groupBy("codename").agg(
        *(F.sum(c).alias(c) for c in rates.needed_counts(names))
    )
    values = rates.with_percents(pooled, {n: rates.rate(n) for n in names})
    listed = (F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names)
    return values.select("codename", F.inline(F.array(*listed)))


@register
def running_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values up to each clip; small buckets, so that every level is used."""
    running = scoring.running_clips(shapes.pairs(spark, sf_dir), ["all"], METRICS, tasks=shapes.TASKS, bits=8)
    table = scoring.results(running, ["all"], METRICS, texts=False)
    return table.select("subset", "split", "system", "norm_type", "sample_idx", *METRICS)


@register
def per_sample_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = scoring.results(_clips(spark, sf_dir, ["all"]), ["all"], METRICS, mode="sample")
    return table.select("system", "sample_idx", "id", "reference", "hypothesis", *METRICS)


@register
def corpus_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = scoring.corpus_metrics(_clips(spark, sf_dir), NORMS, METRICS)
    return pooled.drop("dataset", "version")


# --- joins -------------------------------------------------------------------


@register
def attach_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shapes.samples(spark, sf_dir)
    planned = corpora.planned_samples(rows.drop("conv_id", "turn"), shapes.plan(spark))
    return joins.attach_hypotheses(planned, shapes.cache_of(rows))


@register
def attach_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = shapes.table(spark, sf_dir, "labels")
    documents = shapes.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return joins.attach_metadata(
        documents, labels.withColumn("lang", F.lit("?")), on=["doc_id"]
    )


@register
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shapes.samples(spark, sf_dir)
    planned = corpora.planned_samples(rows, shapes.plan(spark))
    return joins.pending_work(planned, shapes.cache_of(rows)).select(
        "codename", "version", "audio_path"
    )


@register
def run_plan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model group per language with a model per source; the corpora are
    the splits that the samples have."""
    groups = (
        shapes.table(spark, sf_dir, "documents")
        .groupBy(F.col("lang").alias("name"))
        .agg(F.array_sort(F.collect_set("source")).alias("models"))
        .select(
            "name",
            "models",
            F.array("name").alias("providers"),
            F.transform("models", lambda m: F.concat(F.lit("v"), m)).alias("versions"),
        )
    )
    splits = shapes.samples(spark, sf_dir).select(*SPLIT_KEYS).distinct()
    return run_plan.run_plan(run_plan.spread_models(groups), splits, ALL_NORMS)


QUERIES["run_plan"] = QUERIES.pop("run_plan_query")


def _stored_files(rows: DataFrame) -> DataFrame:
    """Where the clips lie: at their path, under a longer name further down,
    in the cache tree only, or nowhere."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    kind = F.col("conv_id") % 5
    path = (
        F.when(kind == 0, F.col("audio_path"))
        .when(kind == 1, F.concat(F.lit("clips/"), conv, F.lit("/parts/"), turn, F.lit(".wav.1")))
        .when(kind == 2, F.concat(F.lit("cache/datasets/"), conv, F.lit("/"), turn, F.lit(".wav")))
    )
    return rows.filter((kind < 3) & (F.col("turn") < 5)).select(path.alias("path"))


@register
def resolve_audio_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shapes.samples(spark, sf_dir)
    return joins.resolve_audio_paths(rows, _stored_files(rows), cache_root="cache/datasets")


@register
def transcribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shapes.samples(spark, sf_dir).select("conv_id", "turn", "audio_path")
    rows = rows.withColumn("there", F.col("conv_id") % 29 != 0)
    made = transcribe_batch(rows, StubTranscriber, exists="there")
    return made.select("audio_path", "asr_hyp")


QUERIES["transcribe_batch"] = QUERIES.pop("transcribe")


@register
def bucketed_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache and samples as bucketed tables: one model's folder is read, and
    the planned runs are joined where the buckets lie."""
    rows, run = shapes.samples(spark, sf_dir), uuid.uuid4().hex
    path = stage_path(spark, "bucketed")
    cache = cache_files.store_cache_table(shapes.cache_of(rows), f"hyp_cache_{run}", buckets=8, path=f"{path}/cache")
    (
        rows.select(*SAMPLE.names).write.bucketBy(8, "audio_path").sortBy("audio_path")
        .option("path", f"{path}/samples").saveAsTable(f"samples_{run}")
    )
    plan = corpora.planned_runs(shapes.plan(spark))
    found = joins.attach_planned_hypotheses(spark.table(f"samples_{run}"), plan, cache, bucketed=True)
    one = cache.filter(F.col("codename") == shapes.CODENAMES["meta"]).groupBy("audio_path").agg(F.count("*").alias("n_meta"))
    return found.join(one, "audio_path", "left").select("codename", "version", "sample_idx", "hypothesis", "n_meta", *_RESOURCES)


@register
def saved_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcribe what is missing, in several commits, and read the cache."""
    planned = corpora.planned_samples(shapes.samples(spark, sf_dir), shapes.plan(spark))
    path = stage_path(spark, "saved_hypotheses")
    for _ in range(2):  # the second call asks again only for what has no answer
        evaluate.save_missing(
            planned, path, StubTranscriber, batch_size=8, clips_per_commit=-(-planned.count() // 3), day="20250131"
        )
    saved = cache_files.stored_hyp_cache(spark, path)
    return saved.select("dataset", "codename", "version", "audio_path", "asr_hyp", "hyp_gen_date")


@register
def capped_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation with a cap per split, a metadata column, resolved
    paths and durations."""
    rows = shapes.samples(spark, sf_dir)
    number = F.col("conv_id") * 10 + F.col("turn")
    corpus = replace(shapes.CORPUS, max_samples_per_subset=6, metadata_columns=["n_words"])
    job = evaluate.Evaluation(
        "capped", stage_path(spark, "capped"), norm_types=["none"], metrics=["WER"], tasks=shapes.TASKS
    )
    durations = rows.filter(F.col("turn") % 2 == 0).select(
        F.col("audio_path").alias("path"), ((F.col("conv_id") % 40).cast("double") / 8).alias("audio_duration")
    )
    table, _ = evaluate.evaluate(
        spark,
        job,
        rows.withColumn("n_words", number),
        shapes.plan(spark),
        shapes.cache_of(rows),
        corpora=[corpus],
        files=rows.select(F.col("audio_path").alias("path")),
        durations=durations.union(durations),
    )
    return table.select("system", "sample_idx", "n_words", "audio_duration", "reference", "hypothesis")


# --- aggregations ------------------------------------------------------------


def _running_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = stage(_clips(spark, sf_dir, ["all"]), "clip_counts")
    running = scoring.with_running_counts(clips, ["all"], METRICS)
    return scoring.results(running, ["all"], METRICS, texts=False)


@register
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summary.group_summary(_running_table(spark, sf_dir), METRICS)
    return _rounded(found.select(*found.columns[: found.columns.index("std_WIL") + 1]))


@register
def resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = shapes.pairs(spark, sf_dir).select(
        *SPLIT_KEYS,
        F.lit("none").alias("norm_type"),
        F.col("codename").alias("system"),
        *_RESOURCES,
    )
    return _rounded(summary.group_summary(pairs), 6)


@register
def running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = shapes.table(spark, sf_dir, "events")
    late = F.when(F.col("event_type") != "error", F.col("value"))
    return _rounded(
        events.groupBy("event_type").agg(
            F.count("*").alias("n_rows"), *corpus_stats.running_stats(late, "value")
        ),
        6,
    )


@register
def split_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_profile(spark, sf_dir).splits, 6)


@register
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_profile(spark, sf_dir).datasets, 6)


@register
def grand_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_profile(spark, sf_dir).grand, 6)


@register
def run_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.run_success_rate(shapes.pairs(spark, sf_dir), ["codename", "subset"])


@register
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _profile(spark, sf_dir)
    splits, datasets = _rounded(found.splits, 6), _rounded(found.datasets, 6)
    per_split = corpus_stats.summary_report(
        splits.withColumn("entry_name", F.concat_ws(" ", "dataset", "split_key")),
        "entry_name",
        "audio_hours",
    )
    return per_split.unionByName(
        corpus_stats.summary_report(datasets, "dataset", "total_audio_hours")
    )


# --- order, union, probes ----------------------------------------------------


@register
def sort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = _clips(spark, sf_dir, NORMS, ["WER"])
    table = scoring.results(clips, NORMS, ["WER"], mode="sample", texts=False)
    return summary.sort_summary(summary.group_summary(table, ["WER"])).select(
        "subset", "split", "norm_type", "system", "sample_count"
    )


@register
def union_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = selection.valid_pairs(shapes.pairs(spark, sf_dir))
    parts = [scoring.fan_out(pairs, [n]) for n in ("lowercase", "punctuation")]
    return summary.union_results(*parts).select(
        "codename", "sample_idx", "norm_type", "reference", "hypothesis"
    )


@register
def union_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of texts as one corpus."""
    documents = corpora.scan_corpus(spark, f"{sf_dir}/documents.parquet", dataset="documents")
    lines = corpora.scan_corpus(spark, f"{sf_dir}/benchmark.parquet", dataset="benchmark")
    both = corpora.union_corpora(
        documents.select("dataset", F.col("doc_id").alias("sample_idx"), "text", "lang"),
        lines.select("dataset", F.col("item_id").alias("sample_idx"), "text"),
    )
    return both.select("dataset", "sample_idx", "lang", F.md5("text").alias("digest"))


@register
def limit_one_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shapes.samples(spark, sf_dir)
    found = {
        split: summary.is_empty(rows.filter(F.col("split") == split))
        for split in ("train", "validation", "test", "dev")
    }
    probe = F.array(
        *(F.struct(F.lit(s).alias("split"), F.lit(e).alias("is_empty")) for s, e in found.items())
    )
    return rows.agg(F.count("*").alias("n_rows")).select("n_rows", F.inline(probe))


# --- upserts and streams -----------------------------------------------------


def _cache_writes(rows: DataFrame) -> DataFrame:
    """The turns of a conversation as repeated writes for one path."""
    path = F.concat(F.lit("clips/"), F.col("conv_id").cast("string"), F.lit(".wav"))
    even = F.col("turn") % 2 == 0
    return rows.select(
        F.lit("conv").alias("dataset"),
        F.col("role").alias("codename"),
        path.alias("audio_path"),
        F.when(even, F.lit("2024Q1")).otherwise(F.lit("2025Q1")).alias("version"),
        F.col("text").alias("asr_hyp"),
        F.lit("p").alias("provider"),
        F.lit("m").alias("model"),
        F.concat(F.lit("2025010"), (F.col("turn") % 3).cast("string")).alias("hyp_gen_date"),
        F.col("turn").cast("double").alias("elapsed_time_seconds"),
        F.lit(None).cast("bigint").alias("peak_vram_bytes"),
        F.lit(None).cast("bigint").alias("vram_diff_bytes"),
        F.col("turn").alias("seq"),
    )


_WRITTEN = ("codename", "audio_path", "version", "asr_hyp", "hyp_gen_date", "elapsed_time_seconds")

_CONVERSATIONS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def _stream(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType) -> DataFrame:
    """A table as a stream.  It is one file or a folder of them: a pattern takes
    either, a plain path only a folder."""
    pattern = f"{sf_dir}/{name}.parque[t]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(pattern)


@register
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a stream into a log, read back as the latest state."""
    path = stage_path(spark, "cache_log")
    rows = _stream(spark, sf_dir, "conversations", _CONVERSATIONS)
    query = scores.stream_cache_log(_cache_writes(rows), path, f"{path}-progress")
    query.awaitTermination()
    return scores.read_cache_log(spark, path).select(*_WRITTEN)


@register
def streaming_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "stream_stats")
    rows = shapes.samples_of(_stream(spark, sf_dir, "conversations", _CONVERSATIONS))
    seconds = (F.char_length("text") % 50).cast("double")
    query = scores.stream_statistics(
        rows.withColumn("duration", seconds), path, f"{path}-progress"
    )
    query.awaitTermination()
    return _rounded(corpus_stats.split_statistics(scores.latest_batch(spark, path)), 6)


@register
def streaming_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses made from arriving conversations, scored as they arrive."""
    path = stage_path(spark, "stream_scores")
    rows = shapes.samples_of(_stream(spark, sf_dir, "conversations", _CONVERSATIONS))
    pairs = shapes.stream_pairs(rows)
    query = scores.stream_scores(
        pairs, path, f"{path}-progress", ["all"], METRICS, tasks=shapes.TASKS
    )
    query.awaitTermination()
    pooled = scores.latest_batch(spark, path).drop("dataset", "version")
    return rates.with_percents(pooled, {m: rates.rate(m) for m in METRICS})


@register
def streaming_rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clip is transcribed twice: a draft, the turns without their ends,
    arrives in a batch before the hypothesis; sentinels replace some drafts."""
    path = stage_path(spark, "stream_rescored")
    pairs = shapes.stream_pairs(shapes.samples(spark, sf_dir))
    conv = F.floor(F.col("sample_idx") / 100)
    draft = F.substring("hypothesis", 1, 60)
    final = F.when(conv % 17 == 0, F.lit("EMPTY")).otherwise(F.col("hypothesis"))
    for seq, said in enumerate((draft, final)):  # what has arrived by then is one batch
        rows = pairs.withColumn("hypothesis", said).withColumn("seq", F.lit(seq))
        rows.write.mode("append").parquet(f"{path}-in")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{path}-in")
        query = scores.stream_scores(
            arriving, path, f"{path}-progress", ["all"], METRICS, order=["seq"], tasks=shapes.TASKS
        )
        query.awaitTermination()
    pooled = scores.latest_batch(spark, path).drop("dataset", "version")
    return rates.with_percents(pooled, {m: rates.rate(m) for m in METRICS})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of all metrics by split, system and normalisation."""
    clips = _clips(spark, sf_dir, ALL_NORMS)
    return summary.sort_summary(
        scoring.corpus_metrics(clips, ALL_NORMS, METRICS).withColumnRenamed("codename", "system")
    )
