import random

import pytest
from pyspark.sql import functions as F

from catalog import shapes
from catalog.queries import QUERIES
from hearscore.functions import rates
from hearscore.operators import corpus_stats, scoring
from hearscore.operators.joins import latest_hypotheses
from hearscore.streaming import scores

METRICS = list(rates.METRICS)


def _rows(df, *drop):
    return sorted(map(repr, (tuple(r) for r in df.drop(*drop).select(sorted(df.drop(*drop).columns)).collect())))


def _conversations(spark, tmp_path, files=5):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    path = str(tmp_path / "in")
    df.repartition(files).write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return df, stream


def test_statistics_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    batch, stream = _conversations(spark, tmp_path)

    def rows(df):
        return shapes.samples_of(df).withColumn("duration", F.char_length("text") / 7)

    out = str(tmp_path / "out")
    query = scores.stream_statistics(rows(stream), out, str(tmp_path / "progress"))
    query.awaitTermination()
    assert len(query.recentProgress) >= 5

    def finish(moments):
        return corpus_stats.rounded(corpus_stats.split_statistics(moments), 6)

    streamed = finish(scores.latest_batch(spark, out))
    assert _rows(streamed) == _rows(finish(corpus_stats.split_moments(rows(batch))))


def test_scores_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    batch, stream = _conversations(spark, tmp_path)

    def rows(df):
        return shapes.stream_pairs(shapes.samples_of(df))

    out, norms = str(tmp_path / "out"), ["none", "all"]
    scores.stream_scores(rows(stream), out, str(tmp_path / "progress"), norms, METRICS).awaitTermination()
    clips = scoring.score_clips(rows(batch), norms, METRICS)
    assert _rows(scores.latest_batch(spark, out)) == _rows(scoring.corpus_counts(clips, norms, METRICS))


def test_replaced_hypotheses_count_once(spark, tmp_path):
    """Several batches with replacements, late writes and sentinels equal the
    last write per clip scored at once."""
    r = random.Random(5)
    kind = (
        "dataset string, subset string, split string, codename string, version string, sample_idx long, "
        "audio_path string, text string, hypothesis string, hyp_gen_date string, seq long, provider string"
    )
    said = ["a b c", "a x c", "b c", "", "EMPTY", None, "a b c d e", "INVALID", "..."]
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    norms, seen, seq = ["none", "all"], [], 0
    for batch in range(6):
        rows = []
        for _ in range(30):
            seq += 1
            day = f"2025010{r.randint(1, 5)}"
            k = r.randint(0, 14)
            rows.append(("d", "s", f"p{k % 2}", f"c{r.randint(0, 1)}", "v", k, f"{k}.wav", "a b c" if k else None, r.choice(said), day, seq, "p"))
        seen += rows
        spark.createDataFrame(rows, kind).coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        query = scores.stream_scores(stream, out, progress, norms, METRICS, order=["hyp_gen_date", "seq"])
        query.awaitTermination()
        latest = latest_hypotheses(spark.createDataFrame(seen, kind), ["hyp_gen_date", "seq"])
        want = scoring.corpus_counts(scoring.score_clips(latest, norms, METRICS), norms, METRICS)
        got = scores.latest_batch(spark, out)
        assert _rows(got) == _rows(want), batch
    assert len(list((tmp_path / "out").glob("batch=*"))) <= 1 + scores._RESULTS_KEPT
    assert sum(row.sample_count for row in got.filter("norm_type = 'none'").collect()) < len({x[3:6:2] for x in seen})


def test_wrong_then_right(spark, tmp_path):
    kind = "dataset string, subset string, split string, codename string, version string, sample_idx long, text string, hypothesis string"
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for said, hits in (("a x", 1), ("a b", 2), ("a b", 2), (None, None)):
        spark.createDataFrame([("d", "s", "p", "c", "v", 1, "a b", said)], kind).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        scores.stream_scores(stream, out, progress, ["none"], ["WER"]).awaitTermination()
        got = [(x.sample_count, x.hits) for x in scores.latest_batch(spark, out).collect()]
        assert got == ([(1, hits)] if hits else [])


def test_cache_log(spark, tmp_path):
    schema = (
        "dataset string, codename string, audio_path string, version string, asr_hyp string, "
        "hyp_gen_date string, seq long"
    )
    source, log, progress = (str(tmp_path / n) for n in ("in", "log", "progress"))

    def arrive(*rows):
        spark.createDataFrame([("d", "c", *r) for r in rows], schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        scores.stream_cache_log(stream, log, progress).awaitTermination()
        return {(r.audio_path, r.version): r.asr_hyp for r in scores.read_cache_log(spark, log).collect()}

    assert arrive(("a", "v1", "one", "1", 1), ("a", "v1", "two", "1", 2)) == {("a", "v1"): "two"}
    assert arrive(("a", "v2", "x", "1", 1), ("b", "v1", "y", "1", 1)) == {
        ("a", "v1"): "two", ("a", "v2"): "x", ("b", "v1"): "y",
    }
    state = arrive(("a", "v1", "late", "0", 9), ("b", "v1", "new", "2", 0))
    assert state == {("a", "v1"): "two", ("a", "v2"): "x", ("b", "v1"): "new"}
    scores.compact_cache_log(spark, log, str(tmp_path / "compact"))
    compact = spark.read.parquet(str(tmp_path / "compact"))
    assert {(r.audio_path, r.version): r.asr_hyp for r in compact.collect()} == state


_LOGGED = "dataset string, codename string, audio_path string, version string, asr_hyp string, hyp_gen_date string, seq long"


def test_cache_log_in_levels(spark, tmp_path, monkeypatch):
    """Many batches: few segments, the state of the last write per key, the
    same after a repeated batch and for who read before a merge."""
    monkeypatch.setattr(scores, "_FAN", 3)
    r, log, state, held = random.Random(6), str(tmp_path / "log"), {}, None

    def read():
        return {(x.audio_path, x.version): x.asr_hyp for x in scores.read_cache_log(spark, log).collect()}

    ranks = {}
    for batch in range(30):
        rows = []
        for k in range(4):
            key, day = (f"{r.randint(0, 9)}.wav", f"v{r.randint(0, 1)}"), f"2025010{r.randint(1, 3)}"
            rows.append(("d", "c", *key, f"{batch}-{k}", day, batch * 10 + k))
            if ranks.get(key, ("", -1, -1)) <= (day, batch * 10 + k, batch):
                ranks[key], state[key] = (day, batch * 10 + k, batch), f"{batch}-{k}"
        df = spark.createDataFrame(rows, _LOGGED).coalesce(1)
        scores.append_cache_log(df, log, batch)
        if held is not None:  # read before this batch, used after it
            assert {(x.audio_path, x.version): x.asr_hyp for x in held[0].collect()} == held[1]
        if batch % 4 == 1:
            scores.append_cache_log(df, log, batch)
            scores.append_cache_log(df.limit(0), log, batch - 1)
        if batch % 3 == 2:
            assert read() == state
            held = scores.read_cache_log(spark, log), dict(state)
    segments = scores._read_manifest(spark, scores._manifests(spark, log)[-1])["segments"]
    assert [s["level"] for s in segments] == [3, 1]  # 27 and 3 batches
    assert len(list((tmp_path / "log" / "segments").glob("*"))) <= 12
    assert len(scores.read_cache_log(spark, log).inputFiles()) <= 2 * 8


def test_cut_short_batch_is_not_seen(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")

    def rows(said):
        return spark.createDataFrame([("d", "c", "a", "v", said, "1", 1)], _LOGGED)

    scores.append_cache_log(rows("one"), log, 0)
    with monkeypatch.context() as broken:
        broken.setattr(scores, "_commit_manifest", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            scores.append_cache_log(rows("two"), log, 1)
    assert scores.read_cache_log(spark, log).first().asr_hyp == "one"
    scores.append_cache_log(rows("two"), log, 1)
    assert [x.asr_hyp for x in scores.read_cache_log(spark, log).collect()] == ["two"]


@pytest.mark.parametrize("name", ["cache_upsert", "streaming_stats", "streaming_scores"])
def test_streamed_table_is_a_file_or_a_folder(spark, tmp_path, name):
    """The table as a single file and as a folder of four gives the same rows."""
    rows = [(c, t, "user" if t % 2 else "assistant", f"word{c} and {t} more, said") for c in range(1, 9) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one, many = tmp_path / "one", tmp_path / "many"
    df.coalesce(1).write.parquet(str(tmp_path / "made"))
    one.mkdir()
    next((tmp_path / "made").glob("part-*.parquet")).rename(one / "conversations.parquet")
    df.repartition(4).write.parquet(str(many / "conversations.parquet"))
    found = [_rows(QUERIES[name](spark, str(place))) for place in (one, many)]
    assert found[0] == found[1] != []


def test_state_of_streamed_scores_needs_no_python_per_clip(spark, tmp_path, monkeypatch):
    """Clips are compared by aggregates over a log: keys may be null, equal
    ranks go to the later row, and a batch that is repeated changes nothing."""
    kind = "dataset string, subset string, split string, codename string, version string, sample_idx long, text string, hypothesis string"
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    monkeypatch.setattr(scores, "_FAN", 2)

    def run():
        stream = spark.readStream.schema(kind).parquet(source)
        scores.stream_scores(stream, out, progress, ["none"], ["WER"]).awaitTermination()
        return [(x.subset, x.sample_count, x.hits) for x in scores.latest_batch(spark, out).orderBy("subset").collect()]

    def arrive(*rows):
        spark.createDataFrame([("d", s, "p", "c", "v", k, "a b", said) for s, k, said in rows], kind).coalesce(1).write.mode(
            "append"
        ).parquet(source)
        return run()

    assert arrive((None, 1, "a x"), ("s", None, "a b"), ("s", 2, "x"), ("s", 2, "b")) == [(None, 1, 1), ("s", 2, 3)]
    assert arrive((None, 1, "a b"), ("s", None, "a")) == [(None, 1, 2), ("s", 2, 2)]
    with monkeypatch.context() as broken:  # the result is written, the log isn't
        broken.setattr(scores, "_commit_manifest", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division"):
            arrive(("s", 2, "a b"), ("s", 3, "a b"))
    assert run() == [(None, 1, 2), ("s", 3, 5)]
    assert arrive(("s", 2, None), ("s", 3, "a")) == [(None, 1, 2), ("s", 2, 2)]
    assert not (tmp_path / "progress" / "state").exists()
