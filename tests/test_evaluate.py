import sys
import uuid
from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark import cloudpickle
from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import functions as F

from catalog import shapes
from catalog.stub import StubTranscriber
from hearscore.operators import scoring, transcribe
from hearscore.operators.transcribe import cache_rows, transcribe_batch
from hearscore.plans import evaluate
from hearscore.schema import CACHE
from hearscore.session import stage
from hearscore.sources.corpora import planned_samples

SF = "/root/testdata/sf0.001"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for the recorder, which workers can't import


def test_transcriber_outcomes(spark):
    rows = spark.createDataFrame(
        [(f"c/{i}.wav", i != 2) for i in range(8)] + [("", True)], "audio_path string, there boolean"
    )
    made = transcribe_batch(rows.repartition(3), StubTranscriber, exists="there")
    got = {r.audio_path: r for r in made.collect()}
    assert {p: r.asr_hyp for p, r in got.items()} == {
        **{f"c/{i}.wav": f"this is c/{i}.wav" for i in (0, 1, 3, 4)},
        "c/2.wav": "", "c/5.wav": "INVALID", "c/6.wav": "EMPTY", "c/7.wav": "", "": "",
    }
    assert got["c/0.wav"].elapsed_time_seconds is not None
    assert got["c/2.wav"].elapsed_time_seconds is None
    assert got["c/0.wav"].peak_vram_bytes is None


def test_retry_once(spark):
    class Second:
        calls = 0

        def transcribe(self, paths):
            self.calls += 1
            return [None if self.calls % 2 else "again"]

    rows = spark.createDataFrame([("a",)], "audio_path string")
    assert transcribe_batch(rows, Second).first().asr_hyp == "again"


def test_three_stages(spark, tmp_path):
    samples = shapes.samples(spark, SF)
    plan = shapes.plan(spark)
    empty = spark.createDataFrame([], CACHE)
    job = evaluate.Evaluation("test", str(tmp_path), norm_types=["none", "all"])
    table, summary = evaluate.evaluate(spark, job, samples, plan, empty, load=StubTranscriber)

    usable = samples.filter("turn < 5").count()
    assert table.count() == usable * 2 * 2
    rows = summary.collect()
    assert sum(r.sample_count for r in rows) == usable * 4
    assert [(r.subset, r.split, r.norm_type, r.system) for r in rows] == sorted(
        (r.subset, r.split, r.norm_type, r.system) for r in rows
    )
    # Another cache is noticed; the same one computes nothing.
    forced, renewed = evaluate.evaluate(spark, job, samples, plan, shapes.cache_of(samples))
    assert not forced.filter(F.col("hypothesis").startswith("this is")).count()
    stages = [job.path(name) for name in ("eval_input", "eval_output")]

    def runs():
        return [spark.read.parquet(f"{path}.groups").count() for path in stages]

    before = runs()
    again, _ = evaluate.evaluate(spark, job, samples, plan, shapes.cache_of(samples))
    assert runs() == before and sorted(map(repr, again.collect())) == sorted(map(repr, forced.collect()))
    # One changed reference: its split is computed again, for both systems.
    changed = samples.withColumn("text", F.when((F.col("conv_id") == 3) & (F.col("turn") == 1), F.lit("new words")).otherwise(F.col("text")))
    again, _ = evaluate.evaluate(spark, job, changed, plan, shapes.cache_of(samples))
    n_changed = changed.filter("text = 'new words'").select("subset", "split").distinct().count()
    assert n_changed == 1 and runs() == [n + 2 for n in before]
    assert again.filter("reference = 'new words'").count() > 0
    # Other metrics leave the eval input as it is.
    evaluate.evaluate(spark, replace(job, metrics=["WER"]), changed, plan, shapes.cache_of(samples))
    after = runs()
    assert after[0] == before[0] + 2 and after[1] > before[1] + 2
    forced, renewed = evaluate.evaluate(spark, job, samples, plan, shapes.cache_of(samples), force_prepare=True, force_metrics=True)
    assert runs()[0] > after[0]
    evaluate.write_reports(job, forced, renewed, "20250101")
    written = spark.read.options(sep="\t", header=True).csv(
        f"{job.path('reports')}/avg_eval_output_all_20250101"
    )
    assert written.count() == renewed.count() > 0


def test_only_pending_clips_are_transcribed(spark):
    samples = shapes.samples(spark, SF)
    planned = planned_samples(samples, shapes.plan(spark))
    first = evaluate.transcribe_missing(planned, spark.createDataFrame([], CACHE), StubTranscriber, day="20250101")
    cached = evaluate.merge_cache(spark.createDataFrame([], CACHE), first)
    second = evaluate.transcribe_missing(planned, cached, StubTranscriber, day="20250102")
    assert {r.asr_hyp for r in second.collect()} <= {"EMPTY", "INVALID"}
    merged = evaluate.merge_cache(cached, second)
    assert merged.count() == cached.count()
    assert merged.filter("hyp_gen_date = '20250102'").count() == second.count()


def test_durations_join_results(spark, tmp_path):
    samples = shapes.samples(spark, SF)
    job = evaluate.Evaluation("d", str(tmp_path), norm_types=["none"], metrics=["wer"], metric_mode="sample", metadata_columns=["turn"])
    pairs = evaluate.prepare_eval_input(spark, job, samples, shapes.plan(spark), shapes.cache_of(samples))
    durations = samples.filter("turn = 0").select(F.col("audio_path").alias("path"), F.lit(1.5).alias("audio_duration"))
    table, summary = evaluate.generate_metrics(spark, job, pairs, durations=durations)
    assert {(r.turn == 0, r.audio_duration) for r in table.select("turn", "audio_duration").collect()} == {(True, 1.5), (False, 0.0)}
    assert "avg_turn" not in summary.columns and "avg_WER" in summary.columns
    assert cache_rows(samples.withColumn("asr_hyp", F.lit("")).select("*", *(F.lit(None).cast("string").alias(c) for c in ("codename", "version", "provider", "model")), *(F.lit(None).alias(c) for c in CACHE.names[-3:]))).count() == 0


class Recorder:
    """Counts its calls in files, as tasks run in processes of their own."""

    def __init__(self, folder, fail_after=None):
        self.folder, self.fail_after = folder, fail_after

    def __call__(self):
        return self

    def transcribe(self, paths):
        import os
        import uuid

        if self.fail_after is not None and len(os.listdir(self.folder)) >= self.fail_after:
            os._exit(1)
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as file:
            file.write("\n".join(paths))
        return [f"said {p}" for p in paths]

    def calls(self):
        return [p.read_text().split("\n") for p in self.folder.iterdir()]


def _recorder(tmp_path, name, **kind):
    folder = tmp_path / name
    folder.mkdir()
    return Recorder(folder, **kind)


def test_saved_hypotheses_are_not_made_again(spark, tmp_path):
    samples, plan = shapes.samples(spark, SF).filter("conv_id < 8"), shapes.plan(spark)
    cache = str(tmp_path / "cache")
    n = samples.count() * 2
    tables = []
    for name in ("first", "second"):
        made = _recorder(tmp_path, name)
        job = evaluate.Evaluation(name, str(tmp_path / "out"), norm_types=["none"], metrics=["WER"])
        table, _ = evaluate.evaluate(
            spark, job, samples, plan, cache, load=made, clips_per_commit=7, batch_size=4, tasks=2
        )
        tables.append(sorted(map(repr, table.select("system", "sample_idx", "hypothesis", "WER").collect())))
        calls = made.calls()
        assert sum(map(len, calls)) == (n if name == "first" else 0)
        assert max(map(len, calls), default=0) <= 4
    assert tables[0] == tables[1] and len(tables[0]) == n


def test_a_failure_keeps_what_was_committed(spark, tmp_path):
    import pytest

    samples, plan = shapes.samples(spark, SF).filter("conv_id < 6"), shapes.plan(spark)
    planned, cache = planned_samples(samples, plan), str(tmp_path / "cache")
    broken = _recorder(tmp_path, "broken", fail_after=9)
    with pytest.raises(Exception, match=r"(?s).*"):
        evaluate.save_missing(planned, cache, broken, clips_per_commit=6, batch_size=1, tasks=1)
    kept = evaluate.stored_hyp_cache(spark, cache).count()
    assert kept > 0
    rest = _recorder(tmp_path, "rest")
    evaluate.save_missing(planned, cache, rest, clips_per_commit=6, batch_size=1, tasks=1)
    assert len(rest.calls()) == planned.count() - kept
    assert evaluate.stored_hyp_cache(spark, cache).count() == planned.count()


def test_texts_do_not_reach_the_recogniser(spark):
    samples, plan = shapes.samples(spark, SF), shapes.plan(spark)
    made = evaluate.transcribe_missing(planned_samples(samples, plan), shapes.cache_of(samples), StubTranscriber)
    plan_text = made._jdf.queryExecution().executedPlan().toString()
    (line,) = [x for x in plan_text.split("\n") if "MapInPandas" in x]
    assert "text#" not in line


def test_metadata_columns_keep_their_names(spark):
    rows = shapes.pairs(spark, SF).withColumn("n_speakers", F.lit(2)).withColumn("n_none_hits", F.lit("kept"))
    table = evaluate.sample_results(rows, ["none"], ["WER"])
    assert {(r.n_speakers, r.n_none_hits) for r in table.select("n_speakers", "n_none_hits").collect()} == {(2, "kept")}


def test_running_values_leave_texts_where_they_are(spark):
    pairs = shapes.pairs(spark, SF, ["conv_id"])
    metrics = ["WER", "CER"]
    table = evaluate.sample_results(pairs, ["none", "all"], metrics, tasks=6)
    clips = stage(scoring.score_clips(pairs, ["none", "all"], metrics), "clips")
    plain = scoring.results(scoring.with_running_counts(clips, ["none", "all"], metrics), ["none", "all"], metrics)
    assert table.columns == plain.columns
    assert sorted(map(repr, table.collect())) == sorted(map(repr, plain.collect())) and table.count() > 100
    plan = table._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line or "Exchange" in line or "Sort " in line]
    assert windows and not any("text#" in line or "hypothesis#" in line for line in windows)
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert any("Bucketed: true" in line and "text#" in line for line in scans)
    # Only the side of the sums is shuffled.
    below = plan[plan.index("ShuffledHashJoin") :]
    texts = min(i for i, line in enumerate(below.splitlines()) if "FileScan" in line and "text#" in line)
    assert not any("Exchange" in line for line in below.splitlines()[:texts])


def test_running_values_with_null_keys_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(scoring, "_CLIPS", 0)  # joins by sorting
    rows = [(None if k % 2 else "d", "s", None, "c", "v", k, f"{k}.wav", "a b c", "a x c" if k % 3 else "a b c") for k in range(40)]
    kind = "dataset string, subset string, split string, codename string, version string, sample_idx long, audio_path string, text string, hypothesis string"
    pairs = spark.createDataFrame(rows, kind)
    got = evaluate.sample_results(pairs, ["none"], ["WER"], counts=True).collect()
    for dataset in (None, "d"):
        own = sorted((r for r in got if r.dataset == dataset), key=lambda r: r.sample_idx)
        wrong, seen = 0, 0
        for r in own:
            wrong, seen = wrong + (r.sample_idx % 3 != 0), seen + 3
            assert r.WER == round(100 * wrong / seen, 2)
        assert len(own) == 20


def test_clips_that_always_fail_are_given_up(spark, tmp_path):
    path, asked = str(tmp_path / "cache"), tmp_path / "asked"
    asked.mkdir()
    kind = "dataset string, subset string, split string, codename string, version string, provider string, model string, audio_path string, sample_idx long"
    planned = spark.createDataFrame([("d", "s", "t", "c", "v", "p", "m", f"{k}.wav", k) for k in range(4)], kind)

    def load():
        class Shaky:
            """1.wav never answers, 2.wav not at first."""

            def transcribe(self, paths):
                for p in paths:
                    (asked / f"{p}-{uuid.uuid4().hex}").touch()
                if "1.wav" in paths or ("2.wav" in paths and len(list(asked.glob("2.wav-*"))) < 3):
                    raise RuntimeError("no answer")
                return [f"said {p}" for p in paths]

        return Shaky()

    def tries():
        return len(list(asked.glob("1.wav-*")))

    calls = []
    for _ in range(6):
        before = tries()
        evaluate.save_missing(planned, path, load, batch_size=1, max_failures=3)
        calls.append(tries() - before)
    assert calls == [1, 1, 1, 0, 0, 0]
    failing = {r.audio_path: r.failures for r in evaluate.failure_counts(spark, path).collect()}
    assert failing == {"1.wav": 3}
    cached = evaluate.stored_hyp_cache(spark, path)
    assert sorted(r.asr_hyp for r in cached.collect()) == ["said 0.wav", "said 2.wav", "said 3.wav"]


def test_profile_of_the_stage(spark):
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(2)).build
    rows = spark.createDataFrame([("a.wav",)], "audio_path string")
    with pytest.warns(UserWarning, match="without its resource profile"):
        made = transcribe_batch(rows, StubTranscriber, profile=profile)
    assert made.count() == 1

    def on(master, dynamic=None):
        conf = {"spark.dynamicAllocation.enabled": dynamic} if dynamic else {}
        context = SimpleNamespace(master=master, getConf=lambda: conf)
        return transcribe.stage_profile(SimpleNamespace(sparkContext=context), own)

    executors = ResourceProfileBuilder().require(ExecutorResourceRequests().resource("gpu", 1)).build
    for own in (profile, executors):
        assert on("yarn", "true") is own and on("k8s://x", "true") is own
    own = profile
    assert on("spark://host:7077") is own  # asks for nothing of executors
    own = executors
    with pytest.warns(UserWarning):
        assert on("yarn") is None
