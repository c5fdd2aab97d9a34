import json
import wave
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hearscore.operators import corpus_stats, joins
from hearscore.schema import CACHE
from hearscore.session import drop_stages, shared_dir, stage
from hearscore.sources import audio, corpora, store, tsv
from hearscore.sources import cache as cache_files


def test_tsv_keeps_everything(spark, tmp_path):
    rows = [
        (1, None, "a\tb"),
        (2, "", 'say "hi"'),
        (3, "line\nbreak", '"'),
        (4, "  spaced ", "żółw"),
        (5, "back\\slash", '""'),
        (6, "#x", "a\r\nb"),
    ]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    path = str(tmp_path / "t")
    tsv.sink_tsv(df.coalesce(1), path)
    back = tsv.scan_tsv(spark, path, df.schema, multi_line=True)
    assert sorted(map(tuple, back.collect())) == rows
    (part,) = Path(path).glob("part-*")
    assert part.read_text().split("\n")[0] == "i\ta\tb"
    assert '1\t\t"a\tb"' in part.read_text() or "1\t\t" in part.read_text()


def test_tsv_overwrites_only_its_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    tsv.sink_tsv(spark.createDataFrame([(1, "a"), (2, "b")], "i int, g string"), path, partition_by=["g"])
    tsv.sink_tsv(spark.createDataFrame([(3, "b")], "i int, g string"), path, partition_by=["g"])
    found = spark.read.options(sep="\t", header=True).csv(path)
    assert sorted(map(tuple, found.collect())) == [("1", "a"), ("3", "b")]


def test_cache_files_last_line_wins(spark, tmp_path):
    value = {
        "asr_hyp": "zażółć", "provider": "p", "model": "m", "version": "v1", "codename": "sys",
        "hyp_gen_date": "20250101",
    }
    lines = [
        {"a.wav": {"v1": value}},
        {"b.wav": {"v1": value | {"elapsed_time_seconds": 0.5, "peak_vram_bytes": 7}, "v2": value}},
        {"a.wav": {"v1": value | {"asr_hyp": "later"}}},
    ]
    folder = tmp_path / "asr_hypotheses" / "conv"
    folder.mkdir(parents=True)
    body = "\n".join(json.dumps(x, ensure_ascii=False) for x in lines)
    (folder / "sys.asr_cache.jsonl").write_text(body + "\n")
    found = cache_files.scan_hyp_cache(spark, str(tmp_path / "asr_hypotheses/*/*.jsonl"))
    rows = {(r.audio_path, r.version): r for r in found.collect()}
    assert found.columns == CACHE.names
    assert set(rows) == {("a.wav", "v1"), ("b.wav", "v1"), ("b.wav", "v2")}
    assert rows["a.wav", "v1"].asr_hyp == "later"
    assert (rows["b.wav", "v1"].peak_vram_bytes, rows["b.wav", "v2"].peak_vram_bytes) == (7, None)
    assert {(r.dataset, r.codename) for r in rows.values()} == {("conv", "sys")}

    out = str(tmp_path / "written")
    cache_files.sink_hyp_cache(found, out)
    (part,) = Path(out).glob("dataset=conv/file=sys.asr_cache.jsonl/part-*")
    written = [json.loads(x) for x in part.read_text().splitlines()]
    assert "zażółć" in part.read_text()
    assert {"b.wav": {"v1": lines[1]["b.wav"]["v1"], "v2": value | {"version": "v2"}}} in written


def _cache_rows(spark, n=60):
    rows = [
        (d, c, f"clips/{k}.wav", v, f"{d} {c} {k} {v}", "p", "m", "20250101", 0.5, None, None)
        for d in ("007", "a b=c") for c in ("sys", "o+x") for k in range(n) for v in ("v1", "v2")
    ]
    return spark.createDataFrame(rows, CACHE)


def _scans(df):
    return [line for line in df._jdf.queryExecution().toString().splitlines() if "FileScan" in line]


def test_cache_reads_one_model(spark, tmp_path):
    cache = _cache_rows(spark)
    out = str(tmp_path / "sunk")
    cache_files.sink_hyp_cache(cache, out)
    whole = cache_files.scan_hyp_cache(spark, out)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, cache.collect()), key=str)
    for kind in ({"dataset": "007", "codename": "o+x"}, {"codename": "sys"}, {"dataset": "a b=c"}):
        want = sorted(map(tuple, cache.filter(" and ".join(f"{c} = '{v}'" for c, v in kind.items())).collect()), key=str)
        found = cache_files.scan_hyp_cache(spark, out, **kind)
        assert sorted(map(tuple, found.collect()), key=str) == want
        filters = [x.split("PartitionFilters: ")[1].split("PushedFilters")[0] for x in _scans(found) if "PartitionFilters: [" in x]
        assert filters and all(f"{'file' if c == 'codename' else c}#" in f for c in kind for f in filters)

    folder = tmp_path / "plain" / "conv"
    folder.mkdir(parents=True)
    for name in ("one", "t[w]o"):
        line = {"a.wav": {"v": {"asr_hyp": name, "provider": "p", "model": "m", "version": "v", "codename": name, "hyp_gen_date": "1"}}}
        (folder / f"{name}.asr_cache.jsonl").write_text(json.dumps(line) + "\n")
    for name in ("one", "t[w]o"):
        found = cache_files.scan_hyp_cache(spark, str(tmp_path / "plain"), codename=name)
        assert [r.asr_hyp for r in found.collect()] == [name]
        assert len(found.inputFiles()) == 1
    assert cache_files.scan_hyp_cache(spark, str(tmp_path / "plain"), dataset="other").count() == 0


def test_cache_table_is_joined_where_it_lies(spark, tmp_path):
    cache = _cache_rows(spark)
    for name in ("hyp_cache", "bucketed_samples"):
        spark.sql(f"drop table if exists {name}")
    table = cache_files.store_cache_table(cache, "hyp_cache", buckets=4, path=str(tmp_path / "table"))
    one = table.filter("dataset = '007' and codename = 'sys'")
    assert one.count() == 120 and "dataset#" in _scans(one)[0].split("PartitionFilters")[1].split("PushedFilters")[0]
    rows = [(d, "s", f"t{k % 2}", k, f"clips/{k}.wav" if k % 9 else "") for d in ("007", "a b=c") for k in range(0, 90)]
    samples = spark.createDataFrame(rows, "dataset string, subset string, split string, sample_idx long, audio_path string")
    runs = spark.createDataFrame(
        [("007", "s", f"t{k}", "p", "m", v, c) for k in (0, 1) for v, c in (("v1", "sys"), ("v2", "o+x"))],
        "dataset string, subset string, split string, provider string, model string, version string, codename string",
    )
    want = sorted(map(tuple, joins.attach_planned_hypotheses(samples, runs, cache).collect()), key=str)
    found = joins.attach_planned_hypotheses(samples, runs, table, bucketed=True)
    assert sorted(map(tuple, found.collect()), key=str) == want and len(want) == 180

    samples.write.bucketBy(4, "audio_path").sortBy("audio_path").option("path", str(tmp_path / "samples")).saveAsTable("bucketed_samples")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # the plan's runs are broadcast, the cache isn't
    found = joins.attach_planned_hypotheses(spark.table("bucketed_samples"), runs, table, bucketed=True)
    assert sorted(map(tuple, found.collect()), key=str) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning(audio_path" not in plan, plan


def test_broken_cache_line(spark):
    lines = spark.createDataFrame([("{not json",)], "value string")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST|Malformed"):
        cache_files.flatten_cache_lines(lines).collect()
    assert cache_files.flatten_cache_lines(lines, strict=False).count() == 0


def _wav(path, frames, rate, before=b""):
    with wave.open(str(path), "wb") as clip:
        clip.setnchannels(1)
        clip.setsampwidth(2)
        clip.setframerate(rate)
        clip.writeframes(b"\0\0" * frames)
    if before:  # a chunk ahead of the samples
        data = Path(path).read_bytes()
        chunk = b"LIST" + len(before).to_bytes(4, "little") + before + b"\0" * (len(before) % 2)
        body = data[12:36] + chunk + data[36:]
        Path(path).write_bytes(b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WAVE" + body)


def test_audio_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    _wav(tmp_path / "a.wav", 8000, 16000)
    _wav(tmp_path / "sub" / "long.wav", 400000, 16000)
    _wav(tmp_path / "late.wav", 100000, 8000, before=b"x" * 200000)
    (tmp_path / "bad.wav").write_bytes(b"not audio" * 20000)
    (tmp_path / "notes.txt").write_text("x")
    rows = audio.audio_manifest(spark, str(tmp_path)).collect()
    found = {Path(r.path).name: r.audio_duration for r in rows}
    assert len(rows) == 4
    assert found == {"a.wav": 0.5, "long.wav": 25.0, "late.wav": 12.5, "bad.wav": 0.0}
    listed = {r.path for r in audio.list_files(spark, str(tmp_path)).collect()}
    assert str(tmp_path / "sub" / "long.wav") in listed and len(listed) == 5


def test_materialize(spark, tmp_path):
    calls = []

    def compute(n):
        def run():
            calls.append(n)
            return spark.range(n)

        return run

    path = str(tmp_path / "m")
    assert store.materialize(spark, path, compute(3)).count() == 3
    assert store.materialize(spark, path, compute(5)).count() == 3
    assert store.materialize(spark, path, compute(5), force=True).count() == 5
    assert calls == [3, 5]


def test_materialize_groups(spark, tmp_path):
    rows = spark.range(30).select((F.col("id") % 3).alias("g"), "id")
    seen = []

    def compute(groups):
        seen.append(sorted(r.g for r in groups.collect()))
        return rows.join(groups, ["g"], "left_semi")

    path = str(tmp_path / "m")
    for wanted in ([0], [0, 1], [0, 1]):
        table = spark.createDataFrame([(g,) for g in wanted], "g long")
        found = store.materialize_groups(spark, path, table, compute, ["g"])
        assert found.count() == 10 * len(wanted)
    assert seen == [[0], [1]]
    store.materialize_groups(spark, path, table, compute, ["g"], force=True)
    assert seen[-1] == [0, 1]


def test_fingerprints(spark):
    kind = "g string, n int, text string, more map<string,int>"
    rows = [("a", 1, "x", {"k": 1}), ("a", 2, None, None), ("b", 1, "x", {"k": 1}), (None, 1, "x", {"k": 1})]

    def marks(rows, columns=("g", "n", "text", "more")):
        df = spark.createDataFrame(rows, kind).select(*columns).repartition(3)
        return {r.g: r.mark for r in store.fingerprints(df, ["g"]).collect()}

    first = marks(rows)
    assert first == marks(rows[::-1], ("more", "text", "g", "n")) and first["b"] == first[None] != first["a"]
    for changed in (
        [*rows, rows[0]], [("a", 1, None, {"k": 1}), ("a", 2, "x", None), *rows[2:]], [rows[0], ("a", None, "2", None), *rows[2:]],
        [("a", 1, "x", {"k": 2}), *rows[1:]],
    ):
        other = marks(changed)
        assert other["a"] != first["a"] and other["b"] == first["b"]


def test_stored_groups_notice_changes(spark, tmp_path):
    path, keys, calls = str(tmp_path / "m"), ["g"], []

    def run(values, **kind):
        rows = spark.createDataFrame(values, "g string, v int")

        def compute(groups):
            calls.append(sorted(str(r.g) for r in groups.collect()))
            return rows.join(groups, rows["g"].eqNullSafe(groups["g"]), "left_semi")

        table = store.materialize_groups(spark, path, rows, compute, keys, marks=store.fingerprints(rows, keys), **kind)
        assert sorted(map(tuple, table.select("g", "v").collect()), key=str) == sorted(values, key=str)

    first = [("a", 1), ("a", 2), ("b", 3), (None, 4)]
    run(first)
    run(first[::-1])
    assert calls == [["None", "a", "b"]]
    run([("a", 1), ("a", 5), ("b", 3), (None, 4)])
    run([("a", 1), ("a", 5), ("b", 3), (None, 4), (None, 4), ("c", 0)])
    assert calls[1:] == [["a"], ["None", "c"]]
    run(first)  # what was there once isn't taken up again
    assert calls[3:] == [["None", "a"]]
    run(first, parameters={"norms": ["none"]})
    run(first, parameters={"norms": ["none"]})
    run(first, parameters={"norms": ["none", "all"]})
    assert calls[4:] == [["None", "a", "b"]] * 2
    (tmp_path / "m" / "run=cutshort").mkdir()
    runs = len(list((tmp_path / "m").glob("run=*")))
    assert store.drop_old_runs(spark, path, keys) == runs - 2  # the last one, and that of c
    run(first, parameters={"norms": ["none", "all"]})
    assert len(calls) == 6


def test_dated_path():
    assert store.dated_path("a/", "b", "20250101") == "a/b_20250101"
    assert len(store.run_date()) == 8


def test_save_statistics(spark, tmp_path):
    def stats(word):
        df = spark.createDataFrame(
            [("hub/a", "s", "train", word, 3600.0), ('b "q"', "s", "test", "x y", 1.0)],
            "dataset string, subset string, split string, text string, duration double",
        )
        m = corpus_stats.split_moments(df)
        parts = corpus_stats.split_statistics(m), corpus_stats.dataset_statistics(m)
        return [corpus_stats.rounded(p) for p in parts] + [corpus_stats.grand_summary(m)]

    path = str(tmp_path / "s")

    def read(name):
        (part,) = Path(path).glob(f"file={name}/part-*")
        return json.loads(part.read_text())

    store.save_statistics(spark, path, *stats("one"))
    first = read("hub_a_statistics")
    assert first["dataset_name"] == "hub/a" and first["total_audio_hours"] == 1.0
    assert first["split_stats"]["s-train"]["transcript_length_stats"]["mean"] == 1.0
    store.save_statistics(spark, path, *stats("one two three"))
    assert read("hub_a_statistics") == first
    combined = read("combined_statistics")
    assert combined["datasets"]["hub/a"]["split_stats"]["s-train"]["transcript_length_stats"]["mean"] == 3.0
    assert set(combined["datasets"]) == {"hub/a", 'b "q"'}
    assert combined["summary"]["total_datasets"] == 2
    assert combined["summary"]["total_audio_hours"] == pytest.approx(3601 / 3600)
    store.save_statistics(spark, path, *stats("one two three"), force=True)
    assert read("hub_a_statistics") != first


def test_corpora(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train", 1, "x"), ("b", "test", 2, "y")], "subset string, split string, sample_idx long, text string")
    rows.write.partitionBy("subset", "split").parquet(str(tmp_path / "c"))
    corpus = corpora.scan_corpus(spark, str(tmp_path / "c"), dataset="d")
    one = corpus.filter("subset = 'a' and split = 'train'")
    assert [r.sample_idx for r in one.collect()] == [1]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(subset" in plan
    both = corpora.union_corpora(corpus, spark.createDataFrame([(3,)], "sample_idx long"))
    assert both.count() == 3


def test_stage_uses_the_shared_folder(spark):
    df = stage(spark.range(5), "some label")
    assert df.count() == 5
    assert all(shared_dir(spark) in f for f in df.inputFiles())


def test_repeated_writes_become_one_line(spark):
    rows = [("d", "c", "a.wav", "v1", f"w{i}", "p", "m", f"2025010{i}", None, None, None) for i in range(5)]
    lines = cache_files.cache_lines(spark.createDataFrame(rows, CACHE)).collect()
    assert [json.loads(r.value)["a.wav"]["v1"]["asr_hyp"] for r in lines] == ["w4"]


def test_many_chunks_before_the_samples(spark, tmp_path):
    _wav(tmp_path / "a.wav", 1000, 1000, before=b"x" * 27)
    data = (tmp_path / "a.wav").read_bytes()
    chunk = b"junk" + (3).to_bytes(4, "little") + b"data"
    body = data[12:36] + chunk * 40 + data[36:]
    (tmp_path / "b.wav").write_bytes(b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WAVE" + body)
    (tmp_path / "c.wav").write_bytes(data[:30])
    (tmp_path / "d.wav").write_bytes(b"")
    found = {Path(r.path).name: r.audio_duration for r in audio.audio_manifest(spark, str(tmp_path)).collect()}
    assert found["b.wav"] == 1.0 and found["c.wav"] == 0.0 and found.get("d.wav", 0.0) == 0.0


def test_stages_can_be_dropped(spark):
    path = Path(stage(spark.range(3), "gone").inputFiles()[0].removeprefix("file:").replace("//", ""))
    assert path.exists()
    drop_stages(spark)
    assert not path.exists()
    assert stage(spark.range(3), "new").count() == 3


def test_cache_names_survive(spark, tmp_path):
    names = ["meta_w2v large", "a+b", "50% off", "plain", "x=y"]
    rows = [("da ta+%", n, f"{k}.wav", "007", "said", "p", "m", "20250101", None, None, None) for k, n in enumerate(names)]
    cache = spark.createDataFrame(rows, CACHE)
    cache_files.sink_hyp_cache(cache, str(tmp_path / "sink"))
    back = cache_files.scan_hyp_cache(spark, str(tmp_path / "sink"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    # Plain files of the same names.
    for row in rows:
        folder = tmp_path / "files" / row[0]
        folder.mkdir(parents=True, exist_ok=True)
        (line,) = cache_files.cache_lines(spark.createDataFrame([row], CACHE)).collect()
        (folder / f"{row[1]}.asr_cache.jsonl").write_text(line.value + "\n")
    back = cache_files.scan_hyp_cache(spark, str(tmp_path / "files"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_appended_hypotheses_win(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert cache_files.stored_hyp_cache(spark, path).count() == 0
    for said in ("EMPTY", "word"):
        row = ("d", "c", "a.wav", "v", said, "p", "m", "20250101", None, None, None)
        cache_files.sink_hyp_cache(spark.createDataFrame([row], CACHE), path, append=True)
    assert [r.asr_hyp for r in cache_files.stored_hyp_cache(spark, path).collect()] == ["word"]


def test_stored_groups_keep_types_and_can_become_empty(spark, tmp_path):
    path, keys = str(tmp_path / "groups"), ["subset", "version"]
    wanted = spark.createDataFrame([("007", "2025"), ("a b", "2024"), (None, "2024"), ("none", "2024")], "subset string, version string")
    calls = []

    def compute(values):
        rows = spark.createDataFrame(values, "subset string, version string, n int")

        def of(groups):
            calls.append(groups.count())
            return rows.join(groups, [rows[k].eqNullSafe(groups[k]) for k in keys], "left_semi")

        return of

    first = [("007", "2025", 1), ("a b", "2024", 2), (None, "2024", 3)]
    table = store.materialize_groups(spark, path, wanted, compute(first), keys)
    assert sorted(map(tuple, table.select("subset", "version", "n").collect()), key=str) == sorted(first, key=str)
    assert dict(table.dtypes) == {"subset": "string", "version": "string", "n": "int"}
    # All groups are done, those without rows as well.
    store.materialize_groups(spark, path, wanted, compute([("007", "2025", 9)]), keys)
    assert calls == [4]
    one = wanted.filter("subset = '007'")
    table = store.materialize_groups(spark, path, one, compute([]), keys, force=True)
    assert table.count() == 0
    table = store.materialize_groups(spark, path, wanted, compute([]), keys)
    assert sorted(r.n for r in table.collect()) == [2, 3]


def test_package_is_shipped(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from hearscore.session import ship_package

    ship_package(spark)

    @F.pandas_udf("string")
    def origin(x: pd.Series) -> pd.Series:
        import sys

        return pd.Series([str(any(p.endswith("hearscore.zip") for p in sys.path))] * len(x))

    assert spark.range(1).select(origin("id")).first()[0] == "True"
