import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_functions import GOLDEN, PLAIN, brute_alignment

from hearscore.functions import align, rates
from hearscore.operators import corpus_stats, joins, ordered, scoring, selection, summary
from hearscore.plans import run_plan
from hearscore.schema import CACHE
from hearscore.session import stage


def numbered(spark, rows=3000, seed=2):
    """Rows of which one group has two thirds; one group key is NULL."""
    rnd = random.Random(seed)
    picked = rnd.sample(range(-(10**6), 10**7), rows)
    data = [(None if i % 7 == 0 else ("hot" if i % 3 else "cold"), p, rnd.randrange(100))
            for i, p in enumerate(picked)]
    return data, spark.createDataFrame(data, "k string, i long, v long")


@pytest.mark.parametrize("bits", [4, 7, 18, 30])
def test_running_totals_on_every_level(spark, bits):
    data, df = numbered(spark)
    want, sums = {}, defaultdict(int)
    for k, i, v in sorted(data, key=lambda r: r[1]):
        sums[k] += v
        want[(k, i)] = sums[k]
    for parts in (1, 13):
        out = ordered.running_totals(df.repartition(parts), ["k"], "i", ["v"], bits=bits)
        assert out.columns == ["k", "i", "v", "v_so_far"]
        assert {(r.k, r.i): r.v_so_far for r in out.collect()} == want


def test_running_totals_bounds_each_window(spark):
    """No window partition of a hot group exceeds the bucket size."""
    df = spark.range(20000).select(F.lit("hot").alias("k"), F.col("id").alias("i"), F.lit(1).alias("v"))
    out = ordered.running_totals(df, ["k"], "i", ["v"], bits=8)
    assert out.filter(F.col("v_so_far") != F.col("i") + 1).isEmpty()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2


@pytest.mark.parametrize("count", [1, 10, 450, 10**6])
def test_first_rows_of_hot_groups(spark, count):
    data, df = numbered(spark)
    rows = df.select(
        F.col("k").alias("dataset"), F.lit("s").alias("subset"), F.lit("t").alias("split"),
        F.col("i").alias("sample_idx"),
    )
    want = set()
    for key in {d[0] for d in data}:
        want |= {(key, i) for i in sorted(i for k, i, _ in data if k == key)[:count]}
    found = selection.first_n_per_split(rows, count).collect()
    assert len(found) == len(want)
    assert {(r.dataset, r.sample_idx) for r in found} == want


def test_caps(spark):
    _, df = numbered(spark, 50)
    rows = df.select(F.col("k").alias("dataset"), F.lit("s").alias("subset"),
                     F.lit("t").alias("split"), F.col("i").alias("sample_idx"))
    assert selection.first_n_per_split(rows, None).count() == 50
    assert selection.first_n_per_split(rows, 0).count() == 0
    assert selection.seeded_sample_per_split(rows, 0).count() == 50
    one, two = (
        {r.sample_idx for r in selection.seeded_sample_per_split(rows.repartition(p), 5).collect()}
        for p in (1, 9)
    )
    assert one == two and len(one) == 15
    other = selection.seeded_sample_per_split(rows, 5, seed=1).collect()
    assert {r.sample_idx for r in other} != one


def test_subset_lookup(spark):
    df = spark.createDataFrame([("a", "train", 1), ("b", "test", 2)], "subset string, split string, x int")
    assert selection.subset_lookup(df, "a", "train").count() == 1
    with pytest.raises(KeyError):
        selection.subset_lookup(df, "a", "test")


def eval_rows(spark, rows, version="v1"):
    """(idx, ref, hyp) as an eval input of one run."""
    data = [("d", "s", "test", i, f"c/{i}.wav", "p", "m", version, "sys", r, h, 1.0, 5, None)
            for i, r, h in rows]
    return spark.createDataFrame(
        data,
        "dataset string, subset string, split string, sample_idx long, audio_path string, "
        "provider string, model string, version string, codename string, text string, "
        "hypothesis string, resources_gen_time_seconds double, resources_peak_vram_bytes long, "
        "resources_vram_diff_bytes long",
    )


RUNNING = [
    (50.0, 42.86, 50.0, 66.67),
    (66.67, 50.0, 66.67, 86.67),
    (66.67, 61.9, 60.0, 80.25),
    (63.64, 43.75, 58.33, 79.34),
    (50.0, 31.11, 46.67, 67.35),
    (60.0, 46.94, 52.94, 73.33),
    (66.67, 50.0, 57.14, 75.0),
]


@pytest.mark.parametrize("bits", [1, 18])
def test_running_values_of_golden_rows(spark, bits):
    pairs = eval_rows(spark, [(i, r, h) for i, (r, h, *_) in enumerate(GOLDEN)])
    clips = stage(scoring.score_clips(pairs.repartition(3), ["none"], list(rates.METRICS)), "t")
    run = scoring.with_running_counts(clips, ["none"], list(rates.METRICS), bits=bits)
    table = scoring.results(run, ["none"], list(rates.METRICS)).orderBy("sample_idx").collect()
    assert [(r.WER, r.CER, r.MER, r.WIL) for r in table] == RUNNING
    assert [(r.WER_sample, r.WIL_sample) for r in table] == [(g[3], g[6]) for g in GOLDEN]
    pooled = scoring.corpus_metrics(clips, ["none"], list(rates.METRICS)).first()
    assert (pooled.WER, pooled.CER, pooled.MER, pooled.WIL) == RUNNING[-1]
    assert table[0].id == "0.wav" and table[0].system == "sys" and table[0].ref_type == "text"


TEXT_PAIRS = [
    (1, "A b,  c", "a B c"),
    (2, "<unk>", "x"),
    (3, "?!", "x y"),
    (4, "a b", "EMPTY"),
    (5, "a b", "INVALID"),
    (6, "a b", None),
    (7, None, "a"),
    (8, "a b", "empty"),
    (9, "a", ""),
    (10, "  ", "a"),
    (11, "un_trunc a\n\nb", "a b c"),
]


def test_every_normalisation_keeps_its_own_rows(spark):
    norms = list(PLAIN)
    pairs = eval_rows(spark, TEXT_PAIRS)
    clips = scoring.score_clips(pairs, norms, ["wer", "cer"])
    table = scoring.results(clips, norms, ["WER", "CER"], mode="sample", counts=True)
    found = {(r.sample_idx, r.norm_type): r for r in table.collect()}
    want = {}
    for i, ref, hyp in TEXT_PAIRS:
        if ref is None or hyp in (None, "EMPTY", "INVALID"):
            continue
        for n, plain in PLAIN.items():
            if plain(ref) and plain(hyp):
                want[(i, n)] = (plain(ref), plain(hyp))
    assert set(found) == set(want)
    for key, (ref, hyp) in want.items():
        row = found[key]
        assert (row.reference, row.hypothesis) == (ref, hyp)
        edits, hits = brute_alignment(align.score_tokens(ref), align.score_tokens(hyp))
        assert (row.subs + row.dels + row.ins, row.hits) == (edits, hits)
        assert row.char_edits == align.char_distances([(ref.strip(), hyp.strip())])[0]
    fanned = scoring.fan_out(selection.valid_pairs(pairs), norms)
    assert {(r.sample_idx, r.norm_type) for r in fanned.collect()} == set(want)


def test_scoring_calls_python_once(spark):
    pairs = eval_rows(spark, TEXT_PAIRS)
    clips = scoring.score_clips(pairs, list(PLAIN), list(rates.METRICS))
    plan = scoring.corpus_counts(clips, list(PLAIN), list(rates.METRICS))
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_required_columns(spark):
    with pytest.raises(ValueError):
        selection.valid_pairs(spark.range(1), "text", "hypothesis")


def test_group_summary(spark):
    pairs = eval_rows(spark, [(1, "a b", "a"), (2, "a b", "a b")])
    clips = scoring.score_clips(pairs, ["none", "all"], ["WER"])
    table = scoring.results(clips, ["none", "all"], ["WER"], mode="sample", texts=False)
    row = summary.sort_summary(summary.group_summary(table, ["WER"])).first()
    assert (row.norm_type, row.sample_count, row.avg_WER) == ("all", 2, 25.0)
    assert row.std_WER == pytest.approx(35.35533905932738)
    assert row.avg_resources_gen_time_seconds == 1.0
    assert row.avg_resources_vram_diff_bytes is None
    single = summary.group_summary(table.filter("sample_idx = 1"), ["WER"]).first()
    assert single.std_WER is None
    auto = selection.metric_columns(table)
    assert auto[0] == ["WER", "WER_sample"] and len(auto[1]) == 3


def test_union_needs_equal_columns(spark):
    a = spark.range(2)
    assert summary.union_results(a, a).count() == 4
    with pytest.raises(ValueError):
        summary.union_results(a, a.withColumn("x", F.lit(1)))


def test_success_rate_floors(spark):
    df = spark.createDataFrame([("r", "a"), ("r", ""), ("r", "EMPTY"), ("q", None)], "k string, hypothesis string")
    found = {r.k: tuple(r)[1:] for r in summary.run_success_rate(df, ["k"]).collect()}
    assert found == {"r": (3, 2, 66), "q": (1, 0, 0)}


def cache(spark, rows):
    """(path, version, hyp, date) of one codename."""
    data = [("d", "sys", p, v, h, "p", "m", day, 0.5, None, None) for p, v, h, day in rows]
    return spark.createDataFrame(data, CACHE)


def test_attach_and_pending(spark):
    rows = [(1, "c/1"), (2, "c/2"), (3, "c/3"), (4, "c/4"), (5, ""), (6, None), (7, "")]
    data = [("d", "s", "t", i, p, "sys", "v1") for i, p in rows]
    planned = spark.createDataFrame(
        data,
        "dataset string, subset string, split string, sample_idx long, audio_path string, "
        "codename string, version string",
    )
    known = cache(spark, [("c/1", "v1", "hi", "1"), ("c/2", "v1", "EMPTY", "1"),
                          ("c/3", "v2", "old", "1"), ("", "v1", "never", "1")])
    attached = {r.sample_idx: r for r in joins.attach_hypotheses(planned, known).collect()}
    assert {i: r.hypothesis for i, r in attached.items()} == {
        1: "hi", 2: "EMPTY", 3: None, 4: None, 5: None, 6: None, 7: None
    }
    assert attached[1].resources_gen_time_seconds == 0.5
    pending = {r.sample_idx for r in joins.pending_work(planned, known).collect()}
    assert pending == {2, 3, 4, 5, 6, 7}
    assert joins.pending_work(planned, known, recreate=True).count() == 7


def test_planned_hypotheses_are_those_of_the_plain_join(spark):
    rows = [("d", "s", t, i, p, f"text {i}") for i, (t, p) in enumerate(
        [("train", "a"), ("train", ""), ("test", "b"), ("test", None), ("dev", "a"), ("test", "a")])]
    samples = spark.createDataFrame(rows, "dataset string, subset string, split string, sample_idx long, audio_path string, text string")
    runs = spark.createDataFrame(
        [("d", "s", t, "p", "m", v, c) for t in ("train", "test") for v in ("v1", "v2") for c in ("x", "y")],
        "dataset string, subset string, split string, provider string, model string, version string, codename string",
    )
    known = spark.createDataFrame(
        [("d", c, p, v, f"{c}{p}{v}", "p", "m", "1", 0.5, 1, None)
         for c in ("x", "z") for p in ("a", "b", "") for v in ("v1", "v3")], CACHE)
    plain = joins.attach_hypotheses(samples.join(runs, ["dataset", "subset", "split"]), known)
    found = joins.attach_planned_hypotheses(samples, runs, known)
    assert found.columns == plain.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))
    assert found.count() == 20 and found.filter("hypothesis is not null").count() == 3


def test_latest_hypotheses(spark):
    rows = cache(spark, [("p", "v1", "old", "20250101"), ("p", "v1", "new", "20250103"),
                         ("p", "v2", "other", "20250102"), ("q", "v1", "x", "20250101")])
    by_version = joins.latest_hypotheses(rows, ["hyp_gen_date"])
    assert sorted((r.audio_path, r.version, r.asr_hyp) for r in by_version.collect()) == [
        ("p", "v1", "new"), ("p", "v2", "other"), ("q", "v1", "x")
    ]
    whole = joins.latest_hypotheses(rows, ["hyp_gen_date"], all_versions=False)
    assert sorted((r.audio_path, r.version, r.asr_hyp) for r in whole.collect()) == [
        ("p", "v1", "new"), ("q", "v1", "x")
    ]
    assert whole.columns == rows.columns


def test_attach_metadata_fans_out_by_path_only(spark):
    metrics = spark.createDataFrame([(1, "p", 5.0), (2, "p", 6.0)], "sample_idx long, audio_path string, WER double")
    pairs = spark.createDataFrame([(1, "p", "m1", 9.0), (2, "p", "m2", 9.0)], "sample_idx long, audio_path string, speaker string, WER double")
    by_path = joins.attach_metadata(metrics, pairs.drop("sample_idx"), on=["audio_path"])
    assert by_path.count() == 4 and "WER_right" in by_path.columns
    by_row = joins.attach_metadata(metrics, pairs.drop("audio_path"), on=["sample_idx"])
    assert {(r.sample_idx, r.speaker) for r in by_row.collect()} == {(1, "m1"), (2, "m2")}


def resolve_plainly(path, files, root):
    if path in files:
        return path
    folder, _, name = path.rpartition("/")
    near = [f for f in files if f.rpartition("/")[2].startswith(name)
            and (f.startswith(folder + "/") or not folder)]
    far = [f for f in files if f.rpartition("/")[2] == name and f.startswith(root + "/")]
    return min(near, default=min(far, default=""))


def test_resolve_audio_paths(spark):
    rnd = random.Random(4)
    names = ["a.wav", "a.wav.gz", "ab.wav", "b.wav", "b", "żółw.wav", "c.flac"]
    folders = ["x", "x/y", "x/y/z", "q", "", "cache/d", "cache/d/e", "/abs/x"]
    every = [f"{f}/{n}" if f else n for f in folders for n in names]
    for _ in range(4):
        files = rnd.sample(every, 18)
        wanted = rnd.sample(every, 30) + ["none/at-all.wav"]
        found = joins.resolve_audio_paths(
            spark.createDataFrame([(w,) for w in wanted * 2], "audio_path string"),
            spark.createDataFrame([(f,) for f in files], "path string"),
            cache_root="cache",
        )
        got = {r.path: r.resolved for r in found.collect()}
        assert got == {w: resolve_plainly(w, files, "cache") for w in wanted}
    samples = spark.createDataFrame([(1, wanted[0]), (2, ""), (3, "nowhere")], "sample_idx long, audio_path string")
    placed = {r.sample_idx: r.audio_path for r in joins.apply_resolved_paths(samples, found).collect()}
    assert placed == {1: got[wanted[0]], 2: "", 3: ""}


@pytest.mark.parametrize("ranges", ["1", "7", "40"])
def test_resolve_nested_names_over_ranges(spark, ranges):
    """Wanted names that are prefixes of each other, in ranges of any size."""
    rnd = random.Random(int(ranges))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    letters = ["a", "ab", "b", "é", "aa", "\U0001f600"]

    def name():
        return "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 5)))

    files = sorted({f"{rnd.choice(['x', 'x/y', 'x/y/z', 'w', 'x/q'])}/{name()}" for _ in range(300)})
    wanted = sorted({f"{rnd.choice(['x', 'x/y', 'w', '', 'v'])}/{name()}".removeprefix("/") for _ in range(150)} | {"x/", "w/a", "x/a"})
    found = joins.resolve_audio_paths(
        spark.createDataFrame([(w,) for w in wanted], "audio_path string"),
        spark.createDataFrame([(f,) for f in files], "path string"),
        cache_root="x",
    )
    got = {r.path: r.resolved for r in found.collect()}
    for k, v in old.items():
        spark.conf.set(k, v)
    assert got == {w: resolve_plainly(w, files, "x") for w in wanted}
    assert len({v for v in got.values() if v}) > 30


def test_resolve_spreads_one_name_and_one_folder(spark):
    """Many files of one name, and a folder with a third of all files: the
    sorted listing has no more entries than folders that are asked for, and
    its ranges are even."""
    n = 20_000
    same = spark.range(n).select(F.format_string("d%05d/1.wav", "id").alias("path"))
    full = spark.range(n).select(F.format_string("big/%05d.wav", "id").alias("path"))
    files = same.union(full)
    wanted = spark.range(n // 2).select(F.format_string("big/%05d", F.col("id") * 2).alias("audio_path")).union(
        spark.createDataFrame([("1.wa",), ("d00007/1",), ("big/1",), ("none/x",)], "audio_path string")
    )
    found = joins.resolve_audio_paths(wanted, files, cache_root="nowhere")
    assert found.filter(F.col("resolved") == F.concat("path", F.lit(".wav"))).count() == n // 2 + 1
    got = {r.path: r.resolved for r in found.filter("path NOT LIKE 'big/%' OR path = 'big/1'").collect()}
    assert got == {"1.wa": "d00000/1.wav", "d00007/1": "d00007/1.wav", "big/1": "big/10000.wav", "none/x": ""}
    missing = wanted.select(F.substring_index("audio_path", "/", -1).alias("name"), F.regexp_replace("audio_path", r"/?[^/]*\z", "").alias("folder"))
    listing = joins._lowest_with_prefix(files.select(F.col("path").alias("file")), missing)
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Join" not in plan  # what is sorted was stored before


def test_resolve_does_not_pair_files_of_one_folder(spark):
    """4000 wanted names and 4000 files in one folder, none equal."""
    n = 4000
    wanted = spark.range(n).select(F.format_string("big/%05d.wav", "id").alias("audio_path"))
    files = spark.range(n).select(F.format_string("big/%05d.wav.part", "id").alias("path"))
    found = joins.resolve_audio_paths(wanted, files)
    assert found.filter(F.col("resolved") == F.concat("path", F.lit(".part"))).count() == n
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan


def test_run_plan(spark):
    groups = [
        run_plan.ModelGroup("w", ["tiny", "Large/V3"], "openai", ["2024Q1", "2025Q1"]),
        run_plan.ModelGroup("m", ["w2v"], ["meta"], "2025Q1"),
    ]
    corpora = [run_plan.Corpus("hub/conv", ["a", "b"]), run_plan.Corpus("read", ["c"], ["test"])]
    models = run_plan.model_table(spark, groups)
    grid = run_plan.run_plan(models, run_plan.corpus_table(spark, corpora), ["none", "all"])
    assert grid.count() == 3 * 7 * 2
    assert grid.filter("dataset = 'conv' and codename = 'openai_large_v3_pl-pl'").count() == 12
    table = spark.createDataFrame(
        [(g.name, list(g.models), [g.providers] if isinstance(g.providers, str) else g.providers,
          [g.versions] if isinstance(g.versions, str) else g.versions) for g in groups],
        "name string, models array<string>, providers array<string>, versions array<string>",
    )
    same = run_plan.spread_models(table).select(models.columns)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, models.collect()))
    with pytest.raises(ValueError):
        run_plan.model_table(spark, [run_plan.ModelGroup("x", ["a", "b", "c"], ["p", "q"], "v")])
    assert run_plan.expand_splits("all") == ["train", "validation", "test"]


@pytest.mark.parametrize("mean", [0.0, 1e5, 1e8, 1e9])
def test_deviation_of_far_values(spark, mean):
    """Small deviations around a large mean, in splits of very different sizes."""
    rnd = random.Random(3)
    rows = [("d", f"s{k}", "train", "a b", mean + rnd.random() + k / 7) for k, n in enumerate((1, 2, 50, 700)) for _ in range(n)]
    rows += [("d", "none", "test", "a", 0.0), ("e", "one", "test", "a", mean + 1)]
    df = spark.createDataFrame(rows, "dataset string, subset string, split string, text string, duration double")
    want = df.filter("duration > 0").groupBy("dataset").agg(F.stddev_pop("duration").alias("std"), F.avg("duration").alias("mean"))
    want = {r.dataset: r for r in want.collect()}
    found = {r.dataset: r for r in corpus_stats.dataset_statistics(corpus_stats.split_moments(df)).collect()}
    for name in ("d", "e"):
        assert abs(found[name].audio_duration_std - want[name]["std"]) <= 1e-9 * max(1, mean * 2e-7)
        assert abs(found[name].audio_duration_mean - want[name]["mean"]) <= 1e-15 * max(1, mean) * 10
    assert found["d"].audio_duration_std > 0.2 and found["e"].audio_duration_std == 0


def test_statistics_merge(spark):
    rnd = random.Random(8)
    data = []
    for i in range(600):
        dataset = "Hidden/x" if i % 3 else "other"
        split = ("train", "test")[i % 2]
        words = 0 if dataset != "other" and split == "test" and i % 5 == 0 else rnd.randrange(1, 40)
        data.append((dataset, f"s{i % 4}", split, " ".join(["w"] * words), rnd.choice([0.0, rnd.random() * 20])))
    df = spark.createDataFrame(data, "dataset string, subset string, split string, text string, duration double")
    moments = corpus_stats.split_moments(df, exclude=corpus_stats.exclude_empty_transcripts("hidden"))

    def stats(values):
        if not values:
            return (0.0, 0.0, 0.0, 0.0)
        mean = sum(values) / len(values)
        return (mean, (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5, min(values), max(values))

    for row in corpus_stats.dataset_statistics(moments).collect():
        mine = [d for d in data if d[0] == row.dataset]
        seconds = [d[4] for d in mine if d[4] > 0]
        words = [len(d[3].split()) for d in mine
                 if not ("hidden" in d[0].lower() and d[2] == "test" and not d[3])]
        assert row.sample_count == len(mine)
        assert row.total_audio_hours == pytest.approx(sum(seconds) / 3600)
        got = [row[f"{n}_{f}"] for n in ("audio_duration", "transcript_length") for f in corpus_stats.FIELDS]
        assert got == pytest.approx([*stats(seconds), *stats(words)])
    planned = spark.createDataFrame([("other", "s0", "train"), ("other", "s0", "dev")], "dataset string, subset string, split string")
    rows = {r.split: r for r in corpus_stats.split_statistics(moments, planned).collect()}
    assert rows["dev"].sample_count == 0 and rows["dev"].audio_duration_max == 0.0
    mine = [d for d in data if d[:3] == ("other", "s0", "train")]
    assert rows["train"].transcript_length_mean == pytest.approx(stats([len(d[3].split()) for d in mine])[0])
    assert corpus_stats.grand_summary(moments).first().total_datasets == 2


def test_stats_of_one_value(spark):
    df = spark.createDataFrame([(5.0,)], "v double")
    assert tuple(df.agg(*corpus_stats.running_stats(F.col("v"), "v")).first()) == (5.0, 0.0, 5.0, 5.0)
    none = df.filter("v > 9").agg(*corpus_stats.running_stats(F.col("v"), "v")).first()
    assert tuple(none) == (0.0, 0.0, 0.0, 0.0)


def test_sample_duration(spark):
    df = spark.createDataFrame(
        [([0.0] * 20, 8, None), ([0.0] * 20, None, 16), ([0.0] * 2000, None, None), (None, 8, 8), ([0.0], 0, None)],
        "a array<float>, row_rate int, rate int",
    )
    found = df.select(corpus_stats.sample_duration(F.col("a"), F.col("rate"), F.col("row_rate")).alias("s"))
    assert [r.s for r in found.collect()] == [2.5, 1.25, 0.12, 0.0, 0.0]
