"""SQL of the registered queries, for DuckDB over the same tables.

Statements are put together from common table expressions; ``_q`` prefixes
the ones a statement asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from catalog.shapes import CODENAMES, RUNS

METRICS = ("WER", "CER", "MER", "WIL")
WORDS = ("hits", "subs", "dels", "ins")

# Fixed value: the characters that count as whitespace.
_WS = (
    r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


# --- scalar expressions -------------------------------------------------------


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _lower(x: str) -> str:
    return f"lower({x})"


def _whitespace(x: str) -> str:
    spaced = f"regexp_replace({x}, '[ \\t\\n\\r\\x0B\\f]', ' ', 'g')"
    return _strip(f"regexp_replace({spaced}, '{_WS}{{2,}}', ' ', 'g')")


def _punctuation(x: str) -> str:
    return f"regexp_replace({x}, '\\p{{P}}', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda w: w <> '')"


def _tags(x: str) -> str:
    tagged = " or ".join(f"contains(lower(w), '{t}')" for t in ("<unk>", "<silence>", "trunc"))
    return f"array_to_string(list_filter({_words(x)}, lambda w: not ({tagged})), ' ')"


NORMS = {
    "none": lambda x: x,
    "lowercase": _lower,
    "whitespace": _whitespace,
    "punctuation": _punctuation,
    "tags": _tags,
    "all": lambda x: _tags(_punctuation(_whitespace(_lower(x)))),
}


def _round_exact(v: str, digits: int = 2) -> str:
    """Decimal rounding of the exact binary value of column ``v``."""
    scale = f"1e{digits}"
    high = f"(134217729e0*{v} - (134217729e0*{v} - {v}))"
    error = f"(({high}*{scale} - {v}*{scale}) + ({v} - {high})*{scale})"
    part = f"({v}*{scale} - floor({v}*{scale}))"
    return (
        f"(floor({v}*{scale}) + case when {part} <> 0.5 then ({part} > 0.5)::int "
        f"when {error} <> 0 then ({error} > 0)::int "
        f"else (floor({v}*{scale}) % 2 = 1)::int end) / {scale}"
    )


def _rate(metric: str, c: str = "") -> str:
    """Fraction from count columns with the prefix ``c``."""
    h, s, d, i = (f"{c}{n}" for n in WORDS)
    return {
        "WER": f"({s}+{d}+{i})::double / nullif({h}+{s}+{d}, 0)::double",
        "CER": f"{c}char_edits::double / nullif({c}char_len, 0)::double",
        "MER": f"({s}+{d}+{i})::double / nullif({h}+{s}+{d}+{i}, 0)::double",
        "WIL": f"case when {h}+{s}+{d} > 0 then 1e0 - case when {h}+{s}+{i} = 0 then 0e0 else "
        f"({h}::double/({h}+{s}+{d})::double) * ({h}::double/({h}+{s}+{i})::double) end end",
    }[metric]


def _percents(source: str, keep: Sequence[str], prefix: str = "") -> str:
    """``keep`` and all metrics in percent, from counts in ``source``."""
    inner = ", ".join(f"({_rate(m, prefix)})*1e2 as v_{m}" for m in METRICS)
    outer = ", ".join(f"{_round_exact(f'v_{m}')} as {m}" for m in METRICS)
    cols = ", ".join(keep)
    return f"select {cols}, {outer} from (select *, {inner} from {source})"


# --- common table expressions -----------------------------------------------

_run_rows = ", ".join(
    f"('{p}', '{m}', '{v}', '{CODENAMES[p]}', {drop}, {alter})" for p, m, v, drop, alter in RUNS
)

_SAID = (
    "array_to_string(list_filter(list_transform(range(0, len(w)), lambda i: "
    "case when (i*7 + conv_id + turn) % dropped = 0 then '' "
    "when (i*5 + conv_id) % altered = 0 then w[i+1] || 'x' else w[i+1] end), "
    "lambda x: x <> ''), ' ')"
)


def _variants(source: str, names: Sequence[str]) -> str:
    return " union all ".join(
        f"select codename, sample_idx, '{n}' norm_type, {NORMS[n]('text')} reference, "
        f"{NORMS[n]('hypothesis')} hypothesis from {source}"
        for n in names
    )


def _tokens(x: str) -> str:
    one = _strip(f"regexp_replace({x}, '{_WS}{{2,}}', ' ', 'g')")
    return f"list_filter(string_split({one}, ' '), lambda w: w <> '')"


def _letters(x: str) -> str:
    return f"list_transform(range(1, length({x})+1), lambda i: substring({x}, i, 1))"


def _encoded(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda c: chr(list_position(v, c)::int)), '')"


# The alignment of each distinct pair of word lists, one anti-diagonal per
# step of the recursion, after the common ends are taken off.
_ALIGN = [
    ("al0", "select row_number() over () k, r, h from (select distinct r, h from tok)"),
    (
        "al1",
        "select *, coalesce(list_position(list_transform(range(1, least(len(r), len(h))+1), "
        "lambda i: r[i] <> h[i]), true) - 1, least(len(r), len(h))) p from al0",
    ),
    ("al2", "select k, p, r[p+1:] r, h[p+1:] h from al1"),
    (
        "al3",
        "select *, coalesce(list_position(list_transform(range(1, least(len(r), len(h))+1), "
        "lambda i: r[len(r)+1-i] <> h[len(h)+1-i]), true) - 1, least(len(r), len(h))) q from al2",
    ),
    (
        "al4",
        "select k, p+q affix, r[:len(r)-q] r, list_reverse(h[:len(h)-q]) hr, "
        "len(r)-q n, len(h)-q m from al3",
    ),
    (
        "st",
        """select k, r, hr, n, m, affix, 0 step, [0]::int[] d1, [0]::int[] k1, []::int[] d2,
  []::int[] k2, 0 lo1, 0 lo2 from al4
 union all
 select k, r, hr, n, m, affix, step, nd, nk, d1, k1, lo, lo1 from (
  select *, list_transform(range(1, len(nd)+1), lambda z:
    case when ii[z] = 0 or ii[z] = step then 0
      when nd[z] = d1[ii[z]-lo1] + 1 then k1[ii[z]-lo1]
      when d1[ii[z]-lo1+1] = d2[ii[z]-lo2] - 1 then k1[ii[z]-lo1+1]
      else k2[ii[z]-lo2] + (r[ii[z]] = hr[m-step+ii[z]+1])::int end)::int[] nk
  from (
   select *, list_transform(ii, lambda i:
     case when i = 0 or i = step then step
       else least(d1[i-lo1]+1, d1[i-lo1+1]+1, d2[i-lo2] + (r[i] <> hr[m-step+i+1])::int) end)::int[] nd
   from (
    select k, r, hr, n, m, affix, step+1 step, d1, k1, d2, k2, lo1, lo2,
      greatest(0, step+1-m) lo, range(greatest(0, step+1-m), least(n, step+1)+1) ii
    from st where step < n+m)))""",
    ),
    (
        "aligned",
        "select al0.r, al0.h, d1[1] e, k1[1] + affix hits from st join al0 using (k) "
        "where step = n+m",
    ),
]

def _counting(words: bool = True, chars: bool = True) -> list[tuple[str, str]]:
    """From ``variants`` to ``counts``, with the counts that are asked for."""
    columns = ["codename", "sample_idx", "norm_type", "reference", "hypothesis"]
    parts = [
        ("norm", "select * from variants where reference <> '' and hypothesis <> ''"),
        (
            "toks",
            "select *"
            + (f", {_tokens('reference')} r, {_tokens('hypothesis')} h" if words else "")
            + (
                f", {_letters(_strip('reference'))} rc, {_letters(_strip('hypothesis'))} hc"
                if chars
                else ""
            )
            + " from norm",
        ),
    ]
    joins = ""
    if words:
        parts += [("tok", "select r, h from toks"), *_ALIGN]
        columns += [
            "hits::bigint hits",
            "(e - (hits - len(h) + e) - (hits - len(r) + e))::bigint subs",
            "(hits - len(h) + e)::bigint dels",
            "(hits - len(r) + e)::bigint ins",
        ]
        joins += " join aligned using (r, h)"
    if chars:
        parts.append(
            (
                "chars",
                f"select rc, hc, levenshtein({_encoded('rc')}, {_encoded('hc')}) char_edits from "
                "(select rc, hc, list_distinct(list_concat(rc, hc)) v from "
                "(select distinct rc, hc from toks))",
            )
        )
        columns += ["char_edits::bigint char_edits", "len(rc)::bigint char_len"]
        joins += " join chars using (rc, hc)"
    return [*parts, ("counts", f"select {', '.join(columns)} from toks{joins}")]


_CTES: dict[str, str] = {
    "samples": (
        "select 'conv' dataset, role subset, ['train', 'validation', 'test'][conv_id % 3 + 1] split, "
        "conv_id*100 + turn sample_idx, 'clips/' || conv_id || '/' || turn || '.wav' audio_path, "
        "text, conv_id, turn from conversations"
    ),
    "runs(provider, model, version, codename, dropped, altered)": f"values {_run_rows}",
    "worded": (
        "select *, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0B\\f]+'), "
        "lambda x: x <> '') w from samples"
    ),
    "cache": (
        "select dataset, codename, audio_path, version, case when conv_id % 17 = 0 then 'EMPTY' "
        f"when conv_id % 19 = 0 then 'INVALID' else {_SAID} end asr_hyp, provider, model, "
        "'20250101' hyp_gen_date, len(w)::double / 20 elapsed_time_seconds, "
        "case when turn % 2 = 0 then len(w)*1000 + 1000000 end peak_vram_bytes, "
        "case when turn % 2 = 0 then len(w)*10 end vram_diff_bytes "
        "from worded, runs where conv_id % 23 <> 0"
    ),
    "planned": (
        "select s.*, provider, model, version, codename from samples s, runs "
        "where version = '2025Q1' and subset in ('user', 'assistant', 'system')"
    ),
    "pairs": (
        "select p.dataset, p.subset, p.split, p.sample_idx, p.audio_path, p.provider, p.model, "
        "p.version, p.codename, p.text, c.asr_hyp hypothesis, "
        "c.elapsed_time_seconds resources_gen_time_seconds, "
        "c.peak_vram_bytes resources_peak_vram_bytes, c.vram_diff_bytes resources_vram_diff_bytes "
        "from planned p left join cache c using (dataset, codename, version, audio_path)"
    ),
    "valid": (
        "select * from pairs where hypothesis is not null and "
        "hypothesis not in ('EMPTY', 'INVALID') and text is not null"
    ),
}
_PAIRS = ("samples", "runs", "worded", "cache", "planned", "pairs", "valid")


def _q(body: str, *ctes: str, extra: Sequence[tuple[str, str]] = ()) -> str:
    heads = {name.split("(")[0]: (name, sql) for name, sql in _CTES.items()}
    parts = [f"{heads[c][0]} as ({heads[c][1]})" for c in ctes]
    parts += [f"{name} as ({sql})" for name, sql in extra]
    return f"with recursive {', '.join(parts)} {body}" if parts else body


def _scored(
    body: str, norms: Sequence[str], extra: Sequence[tuple[str, str]] = (), **parts: bool
) -> str:
    return _q(
        body,
        *_PAIRS,
        extra=[("variants", _variants("valid", norms)), *_counting(**parts), *extra],
    )


_GROUPED = [
    (
        "placed",
        "select s.subset, s.split, c.* from counts c join samples s using (sample_idx)",
    ),
]
_SUMS = ", ".join(f"sum({c})::bigint {c}" for c in (*WORDS, "char_edits", "char_len"))
_COUNTS = [*WORDS, "char_edits", "char_len"]
_RUNNING = [
    *_GROUPED,
    (
        "so_far",
        "select subset, split, codename, norm_type, sample_idx, "
        + ", ".join(f"(sum({c}) over w)::bigint {c}" for c in _COUNTS)
        + " from placed window w as (partition by subset, split, codename, norm_type "
        "order by sample_idx rows between unbounded preceding and current row)",
    ),
    (
        "running",
        _percents("so_far", ["subset", "split", "codename", "norm_type", "sample_idx"]),
    ),
]


def _file_name(x: str) -> str:
    return f"regexp_extract({x}, '[^/]*$')"


_STRESSED = (
    "select doc_id, case when doc_id % 11 = 0 then '\"' else '' end || text || "
    "case when doc_id % 5 = 0 then ' <UNK>' else '' end || "
    "case when doc_id % 7 = 0 then '\u00a0 word_trunc \tend' else '' end || "
    "case when doc_id % 11 = 0 then '\"' else '' end as text from documents"
)

_PROFILED = [
    (
        "rows0",
        "select case when lang = 'fr' then 'Withheld-fr' else lang end dataset, source subset, "
        "['train', 'validation', 'test'][doc_id % 3 + 1] split, "
        "text, len(embedding)::double / (1 << (doc_id % 8)::int) secs "
        "from documents left join embeddings on doc_id = vec_id",
    ),
    (
        "rows1",
        f"select dataset, subset, split, coalesce(len({_words('text')}), 0) words, "
        f"coalesce({_round_exact('secs')}, 0) duration from rows0",
    ),
    (
        "rows2",
        "select *, case when duration > 0 then duration end d, case when not "
        "(contains(lower(dataset), 'withheld') and split = 'test' and words = 0) then words end counted "
        "from rows1",
    ),
    (
        "plan0",
        "select dataset, subset, unnest(['train', 'validation', 'test', 'dev']) split "
        "from (select distinct dataset, subset from rows0)",
    ),
]


def _stats(value: str, name: str) -> str:
    functions = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max"}
    return ", ".join(
        f"round(coalesce({fn}({value})::double, 0), 6) {name}_{f}" for f, fn in functions.items()
    )


_SPLIT_STATS = (
    "split_stats",
    "select plan0.dataset, plan0.subset, plan0.split, plan0.subset || '-' || plan0.split split_key, "
    "count(words) sample_count, round(coalesce(sum(d), 0)/3600, 6) audio_hours, "
    f"{_stats('d', 'audio_duration')}, {_stats('words', 'transcript_length')} "
    "from plan0 left join rows2 using (dataset, subset, split) group by 1, 2, 3, 4",
)
_DATASET_STATS = (
    "dataset_stats",
    "select dataset, count(*) sample_count, round(coalesce(sum(d), 0)/3600, 6) total_audio_hours, "
    f"{_stats('d', 'audio_duration')}, {_stats('counted', 'transcript_length')} "
    "from rows2 group by dataset",
)


def _report(source: str, entry: str, hours: str) -> str:
    return (
        f"select {entry} entry, sample_count samples, printf('%.2f', {hours}) audio_hours, "
        "printf('%.2fs ± %.2fs', audio_duration_mean, audio_duration_std) avg_duration, "
        "printf('%.2f ± %.2f words', transcript_length_mean, transcript_length_std) avg_transcript "
        f"from {source}"
    )


_FILES = (
    "files",
    "select case when conv_id % 5 = 0 then audio_path "
    "when conv_id % 5 = 1 then 'clips/' || conv_id || '/parts/' || turn || '.wav.1' "
    "else 'cache/datasets/' || conv_id || '/' || turn || '.wav' end file "
    "from samples where conv_id % 5 < 3 and turn < 5",
)

_WRITES = (
    "writes",
    "select role codename, 'clips/' || conv_id || '.wav' audio_path, "
    "case when turn % 2 = 0 then '2024Q1' else '2025Q1' end version, text asr_hyp, "
    "'2025010' || (turn % 3) hyp_gen_date, turn::double elapsed_time_seconds, turn seq "
    "from conversations",
)

_STREAM_VARIANTS = [
    (
        "said",
        "select sample_idx, codename, text, subset, split, "
        + _SAID
        + " hypothesis from worded, runs where version = '2025Q1' and provider = 'openai'",
    ),
    ("variants", _variants("said", ("all",))),
]

_ALL_NORMS = ("none", "all", "lowercase", "whitespace", "punctuation", "tags")


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["scan_corpus"] = (
        "select 'documents' dataset, lang, source, count(*) n_rows, "
        "sum(length(text))::bigint n_characters from documents group by all"
    )
    sql["subset_lookup"] = _q(
        "select subset, split, sample_idx, audio_path from samples "
        "where (subset = 'user' and split = 'train') or "
        "(subset, split) in (select (subset, split) from samples where subset = 'system')",
        "samples",
    )
    sql["first_n_per_split"] = _q(
        "select dataset, subset, split, sample_idx, text from samples qualify row_number() over "
        "(partition by dataset, subset, split order by sample_idx) <= 20",
        "samples",
    )
    sql["seeded_sample_per_split"] = _q(
        "select dataset, subset, split, sample_idx from samples qualify row_number() over "
        "(partition by dataset, subset, split order by md5(sample_idx || '/42'), sample_idx) <= 20",
        "samples",
    )
    sql["scan_tsv"] = "select doc_id, lang, source, md5(text) digest from documents"
    sql["sink_tsv"] = _q(
        "select dataset, subset, split, version, codename, sample_idx, text, hypothesis, "
        "resources_gen_time_seconds, resources_peak_vram_bytes, resources_vram_diff_bytes "
        "from pairs",
        *_PAIRS,
    )
    cache = _q("select * from cache", "samples", "runs", "worded", "cache")
    sql["scan_hyp_cache"] = cache
    sql["sink_hyp_cache"] = cache
    sql["sink_stats_json"] = _q(
        "select dataset || '_statistics' file, dataset dataset_name, "
        "max(counted)::double longest, count(*) sample_count from rows2 group by dataset",
        extra=_PROFILED,
    )
    seconds = (
        "select vec_id, case when vec_id % 13 <> 0 then "
        "(len(embedding) * (vec_id % 40))::double / (100 + vec_id % 50)::double end s from embeddings"
    )
    sql["audio_manifest"] = (
        f"select 'clips/' || vec_id || '.wav' path, coalesce({_round_exact('s')}, 0)::double "
        f"audio_duration from ({seconds})"
    )
    per_split = "select dataset, subset, split, count(*) n_rows{} from samples group by all"
    sql["materialize"] = _q(per_split.format(""), "samples")
    sql["refreshed_groups"] = _q(
        "select dataset, subset, split, count(*) filter (stays) n_rows, "
        "case when bool_and(stays) then 1 else 2 end::bigint n_runs "
        "from (select *, split <> 'test' or (sample_idx // 100) % 2 = 0 stays from samples) "
        "group by all having bool_or(stays)",
        "samples",
    )
    sql["dated_output"] = _q(per_split.format(", '20250131' run_date"), "samples")

    sql["tag_model_columns"] = _q(
        "select sample_idx, audio_path, 'openai' provider, 'whisper/Small' model, "
        "'2025Q1' as version, 'whisper' codename from samples",
        "samples",
    )
    sql["select_reference_columns"] = _q(
        "select audio_path, turn, conv_id, text from samples", "samples"
    )
    sql["valid_hypothesis_filter"] = _q(
        "select codename, sample_idx, text, hypothesis from valid", *_PAIRS
    )
    sql["cast_text"] = (
        "select event_id, event_id::varchar as text, user_id::varchar hyp from events"
    )
    odd = (
        "odd",
        "select codename, sample_idx, hypothesis, case when (sample_idx // 100) % 5 = 0 then '<UNK>' "
        "when (sample_idx // 100) % 7 = 0 then '?!' else text end as text from valid",
    )
    sql["non_empty_after_norm"] = _q(
        "select codename, norm_type, count(*) n_rows, sum(sample_idx)::bigint index_sum from variants "
        "where reference <> '' and hypothesis <> '' group by all",
        *_PAIRS,
        extra=[odd, ("variants", _variants("odd", _ALL_NORMS))],
    )
    sql["required_columns"] = _q(
        "select codename, count(*) n_rows, count(text) n_references, "
        "count(hypothesis) n_hypotheses from valid group by all",
        *_PAIRS,
    )
    sql["drop_join_columns"] = _q(
        "select dataset, subset, split, sample_idx, provider, model, version, "
        "resources_gen_time_seconds, resources_peak_vram_bytes, resources_vram_diff_bytes from pairs",
        *_PAIRS,
    )
    kept = (
        f"select * from valid where {NORMS['all']('text')} <> '' and {NORMS['all']('hypothesis')} <> ''"
    )
    found = {
        "WER": ("metric", f"nullif(len({_tokens(NORMS['all']('text'))}), 0)"),
        "CER": ("metric", f"nullif(length({NORMS['all']('text')}), 0)"),
    }
    found |= {f"{m}_sample": v for m, v in list(found.items())}
    found |= {
        c: ("resource", c)
        for c in (
            "resources_gen_time_seconds",
            "resources_peak_vram_bytes",
            "resources_vram_diff_bytes",
        )
    }
    sql["dynamic_metric_columns"] = _q(
        " union all ".join(
            f"select '{c}' column_name, '{kind}' kind, count({expr}) n_values from kept"
            for c, (kind, expr) in found.items()
        ),
        *_PAIRS,
        extra=[("kept", kept)],
    )

    for name, expr in NORMS.items():
        sql[f"norm_{name}"] = f"select doc_id, {expr('text')} clean_text from ({_STRESSED})"
    sql["norm_fanout"] = _q(
        "select * from variants where reference <> '' and hypothesis <> ''",
        *_PAIRS,
        extra=[("variants", _variants("valid", _ALL_NORMS))],
    )
    sql["clip_id"] = (
        "select page_id, regexp_extract(regexp_replace(url, '(/\\.?)+$', ''), '[^/]*$') id from pages"
    )
    sql["codename"] = (
        "select doc_id, replace(lower(source || '_Models/' || source || '_' || lang), '/', '_') "
        "codename, upper(source) || ' - ' || upper('Models/' || source) display_name from documents"
    )
    sql["dataset_short_name"] = (
        "select page_id, regexp_extract(url, '[^/]*$') dataset from pages"
    )
    sql["default_version"] = (
        "select year(ts) || 'Q' || quarter(ts) as version, count(*) n_rows from events group by 1"
    )
    quoted = (
        "select conv_id, turn, case when turn % 3 = 0 then '\"' || rtrim(text, '.') || ' \"\"so\"\"' "
        "|| '\"' else rtrim(text, '.') end t from conversations"
    )
    undoubled = f"select conv_id, turn, replace(t, '\"\"', '\"') t from ({quoted})"
    bare = (
        "select conv_id, turn, case when starts_with(t, '\"') and ends_with(t, '\"') "
        f"then regexp_replace(t, '^\"([^\\n]*)\"$', '\\1') else t end t from ({undoubled})"
    )
    sql["transcript_cleanup"] = (
        "select conv_id, turn, case when right(t, 1) in ('.', '?', '!') then t else t || '.' end "
        f"clean_text from ({bare})"
    )
    sql["word_count"] = (
        f"select doc_id, len({_words('text')})::int n_words from ({_STRESSED})"
    )
    rate = (
        "coalesce(case when vec_id % 11 = 0 then 0 when vec_id % 5 > 0 then 8 + label end, "
        "case when vec_id % 7 > 0 then 6 end, 16000)"
    )
    sql["sample_duration"] = (
        f"select vec_id, coalesce({_round_exact('s')}, 0)::double duration from (select vec_id, "
        f"len(embedding)::double / nullif({rate}, 0)::double s from embeddings)"
    )
    sql["left_trim_hypothesis"] = (
        "select conv_id, turn, case when turn = 4 then 'INVALID' when turn = 3 then 'EMPTY' else "
        f"case when t = '' then 'EMPTY' else t end end asr_hyp from (select conv_id, turn, "
        f"regexp_replace('\n  ' || text || ' ', '^{_WS}+', '') t from conversations)"
    )

    words = _tokens("text"), _tokens("hypothesis")
    sql["word_alignment_counts"] = _q(
        "select codename, sample_idx, hits::bigint hits, "
        "(e - (hits - len(h) + e) - (hits - len(r) + e))::bigint subs, "
        "(hits - len(h) + e)::bigint dels, (hits - len(r) + e)::bigint ins "
        "from toks join aligned using (r, h)",
        *_PAIRS,
        extra=[
            ("toks", f"select *, {words[0]} r, {words[1]} h from valid"),
            ("tok", "select r, h from toks"),
            *_ALIGN,
        ],
    )
    for m in METRICS:
        sql[m.lower()] = _scored(
            f"select codename, sample_idx, {_rate(m)} {m.lower()} from counts",
            ["all"],
            words=m != "CER",
            chars=m == "CER",
        )
    sql["metric_registry"] = _scored(
        " union all ".join(f"select codename, '{m}' metric, {m} as value from pct" for m in METRICS),
        ["all"],
        [
            ("pooled", f"select codename, {_SUMS} from counts group by all"),
            ("pct", _percents("pooled", ["codename"])),
        ],
    )
    sql["running_metric"] = _scored(
        "select subset, split, codename as system, norm_type, sample_idx, WER, CER, MER, WIL "
        "from running",
        ["all"],
        _RUNNING,
    )
    sql["per_sample_metric"] = _scored(
        "select codename as system, sample_idx, regexp_extract(audio_path, '[^/]*$') id, reference, "
        "hypothesis, WER, CER, MER, WIL from pct join samples using (sample_idx)",
        ["all"],
        [("pct", _percents("counts", ["codename", "sample_idx", "reference", "hypothesis"]))],
    )
    pooled = (
        "pooled",
        f"select subset, split, codename, norm_type, count(*) sample_count, {_SUMS} "
        "from placed group by all",
    )
    groups = ["subset", "split", "codename", "norm_type", "sample_count", *_COUNTS]
    sql["corpus_metric"] = _scored(
        _percents("pooled", groups), ["none", "all"], [*_GROUPED, pooled]
    )

    sql["attach_hypotheses"] = _q("select * from pairs", *_PAIRS)
    sql["bucketed_hypotheses"] = _q(
        "select codename, version, sample_idx, hypothesis, n_meta, resources_gen_time_seconds, "
        "resources_peak_vram_bytes, resources_vram_diff_bytes from pairs left join "
        "(select audio_path, count(*) n_meta from cache where codename like 'meta%' group by audio_path) using (audio_path)",
        *_PAIRS,
    )
    sql["attach_metadata"] = (
        "select doc_id, d.lang, n_chars, quality, toxic, case when quality is not null then '?' end "
        "lang_right from documents d left join labels using (doc_id)"
    )
    sql["pending_work"] = _q(
        "select codename, version, audio_path from planned p where not exists (select 1 from cache c "
        "where c.dataset = p.dataset and c.codename = p.codename and c.version = p.version and "
        "c.audio_path = p.audio_path and c.asr_hyp not in ('', 'EMPTY', 'INVALID'))",
        *_PAIRS[:5],
    )
    norms = ", ".join(f"'{n}'" for n in _ALL_NORMS)
    sql["run_plan"] = _q(
        "select lang model_group, lang provider, source model, 'v' || source as version, "
        "replace(lower(lang || '_' || source || '_pl-pl'), '/', '_') codename, dataset, subset, "
        f"split, unnest([{norms}]) norm_type from (select distinct lang, source from documents), "
        "(select distinct dataset, subset, split from samples)",
        "samples",
    )
    sql["resolve_audio_paths"] = _q(
        "select path, coalesce(exact, near, far, '') resolved from (select path, "
        "(select min(file) from files where file = path) exact, "
        "(select min(file) from files where starts_with(file, folder || '/') and "
        f"starts_with({_file_name('file')}, name)) near, "
        "(select min(file) from files where starts_with(file, 'cache/datasets/') and "
        f"{_file_name('file')} = name) far from wanted)",
        "samples",
        extra=[
            _FILES,
            (
                "wanted",
                f"select audio_path path, {_file_name('audio_path')} as name, "
                "'clips/' || conv_id folder from samples",
            ),
        ],
    )
    sql["transcribe_batch"] = _q(
        "select audio_path, case when conv_id % 29 = 0 or turn = 7 then '' when turn = 5 then "
        "'INVALID' when turn = 6 then 'EMPTY' else 'this is ' || audio_path end asr_hyp from samples",
        "samples",
    )

    sql["saved_hypotheses"] = _q(
        "select dataset, codename, version, audio_path, case when turn = 5 then 'INVALID' when turn = 6 "
        "then 'EMPTY' else 'this is ' || audio_path end asr_hyp, '20250131' hyp_gen_date "
        "from planned where turn <> 7",
        "samples",
        "runs",
        "planned",
    )
    sql["capped_evaluation"] = _q(
        "select codename as system, sample_idx, sample_idx // 100 * 10 + sample_idx % 100 n_words, "
        "case when sample_idx % 2 = 0 then (sample_idx // 100 % 40)::double / 8 else 0 end audio_duration, "
        "text reference, hypothesis from valid where text <> '' and hypothesis <> '' and sample_idx in "
        "(select sample_idx from samples qualify row_number() over "
        "(partition by dataset, subset, split order by sample_idx) <= 6)",
        *_PAIRS,
    )

    pair = ", ".join(
        f"round(avg({m}), 8) avg_{m}, round(stddev_samp({m}), 8) std_{m}" for m in METRICS
    )
    sql["group_summary"] = _scored(
        "select 'conv' dataset, subset, split, norm_type, codename as system, count(*) sample_count, "
        f"{pair} from running group by all",
        ["all"],
        _RUNNING,
    )
    costs = (
        "resources_gen_time_seconds",
        "resources_peak_vram_bytes",
        "resources_vram_diff_bytes",
    )
    cost = ", ".join(
        f"round(avg({c}), 6) avg_{c}, round(stddev_samp({c}), 6) std_{c}" for c in costs
    )
    sql["resource_summary"] = _q(
        "select dataset, subset, split, 'none' norm_type, codename as system, count(*) sample_count, "
        f"{cost} from pairs group by all",
        *_PAIRS,
    )
    late = "case when event_type <> 'error' then value end"
    sql["running_stats"] = (
        f"select event_type, count(*) n_rows, {_stats(late, 'value')} from events group by all"
    )
    sql["split_statistics"] = _q("select * from split_stats", extra=[*_PROFILED, _SPLIT_STATS])
    sql["dataset_statistics"] = _q("select * from dataset_stats", extra=[*_PROFILED, _DATASET_STATS])
    sql["grand_summary"] = _q(
        "select count(distinct dataset) total_datasets, round(sum(d)/3600, 6) total_audio_hours "
        "from rows2",
        extra=_PROFILED,
    )
    sql["run_success_rate"] = _q(
        "select codename, subset, count(*) total, count(*) filter (hypothesis <> '') successful, "
        "floor(count(*) filter (hypothesis <> '')::double / count(*) * 100)::bigint success_percent "
        "from pairs group by codename, subset",
        *_PAIRS,
    )
    sql["summary_report"] = _q(
        _report("split_stats", "dataset || ' ' || split_key", "audio_hours")
        + " union all "
        + _report("dataset_stats", "dataset", "total_audio_hours"),
        extra=[*_PROFILED, _SPLIT_STATS, _DATASET_STATS],
    )

    sql["sort_summary"] = _q(
        "select subset, split, norm_type, codename as system, count(*) sample_count from variants "
        "join samples using (sample_idx) where reference <> '' and hypothesis <> '' "
        "group by all order by 1, 2, 3, 4",
        *_PAIRS,
        extra=[("variants", _variants("valid", ("none", "all")))],
    )
    sql["union_results"] = _q(
        "select * from variants where reference <> '' and hypothesis <> ''",
        *_PAIRS,
        extra=[("variants", _variants("valid", ("lowercase", "punctuation")))],
    )
    sql["union_batches"] = (
        "select 'documents' dataset, doc_id sample_idx, lang, md5(text) digest from documents "
        "union all select 'benchmark', item_id, null, md5(text) from benchmark"
    )
    sql["limit_one_probe"] = _q(
        "select (select count(*) from samples) n_rows, split, "
        "not exists (select 1 from samples s where s.split = p.split) is_empty "
        "from (select unnest(['train', 'validation', 'test', 'dev']) split) p",
        "samples",
    )

    sql["cache_upsert"] = _q(
        "select codename, audio_path, version, asr_hyp, hyp_gen_date, elapsed_time_seconds from writes "
        "qualify row_number() over (partition by codename, audio_path, version "
        "order by hyp_gen_date desc, seq desc) = 1",
        extra=[_WRITES],
    )
    stream_stats = (
        _stats("case when secs > 0 then secs end", "audio_duration"),
        _stats("words", "transcript_length"),
    )
    sql["streaming_stats"] = _q(
        "select dataset, subset, split, subset || '-' || split split_key, count(*) sample_count, "
        f"round(sum(secs)/3600, 6) audio_hours, {', '.join(stream_stats)} from "
        f"(select *, (length(text) % 50)::double secs, len({_words('text')}) words from samples) "
        "group by dataset, subset, split",
        "samples",
    )
    sql["streaming_scores"] = _q(
        _percents("pooled", groups),
        "samples",
        "runs",
        "worded",
        extra=[*_STREAM_VARIANTS, *_counting(), *_GROUPED, pooled],
    )
    spoken = [(n, f"select * from ({q}) where sample_idx // 100 % 17 <> 0" if n == "said" else q) for n, q in _STREAM_VARIANTS]
    sql["streaming_rescored"] = _q(
        _percents("pooled", groups),
        "samples",
        "runs",
        "worded",
        extra=[*spoken, *_counting(), *_GROUPED, pooled],
    )
    return sql
