"""The registered queries of this subpackage and their SQL.

Each applies its operator to a whole table with the parameters below; where
``SQL`` has no entry, ``tests/llm`` holds the query against a brute-force
version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearscore.llm import (
    decontaminate,
    jaccard,
    language,
    neighbours,
    packing,
    perplexity,
    pieces,
    pii,
    quality,
    ranked,
    resample,
    simhash,
    substring,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def left_over(modulus: int, rest: int):
    """Documents that are held out by the checksum of their id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


#: Least score of a document of quality.
GOOD = 0.7


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    return quality.train(docs, table(spark, sf_dir, "labels"), "quality", ~left_over(4, 2))


@register
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select(
        "doc_id",
        left_over(4, 2).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


@register
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, ~left_over(4, 2))
    return language.identify(docs, model).select(
        "doc_id", left_over(4, 2).alias("held_out"), "lang_pred", "score"
    )


@register
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


@register
def op3_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@register
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.sha2(pii.written(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, pii.BASE), base, pii.written(F.col("spans")).alias("spans"))


def piece_model() -> bytes:
    import public_tokenizers

    return pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def coded(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.size("ids").alias("n_ids"), "ids", "lossless")


@register
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(pieces.round_trip(table(spark, sf_dir, "documents"), piece_model()))


@register
def op10_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), piece_model())


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Figures of every document: contaminated if a twentieth of its words or
    more lie in windows of test items."""
    found = decontaminate.search(docs, items).withColumn("n_hit", F.size("hits").cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


@register
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.score(table(spark, sf_dir, "documents"), left_over(10, 0))


@register
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.group(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.written().alias("fingerprint"), "component_id")


@register
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The word patterns of the contracts.
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op1_substring_dedup"] = f"""
with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') w from documents),
windows as (
  select doc_id, s, array_to_string(w[s:s + 49], ' ') passage
  from (select doc_id, w, unnest(range(1, len(w) - 48)) s from texts)
),
firsts as (select passage, min(doc_id) first from windows group by passage),
gone as (
  select distinct doc_id, s + k i from windows join firsts using (passage), range(50) r(k) where first < doc_id
),
spread as (select doc_id, unnest(w) word, generate_subscripts(w, 1) i from texts),
kept as (select * from spread anti join gone using (doc_id, i)),
joined as (select doc_id, string_agg(word, ' ' order by i) kept, count(*) n from kept group by doc_id)
select t.doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed,
  sha256(coalesce(kept, '')) kept_sha256
from texts t left join joined using (doc_id)
"""

SQL["op4_benchmark_decontamination"] = f"""
with items as (select item_id::varchar item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') w from benchmark),
phrases as (
  select distinct item_id, w[s:s + least(13, len(w)) - 1] phrase
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) s from items where len(w) > 0)
),
texts as (select doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') w from documents),
sizes as (select distinct len(phrase) n from phrases),
windows as (
  select doc_id, s, w[s:s + n - 1] phrase from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) s from texts, sizes)
),
found as (select doc_id, s, item_id, len(phrase) n from windows join phrases using (phrase)),
hits as (
  select doc_id, count(distinct i) n_hit from (select doc_id, unnest(range(s, s + n)) i from found) group by doc_id
),
named as (
  select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) items
  from (select distinct doc_id, item_id from found) group by doc_id
)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) contaminated
from texts left join hits using (doc_id) left join named using (doc_id)
"""

SQL["op5_ngram_jaccard_join"] = f"""
with recursive texts as (select doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[s:s + 2], ' ') shingle
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) s from texts where len(w) > 0)
),
sizes as (select doc_id, count(*) n from shingles group by doc_id),
shared as (
  select a.doc_id a, b.doc_id b, count(*) n_both from shingles a join shingles b using (shingle)
  where a.doc_id < b.doc_id group by all
),
links as (
  select a, b from shared join sizes x on a = x.doc_id join sizes y on b = y.doc_id
  where 100 * n_both >= 90 * (x.n + y.n - n_both)
),
both_ways as (select a, b from links union select b, a from links),
reached as (
  select doc_id, doc_id other from texts union select doc_id, b from reached join both_ways on other = a
)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id
from (select doc_id, min(other) component_id from reached group by doc_id) left join sizes using (doc_id)
"""

SQL["op13_ranked_search"] = f"""
with texts as (select doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') w from documents),
lengths as (select doc_id, len(w) n from texts where len(w) > 0),
corpus as (select count(*) all_docs, sum(n)::bigint all_terms from lengths),
asked as (select distinct item_id, unnest(regexp_extract_all({_LOWER}, '{_ALNUM}')) term from benchmark),
occurrences as (
  select doc_id, term, count(*) tf from (select doc_id, unnest(w) term from texts)
  where term in (select term from asked) group by all
),
weights as (
  select term, floor(1000 * ln((2 * all_docs + 2)::double / (2 * df + 1)))::bigint weight
  from (select term, count(*) df from occurrences group by term), corpus
),
scored as (
  select item_id, doc_id,
    sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * all_docs) // all_terms)))))::bigint score
  from asked join occurrences using (term) join weights using (term) join lengths using (doc_id), corpus
  group by item_id, doc_id
),
ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int rank, doc_id, score
  from scored where score > 0
)
select * from ranked where rank <= 50
"""

SQL["op11_importance_resampling"] = f"""
with crc as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) steps
  from range(256) r(i)
),
docs as (select doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') w from documents),
goal as (select regexp_extract_all({_LOWER}, '{_ALNUM}') w from benchmark),
bytes as (
  select word, list_transform(range(1, length(hex(encode(word))), 2),
    lambda k: ('0x' || substr(hex(encode(word)), k, 2))::bigint) b
  from (select unnest(w) word from docs union select unnest(w) from goal)
),
buckets as (
  select word, xor(list_reduce([4294967295::bigint] || b, lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])),
    4294967295) % 10000 bucket
  from bytes, crc
),
ours as (select bucket, count(*) s from (select unnest(w) word from docs) join buckets using (word) group by bucket),
theirs as (select bucket, count(*) t from (select unnest(w) word from goal) join buckets using (word) group by bucket),
sums as (select (select coalesce(sum(s), 0) from ours)::double all_s, (select coalesce(sum(t), 0) from theirs)::double all_t),
gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (all_s + 10000)
    / ((s + 1)::double * (all_t + 10000))))::bigint gain
  from ours left join theirs using (bucket), sums
),
weights as (
  select doc_id, sum(gain)::bigint weight
  from (select doc_id, unnest(w) word from docs) join buckets using (word) join gains using (bucket) group by doc_id
),
scored as (
  select doc_id, len(w)::bigint n_features, coalesce(weight, 0) weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double)
      / 4294967296)))::bigint score
  from docs left join weights using (doc_id)
),
ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) rank, count(*) over () n from scored where n_features >= 20
)
select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end rank
from scored left join ranked using (doc_id)
"""
