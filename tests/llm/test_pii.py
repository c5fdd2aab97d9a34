import hashlib
import re

from hearscore.llm import pii
from hearscore.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = (
        ("email", EMAIL, lambda m: True),
        ("ip", IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", CARD, lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    )
    found = []
    for no, (kind, pattern, valid) in enumerate(rules):
        found += [(m.start(), no, m.end(), kind) for m in pattern.finditer(text or "") if valid(m[0])]
    return sorted(found)


HARD = [
    None, "", "plain words", "é a@b.co ü c.d+e@x-y.example.org.", "a@b.com_x@y.zz a@b@c.de @x.y a@b", "%%a@b.c@d.e",
    "1.2.3.4.5 256.1.1.1 1.2.3 0001.002.3.4 999.1.2.3.4 10.0.0.256", "4111 1111 1111 1111, 4111-1111-1111-1112",
    "4111  1111 1111 1111 42 7", "+1 (375) 555-4393 +44 20 7946 0958. +1 23 ++1 (222) 333 4444-", "€😀 +12345678901 x@y.z",
    "1" * 30000, "a" * 30000 + "@", "1 " * 20000, "1.2." * 9000, "mail a.b@c.dd " * 700, "(" * 200 + "+1((((((", "5500005555555559 5500005555555559",
]


def test_base_spans_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(HARD)], "doc_id long, text string, base array<int>")
    for r in pii.find(docs).collect():
        assert [tuple(s) for s in r.base] == brute(HARD[r.doc_id]), HARD[r.doc_id]
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def test_query(spark):
    path = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = QUERIES["op9_pii"](spark, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        counts = [sum(s[3] == k for s in want) for k in pii.BASE]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_trees_add_what_looks_like_a_secret(spark):
    rows, text = [], "word password={} and {} more"
    for i in range(300):
        secret = hashlib.md5(str(i).encode()).hexdigest()[:20]
        other = hashlib.md5(f"o{i}".encode()).hexdigest()[:20]
        rows.append((i, text.format(secret, "calm" if i % 10 else other) + f" section-{i}-of-chapter-{i % 7}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [rows[r.doc_id][1][s.start : s.stop] for s in r.spans if s.kind == "secret"] for r in pii.find(docs, precision=0.8).collect()}
    assert sum(any(len(m) >= 20 and "-" not in m for m in found[i]) for i in range(300)) > 250
    assert sum(any(m.startswith("section") for m in found[i]) for i in range(300)) < 15


def test_redact(spark):
    text = "é mail a@b.co, card 4111 1111 1111 1111."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string")
    found = pii.find(docs).join(docs, "doc_id").select("doc_id", pii.redact(pii.F.col("text"), pii.F.col("spans")).alias("t"))
    assert {r.doc_id: r.t for r in found.collect()} == {1: "é mail [email], card [card].", 2: None, 3: "none"}


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (None, "1.2.3.4")], "doc_id long, text string")
    assert pii.find(docs.limit(0)).collect() == []
    assert sorted((str(r.doc_id), len(r.base)) for r in pii.find(docs).collect()) == [("1", 1), ("1", 1), ("None", 1)]
