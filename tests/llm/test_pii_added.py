import random

from hearscore.llm import pii


def planted():
    """Texts with base contacts and numbers, looser forms of both, and numbers
    that are neither; what should be added and what shouldn't."""
    r, rows, contacts, numbers, others = random.Random(4), [], [], [], []
    digit = lambda n: "".join(r.choices("123456789", k=n))
    for i in range(600):
        contact = r.choice(["user{0} (at) host{1} (dot) com", "u.{0} [at] mail{1} [dot] org", "x{0}(AT)y{1}(DOT)net", "m{0} @ site{1}.com"]).format(i, i % 9)
        phone = f"({digit(3)}) {digit(3)}-{digit(4)}"
        key = r.choice(["tel: ", "Phone: ", "call ", "", "", "lorem "])
        other = r.choice([f"order {digit(9)}", f"on 20{digit(2)}-0{digit(1)}-1{digit(1)}", f"id {digit(6)}", f"{digit(16)}"])
        base = f"mail a{i}@b{i % 7}.com or +1 ({digit(3)}) {digit(3)}-{digit(4)}"
        rows.append((i, f"some words {contact}. Then {base} and {key}{phone}, {other} at the end"))
        contacts.append(contact)
        numbers.append(phone)
        others.append(other.split(" ")[-1])
    return rows, contacts, numbers, others


def added(spark, rows, kind):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(docs).collect()
    return {r.doc_id: [rows[r.doc_id][1][s.start : s.stop] for s in r.spans if s.kind == kind] for r in found}


def test_looser_contacts_and_numbers_are_added(spark):
    rows, contacts, numbers, others = planted()
    found = added(spark, rows, "contact")
    assert sum(contacts[i] in found[i] for i in range(600)) > 580
    found = added(spark, rows, "number")
    assert sum(numbers[i] in found[i] for i in range(600)) > 580
    assert sum(others[i] in found[i] for i in range(600)) < 15


def test_they_are_replaced(spark):
    rows, contacts, numbers, _ = planted()
    after = pii.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(contacts[r.doc_id] in r.text or numbers[r.doc_id] in r.text for r in after) < 20


def test_labels(spark):
    cases = [
        ("a (at) b (dot) com", True), ("a [AT] b [DOT] co", True), ("a@b.com", True), ("a @ b.com", True), ("5 @ 22.30", False),
    ]
    df = spark.createDataFrame(cases, "m string, want boolean")
    assert all(r.want == r.got for r in df.select("m", "want", pii._sure_contact(pii.F.col("m")).alias("got")).collect())
    cases = [
        ("tel: ", "(555) 123-4567", True), ("Please call us at ", "555-123-4567", True), ("x ", "+1 (555) 123-4567", True),
        ("lorem ", "(555) 123-4567", None), ("isbn ", "978-3-16-148410-0", False), ("on ", "2020-01-12", False),
        ("hotel ", "5551234567", False), ("phone ", "12345", False),
    ]
    df = spark.createDataFrame(cases, "left string, m string, want boolean").withColumn("c", pii.F.struct("left", "m"))
    assert [(r.m, r.got) for r in df.select("m", pii._sure_number(pii.F.col("c")).alias("got")).collect()] == [(m, w) for _, m, w in cases]
