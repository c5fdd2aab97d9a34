import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from hearscore.llm import packing, pieces
from hearscore.llm.queries import QUERIES, piece_model

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return piece_model()


@pytest.fixture(scope="module")
def own(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def odd_texts():
    r = random.Random(9)
    alphabet = list("aaabbcehinorstT .,-  \n\t<s>0x1é€😀漢▁")
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(400)]
    texts += [" " * n + "x" + " " * (n // 2) for n in range(40)] + ["a" * n for n in range(1, 60)]
    return texts + ["", "<s>", "<0x41>", "</s> <unk>", "\n\n", "word\r\nword", "x" * 20000, "hello world " * 3000]


def test_parity_with_sentencepiece(model, own):
    texts = odd_texts()
    ids, offsets = pieces.Codec(model).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == own.encode(text), repr(text[:90])


def test_whole_tokenizer_and_decoding(model, own):
    whole, codec = pieces.tokenizer(model), pieces.Codec(model)
    for text in odd_texts()[:120]:
        want = own.encode(text)
        assert whole.encode(text, add_special_tokens=False).ids == want if text else want == []
        back = codec.decode(np.array(want, dtype=np.int32), np.array([0, len(want)])).to_pylist()[0]
        assert back == own.decode(want) == text.replace("▁", " "), repr(text)
        assert whole.decode(want) == back


def changed(model, kinds=(), score=None):
    """The installed model as a unigram model (field 3 of the trainer's part);
    pieces of some numbers get another kind."""

    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    def field(number, value):
        return varint(number << 3 | 2) + varint(len(value)) + value

    out, k, kinds = b"", 0, dict(kinds)
    for number, value in pieces._fields(model):
        if number == 1:
            own = dict(pieces._fields(value))
            points = struct.unpack("<f", own.get(2, bytes(4)))[0]
            value = field(1, own[1]) + b"\x15" + struct.pack("<f", score(points) if score else points)
            value += b"\x18" + varint(kinds.get(k, own.get(3, 1)))
            k += 1
        elif number == 2:
            at = value.index(b"\x18\x02")  # the kind of the model
            value = value[:at] + b"\x18\x01" + value[at + 2 :]
        out += field(number, value)
    assert pieces.parse(out).kind == 1
    return out


@pytest.mark.parametrize("score", [None, lambda s: s / 3000 - 2])
def test_unigram_parity(model, score):
    """All kinds of pieces, texts that spell them, bytes, unused and user pieces."""
    spec = pieces.parse(model)
    normal = [i for i, (t, _, kind) in enumerate(spec.pieces) if kind == 1 and len(t) > 3]
    some = {normal[5]: 5, normal[60]: 5, normal[700]: 4, normal[90]: 4}
    for kinds in ({}, some):
        made = changed(model, kinds, score)
        own, codec = sentencepiece.SentencePieceProcessor(model_proto=made), pieces.Codec(made)
        texts = odd_texts()[:250] + ["a <s> b", "</s>x", "<unk> a", "<0x41>", "<0x0A><0xFF>", "😀<0x41>€", " 5", "\u2047 x", "\x00\x01"]
        texts += [f"a{spec.pieces[i][0].replace('▁', ' ')}b {spec.pieces[i][0].replace('▁', ' ')}" for i in some]
        ids, offsets = codec.encode(pa.array(texts))
        lists = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
        for text, got in zip(texts, lists):
            assert got == own.encode(text), repr(text[:90])
        back = codec.decode(ids, offsets).to_pylist()
        assert [b for b, t in zip(back, texts) if b != t.replace("▁", " ")] == []


def test_encode_and_decode_tables(spark, model, own):
    texts = [None, "", "a b", "a b", "é " * 5000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    coded = pieces.encode(docs, model)
    rows = {r.doc_id: r.ids for r in coded.collect()}
    assert rows == {0: None, **{i: own.encode(t) for i, t in enumerate(texts) if t is not None}}
    assert {r.doc_id: r.text for r in pieces.decode(coded, model).collect()} == dict(enumerate(texts))
    assert pieces.encode(docs.limit(0), model).collect() == []


def test_query(spark, own):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.lossless and r.n_ids == len(r.ids) and r.ids == own.encode(texts[r.doc_id])


def brute_fit(sizes, length):
    rooms, rows = [], []
    for item, size in enumerate(sizes):
        fit = [(room, k) for k, room in enumerate(rooms) if room >= size]
        if fit:
            least = min(room for room, _ in fit)
            k = next(k for room, k in fit if room == least)
            rooms[k] -= size
            rows[k].append(item)
        else:
            rooms.append(length - size)
            rows.append([item])
    return sorted(length - sum(sizes[i] for i in row) for row in rows)


def test_best_fit_against_brute_force():
    r = random.Random(2)
    for length in (1, 7, 16, 100):
        for _ in range(30):
            sizes = sorted((r.randint(1, length) for _ in range(r.randint(0, 80))), reverse=True)
            rows = packing.best_fit(sizes, length)
            assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
            assert sorted(length - sum(sizes[i] for i in row) for row in rows) == brute_fit(sizes, length)


def check_packed(rows, texts, own, length, end):
    found = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == length and r.cu_seqlens[-1] == r.n_tokens <= length and not ids[r.n_tokens :].any()
        assert r.position_resets == r.cu_seqlens[:-1]
        for a, b, d, p in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.parts):
            found.setdefault(d, []).append((p, ids[a:b].tolist()))
    for doc, text in texts:
        ids = own.encode(text or "")
        ids += [end] * bool(ids)
        parts = sorted(found.pop(doc, []))
        assert [p for p, _ in parts] == list(range(len(parts)))
        assert [i for _, x in parts for i in x] == ids
    assert not found


def test_packing(spark, model, own):
    r = random.Random(4)
    texts = [(i, " ".join("word" for _ in range(r.randint(0, 70)))) for i in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, shard int")
    rows = packing.pack(docs, model, length=32, shard=500).collect()
    check_packed(rows, texts, own, 32, 2)
    again = packing.pack(docs.repartition(5), model, length=32, shard=500).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert packing.pack(docs.limit(0), model).collect() == []


def test_packed_query_and_files(spark, own, tmp_path):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    packed = QUERIES["op10_packed_ids"](spark, SF)
    packing.write(packed, str(tmp_path / "packed"))
    rows = spark.read.parquet(str(tmp_path / "packed")).collect()
    check_packed(rows, texts, own, packing.LENGTH, 2)
    assert sum(r.n_tokens for r in rows) >= 0.95 * (len(rows) - 1) * packing.LENGTH


def test_unknown_piece_is_looked_up_once(monkeypatch):
    """The list of pieces isn't walked again for every cut; a cut that comes
    back in a later batch has the ids it had."""
    seen, whole = [], pieces.Spec.unknown.fget
    monkeypatch.setattr(pieces.Spec, "unknown", property(lambda spec: seen.append(1) or whole(spec)))
    codec = pieces.Codec(piece_model())
    seen.clear()
    texts = [f"word{i} and tail{i}" for i in range(300)]
    for part in (texts[:200], texts[100:]):
        ids, offsets = codec.encode(pa.array(part))
        lists = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
        assert lists == [e.ids for e in codec.whole.encode_batch(part, add_special_tokens=False)]
    assert seen == []
