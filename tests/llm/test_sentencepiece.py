import pytest
import sentencepiece
from pyspark.sql import functions as F

from factloom.llm import sentencepiece_codec as sp
from factloom.llm.queries import MODEL

PATH = MODEL
ODD = ["", " ", "  two  spaces ", "\n\tx\n", "▁mark ▁▁ x▁y", "ДЖ 梦 😀 \x00 ​", "<s> </s> <unk> <0x41>", "a" * 3000, "ñandú ciónñ ßü", "x y", "é", "\r\n", "word " * 2000]


@pytest.fixture(scope="module")
def codec():
    return sp.Codec(sp.load(PATH))


def test_parity_with_library(codec, spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ODD
    reference = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert codec.apart
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        want = reference.encode(t)
        assert ids.tolist() == want, t[:80]
        assert codec.decode(ids) == reference.decode(want)
        assert codec.decode(ids) == t or "▁" in t


def test_words_apart_equals_whole_texts(codec, spark, sf_dir):
    texts = [r.text[:3000] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(40).collect()]
    assert [x.tolist() for x in codec.encode(texts)] == [e.ids for e in codec.whole.encode_batch(texts, add_special_tokens=False)]


def test_rows(spark):
    rows = [(i, t, [1], 2) for i, t in enumerate([None, *ODD])] + [(None, "x", [1], 2), (3, "y", [1], 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, n_tokens int")
    got = sp.encode_decode(docs, sp.load(PATH)).collect()
    assert sorted(str((r.doc_id, r.decoded)) for r in got) == sorted(str((d, None if t is None else t.replace("▁", " "))) for d, t, *_ in rows)
    assert all((r.ids is None) == (r.decoded is None) for r in got)
    assert sp.encode_decode(docs.where(F.lit(False)), sp.load(PATH)).collect() == []


def test_unigram_model():
    def field(number, kind, body):
        return bytes([number << 3 | kind]) + (bytes([len(body)]) + body if kind == 2 else body)

    import struct

    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -1.5, 1), ("ab", -1.2, 1)]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    data += field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00"))
    codec = sp.Codec(data)
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in ("ab", "a b", "aab ba", "b"):
        assert codec.encode([text])[0].tolist() == reference.encode(text)
        assert codec.whole.encode(text, add_special_tokens=False).ids == reference.encode(text)


def test_parity_operator(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sp.parity(docs, sp.load(PATH)).where("not same").count() == 0
