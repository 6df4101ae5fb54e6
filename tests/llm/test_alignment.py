import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import alignment
from factloom.llm.queries import BYTE_BPE, MODEL, op13_alignment
from factloom.llm.sentencepiece_codec import load


@pytest.fixture(scope="module")
def models():
    return load(BYTE_BPE), load(MODEL)


class Brute:
    """Whole texts, token by token, with the libraries alone."""

    def __init__(self, models):
        self.a, self.b = Tokenizer.from_str(models[0].decode()), sentencepiece.SentencePieceProcessor(model_proto=models[1])
        self.a.encode_special_tokens = True
        self.alphabet = alignment._byte_alphabet()

    def piece(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False)
        left = [bytes(self.alphabet[c] for c in t) for t in a.tokens]
        b = self.b.encode(text)
        right = [self.piece(i) for i in b]
        if not b"".join(left) == b"".join(right) == (" " + text).encode():
            return []
        ends_a, ends_b = np.cumsum([len(x) for x in left]).tolist(), np.cumsum([len(x) for x in right]).tolist()
        out, last = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            out.append(([i for i, e in zip(a.ids, ends_a) if last < e <= end], [i for i, e in zip(b, ends_b) if last < e <= end]))
            last = end
        return out

    def rows(self, docs):
        groups = [(d, self.groups(t)) for d, t in docs]
        counts = Counter((x[-1], y[-1]) for _, g in groups for x, y in g)
        most = defaultdict(int)
        for (_, y), n in counts.items():
            most[y] = max(most[y], n)
        for d, g in groups:
            links = [(x[-1], y[-1]) for x, y in g]
            text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
            yield (d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), text)


def odd_texts():
    rng = random.Random(5)
    pieces = ["word", " ", "  ", "\n", "\t", "é", "日本", " ", "　", " \n ", "'s", "<|endoftext|>", "<s>", "1234", "—", "🙂", "\x00", "\x1c", "\x85", " ", "...", "ſ", "é", "a b", "​", "x\r\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(600)]
    return texts + [None, "", " ", "  ", " a", "a ", "a  ", "\n", "▁", "a▁b c", "<0x41> x", "word " * 30_000, "w" * 50_000, "the cat", "the cat"]


def test_alignment_matches_brute_force(spark, models):
    docs = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "null id"), (None, "null id"), (3, "again")]
    frame = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, key int, bucket string").repartition(3)
    brute = sorted(map(str, Brute(models).rows(docs)))
    for bucket_bytes, fan, tree_fan in ((8 << 20, 64, 8), (250_000, 1, 2)):
        got = sorted(str(tuple(r)) for r in alignment.align(frame, *models, bucket_bytes, fan, tree_fan).collect())
        assert got == brute
    assert alignment.align(frame.limit(0), *models).collect() == []


def test_query_matches_brute_force(spark, sf_dir, models):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted((*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in Brute(models).rows(docs))
    assert sorted(tuple(r) for r in op13_alignment(spark, sf_dir).collect()) == want


def test_tokenizers_that_do_not_begin_anew_are_aligned_whole(models):
    aligner, brute = alignment.Aligner(*models), Brute(models)
    aligner.apart = False
    texts = [t or "" for t in odd_texts() if len(t or "") < 1000]
    n_a, n_b, first, keys, groups = aligner.align(pa.array(texts, pa.large_string()))
    for k, t in enumerate(texts):
        g = brute.groups(t)
        assert n_a[k] == sum(len(x) for x, _ in g) and first[k + 1] - first[k] == len(g)
        assert keys[first[k] : first[k + 1]].tolist() == [x[-1] * aligner.n_b + y[-1] for x, y in g]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 100_000):
        keys = np.unique(rng.integers(0, 1 << 40, n))
        h = alignment.PerfectHash.unpack(alignment.PerfectHash.build(keys).pack())
        assert sorted(h.number(keys).tolist()) == list(range(len(keys)))
        stored = np.empty(len(keys), np.int64)
        stored[h.number(keys)] = keys
        assert np.array_equal(h.verified(keys, stored), h.number(keys))
    with pytest.raises(ValueError):
        h.verified(np.array([-5]), stored)
