"""Alignment of two tokenizers, with corpus-wide counts of the token pairs that end together.

Byte offsets at which a token of A and one of B both end cut a text into groups; the last token
of A and the last of B in a group are linked. Counts of linked id pairs are kept in dense vectors
that a minimal perfect hash of the distinct pairs indexes:

1. Documents are dealt to buckets of bounded size; each bucket is aligned and gives one row for
   each pair that it holds.
2. Distinct pairs are dealt to shards by their B id. A shard holds at most (pairs of the two
   vocabularies / number of shards) pairs, whatever the corpus, and builds its hash: a level is a
   bit array of twice as many bits as keys, keys that are alone on their bit stay, the others go
   to the next level, and a key's number is the rank of its bit.
3. For each shard, leaves of ``FAN`` buckets add their pairs into dense vectors, which are summed
   by a tree. A pair that the hash places on another's number is told by the stored keys.
4. Each bucket's pairs are looked up, and a second pass aligns its documents again and adds up
   the counts of their links.

Both tokenizers begin anew at a space behind anything but white space, if A splits words in the
byte-level way and no piece of B has its marker behind another character; then each distinct
chunk between such spaces is aligned once for a batch. Other tokenizers, and texts with a chunk
whose tokens do not spell it, are aligned whole.

Defined results: a text that is null or empty, or whose tokens of A or B do not spell a space and
the text byte for byte, has no tokens, no groups and no links; a null doc_id stays null; repeated
rows are rows of their own and count as often; further columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import buckets as bk
from factloom.llm import packed
from factloom.llm import textkernels as tk
from factloom.llm.runs import spread
from factloom.llm.sentencepiece_codec import BYTE, MARK, SentencePieceModel
from factloom.plans.shared import materialize

BUCKET_BYTES = 8 << 20
#: Buckets to a leaf, and vectors to a node of the tree above.
FAN, TREE_FAN = 64, 8
#: Most pairs that a shard may get if every pair of the vocabularies came.
SHARD_PAIRS = 1 << 24
_GROUP = 4 << 20
_CACHED = 1 << 19
_CALL = 1 << 13
_CHUNKS_A_TEXT = 256
_MARK = MARK.encode()
# White space of more than one byte, U+0085, 00A0, 1680, 180E, 2000-200A, 2028, 2029, 202F, 205F and 3000.
_WIDE = re.compile(rb"(?s)(?:\xC2[\x85\xA0]|\xE1(?:\x9A\x80|\xA0\x8E)|\xE2(?:\x80[\x80-\x8A\xA8\xA9\xAF]|\x81\x9F)|\xE3\x80\x80)\Z").search


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters for themselves, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return table | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens in a row, and where each starts and how long it is."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


class Aligner:
    """Aligns batches of texts; ``a`` is a byte-level tokenizer's JSON, ``b`` a SentencePiece model."""

    def __init__(self, a: bytes, b: bytes):
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a.decode()), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        alphabet = _byte_alphabet()
        self.a_bytes: dict[int, bytes] = {}
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        model = SentencePieceModel(b)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in model.pieces]
        self.n_b = len(self.b_bytes)
        self.a_table = _table([self.a_bytes.get(i, b"") for i in range(max(self.a_bytes) + 1)])
        self.b_table = _table(self.b_bytes)
        split = json.loads(a).get("pre_tokenizer") or {}
        self.apart = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and json.loads(a).get("normalizer") is None and model.words_apart() and model.dummy_prefix
        # what follows a text's last space is empty: a marker alone
        self.marker = self.b.piece_to_id(MARK)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held: list[tuple] = []
        self.good, self.n_a_of, self.n_b_of, self.size, self.start = (np.empty(0, np.int64),) * 5
        self.keys = np.empty(0, np.int64)
        self.spelled = pa.array([], pa.large_string())

    def pair(self, text: str, a: list[int], b: list[int]) -> tuple[str, list[int]] | None:
        """Groups as text and the linked pairs of one chunk; None if the tokens do not spell it."""
        left, right = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if not b"".join(left) == b"".join(right) == text.encode():
            return None
        groups, keys, i, j, x, y = [], [], 0, 0, 0, 0
        from_a = from_b = 0
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                x += len(left[i])
                i += 1
            else:
                y += len(right[j])
                j += 1
            if x == y and i > from_a and j > from_b:
                groups.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
                keys.append(a[i - 1] * self.n_b + b[j - 1])
                from_a, from_b = i, j
        return ";".join(groups), keys

    def _encode(self, chunks: list[str], whole: bool) -> list[tuple[list[int], list[int]]]:
        """Ids of strings that begin with the space that B adds by itself."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        if not whole:
            b = [ids if len(c) > 1 else [self.marker] for c, ids in zip(chunks, b, strict=True)]
        return list(zip(a, b, strict=True))

    def _alone(self, chunks: list[str]) -> tuple:
        """Columns of chunks that are encoded one by one."""
        good, n_a, n_b, size, keys, spelled = [], [], [], [], [], []
        for chunk, (a, b) in zip(chunks, self._encode(chunks, False), strict=True):
            text, links = self.pair(chunk, a, b) or ("", None)
            good.append(links is not None)
            n_a.append(len(a))
            n_b.append(len(b))
            size.append(len(links or ()))
            keys += links or ()
            spelled.append(text)
        return (*(np.array(v, np.int64) for v in (good, n_a, n_b, size, keys)), pa.array(spelled, pa.large_string()))

    def _together(self, chunks: list[bytes]) -> tuple | None:
        """The same for chunks that end in no white space, many to a text, since a call and a
        result for each costs more than its ids: both tokenizers begin anew at the next one's
        space. None if the tokens do not spell the texts or cross from chunk to chunk."""
        joined = [b"".join(chunks[k : k + _CHUNKS_A_TEXT]) for k in range(0, len(chunks), _CHUNKS_A_TEXT)]
        coded = self._encode([t.decode() for t in joined], True)
        a, b = (np.array([i for pair in coded for i in pair[side]], np.int64) for side in (0, 1))
        data = np.frombuffer(b"".join(joined), np.uint8)
        ends = []
        for ids, (spelling, starts, sizes) in ((a, self.a_table), (b, self.b_table)):
            if sizes[ids].sum() != len(data) or not np.array_equal(spelling[spread(starts[ids], starts[ids] + sizes[ids])], data):
                return None
            ends.append(np.cumsum(sizes[ids]))
        common = np.intersect1d(*ends, assume_unique=True)
        edges = np.cumsum([len(c) for c in chunks])
        last = np.searchsorted(common, edges)
        if last[-1] >= len(common) or not np.array_equal(common[last], edges):
            return None
        at = [np.searchsorted(e, common) for e in ends]  # of each group's last tokens
        texts = []
        for ids, stop in zip((a, b), at, strict=True):
            numbers = pa.array(ids).cast(pa.large_string())
            texts.append(pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], stop + 1])), numbers), pa.scalar(",", pa.large_string())))
        groups = pc.binary_join_element_wise(*texts, pa.scalar("|", pa.large_string()))
        first = np.concatenate([[0], last + 1])
        spelled = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first), groups), pa.scalar(";", pa.large_string()))
        n_a, n_b = (np.diff(np.concatenate([[0], stop[last] + 1])) for stop in at)
        return np.ones(len(chunks), np.int64), n_a, n_b, np.diff(first), a[at[0]] * self.n_b + b[at[1]], spelled

    def _learn(self, fresh: list[bytes]) -> None:
        plain, odd = [], []
        for c in fresh:  # behind white space the next chunk does not surely begin anew
            (plain if (32 < c[-1] < 127 or c[-1] > 127 and not _WIDE(c[-3:])) and _MARK not in c else odd).append(c)
        for k in range(0, len(plain), _CALL):
            some = plain[k : k + _CALL]
            self.held.append(self._together(some) or self._alone([c.decode() for c in some]))
        for k in range(0, len(odd), _CALL):
            self.held.append(self._alone([c.decode() for c in odd[k : k + _CALL]]))
        fresh = plain + odd
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        if len(self.held) > 1:
            columns = list(zip(*self.held, strict=True))
            self.held = [(*map(np.concatenate, columns[:5]), pa.concat_arrays(columns[5]))]
        if self.held:
            self.good, self.n_a_of, self.n_b_of, self.size, self.keys, self.spelled = self.held[0]
            self.start = np.cumsum(self.size) - self.size

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place among the known chunks of each chunk of a space and the text, and each text's first."""
        data, offsets = tk.utf8(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        at = np.flatnonzero(data == 32)
        padded = np.concatenate([np.zeros(3, np.uint8), data])
        p1, p2, p3 = padded[at + 2], padded[at + 1], padded[at]
        # white space of more than one byte, as in _WIDE
        wide = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0)) | (p3 == 0xE1) & ((p2 == 0x9A) & (p1 == 0x80) | (p2 == 0xA0) & (p1 == 0x8E)) | (p3 == 0xE2) & ((p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF)) | (p2 == 0x81) & (p1 == 0x9F)) | (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)
        behind = ((p1 > 32) & (p1 < 127)) | (p1 >= 128) & ~wide
        mark = np.zeros(len(data) + 1, bool)
        mark[at[behind]] = mark[offsets] = True
        ends = np.flatnonzero(mark)
        begins = ends[:-1]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > _CACHED:
            self._forget()
        self._learn([w for w in words if w not in self.known])
        place = np.array([self.known[w] for w in words], np.int64)[coded.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
        return place, np.searchsorted(begins, offsets)

    def align(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of each text the numbers of tokens of A and B, the first of its links (one more at the
        end), all links' pairs in a row, and its groups as text."""
        texts = texts.fill_null("")
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        if self.apart:
            place, first = self._chunks(texts)
            total = lambda of: np.diff(np.concatenate([[0], np.cumsum(of[place])])[first])
            odd = ~empty & (total(1 - self.good) > 0)
        else:
            place, first = np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
            total = lambda of: np.zeros(len(texts), np.int64)
            odd = ~empty
        n_a, n_b, links = total(self.n_a_of), total(self.n_b_of), total(self.size)
        n_a[empty | odd] = n_b[empty | odd] = links[empty | odd] = 0
        plain = np.repeat(~(empty | odd), np.diff(first))
        mine = place[plain]
        chunked = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(empty | odd, 0, np.diff(first)))])), self.spelled.take(pa.array(mine)))
        groups = pc.binary_join(chunked, pa.scalar(";", pa.large_string()))
        keys = self.keys[spread(self.start[mine], self.start[mine] + self.size[mine])]
        if odd.any():
            rows, which = [], np.flatnonzero(odd)
            for k, text in zip(which.tolist(), texts.filter(pa.array(odd)).to_pylist(), strict=True):
                (a, b), = self._encode([" " + text], True)
                spelled, linked = self.pair(" " + text, a, b) or ("", [])
                if spelled:
                    n_a[k], n_b[k], links[k] = len(a), len(b), len(linked)
                rows.append((spelled, linked))
            groups = pc.replace_with_mask(groups, pa.array(odd), pa.array([r[0] for r in rows], pa.large_string()))
            joined = np.empty(links.sum(), np.int64)
            whole = np.repeat(odd, links)
            joined[~whole], joined[whole] = keys, [x for r in rows for x in r[1]]
            keys = joined
        return n_a, n_b, np.concatenate([[0], np.cumsum(links)]), keys, groups


@functools.lru_cache(maxsize=2)
def _aligner(a: bytes, b: bytes) -> Aligner:
    return Aligner(a, b)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with a bounded size of text, one row at least."""
    sizes, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _GROUP, side="right")))
        yield at, stop
        at = stop


def _column(table: pa.Table, name: str, kind: pa.DataType) -> pa.Array:
    column = table.column(name).cast(kind)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], kind)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place.reshape(-1), weights=counts, minlength=len(found)).astype(np.int64)


def shard_of(keys: np.ndarray, n_b: int, shards: int) -> np.ndarray:
    """Pairs of one B id are of one shard, so that its highest count is found there."""
    return (tk.mix((keys % n_b).astype(np.uint64) + np.uint64(1)) % np.uint64(shards)).astype(np.int32)


class PerfectHash:
    """Minimal perfect hash of distinct keys: ``number`` gives 0 to n - 1, each once."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bits of each level
        self.ranks = []
        before = 0
        for bits in levels:
            self.ranks.append(before + np.cumsum(bits, dtype=np.int64) - bits)
            before += int(bits.sum())
        self.n = before

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tk.mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            size = 2 * len(keys)
            place = cls._place(keys, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[place]]
        return cls(levels)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that no level holds; another unknown key may get a known one's number."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            place = self._place(keys[left], level, len(bits))
            hit = bits[place]
            out[left[hit]] = ranks[place[hit]]
            left = left[~hit]
        return out

    def pack(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i8").tobytes()
        return sizes + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def unpack(cls, blob: bytes) -> PerfectHash:
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(blob, "<i8", n, 8).tolist(), 8 * (n + 1), []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(levels)

    def verified(self, keys: np.ndarray, stored: np.ndarray) -> np.ndarray:
        """Numbers of keys that all are known: the stored key at each number is the key."""
        number = self.number(keys)
        if (number < 0).any() or not np.array_equal(stored[number], keys):
            raise ValueError("a pair is not among those that the hash was built for")
        return number


def _blob(table: pa.Table, name: str) -> bytes:
    return table.column(name)[0].as_py()


def align(docs: DataFrame, a: bytes, b: bytes, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN, tree_fan: int = TREE_FAN) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row for each row: ``doc_id, n_a, n_b, n_groups, n_links``,
    ``n_best`` (links whose pair's count is the highest of its B id), ``count_sum`` (of the links'
    counts) and ``groups`` (ids of A and B in order: ``a1,a2|b1;a3|b2``)."""
    pairs, n_b = _vocabulary(a, b)
    n = bk.count_buckets(docs, bucket_bytes)
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // SHARD_PAIRS))
    dealt = bk.deal(docs, n)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        aligner, texts = _aligner(a, b), _column(table, "text", pa.large_string())
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for at, stop in _slices(texts):
            found = aligner.align(texts.slice(at, stop - at))[3]
            keys, counts = _summed(np.concatenate([keys, found]), np.concatenate([counts, np.ones(len(found), np.int64)]))
        return pa.table({"bucket": pa.array(np.full(len(keys), key[0].as_py(), np.int32)), "shard": pa.array(shard_of(keys, n_b, shards)), "key": keys, "n": counts})

    held = materialize(dealt.groupBy("bucket").applyInArrow(count, "bucket int, shard int, key long, n long"), "pairs")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        keys = np.sort(_column(table, "key", pa.int64()).to_numpy())
        function = PerfectHash.build(keys)
        stored = np.empty(len(keys), np.int64)
        stored[function.number(keys)] = keys
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "function": pa.array([function.pack()], pa.binary()), "keys": pa.array([packed.pack(stored)], pa.binary())})

    functions = held.select("shard", "key").distinct().groupBy("shard").applyInArrow(build, "shard int, function binary, keys binary")
    functions = materialize(functions, "functions")
    leaves = -(-n // fan)
    to_leaves = lambda d: d.withColumn("leaf", F.explode(F.sequence(F.lit(0), F.lit(leaves - 1))))
    parts = held.withColumn("leaf", F.floor(F.col("bucket") / fan).cast("int"))

    def add(key: tuple, found: pa.Table, function: pa.Table) -> pa.Table:
        stored = packed.unpack(_blob(function, "keys"), "<i8")
        number = PerfectHash.unpack(_blob(function, "function")).verified(_column(found, "key", pa.int64()).to_numpy(), stored)
        vector = np.bincount(number, weights=_column(found, "n", pa.int64()).to_numpy(), minlength=len(stored)).astype(np.int64)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "leaf": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([packed.pack(vector)], pa.binary())})

    vectors = parts.groupBy("shard", "leaf").cogroup(to_leaves(functions).groupBy("shard", "leaf")).applyInArrow(add, "shard int, leaf int, counts binary")

    def tree(key: tuple, table: pa.Table) -> pa.Table:
        vector = sum(packed.unpack(v, "<i8") for v in table.column("counts").to_pylist())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "leaf": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([packed.pack(vector)], pa.binary())})

    nodes = leaves
    while nodes > 1:
        nodes = -(-nodes // tree_fan)
        vectors = vectors.withColumn("leaf", F.floor(F.col("leaf") / tree_fan).cast("int")).groupBy("shard", "leaf").applyInArrow(tree, "shard int, leaf int, counts binary")
    totals = materialize(functions.join(vectors.select("shard", "counts"), "shard"), "totals")

    def look_up(key: tuple, found: pa.Table, total: pa.Table) -> pa.Table:
        stored, counts = packed.unpack(_blob(total, "keys"), "<i8"), packed.unpack(_blob(total, "counts"), "<i8")
        most = np.zeros(n_b, np.int64)
        np.maximum.at(most, stored % n_b, counts)
        keys = _column(found, "key", pa.int64()).to_numpy()
        number = PerfectHash.unpack(_blob(total, "function")).verified(keys, stored)
        return pa.table({"bucket": _column(found, "bucket", pa.int32()), "key": keys, "total": counts[number], "best": counts[number] == most[keys % n_b]})

    answers = parts.groupBy("shard", "leaf").cogroup(to_leaves(totals).groupBy("shard", "leaf")).applyInArrow(look_up, "bucket int, key long, total long, best boolean")

    def again(key: tuple, mine: pa.Table, answer: pa.Table) -> pa.Table:
        aligner, texts, ids = _aligner(a, b), _column(mine, "text", pa.large_string()), _column(mine, "doc_id", pa.int64())
        known = _column(answer, "key", pa.int64()).to_numpy()
        order = np.argsort(known)
        known, total, best = known[order], _column(answer, "total", pa.int64()).to_numpy()[order], _column(answer, "best", pa.bool_()).to_numpy(zero_copy_only=False)[order].astype(np.int64)
        out = []
        for at, stop in _slices(texts):
            n_a, n_b_, first, keys, groups = aligner.align(texts.slice(at, stop - at))
            place = np.searchsorted(known, keys)
            sums = lambda of: np.diff(np.concatenate([[0], np.cumsum(of[place])])[first])
            links = np.diff(first)
            out.append(pa.record_batch([ids.slice(at, stop - at), *map(pa.array, (n_a, n_b_, links, links, sums(best), sums(total))), groups.cast(pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]))
        return pa.Table.from_batches(out) if out else pa.table({c: pa.array([], t) for c, t in _RESULT})

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(again, schema)


_RESULT = [(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups", pa.string())]


def _vocabulary(a: bytes, b: bytes) -> tuple[int, int]:
    """How many pairs the two vocabularies have, and the size of B's."""
    n_a = max(json.loads(a)["model"]["vocab"].values()) + 1
    n_b = len(SentencePieceModel(b).pieces)
    return n_a * n_b, n_b
