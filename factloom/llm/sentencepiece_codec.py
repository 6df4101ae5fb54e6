"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model's protobuf is read field by field; from it the normaliser, the metaspace marker,
the pieces with their scores and byte fallback are rebuilt as a ``tokenizers`` pipeline, for
unigram models as well as BPE ones (whose merges follow from the scores). Texts are encoded
in batches on the library's threads.

Where no piece has the marker behind another character, no merge or segment crosses from a
word to the next marker, so a text's ids are those of its words in order. Then each distinct
word of a batch is encoded once, and its ids are decoded once; a text's ids and decoded text
are put together from those of its words. Parity with encoding
whole texts is tested, as is parity with the SentencePiece library.

Defined results: a null text has null ids and decodes to null; the empty text has no ids;
whatever the vocabulary lacks is spelled in bytes, so decoding gives the normalised text.
Each row is coded by itself, so repeated rows get equal results and a null doc_id stays null;
an empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_CACHED_WORDS = 1 << 19
_WORDS_A_CALL = 1 << 12
_WORDS_A_TEXT = 256
_GROUP = 1 << 22
#: Threads of the library in each worker where ``threads`` is not given: a task has one core.
_THREADS = 2


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protobuf message: varints as numbers, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


class SentencePieceModel:
    """What a model file says: pieces, kinds, scores and the normaliser's rules."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk = UNIGRAM, False, 0
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        for field, value in _fields(data):
            if field == 1:
                parts = dict(_fields(value))
                score = struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0
                self.pieces.append((parts[1].decode(), score, parts.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
                self.kind, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif field == 3:
                rules = dict(_fields(value))
                self.charsmap = rules.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def normalizer(self) -> normalizers.Normalizer:
        steps: list = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(_regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        return normalizers.Sequence(steps)

    def core(self) -> models.Model:
        if self.kind == UNIGRAM:
            return models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk, self.byte_fallback)
        if self.kind != BPE:
            raise ValueError("only unigram and BPE models are read")
        vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        usable = {p: s for p, s, k in self.pieces if k in (NORMAL, USER, UNUSED)}
        merges = []
        for piece, score in usable.items():
            for k in range(1, len(piece)):
                if piece[:k] in usable and piece[k:] in usable:
                    merges.append((-score, vocab[piece[:k]], vocab[piece[k:]], piece[:k], piece[k:]))
        merges.sort()
        return models.BPE(vocab, [m[3:] for m in merges], unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback)

    def words_apart(self) -> bool:
        """No piece has the marker behind another character."""
        return self.escape and not self.charsmap and not self.squeeze and not any(MARK in p.lstrip(MARK) for p, _, k in self.pieces if k == NORMAL) and not any(k == USER for _, _, k in self.pieces)

    def tokenizer(self, normalize: bool = True) -> Tokenizer:
        t = Tokenizer(self.core())
        if normalize:
            t.normalizer = self.normalizer()
        special = [p for p, _, k in self.pieces if k == CONTROL]
        t.add_special_tokens([AddedToken(p, normalized=False, special=True) for p in special])
        t.encode_special_tokens = True  # their spelling in a text is ordinary text
        # the space of the dummy prefix is taken off where a whole text has been put together
        t.decoder = decoders.Sequence([decoders.Replace(self.pieces[self.unk][0], " ⁇ "), decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        return t


def _regex(pattern: str):
    from tokenizers import Regex

    return Regex(pattern)


_WORD = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")


def _spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + size]`` one after the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(sizes.sum())]


class Codec:
    """Encodes and decodes batches of texts."""

    def __init__(self, data: bytes, threads: int | None = None):
        if threads:
            os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ.setdefault("RAYON_NUM_THREADS", str(_THREADS))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.model = SentencePieceModel(data)
        self.apart = self.model.words_apart()
        self.plain = self.model.tokenizer(normalize=False)
        kinds = [k for _, _, k in self.model.pieces]
        self.bytes = np.array([k == BYTE for k in kinds])
        self.odd = np.array([k in (BYTE, UNKNOWN, CONTROL) for k in kinds])
        self.marked = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        spelled = [b"" if o else p.replace(MARK, " ").encode() for (p, _, _), o in zip(self.model.pieces, self.odd.tolist(), strict=True)]
        self.piece_text = np.frombuffer(b"".join(spelled), np.uint8)
        self.piece_size = np.array([len(x) for x in spelled])
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self._forget()

    @functools.cached_property
    def whole(self) -> Tokenizer:
        """For whole texts; built where it is needed."""
        return self.model.tokenizer()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.word_ids, self.word_size, self.word_start = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.word_text = pa.array([], pa.large_string())
        self.held = [(self.word_ids, self.word_size, self.word_text)]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has.

        Words that start with their only marker are put into texts of many, since a call and a
        result for each word cost more than its ids: a word begins where a piece has the marker.
        """
        joined = np.array([w[0] == MARK and w.count(MARK) == 1 for w in words])
        some = [w for w, j in zip(words, joined.tolist(), strict=True) if j]
        texts = ["".join(some[k : k + _WORDS_A_TEXT]) for k in range(0, len(some), _WORDS_A_TEXT)]
        size = np.zeros(len(words), np.int64)
        run = np.array([i for e in self.plain.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.int32)
        begins = np.flatnonzero(self.marked[run])
        if len(begins) == len(some):
            size[joined] = np.diff(np.concatenate([begins, [len(run)]]))
        else:  # the model spells the marker itself in bytes
            joined[:], run = False, np.empty(0, np.int32)
        rest = [w for w, j in zip(words, joined.tolist(), strict=True) if not j]
        alone = [e.ids for e in self.plain.encode_batch_fast(rest, add_special_tokens=False)]
        size[~joined] = [len(ids) for ids in alone]
        out, mine = np.empty(size.sum(), np.int32), np.repeat(joined, size)
        out[mine], out[~mine] = run, [i for ids in alone for i in ids]
        return out, size

    def _spell(self, ids: np.ndarray, size: np.ndarray) -> pa.Array:
        """Text of each word's ids: its pieces' texts in a row; the library's decoder puts
        together those that are spelled in bytes or unknown."""
        length = self.piece_size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        offsets = np.concatenate([[0], np.cumsum(length)])[ends]
        data = _spread(self.piece_text, self.piece_start[ids], length)
        text = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
        odd = np.flatnonzero(np.add.reduceat(np.concatenate([self.odd[ids], [False]]).astype(np.int64), ends[:-1]) * (size > 0)) if len(size) else ends[:0]
        if not len(odd):
            return text
        decoded = self.plain.decode_batch([ids[ends[k] : ends[k + 1]].tolist() for k in odd], skip_special_tokens=True)
        mask = np.zeros(len(size), bool)
        mask[odd] = True
        return pc.replace_with_mask(text, pa.array(mask), pa.array(decoded, pa.large_string()))

    def _learn(self, fresh: list[str]) -> None:
        """Ids of new words, and the text that those ids decode to."""
        for k in range(0, len(fresh), _WORDS_A_CALL):  # the library's results are far larger than the ids
            ids, size = self._ids(fresh[k : k + _WORDS_A_CALL])
            self.held.append((ids, size, self._spell(ids, size)))
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        if len(self.held) > 1:
            self.held = [(np.concatenate([x for x, _, _ in self.held]), np.concatenate([y for _, y, _ in self.held]), pa.concat_arrays([z for _, _, z in self.held]))]
            self.word_ids, self.word_size, self.word_text = self.held[0]
            self.word_start = np.cumsum(self.word_size) - self.word_size

    def _places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place among the known words of each word of the texts, and each text's first word.

        Words are split and told apart by Arrow, once for a batch; texts with marks of their
        own or with spaces in a row, whose marks belong to the next word, are split one by one.
        """
        lead = MARK if self.model.dummy_prefix else ""
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)), pc.or_(pc.ends_with(texts, " "), pc.or_(pc.starts_with(texts, " "), pc.equal(texts, ""))))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        split = pc.split_pattern(plain, " ")
        coded = split.flatten().dictionary_encode()
        firsts = split.offsets.to_numpy()[:-1] - (split.offsets[0].as_py() if len(split.offsets) else 0)
        # the first word of a text has a marker only where the model adds one
        words = [MARK + w for w in coded.dictionary.to_pylist()]
        heads = [] if lead or not len(plain) else pc.list_element(split, 0).to_pylist()
        slow = [_WORD.findall(lead + t.replace(" ", MARK)) if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
        wanted = dict.fromkeys(words)
        wanted.update(dict.fromkeys(heads))
        wanted.update(dict.fromkeys(w for row in slow for w in row))
        if len(self.known) > _CACHED_WORDS:
            self._forget()
        self._learn([w for w in wanted if w not in self.known])
        place = np.array([self.known[w] for w in words], np.int64)[coded.indices.to_numpy()] if words else np.empty(0, np.int64)
        if heads:
            place[firsts] = [self.known[w] for w in heads]
        if not odd.any():
            return place, np.concatenate([firsts, [len(place)]])
        size = np.zeros(len(odd), np.int64)
        size[~odd] = np.diff(np.concatenate([firsts, [len(place)]]))
        size[odd] = [len(row) for row in slow]
        first = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(first[-1], np.int64)
        out[np.repeat(~odd, size)] = place
        out[np.repeat(odd, size)] = [self.known[w] for row in slow for w in row]
        return out, first

    def code(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids of all texts in a row, each text's first place (one more at the end), and the
        text that each row of ids decodes to."""
        if not self.apart:
            rows = [e.ids for e in self.whole.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in rows for i in ids], np.int32), np.cumsum([0, *map(len, rows)]), pa.array([self.decode(ids) for ids in rows], pa.large_string())
        place, first = self._places(texts)
        size = self.word_size[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = _spread(self.word_ids, self.word_start[place], size)
        words = pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), self.word_text.take(pa.array(place)))
        decoded = pc.binary_join(words, pa.scalar("", pa.large_string()))
        if self.model.dummy_prefix:
            decoded = pc.if_else(pc.starts_with(decoded, " "), pc.utf8_slice_codeunits(decoded, 1), decoded)
        return ids, ends[first], decoded

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, first, _ = self.code(pa.array(texts, pa.large_string()))
        return [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = self.plain.decode(list(map(int, ids)), skip_special_tokens=True)
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


@functools.lru_cache(maxsize=2)
def _codec(data: bytes, threads: int | None) -> Codec:
    return Codec(data, threads)


def load(path: str) -> bytes:
    """Bytes of a model file; they are small and travel with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model: bytes, threads: int | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row for each row: ``doc_id, ids, n_tokens, n_bytes``
    (tokens that are single bytes) and ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, threads)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            at = 0
            while at < batch.num_rows:
                end, held = at, 0
                while end < batch.num_rows and (end == at or held + sizes[end] <= _GROUP):
                    held += sizes[end]
                    end += 1
                some = texts.slice(at, end - at)
                null = some.is_null().to_numpy(zero_copy_only=False)
                ids, first, decoded = codec.code(some.fill_null(""))
                spelled = np.concatenate([[0], np.cumsum(codec.bytes[ids])])
                yield pa.record_batch(
                    [
                        batch.column(0).slice(at, end - at),
                        pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(null)),
                        pa.array(np.diff(first), pa.int64(), mask=null),
                        pa.array(np.diff(spelled[first]), pa.int64(), mask=null),
                        pc.if_else(pa.array(null), None, decoded).cast(pa.string()),
                    ],
                    ["doc_id", "ids", "n_tokens", "n_bytes", "decoded"],
                )
                at = end

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, n_bytes long, decoded string")


def parity(docs: DataFrame, model: bytes) -> DataFrame:
    """``(doc_id, same)``: whether ids and decoded text equal the SentencePiece library's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        codec, reference = _codec(model, None), sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            same = []
            for text in batch.column(1).to_pylist():
                ids, want = codec.encode([text or ""])[0], reference.encode(text or "")
                same.append(ids.tolist() == want and codec.decode(ids) == reference.decode(want))
            yield pa.record_batch([batch.column(0), pa.array(same, pa.bool_())], ["doc_id", "same"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, same boolean")
