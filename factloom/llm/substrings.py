"""Substring dedup with prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words; a word goes if some window over it also starts in
a document with a smaller doc_id. Suffixes are the word sequences from each word on, and
only their first ``WINDOW`` words matter, so a tree is cut at that depth.

1. Each bucket of documents sends the hashes of its windows to hash ranges, which mark
   those that come in two documents or more. Every other suffix is a leaf on its own and
   is left out; a false mark costs time, not correctness. Hashes of whole documents go
   along: of a text that comes whole in an earlier document every window does, so a copy
   is settled here and adds nothing to the trees.
2. Each marked suffix, once per bucket, goes to the group of its prefix: as many leading
   words as it takes to reach ``PREFIX_BYTES``, so that prefixes of short frequent words
   grow longer. Groups are hash ranges of prefixes and hold a share of the input.
3. A group sorts its suffixes, which lists the leaves of its subtree in order; neighbours
   with a common prefix of ``WINDOW`` words share a deep internal node. The node's smallest
   doc_id is sent back to every bucket that has it.
4. Each bucket drops the words under windows that an earlier document has. Runs of them
   are its maximal repeats.

Defined results: a null text has no words; a row with a null doc_id is neither earlier than
another nor has words removed; rows with equal doc_id, repeated rows among them, are not
earlier than each other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from factloom.llm import textkernels as tk
from factloom.llm.buckets import Bucket, count_buckets, deal, split
from factloom.llm.packed import pack, pack_sorted, unpack, unpack_sorted

WINDOW = 13
PREFIX_BYTES = 12
BUCKET_BYTES = 8 << 20
BUCKETS_A_GROUP = 4  # larger groups hold more suffixes that overlap, which pack better
_SHORT = 40  # bits of the window hashes of step 1
_SLICE = 1 << 16

MARKS = "bucket int, part int, hashes binary, twice binary, texts binary, docs binary"
SUFFIXES = "bucket int, part int, suffixes binary, docs binary, copies binary"
NODES = "bucket int, part int, hashes binary, docs binary, copies binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>"


class Windows(Bucket):
    def __init__(self, table: pa.Table, window: int):
        super().__init__(table)
        self.size = window
        self.hash, self.at = tk.window_hashes(self.hashes, self.first, window)
        self.owner = self.doc[self.at] if len(self.at) else self.at
        counted = self.owner < self.known
        self.hash, self.at, self.owner = self.hash[counted], self.at[counted], self.owner[counted]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of whole documents of a window or more, ascending, and whose they are."""
        own = np.flatnonzero(np.diff(self.first)[: self.known] >= self.size)
        if not len(own):
            return np.empty(0, np.uint64), own
        place = np.arange(len(self.hashes)) - np.repeat(self.first[:-1], np.diff(self.first))
        total = np.concatenate([[0], np.cumsum(tk.mix(self.hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]).astype(np.uint64)
        h = tk.mix(total[self.first[own + 1]] - total[self.first[own]])
        order = np.argsort(h, kind="stable")
        return h[order], own[order]

    def short(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct short hashes, the place of each window's, and which are in two documents."""
        values, place = np.unique(self.hash >> np.uint64(64 - _SHORT), return_inverse=True)
        least = np.full(len(values), np.iinfo(np.int64).max)
        most = np.full(len(values), np.iinfo(np.int64).min)
        np.minimum.at(least, place, self.doc_ids[self.owner])
        np.maximum.at(most, place, self.doc_ids[self.owner])
        return values, place, least != most


def _ask(parts: int, window: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = Windows(table, window)
        values, _, twice = bucket.short()
        cuts = split(values, parts, _SHORT)
        whole, owner = bucket.whole()
        ids = bucket.doc_ids[owner].astype("<i8")
        texts = split(whole, parts)
        columns = {
            "hashes": [pack_sorted(values[a:b]) for a, b in cuts],
            "twice": [np.packbits(twice[a:b]).tobytes() for a, b in cuts],
            "texts": [pack_sorted(whole[a:b]) for a, b in texts],
            "docs": [pack(ids[a:b]) for a, b in texts],
        }
        return pa.table({"bucket": pa.array([key[0].as_py()] * parts, pa.int32()), "part": pa.array(range(parts), pa.int32())} | {k: pa.array(v, pa.binary()) for k, v in columns.items()})

    return run


def _mark(key: tuple, table: pa.Table) -> pa.Table:
    """Which windows are in two documents, and the first document of each whole text."""
    lists = [unpack_sorted(b) for b in table.column("hashes").to_pylist()]
    own = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(v)).astype(bool) for b, v in zip(table.column("twice").to_pylist(), lists, strict=True)]
    _, place, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    cut = np.cumsum([0, *map(len, lists)])
    both = [np.packbits((count[place[a:b]] > 1) | t).tobytes() for a, b, t in zip(cut[:-1], cut[1:], own, strict=True)]
    texts = [unpack_sorted(b) for b in table.column("texts").to_pylist()]
    docs = np.concatenate([unpack(b, "<i8") for b in table.column("docs").to_pylist()])
    values, place = np.unique(np.concatenate(texts), return_inverse=True)
    least = np.full(len(values), np.iinfo(np.int64).max)
    np.minimum.at(least, place, docs)
    cut = np.cumsum([0, *map(len, texts)])
    firsts = [pack(least[place[a:b]].astype("<i8")) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    none = pa.array([b""] * len(lists), pa.binary())
    return pa.table({"bucket": table.column("bucket"), "part": table.column("part"), "hashes": none, "twice": pa.array(both, pa.binary()), "texts": none, "docs": pa.array(firsts, pa.binary())})


def _prefix_hashes(bucket: Bucket, at: np.ndarray, window: int) -> np.ndarray:
    """Hash of the leading words of each suffix, as many as reach PREFIX_BYTES."""
    h, open_ = np.zeros(len(at), np.uint64), np.ones(len(at), bool)
    size = bucket.ends - bucket.starts
    length = np.zeros(len(at), np.int64)
    for k in range(window):
        h[open_] = tk.mix(h[open_] + bucket.hashes[at[open_] + k])
        length[open_] += size[at[open_] + k]
        open_ &= length < PREFIX_BYTES
        if not open_.any():
            break
    return h


def _send(parts: int, groups: int, window: int):
    def run(key: tuple, docs: pa.Table, marks: pa.Table) -> pa.Table:
        bucket = Windows(docs, window)
        values, place, _ = bucket.short()
        cuts = split(values, parts, _SHORT)
        whole, owner = bucket.whole()
        texts = split(whole, parts)
        marked, copy = np.zeros(len(values), bool), np.zeros(len(bucket.ids), bool)
        for part, bits, firsts in zip(*(marks.column(c).to_pylist() for c in ("part", "twice", "docs")), strict=True):
            a, b = cuts[part]
            marked[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
            who = owner[slice(*texts[part])]
            copy[who] = unpack(firsts, "<i8") < bucket.doc_ids[who]
        some = np.flatnonzero(marked[place] & ~copy[bucket.owner]) if len(place) else place
        _, lead = np.unique(bucket.hash[some], return_index=True)
        lead = np.sort(some[lead])
        group = _prefix_hashes(bucket, bucket.at[lead], window) % np.uint64(groups)
        order = np.argsort(group, kind="stable")
        lead, group = lead[order], group[order]
        text, start, end = bucket.joined()
        text = text.tobytes()
        cut = np.searchsorted(group, np.arange(groups + 1, dtype=np.uint64))
        copies = pack(np.flatnonzero(copy).astype("<i4"))
        rows: dict[str, list] = {"part": [], "suffixes": [], "docs": [], "copies": []}
        for part in np.flatnonzero(np.diff(cut)).tolist() or [0]:
            own = lead[cut[part] : cut[part + 1]]
            at = bucket.at[own]
            suffixes = [text[a:b] for a, b in zip(start[at].tolist(), end[at + window - 1].tolist(), strict=True)]
            rows["part"].append(part)
            rows["suffixes"].append(zstandard.ZstdCompressor(level=6).compress(b"\n".join(suffixes)))
            rows["docs"].append(pack(bucket.doc_ids[bucket.owner[own]].astype("<i8")))
            rows["copies"].append(copies)  # comes back with the first answer
            copies = b""
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(rows["part"]), pa.int32()), "part": pa.array(rows["part"], pa.int32())} | {c: pa.array(rows[c], pa.binary()) for c in ("suffixes", "docs", "copies")})

    return run


def _common_words(a: bytes, b: bytes, window: int) -> int:
    """Words of the longest common prefix of two suffixes of ``window`` words."""
    if a == b:
        return window
    n = 0
    for x, y in zip(a.split(b" "), b.split(b" "), strict=False):
        if x != y:
            break
        n += 1
    return n


def deep_nodes(suffixes: list[bytes], window: int) -> np.ndarray:
    """The deep internal node (or single leaf) of each suffix, as a number."""
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    node, out = 0, np.zeros(len(suffixes), np.int64)
    for last, this in zip(order, order[1:], strict=False):
        node += suffixes[last] != suffixes[this] and _common_words(suffixes[last], suffixes[this], window) < window
        out[this] = node
    return out


def _suffix_hashes(suffixes: list[bytes], window: int) -> np.ndarray:
    out = [np.empty(0, np.uint64)]
    for k in range(0, len(suffixes), _SLICE):
        data, offsets = tk.utf8(pa.array(suffixes[k : k + _SLICE], pa.large_binary()))
        starts, ends, first = tk.word_spans(data, offsets)
        out.append(tk.window_hashes(tk.word_hashes(data, starts, ends), first, window)[0])
    return np.concatenate(out)


def _grow(window: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """A group's subtree: the first document of each deep node, for all that asked."""
        lists = [[s for s in zstandard.ZstdDecompressor().decompress(b).split(b"\n") if s] for b in table.column("suffixes").to_pylist()]
        docs = np.concatenate([unpack(b, "<i8") for b in table.column("docs").to_pylist()])
        suffixes = [s for one in lists for s in one]
        node = deep_nodes(suffixes, window)
        least = np.full(len(suffixes), np.iinfo(np.int64).max)
        np.minimum.at(least, node, docs)
        h = _suffix_hashes(suffixes, window)
        hashes, found = [], []
        cut = np.cumsum([0, *map(len, lists)])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            first = least[node[a:b]]
            news = np.flatnonzero(first < docs[a:b])  # a bucket knows its own first document
            order = news[np.argsort(h[a:b][news])]
            hashes.append(pack_sorted(h[a:b][order]))
            found.append(pack(first[order].astype("<i8")))
        return pa.table({"bucket": table.column("bucket"), "part": table.column("part"), "hashes": pa.array(hashes, pa.binary()), "docs": pa.array(found, pa.binary()), "copies": table.column("copies")})

    return run


def _drop(window: int):
    def run(key: tuple, docs: pa.Table, nodes: pa.Table) -> pa.Table:
        bucket = Windows(docs, window)
        gone = np.zeros(len(bucket.starts) + 1, np.int64)
        if len(bucket.hash):
            # the first document of each window: here, or where the trees know an earlier one
            values, place = np.unique(bucket.hash, return_inverse=True)
            least = np.full(len(values), np.iinfo(np.int64).max)
            np.minimum.at(least, place, bucket.doc_ids[bucket.owner])
            for blob, docs_blob in zip(nodes.column("hashes").to_pylist(), nodes.column("docs").to_pylist(), strict=True):
                known = unpack_sorted(blob)
                least[np.searchsorted(values, known)] = unpack(docs_blob, "<i8")
            earlier = bucket.at[least[place] < bucket.doc_ids[bucket.owner]]
            np.add.at(gone, earlier, 1)
            np.add.at(gone, earlier + window, -1)
        for blob in filter(None, nodes.column("copies").to_pylist()):
            copy = unpack(blob, "<i4")
            np.add.at(gone, bucket.first[copy], 1)
            np.add.at(gone, bucket.first[copy + 1], -1)
        gone = np.cumsum(gone)[:-1] > 0
        text, start, end = bucket.joined()
        text = text.tobytes()
        removed = np.concatenate([[0], np.cumsum(gone)])
        kept, spans = [], []
        for a, b in zip(bucket.first[:-1].tolist(), bucket.first[1:].tolist(), strict=True):
            if removed[b] == removed[a]:
                kept.append(text[start[a] : end[b - 1]].decode() if b > a else "")
                spans.append([])
                continue
            flip = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)))
            spans.append([{"start": int(s), "end": int(e)} for s, e in flip.reshape(-1, 2)])
            edges = [0, *flip.tolist(), b - a]
            kept.append(b" ".join(text[start[a + s] : end[a + e - 1]] for s, e in zip(edges[::2], edges[1::2], strict=True) if e > s).decode())
        n = np.diff(bucket.first)
        return pa.table({"doc_id": bucket.ids, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed[bucket.first[1:]] - removed[bucket.first[:-1]], pa.int64()), "kept_text": pa.array(kept, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})

    return run


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row for each row: ``doc_id, n_words, n_removed,
    kept_text`` (the words left, joined by single spaces) and ``spans`` of removed words."""
    n = count_buckets(docs, BUCKET_BYTES)
    groups = -(-n // BUCKETS_A_GROUP)
    dealt = deal(docs, n)
    marks = dealt.groupBy("bucket").applyInArrow(_ask(n, window), MARKS).groupBy("part").applyInArrow(_mark, MARKS)
    suffixes = dealt.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(_send(n, groups, window), SUFFIXES)
    nodes = suffixes.groupBy("part").applyInArrow(_grow(window), NODES)
    return dealt.groupBy("bucket").cogroup(nodes.groupBy("bucket")).applyInArrow(_drop(window), RESULT)
