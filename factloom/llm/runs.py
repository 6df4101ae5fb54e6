"""Periodic runs of words, found in a grammar of each text.

A run is a stretch of words with smallest period q, at least ``MIN_LENGTH`` words and
``MIN_REPEATS`` periods long, that no neighbouring word extends. Word ids of each text are
compressed by Re-Pair: pairs of neighbouring symbols that come twice or more become rules, the
most frequent of overlapping pairs first. All pairs that no overlapping pair outranks are
replaced in one round (equal counts are ranked by a hash), so that a batch of texts takes a few
dozen rounds over arrays. What a run is made of crosses the boundary between the two halves of
the smallest rule that holds it all, or a boundary between symbols that no rule joins; so each
rule is searched once, at its first occurrence, for runs over its boundary, and what is found is
moved to every place of the derivation where the rule stands. Where a rule's end cuts a run
short, a rule above it holds the whole; so of intervals with one period the maximal stay.

Runs over a boundary come from equal windows: the longer side of the boundary holds one and a
half periods, so a window of half the period (its power of two) beside the boundary comes again
one period away. Windows are told apart by exact ids (pairs of ids of half the length), which
also answer how far two places agree. Two facts, both lossless, leave plain prose out early: a
word pair that comes once in its text is in no run, and neither is an 8-word window that does.

Defined results: a null or blank text has no words, no runs, and an empty collapsed text; each
row is searched by itself, so repeated rows get equal results; a null doc_id stays null; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkernels as tk

MIN_LENGTH, MIN_REPEATS = 24, 3
#: Bytes of text that are compressed together; a longer text is by itself.
BATCH_BYTES = 4 << 20
_SEED = 8  # words of a window that comes again inside every run: MIN_LENGTH - 2 * 8
_NEAR = 16  # periods below are tried one by one


def _ids(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].reshape(-1)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair of numbers below 2 ** 31."""
    return (a.astype(np.int64) << 32) | b


def stretches(good: np.ndarray, group: np.ndarray, extra: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal stretches where ``good`` holds within one group, each ``extra``
    longer than the places that hold, if they are ``least`` long then."""
    if not len(good):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, last = good.copy(), good.copy()
    same = group[1:] == group[:-1]
    first[1:] &= ~(good[:-1] & same)
    last[:-1] &= ~(good[1:] & same)
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1 + extra
    long = b - a >= least
    return a[long], b[long]


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    size = ends - starts
    before = np.cumsum(size) - size
    return np.repeat(starts - before, size) + np.arange(size.sum())


class Grammar:
    """Rules of a batch of texts and where they stand.

    ``boundary``, ``low`` and ``high``: a place between two words to be searched, and the extent
    that the search may look at; ``rule`` is -1 for a boundary that no rule joins, else a number.
    Occurrence k of the derivation is of rule ``occurs[k]`` and starts at ``place[k]``.
    """

    def __init__(self, words: np.ndarray, stretch: np.ndarray, low: np.ndarray, high: np.ndarray, text: np.ndarray):
        symbol, start, end = words.astype(np.int64), np.arange(len(words)), np.arange(1, len(words) + 1)
        linked = np.zeros(len(words), bool)  # to the next symbol, by a pair that may come again
        linked[:-1] = stretch[1:] == stretch[:-1]
        fresh = int(symbol.max(initial=0)) + 1
        tops: list[np.ndarray] = []
        nodes: list[tuple[np.ndarray, ...]] = []
        placed: list[tuple[np.ndarray, np.ndarray]] = []
        n_rules = 0
        while True:
            at = np.flatnonzero(linked)
            if not len(at):
                break
            kind = _ids(_pairs(_ids(_pairs(text[start[at]], symbol[at])), symbol[at + 1]))
            count = np.bincount(kind)[kind]
            once = at[count < 2]
            tops.append(start[once + 1])
            linked[once] = False
            at, kind, count = at[count >= 2], kind[count >= 2], count[count >= 2]
            if not len(at):
                break
            rank = np.zeros(len(symbol) + 1, np.uint64)
            salt = tk.mix(kind.astype(np.uint64) + np.uint64(1)) >> np.uint64(32)
            rank[at] = (count.astype(np.uint64) << np.uint64(32)) | salt | np.uint64(1)
            of = np.full(len(symbol) + 1, -1, np.int64)
            of[at] = kind
            before, after = np.concatenate([rank[:1] * np.uint64(0), rank[:-1]])[at], rank[at + 1]
            same_before = np.concatenate([[-1], of[:-1]])[at] == kind
            top = (same_before | (rank[at] > before)) & ((of[at + 1] == kind) | (rank[at] > after))
            # in a row of equal symbols every second pair, counted from the first
            chain = np.flatnonzero(~(same_before & np.concatenate([[False], top[:-1]])))
            offset = np.arange(len(at)) - np.repeat(chain, np.diff(np.concatenate([chain, [len(at)]])))
            chosen = top & (offset % 2 == 0)
            # two ranks may be equal, or a chain may end beside a higher pair: never overlap
            take = at[chosen]
            clash = np.flatnonzero(np.diff(take) == 1) + 1
            if len(clash):
                chosen[np.flatnonzero(chosen)[clash]] = False
                take = at[chosen]
            if not len(take):  # equal ranks of different pairs all around: take the first
                chosen = np.arange(len(at)) == 0
                take = at[:1]
            rule, first = np.unique(kind[chosen], return_index=True)
            number = np.searchsorted(rule, kind[chosen])
            long = (end[take + 1] - start[take])[first] >= MIN_LENGTH
            nodes.append((start[take + 1][first][long], start[take][first][long], end[take + 1][first][long], n_rules + np.flatnonzero(long)))
            mine = long[number]
            placed.append((n_rules + number[mine], start[take][mine]))
            n_rules += len(rule)
            symbol[take] = fresh + number
            end[take] = end[take + 1]
            linked[take] = linked[take + 1]
            fresh += len(rule)
            stay = np.ones(len(symbol), bool)
            stay[take + 1] = False
            alone = ~linked
            alone[1:] &= ~linked[:-1]
            stay &= ~alone  # no pair of it can become a rule
            symbol, start, end, linked = symbol[stay], start[stay], end[stay], linked[stay]
        top = np.concatenate([*tops, np.empty(0, np.int64)])
        self.boundary = np.concatenate([top, *(n[0] for n in nodes)]).astype(np.int64)
        self.low = np.concatenate([low[top], *(n[1] for n in nodes)]).astype(np.int64)
        self.high = np.concatenate([high[top], *(n[2] for n in nodes)]).astype(np.int64)
        self.rule = np.concatenate([np.full(len(top), -1), *(n[3] for n in nodes)]).astype(np.int64)
        self.occurs = np.concatenate([np.empty(0, np.int64), *(p[0] for p in placed)])
        self.place = np.concatenate([np.empty(0, np.int64), *(p[1] for p in placed)])


class Windows:
    """Exact ids of all windows of 1, 2, 4, ... words of an array."""

    def __init__(self, words: np.ndarray):
        self.ids = [words.astype(np.int64)]

    def of(self, power: int) -> np.ndarray:
        while len(self.ids) <= power:
            half, last = 1 << (len(self.ids) - 1), self.ids[-1]
            m = max(len(last) - half, 0)
            self.ids.append(_ids(_pairs(last[:m], last[half:])) if m else np.empty(0, np.int64))
        return self.ids[power]

    def agree(self, a: np.ndarray, b: np.ndarray, bound: np.ndarray, forward: bool) -> np.ndarray:
        """How many words agree from places a and b (a < b) on, up to ``bound`` for b; backward:
        before them, down to ``bound`` for a."""
        a, b = a.copy(), b.copy()
        room = int((bound - b if forward else a - bound).max(initial=0))
        done = np.zeros(len(a), np.int64)
        for power in range(max(room, 1).bit_length() - 1, -1, -1):
            size, ids = 1 << power, self.of(power)
            i = np.flatnonzero(b + size <= bound if forward else a - size >= bound)
            x, y = (a[i], b[i]) if forward else (a[i] - size, b[i] - size)
            i = i[ids[x] == ids[y]] if len(i) else i
            step = size if forward else -size
            a[i] += step
            b[i] += step
            done[i] += size
        return done


def crossing(words: np.ndarray, boundary: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of runs that hold the words on both sides of a boundary, within its extent:
    ``(which boundary, start, end, period)``; a period may be a multiple of the smallest."""
    windows = Windows(words)
    which, period = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def keep(i: np.ndarray, q: np.ndarray, forward: bool) -> None:
        which.append(2 * i + forward)
        period.append(q)

    four = windows.of(2)
    for q in range(1, _NEAR):
        room = np.flatnonzero(high - low >= max(MIN_LENGTH, MIN_REPEATS * q))
        c = boundary[room]
        right, left = c + q + 4 <= high[room], c - 4 - q >= low[room]
        right[right] = four[c[right]] == four[c[right] + q]
        left[left] = four[c[left] - 4] == four[c[left] - 4 - q]
        keep(room[right], np.full(right.sum(), q), True)
        keep(room[left], np.full(left.sum(), q), False)
    power = 3
    while len(room := np.flatnonzero(high - low >= MIN_REPEATS * 2 << power)):
        size, ids = 1 << power, windows.of(power)
        # places of each id in order, as numbers id * n + place
        n = len(words) + 1
        order = np.sort(ids * n + np.arange(len(ids)))
        for forward in (True, False):
            x = boundary[room] if forward else boundary[room] - size
            first, last = (x + 2 * size, np.minimum(x + 4 * size - 1, high[room] - size)) if forward else (np.maximum(x - 4 * size + 1, low[room]), x - 2 * size)
            ok = np.flatnonzero((first <= last) & (x >= low[room]) & (x + size <= high[room]))
            base = ids[x[ok]] * n
            a, b = np.searchsorted(order, base + first[ok]), np.searchsorted(order, base + last[ok], side="right")
            some = b > a
            a, b, at = a[some], b[some], ok[some]
            found = order[spread(a, b)] % n
            i = np.repeat(at, b - a)
            keep(room[i], np.abs(found - x[i]), forward)
        power += 1
    i, q = np.concatenate(which), np.concatenate(period)
    both = np.unique(_pairs(i, q))
    i, forward, q = both >> 33, (both >> 32) & 1, both & 0xFFFFFFFF
    a = boundary[i] - np.where(forward, 0, q)  # agrees with the place one period later
    end = a + q + windows.agree(a, a + q, high[i], True)
    start = a - windows.agree(a, a + q, low[i], False)
    fits = end - start >= np.maximum(MIN_LENGTH, MIN_REPEATS * q)
    return i[fits], start[fits], end[fits], q[fits]


def find(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a batch: word ids and each word's text -> starts, ends and periods, in order."""
    none = (np.empty(0, np.int64),) * 3
    if len(words) < MIN_LENGTH:
        return none
    kind = _ids(_pairs(_ids(_pairs(text[:-1], words[:-1])), words[1:]))
    twice = (np.bincount(kind)[kind] > 1) & (text[1:] == text[:-1])
    a, b = stretches(twice, text[:-1], 1, MIN_LENGTH)
    if not len(a):
        return none
    kept, size = spread(a, b), b - a
    words, text = words[kept], text[kept]
    edge = np.cumsum(size)
    low, high = np.repeat(edge - size, size), np.repeat(edge, size)
    grammar = Grammar(words, low, low, high, text)
    # an 8-word window that comes once in its text is in no run
    eight = Windows(words).of(3)
    if not len(eight):
        return none
    kind = _ids(_pairs(text[: len(eight)], eight))
    again = (np.bincount(kind)[kind] > 1) & (low[: len(eight)] == low[_SEED - 1 :])
    c, d = stretches(again, low[: len(eight)], _SEED - 1, MIN_LENGTH)
    if not len(c):
        return none
    i = np.searchsorted(c, grammar.boundary, side="right") - 1
    inside = (i >= 0) & (grammar.boundary < d[i]) & (grammar.boundary > c[i])
    lowest, highest = np.maximum(grammar.low, c[i]), np.minimum(grammar.high, d[i])
    inside &= highest - lowest >= MIN_LENGTH
    # only what is left of the texts is given ids of long windows
    left, shift = spread(c, d), np.cumsum(d - c) - (d - c) - c
    move = shift[i[inside]]
    where, start, end, period = crossing(words[left], grammar.boundary[inside] + move, lowest[inside] + move, highest[inside] + move)
    start, end, node = start - move[where], end - move[where], np.flatnonzero(inside)[where]
    # to all places of the derivation
    rule = grammar.rule[node]
    ruled = rule >= 0
    order = np.argsort(grammar.occurs, kind="stable")
    of, place = grammar.occurs[order], grammar.place[order]
    x, y = np.searchsorted(of, rule[ruled]), np.searchsorted(of, rule[ruled], side="right")
    k = np.repeat(np.flatnonzero(ruled), y - x)
    to = place[spread(x, y)] - grammar.low[node[k]]
    start, end, period = (np.concatenate([v[~ruled], w]) for v, w in ((start, start[k] + to), (end, end[k] + to), (period, period[k])))
    # of one period the maximal; of one interval the smallest period
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    if not len(start):
        return none
    tall = period * (len(words) + 1) + end  # grows from period to period
    maximal = np.ones(len(start), bool)
    maximal[1:] = tall[1:] > np.maximum.accumulate(tall)[:-1]
    start, end, period = start[maximal], end[maximal], period[maximal]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least = np.ones(len(start), bool)
    least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[least], end[least], period[least]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    first = kept[start]
    return first, first + (end - start), period


def _search(texts: pa.Array, ids: list, tail: Callable[[int, int], tuple[int, int] | None] | None) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of each text of a batch."""
    data, offsets = tk.utf8(texts)
    starts, ends, first = tk.word_spans(data, offsets)
    size = ends - starts
    edges = np.concatenate([[0], np.cumsum(size)])
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data[spread(starts, ends)])])
    words = spelled.dictionary_encode().indices.to_numpy().astype(np.int64)
    source = np.arange(len(words))
    if tail is not None:
        for k, doc_id in enumerate(ids):
            n = int(first[k + 1] - first[k])
            cut = tail(doc_id, n) if n and doc_id is not None else None
            if cut is not None:
                a, p = cut
                source[first[k] + a : first[k + 1]] = first[k] + a + np.arange(n - a) % p
        words = words[source]
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    start, end, period = find(words, text)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    kept = np.cumsum(gone[:-1]) == 0
    taken, owner = source[kept], text[kept]
    # every kept word with a space before it, but for the first of a text
    lead = np.ones(len(taken), np.int64)
    lead[:1] = 0
    lead[1:] = owner[1:] == owner[:-1]
    edge = np.concatenate([[0], np.cumsum(size[taken] + lead)])
    out = np.full(int(edge[-1]), 32, np.uint8)
    out[spread(edge[:-1] + lead, edge[1:])] = data[spread(starts[taken], ends[taken])]
    count = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
    collapsed = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(edge[count].astype(np.int64)), pa.py_buffer(out))
    of = text[start] if len(start) else np.empty(0, np.int64)
    lists = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])
    rows = pa.StructArray.from_arrays([pa.array(start - first[of]), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), rows), collapsed


def find_runs(docs: DataFrame, tail: Callable[[int, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row for each row: ``doc_id``, ``n_words``, ``runs`` (an array
    of ``start, length, period`` in words, by start, then period) and ``collapsed``: the words
    joined by one space, without those that a run holds after its first period.

    ``tail(doc_id, words)`` may give ``(start, period)``: the words from ``start`` on then repeat
    the first ``period`` of them, so that there is something to find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                held = sizes[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(sizes, held + BATCH_BYTES, side="right")))
                some, ids = texts.slice(at, stop - at), batch.column(0).slice(at, stop - at)
                runs, collapsed = _search(some, ids.to_pylist(), tail)
                yield pa.record_batch([ids, runs, collapsed.cast(pa.string())], ["doc_id", "runs", "collapsed"])
                at = stop

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Of ``find_runs``: how many runs, the one with the greatest length for its period (the first
    of equals), and hashes of all runs and of the collapsed text."""
    better = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    spelled = F.transform("runs", lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n")))
    return found.withColumn("best", F.aggregate("runs", none, better)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(spelled, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
