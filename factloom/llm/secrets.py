"""Secret scanning: fixed patterns, and a linear-chain conditional random field beside them.

The patterns find assignments, access keys and hex strings. The field tags the tokens of every
line, one chain a line, as begin, inside or outside of a secret, and is decoded by Viterbi; what
it finds beyond the patterns is added as spans of kind ``crf``. Its features are the token's
shape, how much its letters follow each other as in words, the words before and behind it and
what stands between, and how much the whole text looks like a settings or source file.

It is trained here on a bounded sample: ``SAMPLE_DOCS`` texts with a pattern's span and as many
without, lowest hash of doc_id first, of each ``SAMPLE_LINES`` lines at most. The patterns' own
spans are the labels. So that the field does not learn the patterns again, each labelled line is
varied ``VARIANTS`` times or more: another name or none stands before the value, another separator, and
a value of another make (``values``); the shape and the neighbours carry the tag, not the name.
Names before words that are no secrets are shown as well. Lines without a label may hold
secrets that no pattern finds: those in which a first fit sees one are left out of the second.

A token is a run of letters, digits, ``+ / _ . -`` and characters beyond ASCII. No token is
ruled out beforehand: the scores of all are computed, column-wise, and Viterbi is run on each
line where some token's score could outweigh the moves between tags; in the others the best
path is outside throughout.

Defined results: a null text counts as empty; spans are code points, end exclusive; repeated
rows get equal results, also those with a null doc_id, which are left out of the sample;
without labelled rows the field adds nothing; an empty table gives no rows. Of equally good
tags the first of outside, begin, inside is taken.
"""

from __future__ import annotations

import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkernels as tk

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_BYTES = re.compile(rb"[0-9a-f]{24}")
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "crf")

SAMPLE_DOCS = 512
SAMPLE_LINES = 4
VARIANTS = 2
#: Variants in all: few labelled lines are varied more often, many less. As many lines without a
#: label are looked at, and of every line ``SAMPLE_CHARS`` characters, about the secret.
VARIED = 2048
SAMPLE_CHARS = 160
EPOCHS = 36
_TRAINED = 64
OUT, BEGIN, INSIDE = 0, 1, 2
TAGS = (OUT, BEGIN, INSIDE)
#: Names that a value may be given, and words that join the two.
NAMES = ("pwd", "pass", "passphrase", "credential", "credentials", "auth", "bearer", "authorization", "key", "private_key", "signing_key", "access_key", "client_key", "login", "session", "cookie", "pin", "webhook", "license_key")
JOINTS = (" = ", "=", ": ", ":", " := ", " is ", " ", ' = "', '="', ": '", " -> ")

Span = tuple[str, int, int]


def base_spans(text: str, raw: bytes | None = None) -> list[Span]:
    """The patterns' spans by start, then kind."""
    raw = text.encode() if raw is None else raw
    low, out = raw.lower(), []
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEX_BYTES.search(raw):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- features -------------------------------------------------------------------------------

_INNER = np.array([chr(b).isalnum() and b < 128 or b in b"+/_.-" or b >= 128 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_HEXES = _DIGIT | np.array([97 <= b <= 102 for b in range(256)])
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_WORDS = 1 << 15
#: Of the features below, the words before, behind and second before a token.
_NEIGHBOURS = np.array([10, 11, 12])
#: Sizes of the features' value sets, in order.
_WIDTHS = (16 * 2, 6 * 5, 2 * 16, 8, 6, 8 * 8, 8 * 2, 6, 6, 3 * 2, _WORDS, _WORDS, _WORDS, 1)
_BASES = np.concatenate([[0], np.cumsum(_WIDTHS)])


class Tokens:
    """Tokens of the lines of texts: their places, chains and features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, likely: np.ndarray):
        """``likely``: log-odds of each pair of bytes in words; 0 where none is known."""
        self.data = data
        self.starts, self.ends, self.first = tk.word_spans(data, offsets, ~_INNER)
        n = len(self.starts)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        size = self.ends - self.starts
        within = lambda table: self._count(table[data])
        digits, upper, lower, hexes = within(_DIGIT), within(_UPPER), within(_LOWER), within(_HEXES)
        beyond = within(np.arange(256) >= 128)
        kind = _DIGIT[data].astype(np.int8)
        turns = self._count(np.concatenate([[False], kind[1:] != kind[:-1]]) if n else kind, 1)
        marks = size - digits - upper - lower - beyond
        pair = np.zeros(len(data), np.float32)
        if n:
            pair[1:] = likely[_FOLD[data[:-1]], _FOLD[data[1:]]]
        wordly = self._count(pair, 1, np.float64) / np.maximum(size - 1, 1)
        # what stands before a token and behind it: new line, sign, quote, other, space, nothing
        feed, sign, quote = (self._sum(np.isin(data, list(c))) for c in (b"\n", b"=:", b"\"'`"))
        blank = self._sum(np.isin(data, list(b" \t\r")))
        lo = np.concatenate([[0], self.ends[:-1]]) if n else self.starts
        hi = np.concatenate([self.starts[1:], [len(data)]]) if n else self.ends
        fresh, over = np.zeros(n, bool), np.zeros(n, bool)
        has = self.first[:-1][np.diff(self.first) > 0]
        fresh[has] = True
        over[self.first[1:][np.diff(self.first) > 0] - 1] = True
        lo[fresh], hi[over] = offsets[self.doc[fresh]], offsets[self.doc[over] + 1]
        gap = lambda a, b: [x[b] - x[a] > 0 for x in (feed, sign, quote)]
        feed_a, sign_a, quote_a = gap(lo, self.starts)
        feed_b, sign_b, quote_b = gap(self.ends, hi)
        self.line = np.cumsum(fresh | feed_a)  # chains
        other_a = self.starts - lo - (blank[self.starts] - blank[lo]) > 0
        other_b = hi - self.ends - (blank[hi] - blank[self.ends]) > 0
        before = np.select([feed_a | fresh, sign_a & quote_a, sign_a, quote_a, other_a, self.starts > lo], [0, 1, 2, 3, 4, 5], 6)
        behind = np.select([feed_b | over, sign_b & quote_b, sign_b, quote_b, other_b, hi > self.ends], [0, 1, 2, 3, 4, 5], 6)
        case = np.select([(upper == 0) & (lower == 0), upper == 0, lower == 0, (upper == 1) & _UPPER[data[self.starts]]], [0, 1, 2, 3], 4) if n else size
        words = (tk.word_hashes(data, self.starts, self.ends, _FOLD) % np.uint64(_WORDS - 1)).astype(np.int64) + 1 if n else size
        shift = lambda x, k, stop: np.where(stop, 0, np.roll(x, k))
        opens = fresh | feed_a
        closes = over | feed_b
        prev = shift(words, 1, opens)
        second = shift(prev, 1, opens)
        length = np.minimum(size // 3, 15)
        code = self._share(np.isin(data, list(b"=;{}")), offsets)
        short = self._share(data == 10, offsets)
        self.features = np.stack(
            [
                length * 2 + (digits > 0),
                np.minimum(5 * digits // np.maximum(size, 1), 5) * 5 + case,
                (hexes == size) * 16 + length,
                np.minimum(8 * turns // np.maximum(size, 1), 7),
                np.minimum(marks, 5),
                before * 8 + behind,
                np.clip((wordly + 4).astype(np.int64), 0, 7) * 2 + (size >= 6),
                np.where(beyond > 0, 5, np.minimum(size // 2, 4)),
                np.minimum(upper, 5),
                np.minimum((code * 50).astype(np.int64), 2)[self.doc] * 2 + (short * 60 > 1)[self.doc],
                prev,
                shift(words, -1, closes),
                second,
                np.zeros(n, np.int64),
            ],
            axis=1,
        ) + _BASES[:-1] if n else np.empty((0, len(_WIDTHS)), np.int64)

    def _sum(self, flags: np.ndarray, dtype: type = np.int64) -> np.ndarray:
        return np.concatenate([np.zeros(1, dtype), np.cumsum(flags, dtype=dtype)])

    def _count(self, flags: np.ndarray, skip: int = 0, dtype: type = np.int64) -> np.ndarray:
        """Sum over each token, but for its first ``skip`` bytes."""
        total = self._sum(flags, dtype)
        return total[self.ends] - total[np.minimum(self.starts + skip, self.ends)]

    def _share(self, flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = self._sum(flags)
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def word_pairs(data: np.ndarray, secret: np.ndarray) -> np.ndarray:
    """Log-odds of pairs of bytes in the sample's ordinary tokens against any pair."""
    count = np.full((256, 256), 0.5)
    if len(data) > 1:
        inside = _INNER[data[:-1]] & _INNER[data[1:]] & ~secret[1:]
        np.add.at(count, (_FOLD[data[:-1]][inside], _FOLD[data[1:]][inside]), 1)
    letters = np.flatnonzero(_INNER & ~_UPPER)
    odds = np.log(count / count.sum()) + np.log(len(letters) ** 2)
    return np.clip(odds, -4, 4).astype(np.float32)


# ---- the field ------------------------------------------------------------------------------


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Linear-chain conditional random field over the three tags; chains start and end outside."""

    def __init__(self, likely: np.ndarray | None = None):
        self.likely = np.zeros((256, 256), np.float32) if likely is None else likely
        self.weights = np.zeros((int(_BASES[-1]), 3), np.float32)
        self.moves = np.zeros((3, 3), np.float32)
        self.moves[OUT, INSIDE] = -1e9

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Score of each tag of each token."""
        out = np.zeros((len(features), 3), np.float32)
        for k in range(features.shape[1]):
            out += self.weights[features[:, k]]
        return out

    def decode(self, scores: np.ndarray) -> list[int]:
        """Best tags of one chain, by Viterbi."""
        moves = self.moves.tolist()
        best, back = [0.0, -1e18, -1e18], []
        for s in scores.tolist():
            step = [max((best[a] + moves[a][t], -a) for a in TAGS) for t in TAGS]
            back.append([-a for _, a in step])
            best = [step[t][0] + s[t] for t in TAGS]
        tag = max(TAGS, key=lambda t: (best[t] + moves[t][OUT], -t))
        tags = []
        for b in reversed(back):
            tags.append(tag)
            tag = b[tag]
        return tags[::-1]

    def may_begin(self, scores: np.ndarray) -> np.ndarray:
        """Tokens whose score, with the best moves, is no worse than outside. In a chain without
        one no path is better than outside throughout: a run of other tags gains no more than
        the sum of its tokens' scores over outside and of its moves over staying outside."""
        m = self.moves - self.moves[OUT, OUT]
        leave = max(m[BEGIN, OUT], m[INSIDE, OUT], 0)
        begin = scores[:, BEGIN] + max(m[OUT, BEGIN], m[BEGIN, BEGIN], m[INSIDE, BEGIN]) + leave
        inside = scores[:, INSIDE] + max(m[BEGIN, INSIDE], m[INSIDE, INSIDE]) + leave
        return np.maximum(begin, inside) >= scores[:, OUT]

    def slope(self, features: np.ndarray, chain: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the log-likelihood by weights and moves: forward and backward sums, all
        chains in step."""
        _, at, size = np.unique(chain, return_index=True, return_counts=True)
        order = np.argsort(-size, kind="stable")
        at, size = at[order], size[order]
        live = [int(np.searchsorted(-size, -t, "left")) for t in range(size[0] + 1)]  # chains longer than t
        s, m = self.scores(features).astype(np.float64), self.moves.astype(np.float64)
        ahead, behind, whole = np.zeros_like(s), np.zeros_like(s), np.zeros(len(s))
        last = np.repeat(np.array([[0.0, -1e18, -1e18]]), len(at), axis=0)
        for t in range(size[0]):
            k = live[t]
            last = _logsum(last[:k, :, None] + m, 1) + s[at[:k] + t]
            ahead[at[:k] + t] = last
        after = np.zeros((len(at), 3))
        for t in range(size[0] - 1, -1, -1):
            k, more = live[t], live[t + 1] if t + 1 < size[0] else 0
            here = np.repeat(m[None, :, OUT], k, axis=0)
            here[:more] = _logsum(m[None] + after[:more, None, :], 2)
            behind[at[:k] + t] = here
            after[:k] = here + s[at[:k] + t]
        total = _logsum(ahead[at] + behind[at], 1)
        for t in range(size[0]):
            whole[at[: live[t]] + t] = total[: live[t]]
        share = np.exp(ahead + behind - whole[:, None])
        gold = np.eye(3)[tags]
        inner = np.flatnonzero(chain[1:] == chain[:-1])
        pairs = np.exp(ahead[inner][:, :, None] + m + (s + behind)[inner + 1][:, None, :] - whole[inner][:, None, None]).sum(axis=0)
        moves = gold[inner].T @ gold[inner + 1] - pairs
        moves[OUT] += (gold - share)[at].sum(axis=0)
        moves[:, OUT] += (gold - share)[at + size - 1].sum(axis=0)
        moves[OUT, INSIDE] = 0
        off = gold - share
        weights = np.stack([sum(np.bincount(features[:, k], off[:, t], len(self.weights)) for k in range(features.shape[1])) for t in TAGS], axis=1)
        return weights, moves

    def fit(self, features: np.ndarray, chain: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, decay: float = 0.05) -> None:
        """Ascent of the log-likelihood less a square penalty, with steps scaled by running
        means of the slope and its square."""
        mean = [np.zeros_like(self.weights), np.zeros_like(self.moves)]
        square = [np.zeros_like(self.weights), np.zeros_like(self.moves)]
        for epoch in range(1, epochs + 1):
            slopes = self.slope(features, chain, tags)
            for k, (x, slope) in enumerate(zip((self.weights, self.moves), slopes, strict=True)):
                slope = (slope - decay * np.where(x < -1e6, 0, x)).astype(np.float32)
                mean[k] = 0.8 * mean[k] + 0.2 * slope
                square[k] = 0.95 * square[k] + 0.05 * slope**2
                x += 0.15 * (mean[k] / (1 - 0.8**epoch)) / (np.sqrt(square[k] / (1 - 0.95**epoch)) + 1e-3)


# ---- training -------------------------------------------------------------------------------


def values(rng: random.Random) -> str:
    """A made-up secret: hex, base 64, letters and digits, letters alone, with a prefix, or grouped."""
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    make = rng.randrange(8)
    if make == 0:
        return draw(dig + "abcdef", rng.choice((8, 12, 16, 20, 22)))
    if make == 1:
        return draw(low + up + dig + "+/", rng.randrange(16, 60))
    if make == 2:
        return draw(low + up + dig, rng.randrange(8, 40))
    if make == 3:
        return draw(low + up, rng.randrange(10, 32))
    if make == 4:
        return draw(low + dig, rng.randrange(6, 20))
    if make == 5:
        return draw(low, 2) + "_" + rng.choice(("live", "test", "prod")) + "_" + draw(low + up + dig, rng.randrange(12, 36))
    if make == 6:
        return draw(up + dig, rng.randrange(10, 30))
    return "-".join(draw(dig + "abcdef", n) for n in (8, 4, 4, 4, 6))


def labelled(text: str) -> list[tuple[int, int]]:
    """The patterns' secrets: of an assignment, its value."""
    found = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return found + [(s, e) for k, s, e in base_spans(text) if k != "assign"]


def vary(line: str, span: tuple[int, int], rng: random.Random, words: list[str], times: int = VARIANTS) -> list[tuple[str, list[tuple[int, int]]]]:
    """Other lines like one that holds a secret, with their secrets' places."""
    head = re.sub(r"""(?ai)[A-Za-z_]*["']?\x20*[:=]?\x20*["']?$""", "", line[: span[0]])
    head, tail = head[-SAMPLE_CHARS // 2 :], line[span[1] :].lstrip("\"'=")[: SAMPLE_CHARS // 2]
    out = []
    for _ in range(times):
        name, joint, value = rng.choice(NAMES), rng.choice(JOINTS), values(rng)
        if rng.random() < 0.25:
            name = rng.choice(words) + rng.choice(("_key", "_secret", "Token", "_pwd", ""))
        close = '"' if joint.endswith('"') else "'" if joint.endswith("'") else ""
        lead = f"{head}{name}{joint}"
        out.append((f"{lead}{value}{close}{tail}", [(len(lead), len(lead) + len(value))]))
    for _ in range(max(1, times // 6)):  # the same names before ordinary words, and numbers that are no secrets
        word = rng.choice(words) if rng.random() < 0.6 else str(rng.randrange(10 ** rng.randrange(1, 17)))
        out.append((f"{head}{rng.choice(NAMES)}{rng.choice(JOINTS)}{word}{tail}", []))
    return out


def _about(line: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The line from a little ahead of its first secret on to a little behind it."""
    if not spans:
        return line[: 2 * SAMPLE_CHARS], []
    lo, hi = max(0, spans[0][0] - SAMPLE_CHARS // 2), spans[0][1] + SAMPLE_CHARS // 2
    return line[lo:hi], [(max(a, lo) - lo, min(b, hi) - lo) for a, b in spans if a < hi and b > lo]


def _arrow(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return tk.utf8(pa.array([t.encode() for t in texts], pa.large_binary()))


def train(texts: list[str]) -> Field | None:
    """A field from texts in their given order; None where no token is a secret."""
    rng = random.Random(20240607)
    rows: list[tuple[str, list[tuple[int, int]]]] = []
    plain: list[tuple[str, list[tuple[int, int]]]] = []
    for text in texts:
        lines = text.split("\n")
        some = [(x, labelled(x)) for x in lines]
        with_, without = [x for x in some if x[1]], [x for x in some if not x[1] and x[0].strip()]
        rows += with_[:SAMPLE_LINES]
        plain += rng.sample(without, min(SAMPLE_LINES, len(without)))
    if not rows:
        return None
    plain = [(line[:SAMPLE_CHARS], []) for line, _ in rng.sample(plain, min(VARIED, len(plain)))]
    words = [w for line, _ in plain for w in re.findall(r"[A-Za-z]{3,}", line)][: 1 << 16] or ["word"]
    times = max(VARIANTS, VARIED // len(rows))
    rows += [v for line, spans in rows for v in vary(line, spans[0], rng, words, times)]
    rows = [_about(line, spans) for line, spans in rows]
    known = len(rows)
    rows += plain
    data, offsets = _arrow([line for line, _ in rows])
    secret = np.zeros(len(data), bool)
    for k, (line, spans) in enumerate(rows):
        for a, b in spans:
            start = offsets[k] + len(line[:a].encode())
            secret[start : start + len(line[a:b].encode())] = True
    field = Field(word_pairs(data, secret))
    tokens = Tokens(data, offsets, field.likely)
    if not len(tokens.starts):
        return None
    total = np.concatenate([[0], np.cumsum(secret)])
    hit = total[tokens.ends] > total[tokens.starts]
    follows = np.zeros(len(hit), bool)  # no byte outside of the secret between a token and the last
    follows[1:] = hit[1:] & hit[:-1] & (total[tokens.starts[1:]] - total[tokens.ends[:-1]] == tokens.starts[1:] - tokens.ends[:-1])
    tags = np.where(hit, np.where(follows, INSIDE, BEGIN), OUT)
    # long lines are cut into chains for training alone
    place = np.arange(len(hit)) - np.searchsorted(tokens.line, tokens.line)
    chain = tokens.line * (1 << 32) + place // _TRAINED
    # neighbouring words are kept from the first fit, which would learn unlabelled secrets by them
    shapes = tokens.features.copy()
    shapes[:, _NEIGHBOURS] = _BASES[_NEIGHBOURS]
    first = Field(field.likely)
    first.fit(shapes, chain, tags, EPOCHS // 2)
    seen = np.zeros(len(rows), bool)
    for one in np.unique(chain[first.may_begin(first.scores(shapes))]):
        at = np.flatnonzero(chain == one)
        seen[tokens.doc[at[0]]] |= any(first.decode(first.scores(shapes[at])))
    sure = (tokens.doc < known) | ~seen[tokens.doc]
    field.fit(tokens.features[sure], chain[sure], tags[sure])
    return field


def training_texts(docs: DataFrame) -> list[str]:
    """The bounded sample. Patterns are looked for in as many texts, lowest hash of doc_id first,
    as it takes to find ``SAMPLE_DOCS`` with a span, and at first in 64 times as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(2).cast(pa.binary()):
                raw = value.as_py()
                found.append(bool(base_spans(raw.decode(), raw)))
            yield pa.record_batch([*batch.columns, pa.array(found, pa.bool_())], ["h", "doc_id", "text", "found"])

    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("doc_id is not null and text is not null")
    n, pool = rows.count(), 64 * SAMPLE_DOCS
    while True:
        share = pool / max(n, 1)
        some = rows if share >= 1 else rows.where(F.col("h") < F.lit(int(-(2**63) + share * 2**64)))
        flags = some.mapInArrow(run, "h long, doc_id long, text string, found boolean")
        texts = []
        for found in (True, False):
            mine = flags.where(F.col("found") == found).orderBy("h", "doc_id", "text").limit(SAMPLE_DOCS).select("text").collect()
            texts.append([r.text for r in mine])
        if share >= 1 or len(texts[0]) >= SAMPLE_DOCS:
            return texts[0] + texts[1]
        pool *= 16


# ---- scanning -------------------------------------------------------------------------------


def field_spans(data: np.ndarray, offsets: np.ndarray, field: Field | None) -> list[list[tuple[int, int]]]:
    """The field's secrets in each text, in bytes from the text's start."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(offsets) - 1)]
    if field is None or not len(data):
        return out
    tokens = Tokens(data, offsets, field.likely)
    scores = field.scores(tokens.features)
    lines = np.unique(tokens.line[field.may_begin(scores)])
    lo, hi = np.searchsorted(tokens.line, lines, "left").tolist(), np.searchsorted(tokens.line, lines, "right").tolist()
    for a, b in zip(lo, hi, strict=True):
        run: list[int] | None = None
        base = int(offsets[tokens.doc[a]])
        for k, tag in zip(range(a, b + 1), [*field.decode(scores[a:b]), OUT], strict=True):
            if run and tag != INSIDE:
                out[tokens.doc[a]].append((run[0] - base, run[1] - base))
                run = None
            if tag != OUT:
                run = [run[0] if run else int(tokens.starts[k]), int(tokens.ends[k])]
    return out


_BYTES = 1 << 22


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row for each row: ``doc_id, spans`` as an array of
    ``(kind, start, end)``."""
    field = train(training_texts(docs)) if field is None else field
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(field))  # a table of fixed size

    def spans(texts: pa.Array) -> list[list[dict]]:
        data, offsets = tk.utf8(texts.cast(pa.large_binary()))
        raws = [(v.as_py() or b"") for v in texts.cast(pa.large_binary())]
        rows = []
        for raw, more in zip(raws, field_spans(data, offsets, held[0]), strict=True):
            text = raw.decode()
            base = base_spans(text, raw)
            place = (lambda b, r=raw: b) if len(text) == len(raw) else (lambda b, r=raw: len(r[:b].decode(errors="ignore")))
            added = [("crf", place(a), place(b)) for a, b in more]
            added = [x for x in added if not any(x[1] < e and s < x[2] for _, s, e in base)]
            rows.append([{"kind": k, "start": s, "end": e} for k, s, e in sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))])
        return rows

    held: list[Field | None] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(pickle.loads(packed.value))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = batch.column(1)
            size = np.cumsum([len(v.as_buffer()) if v.is_valid else 0 for v in texts.cast(pa.binary())] or [0])
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _BYTES)))
                yield pa.record_batch([batch.column(0).slice(at, end - at), pa.array(spans(texts.slice(at, end - at)), kind)], ["doc_id", "spans"])
                at = end

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of ``scan``'s result."""
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("crf"))
