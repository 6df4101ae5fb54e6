"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of its labelled text is built. A
text is parsed greedily into longest matches with the automaton (a letter the automaton
never saw is a phrase of its own); phrases, times the bits it takes to point into the
sample, per symbol, is its cross-parsing entropy. The language that needs the fewest
normalised phrases wins, the alphabetically first of equals.

Symbols are lower-case letters; every run of other characters is one space. Texts are
parsed whole, in lanes of ``LANE`` symbols, each of which begins a phrase anew, all lanes in
step through dense transition tables. Letters beyond the ``LETTERS`` commonest of the sample
count as one symbol.

Training bound: ``SAMPLE_DOCS`` labelled texts per language (lowest hash of doc_id first),
``SAMPLE_CHARS`` characters of each and ``TRAIN_SYMBOLS`` symbols together. doc_id chooses
the sample, but is no input of a prediction; nor are lang and source.

Defined results: ``und`` with score 0 for a null text, one without a letter, or where no
language was learned. ``score`` is how far, as a share, the best entropy lies below the next
best; 1 if there is only one language. Repeated rows get equal results.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 64
SAMPLE_CHARS = 8192
TRAIN_SYMBOLS = 32768
LETTERS = 250
LANE = 1024
LANES = 4096
_SLICE = 1 << 20
_SPACE, _OTHER, _PAD = 0, 1, 2


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame) -> dict[str, list[str]]:
    """Language -> its bounded sample of texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = rows.withColumn("rank", first).where(F.col("rank") <= SAMPLE_DOCS).orderBy("lang", "rank").collect()
    if not chosen:
        return {}
    texts = docs.where(F.col("doc_id").isin([r.doc_id for r in chosen])).select("doc_id", F.col("lang").alias("lang"), F.substring(F.col("text").cast("string"), 1, SAMPLE_CHARS).alias("text"))
    by_key: dict[tuple, str] = {}
    for r in texts.where("text is not null").orderBy("doc_id", "text").collect():
        by_key.setdefault((r.lang, r.doc_id), r.text)
    out: dict[str, list[str]] = {}
    for r in chosen:
        if (r.lang, r.doc_id) in by_key:
            out.setdefault(r.lang, []).append(by_key[r.lang, r.doc_id])
    return out


class Automaton:
    """Suffix automaton of a symbol sequence as a dense table; -1: no such extension."""

    def __init__(self, symbols: list[int], width: int):
        nexts, link, length = [{}], [-1], [0]
        last = 0
        for c in symbols:
            cur = len(nexts)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.table = np.full((len(nexts), width), -1, np.int32)
        for s, n in enumerate(nexts):
            for c, t in n.items():
                self.table[s, c] = t
        self.table[:, _PAD] = np.arange(len(nexts))
        self.bits = np.log2(max(2, len(symbols)))

    def phrases(self, lanes: np.ndarray) -> np.ndarray:
        """Phrases of each lane; ``lanes`` is (steps, lanes), filled up with _PAD."""
        flat, width = self.table.ravel(), self.table.shape[1]
        fresh = self.table[0].copy()
        extra = (fresh < 0).astype(np.int32)  # a symbol of which nothing starts is a phrase itself
        fresh[fresh < 0] = 0
        state = np.zeros(lanes.shape[1], np.int32)
        count = np.zeros(lanes.shape[1], np.int32)
        for symbol in lanes:
            to = flat[state * width + symbol]
            over = to < 0
            count += over * (1 + extra[symbol])
            state = np.where(over, fresh[symbol], to)
        return count + 1


class Model:
    def __init__(self, samples: dict[str, list[str]]):
        letters = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
        self.table = np.array([_OTHER if chr(c).isalpha() else _SPACE for c in range(0x110000)], np.uint8)
        known = sorted(c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:LETTERS])
        for i, c in enumerate(known):
            for form in {c, c.upper(), c.title()}:
                if len(form) == 1:
                    self.table[ord(form)] = _PAD + 1 + i
        width = _PAD + 1 + len(known)
        self.langs, self.automata = [], []
        for lang in sorted(samples):
            symbols = np.concatenate([self.symbols(t + " ") for t in samples[lang]])[:TRAIN_SYMBOLS]
            if (symbols != _SPACE).any():
                self.langs.append(lang)
                self.automata.append(Automaton(symbols.tolist(), width))

    def symbols(self, text: str) -> np.ndarray:
        s = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = s != _SPACE
        keep[1:] |= s[:-1] != _SPACE
        return s[keep]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        owner, lanes, lettered = [], [], np.zeros(len(texts), bool)
        size = np.zeros(len(texts))
        for i, t in enumerate(texts):
            for k in range(0, len(t or ""), _SLICE):
                s = self.symbols(t[k : k + _SLICE])
                lettered[i] |= bool((s != _SPACE).any())
                size[i] += len(s)
                for a in range(0, len(s), LANE):
                    owner.append(i)
                    lanes.append(s[a : a + LANE])
        total = np.zeros((len(self.langs), len(texts)))
        order = sorted(range(len(lanes)), key=lambda k: len(lanes[k]))
        for lo in range(0, len(order), LANES):
            some = order[lo : lo + LANES]
            block = np.full((len(lanes[some[-1]]), len(some)), _PAD, np.uint8)
            for j, k in enumerate(some):
                block[: len(lanes[k]), j] = lanes[k]
            who = np.array([owner[k] for k in some])
            for j, automaton in enumerate(self.automata):
                total[j] += np.bincount(who, automaton.phrases(block), len(texts))
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        entropy = total * np.array([[a.bits] for a in self.automata]) / np.maximum(size, 1)
        best = entropy.argmin(axis=0)
        ranked = np.sort(entropy, axis=0)
        margin = 1 - ranked[0] / np.maximum(ranked[1], 1e-12) if len(self.langs) > 1 else np.ones(len(texts))
        return [self.langs[b] if x else "und" for b, x in zip(best, lettered, strict=True)], [float(m) if x else 0.0 for m, x in zip(margin, lettered, strict=True)]


@functools.lru_cache(maxsize=2)
def _model(samples: tuple[tuple[str, tuple[str, ...]], ...]) -> Model:
    """Each Python worker builds its automata once, from the sample."""
    return Model({lang: list(texts) for lang, texts in samples})


def _groups(texts: list[str | None], chars: int = 1 << 22) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t or "") > chars:
            yield start, i
            start, held = i, 0
        held += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def identify(docs: DataFrame, samples: dict[str, list[str]] | None = None) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` -> a row for each row: ``doc_id, held_out, lang_pred, score``."""
    samples = training_sample(docs) if samples is None else samples
    packed = tuple((lang, tuple(texts)) for lang, texts in sorted(samples.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(packed)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _groups(texts):
                langs, scores = model.predict(texts[a:b])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
