"""Reach of many roots without a shuffle of what they reach.

Nodes and roots are numbers. A task takes some roots, holds a bit for each of them and each node, and
reads the edges, which lie in the shared folder in order of their targets, once a round. What is shuffled
and written is the edges, however many roots there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.shared import TASK_ROWS, discard, materialize

#: Bytes of a task's bits of one round, of which it holds two; a graph of more nodes than this has
#: room for with 64 roots is not swept.
SWEEP_BYTES = 128 << 20
#: Columns of 64 roots that a task takes at most.
SWEEP_WORDS = 16
#: Rows of a batch of edges, or of what is handed back.
BATCH_ROWS = 1 << 17
#: Texts of 64 roots that a task keeps, and characters of texts that it hands back at once.
KEPT_TEXTS, TEXT_BYTES = 1 << 13, 8 << 20


class Sweep:
    """``steps(id, next)`` and ``roots(number, id)``, numbered from 0, over ids below ``size``."""

    def __init__(self, steps: DataFrame, roots: DataFrame, size: int, cap: int):
        spark = steps.sparkSession
        self.spark, self.size, self.cap = spark, size, cap
        steps = materialize(steps.where("id is not null and next is not null").select(F.col("id").cast("int"), F.col("next").cast("int")), "sweep-steps")
        tasks = max(-(-steps.count() // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.steps = materialize(steps.repartition(tasks, "next").sortWithinPartitions("next", "id"), "sweep").inputFiles()
        discard(steps)
        roots = materialize(roots.select(F.col("number").cast("long"), F.col("id").cast("int")), "sweep-roots")
        self.roots, self.n = roots.inputFiles(), roots.count()
        words = -(-self.n // 64)
        fair = -(-words // (2 * spark.sparkContext.defaultParallelism))
        self.words = max(1, min(SWEEP_WORDS, fair, SWEEP_BYTES // (8 * max(1, size))))
        self.groups = -(-words // self.words)

    def run(self, each: Callable[[int, Iterator[tuple[int, np.ndarray, np.ndarray]], int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``each(first, rounds, n)`` for the roots from number ``first`` on, ``n`` of them: ``rounds`` are
        ``(depth, new, seen)``, rows of words by id, ``new`` being the bits that came in this round."""
        files, given, words, size, cap = self.steps, self.roots, self.words, self.size, self.cap

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for group in batch.column(0).to_pylist():
                    first = group * 64 * words
                    number, at = _roots(given, first, first + 64 * words)
                    yield from each(first, _rounds(files, number - first, at, words, size, cap), len(number))

        return self.spark.range(0, self.groups, 1, max(1, self.groups)).mapInArrow(sweep, schema)


def sweepable(df: DataFrame, size: int) -> bool:
    """Whether a task has room for a bit of 64 roots for each of ``size`` nodes, and the shared folder is one
    that a task opens by itself."""
    try:
        pafs.FileSystem.from_uri(_uri(df._shared_path))  # type: ignore[attr-defined]
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return size * 8 <= SWEEP_BYTES and size < 1 << 31


def _uri(path: str) -> str:
    return path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:")


def _batches(file: str, columns: list[str], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    fs, path = pafs.FileSystem.from_uri(_uri(file))
    with fs.open_input_file(path) as f:
        yield from pq.ParquetFile(f).iter_batches(rows, columns=columns, use_threads=False)


def _roots(files: list[str], first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from ``first`` to ``end`` and their ids."""
    numbers, ids = [np.empty(0, "i8")], [np.empty(0, "i8")]
    for file in files:
        for batch in _batches(file, ["number", "id"]):
            n, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            mine = (n >= first) & (n < end)
            numbers.append(n[mine])
            ids.append(i[mine])
    return np.concatenate(numbers), np.concatenate(ids)


def _rounds(files: list[str], at: np.ndarray, ids: np.ndarray, words: int, size: int, cap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    seen = np.zeros((size, words), "u8")
    np.bitwise_or.at(seen, (ids, at // 64), np.left_shift(np.uint64(1), (at % 64).astype("u8")))
    yield 0, seen, seen
    whole = np.zeros(words, "u8")
    np.bitwise_or.at(whole, at // 64, np.left_shift(np.uint64(1), (at % 64).astype("u8")))
    came = (seen != 0).any(axis=1)  # sources that got a bit in the last round
    left = list(files)  # files with a target that some root has not reached
    new = np.empty_like(seen)
    for depth in range(1, cap + 1):
        lacks = (seen != whole).any(axis=1)
        new[:] = 0
        left = [f for f in left if _round(f, seen, new, came, lacks)]
        new |= seen
        new ^= seen
        came = (new != 0).any(axis=1)
        if not came.any():
            return
        seen |= new
        yield depth, new, seen


def _round(file: str, seen: np.ndarray, new: np.ndarray, came: np.ndarray, lacks: np.ndarray) -> bool:
    """Adds to ``new`` what the edges of a file bring; whether one of its targets lacks a root."""
    some = False
    for batch in _batches(file, ["id", "next"]):
        source, target = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
        kept = lacks[target]
        some = some or bool(kept.any())
        kept &= came[source]
        source, target = source[kept], target[kept]
        if len(target):
            starts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
            new[target[starts]] |= np.bitwise_or.reduceat(seen.take(source, axis=0), starts, axis=0)
    return some


def counts(sweep: Sweep) -> DataFrame:
    """``(number, n)``: how many ids each root reaches, itself included."""
    size = 64 * sweep.words

    def count(first: int, rounds: Iterator, n: int) -> Iterator[pa.RecordBatch]:
        for _, _, seen in rounds:
            pass
        total = np.zeros(size, "i8")
        for i in range(0, len(seen), BATCH_ROWS):
            total += np.unpackbits(np.ascontiguousarray(seen[i : i + BATCH_ROWS]).astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at + first), pa.array(total[at])], names=["number", "n"])

    return sweep.run(count, "number long, n long")


def reached(sweep: Sweep, names: DataFrame) -> DataFrame:
    """``(path, depth, word, bits)``: the 64 roots from number 64 * ``word`` on that reach a path at
    just this depth; ``names(id, path)``."""
    files = materialize(names.select(F.col("id").cast("int"), "path"), "sweep-names").inputFiles()

    def rows(first: int, rounds: Iterator, n: int) -> Iterator[pa.RecordBatch]:
        for depth, new, _ in rounds:
            for file in files:
                for batch in _batches(file, ["id", "path"], BATCH_ROWS // 2):
                    mine = new.take(batch.column(0).to_numpy(zero_copy_only=False), axis=0)
                    for word in range(mine.shape[1]):
                        at = np.flatnonzero(mine[:, word])
                        if len(at):
                            same = lambda x, kind: pa.array(np.full(len(at), x, kind))  # noqa: B023, E731
                            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at)), same(depth, "i4"), same(first // 64 + word, "i4"), pa.array(mine[at, word].view("i8"))], names=["path", "depth", "word", "bits"])

    return sweep.run(rows, "path string, depth int, word int, bits long")


def roots_by_word(named: DataFrame) -> DataFrame:
    """``named(number, root)`` -> ``(word, roots)``: the roots of each word of bits in order."""
    each = named.select(F.floor(F.col("number") / 64).cast("int").alias("word"), F.struct("number", "root").alias("x")).groupBy("word")
    return materialize(each.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["root"]).alias("roots")), "root-words")


def held(sweep: Sweep) -> DataFrame:
    """``(id, first, bits)``: the roots that reach an id, ``bits`` an array of words from number ``first`` on."""
    size = sweep.words

    def rows(first: int, rounds: Iterator, n: int) -> Iterator[pa.RecordBatch]:
        for _, _, seen in rounds:
            pass
        for i in range(0, len(seen), BATCH_ROWS // 8):
            mine = seen[i : i + BATCH_ROWS // 8]
            at = np.flatnonzero((mine != 0).any(axis=1))
            bits = pa.FixedSizeListArray.from_arrays(pa.array(mine[at].view("i8").reshape(-1)), size).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at + i), pa.array(np.full(len(at), first)), bits], names=["id", "first", "bits"])

    return sweep.run(rows, "id long, first long, bits array<long>")


def joined(words: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``(path, parts)``, parts being ``held``'s ``(first, bits)`` in order or null, to ``(path, status, owners)``;
    ``words`` as of ``roots_by_word``. The text of a word's roots is made once for all equal words."""
    files = words.inputFiles()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = {word: names for file in files for batch in _batches(file, ["word", "roots"]) for word, names in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)}

        @lru_cache(KEPT_TEXTS)
        def text(word: int, bits: int) -> tuple[str, int]:
            mine = [x for i, x in enumerate(roots[word].as_py()) if bits >> i & 1]
            return ",".join(mine), len(mine)

        rows, size = [], 0
        for batch in batches:
            for path, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts = [text(part["first"] // 64 + i, bits) for part in parts or () for i, bits in enumerate(part["bits"]) if bits]
                n = sum(t[1] for t in texts)
                rows.append((path, "sole" if n == 1 else "shared" if n else "unreached", ",".join(t[0] for t in texts) if texts else None))
                size += len(rows[-1][2] or "")
                if size > TEXT_BYTES:
                    yield _texts(rows)
                    rows, size = [], 0
            yield _texts(rows)
            rows, size = [], 0

    return join


def _texts(rows: list[tuple[str, str, str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["path", "status", "owners"])
