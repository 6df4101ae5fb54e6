"""Walks from many roots over a sparse graph of numbers, in tasks that hold the whole of its steps.

A task reads the steps from the shared folder, two numbers for each of them, and walks from one root after
the other, so that a long way takes no rounds and what was reached is not compared over again.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans import sweeps
from factloom.plans.shared import materialize

#: Pairs that a task hands back at once.
PAIRS = 1 << 17
#: Roots of a task at least.
TASK_ROOTS = 1 << 10


class Walks:
    """``steps(node, next)``, or ``(node, next, seq)`` with the steps of a node in order of seq, over numbers below
    ``size``, and ``starts(root, node)``."""

    def __init__(self, steps: DataFrame, starts: DataFrame, size: int):
        spark, order = steps.sparkSession, ["node", *(["seq"] if "seq" in steps.columns else []), "next"]
        dealt = steps.repartitionByRange("node").sortWithinPartitions(*order).select(F.col("node").cast("int"), F.col("next").cast("int"))
        self.steps, self.size = sorted(materialize(dealt, "walk-steps").inputFiles()), size
        roots = materialize(starts.groupBy("root").agg(F.array_sort(F.collect_set(F.col("node").cast("int"))).alias("nodes")), "walk-roots")
        tasks = min(4 * spark.sparkContext.defaultParallelism, -(-roots.count() // TASK_ROOTS))
        self.roots = roots.repartition(max(1, tasks))

    def run(self, each: Callable[[memoryview, memoryview, bytearray], Callable[[list[int]], tuple[array, ...]]], name: str, schema: str) -> DataFrame:
        """``(root, *name)``: a row for each item of the arrays that ``each(ptr, nxt, mark)(nodes)`` gives for a root."""
        files, size = self.steps, self.size

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ptr, nxt, step = None, None, None
            held, n = [], 0

            def rows() -> Iterator[pa.RecordBatch]:
                at = pa.array(np.repeat(np.arange(len(held)), [len(h[1][0]) for h in held]))
                whole = pa.table([pa.array([h[0] for h in held], pa.string()).take(at), *[pa.array(np.concatenate([np.frombuffer(h[1][i], "i4") for h in held])) for i in range(len(held[0][1]))]], names=["root", *name.split()])
                yield from whole.to_batches(PAIRS)

            for batch in batches:
                if step is None:
                    ptr, nxt = _graph(files, size)
                    step = each(ptr, nxt, bytearray(size))
                for root, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = step(nodes)
                    if len(found[0]):
                        held.append((root, found))
                        n += len(found[0])
                    if n >= PAIRS:
                        yield from rows()
                        held, n = [], 0
            if held:
                yield from rows()

        return self.roots.mapInArrow(walk, schema)


def walkable(df: DataFrame, size: int, steps: int) -> bool:
    """Whether a task has room for a graph of ``size`` nodes."""
    return sweeps.sweepable(df, max(size, steps) // 2)


def _graph(files: list[str], size: int) -> tuple[memoryview, memoryview]:
    """Where the steps of each node begin and, in their order, where they lead."""
    count, to = np.zeros(size + 1, "i4"), [np.empty(0, "i4")]
    for file in files:
        for batch in sweeps._batches(file, ["node", "next"]):
            node, next_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            some, n = np.unique(node, return_counts=True)
            count[some + 1] += n.astype("i4")
            to.append(next_)
    return memoryview(np.cumsum(count, dtype="i4")), memoryview(np.concatenate(to))


def _further(ptr: memoryview, nxt: memoryview, mark: bytearray, nodes: list[int], found: array, at: int = 0) -> None:
    """Adds to ``found`` what is reached from ``nodes``, or from place ``at`` of ``found`` on, and not marked, and marks it."""
    for node in nodes:
        for i in range(ptr[node], ptr[node + 1]):
            to = nxt[i]
            if not mark[to]:
                mark[to] = 1
                found.append(to)
    while at < len(found):
        node = found[at]
        at += 1
        for i in range(ptr[node], ptr[node + 1]):
            to = nxt[i]
            if not mark[to]:
                mark[to] = 1
                found.append(to)


def called(walks: Walks) -> DataFrame:
    """``(root, node)`` of all that a root's steps lead to; a start just if they lead back to it."""

    def each(ptr: memoryview, nxt: memoryview, mark: bytearray) -> Callable:
        def step(nodes: list[int]) -> tuple[array]:
            found = array("i")
            _further(ptr, nxt, mark, nodes, found)
            for node in found:
                mark[node] = 0
            return (found,)

        return step

    return walks.run(each, "node", "root string, node int")


def traced(walks: Walks, file_of: DataFrame, cap: int | None) -> DataFrame:
    """``(root, node, place, whole)``: the first node of each file in the order of discovery, as of
    ``traces.traced_files``, and how many files there are in all; ``file_of(node, file)`` in numbers. For roots with
    one start."""
    files, size = sorted(materialize(file_of.select(F.col("node").cast("int"), F.col("file").cast("int")), "walk-files").inputFiles()), walks.size

    def each(ptr: memoryview, nxt: memoryview, mark: bytearray) -> Callable:
        of = np.zeros(size, "i4")
        for name in files:
            for batch in sweeps._batches(name, ["node", "file"]):
                of[batch.column(0).to_numpy(zero_copy_only=False)] = batch.column(1).to_numpy(zero_copy_only=False)
        of = memoryview(of)

        def step(nodes: list[int]) -> tuple[array, array, array]:
            found, first, known = array("i", nodes), array("i"), set()
            for node in nodes:
                mark[node] = 1
                known.add(of[node])
                first.append(node)
            start, end = 0, len(found)
            while start < end and (cap is None or start == 0 or len(known) < cap):  # a depth
                for at in range(start, end):
                    node = found[at]
                    for i in range(ptr[node], ptr[node + 1]):
                        to = nxt[i]
                        if not mark[to]:
                            mark[to] = 1
                            found.append(to)
                            if of[to] not in known:
                                known.add(of[to])
                                first.append(to)
                start, end = end, len(found)
            whole = len(known)
            if start < end:  # the cap was met
                _further(ptr, nxt, mark, [], found, start)
                whole = len(np.unique(np.frombuffer(of, "i4")[np.frombuffer(found, "i4")]))
            for node in found:
                mark[node] = 0
            return first, array("i", range(1, len(first) + 1)), array("i", [whole] * len(first))

        return step

    return walks.run(each, "node place whole", "root string, node int, place int, whole int")
