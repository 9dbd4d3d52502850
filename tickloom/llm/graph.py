"""Connected components of a graph given by its edges, without collecting edges or components anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut

#: Edges that a task contracts at a time.
CONTRACT = 1_000_000
#: Far more rounds than the logarithm of any number of nodes.
MOST_ROUNDS = 60


class Forest:
    """Disjoint sets over a bounded number of nodes; the root of a set is its smallest node."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def stars(self) -> tuple[list[int], list[int]]:
        """Nodes that aren't roots, and their roots."""
        nodes = [x for x, above in self.up.items() if above != x]
        return nodes, [self.root(x) for x in nodes]


def contracted(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Stars (a: node, b: root) that connect what the pairs connect, for each CONTRACT pairs or so."""
    forest, held = Forest(), 0

    def batch() -> pa.RecordBatch:
        nodes, roots = forest.stars()
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])

    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            forest.join(x, y)
        held += len(a)
        if held >= CONTRACT:
            yield batch()
            forest, held = Forest(), 0
    yield batch()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of the edges (longs a, b) but the roots.

    Rounds of large stars (each node hangs its larger neighbours on the smallest one that it sees) and small stars (each
    node hangs itself and its smaller neighbours on the smallest), until nothing changes; the number of rounds grows as
    the logarithm of the component size. Each round is written to the checkpoint folder. Minima are combined before the
    shuffle and written too, so that both sides of the joins come straight from a shuffle and Spark can split a hub's key.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        both = _both(edges)
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a")
        small = (
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        ).distinct()
        edges = cut(small)
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
