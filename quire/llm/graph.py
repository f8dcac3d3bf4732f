"""Connected components of a graph whose edges never leave the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize

#: Edges that a worker folds into a forest at a time.
FOLD = 500_000


def forest(a: list[int], b: list[int]) -> dict[int, int]:
    """Root (the smallest node) of every node of these edges."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for x, y in zip(a, b):
        parent.setdefault(x, x)
        parent.setdefault(y, y)
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a: list[int] = []
    b: list[int] = []

    def out() -> pa.RecordBatch:
        roots = {x: r for x, r in forest(a, b).items() if x != r}
        return pa.RecordBatch.from_arrays([pa.array(roots.keys(), pa.int64()), pa.array(roots.values(), pa.int64())], names=["a", "b"])

    for batch in batches:
        a += batch.column(0).to_pylist()
        b += batch.column(1).to_pylist()
        if len(a) >= FOLD:
            yield out()
            a, b = [], []
    if a:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b: longs); root is its component's smallest node.

    Each partition first folds its edges into stars, and what is left is dealt to as many
    tasks as hold FOLD edges each and folded again. If that took several tasks, rounds of
    large stars and small stars (every node links its neighbours to the smallest of them)
    make one star of each component; a round is written to the shared folder. Edges from a
    node to itself and repeated edges are harmless; no edges, no rows.
    """
    e = materialize(edges.select("a", "b").mapInArrow(_fold, "a long, b long"), "stars")
    tasks = max(1, -(-e.count() // FOLD))
    e = materialize(e.repartition(tasks).mapInArrow(_fold, "a long, b long"), "stars")
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tasks == 1 or state == seen or state[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        seen = state
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        # large star: what is above a node goes to the smallest node around it
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        # small star: what is below a node, and the node, go to the smallest below it
        below = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        small = large.join(below, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("p")).select(F.col("p.b").alias("a"), F.col("p.m").alias("b"))
        e = materialize(small.where("a <> b").mapInArrow(_fold, "a long, b long").distinct(), "stars")
