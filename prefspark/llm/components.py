"""Connected components of a table of edges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prefspark.llm.common import lean
from prefspark.plans.session import materialize


def spanning_stars(edges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, least node of its component) for every node of `edges` that isn't the least one."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, root) for x in up if (root := find(x)) != x]


def _contracted(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars, about `most` edges at a time."""
    held: list[tuple[int, int]] = []

    def out():
        a, b = zip(*spanning_stars(held)) if held else ((), ())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], ["a", "b"])

    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns))
        if len(held) > most:
            yield out()
    yield out()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: every node hangs on one other node at most, which hangs on none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("hangs")), F.struct(F.col("b").alias("node"), F.lit(0).alias("hangs")))).alias("end"))
    by_node = ends.select("end.*").groupBy("node").agg(F.sum("hangs").alias("above"), F.min("hangs").alias("least"))
    return by_node.where("above > 1 OR above = 1 AND least = 0").isEmpty()


def connected_components(edges: DataFrame, rounds: int = 50, held_edges: int = 500_000) -> DataFrame:
    """(node, component): the smallest node reachable from every node of `edges` (a, b), alternating large and small stars.

    Tasks first contract the edges they hold, `held_edges` at a time, so that few rounds are left. Each round joins
    every node's larger neighbours, then its smaller ones, to the smallest neighbour; edges
    never grow in number, and chains shrink by a constant factor. A node that a third of the edges touch is
    aggregated with partial sums and joined by a join that Spark can split. Every round is written to the
    shared folder. Rounds go on until all components are stars; more than `rounds` is an error.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    now = materialize(ordered.mapInArrow(lean(lambda batches: _contracted(batches, held_edges)), "a bigint, b bigint").distinct(), "edges")
    for _ in range(rounds):
        if _settled(now):
            named = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return named.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "of")
        # Large star: larger neighbours of a node hang on the smallest one.
        large = (
            both.where("b > a")
            .join(least, F.col("a") == F.col("of"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        # Small star: the node and its smaller neighbours hang on the smallest one.
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "of")
        hung = large.join(lowest, F.col("a") == F.col("of"))
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select("a", F.col("m").alias("b"))).where("a <> b")
        now = materialize(small.mapInArrow(lean(lambda batches: _contracted(batches, held_edges)), "a bigint, b bigint").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
