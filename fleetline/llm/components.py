"""Connected components of a link table: stars within each task first, then large and small stars across tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetline.session import staged

#: Links that a task holds at once to turn their groups into stars.
HELD_LINKS = 1_000_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of each task as stars around the smallest node, by union and find over bounded runs of links."""
    parent: dict[int, int] = {}

    def top(node: int) -> int:
        root = node
        while parent[root] != root:
            root = parent[root]
        while parent[node] != root:
            parent[node], node = root, parent[node]
        return root

    def out() -> pa.RecordBatch:
        pairs = [(node, top(node)) for node in parent]
        u, v = zip(*(p for p in pairs if p[0] != p[1])) if pairs else ((), ())
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = top(a), top(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD_LINKS:
            yield out()
    yield out()


def _nearest(links: DataFrame) -> DataFrame:
    """For each `u` the smallest of itself and its neighbours."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Columns (node, component): for every linked node the smallest node that it reaches.

    Only nodes with a link are returned; links of a node with itself and repeated links change nothing. Each round is
    written to the shared folder. The minimum of a hub's neighbours is taken before the shuffle, and the joins are plain
    equality joins, which adaptive execution splits where one node has very many links.
    """
    edges = links.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = _within_tasks(staged(edges, "links"))
    while not _are_stars(edges):
        # Large star: every larger neighbour of u is linked to the smallest neighbour of u.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        least = _nearest(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
        edges = _within_tasks(staged(small.filter("u <> v").distinct(), "links"))
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def _within_tasks(edges: DataFrame) -> DataFrame:
    """The same components with fewer steps between nodes. The files of a written table are few tasks' work."""
    return staged(edges.select("u", "v").mapInArrow(_stars, "u long, v long").distinct(), "stars")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one link upwards, to a node that has none."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up")))
    wrong = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.count("*").alias("all")).filter("ups > 0 AND all > 1")
    return wrong.isEmpty()
