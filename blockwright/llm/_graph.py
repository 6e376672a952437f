"""Connected components on executors only: of up to SMALL links in one task, of more by alternating large and small stars.

A round of stars is a dozen short jobs that cost a task and a file for each partition, however few the links are. Each
round needs two aggregations with map-side combining and two joins. What is aggregated is written before it is joined, so
that both sides of the join come from plain exchanges, whose hot keys adaptive execution splits: a hub with a third of all
links is no single task's work. Every round is written to the shared folder; nothing but counts reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm._store import release, stored

#: Links of 64-bit keys, 16 bytes each, that one task unites.
SMALL = 1 << 19


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in order, the least node that links reach from each)."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while True:
        x, y = root[i], root[j]
        apart = x != y
        if not apart.any():
            return node, node[root]
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _united(batches):
    none = np.zeros(0, np.int64)
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    node, root = united(np.concatenate([none, *(a for a, _ in parts)]), np.concatenate([none, *(b for _, b in parts)]))
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def _star(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``both`` (u, v) with the least of each u's neighbourhood, itself included; and the stored table of the least."""
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), "least")
    return both.join(least, F.col("u") == F.col("_u")).drop("_u"), least


def _settled(star: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most and none that has one is another's: stars are whole components."""
    ends = star.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(star.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0")
    return odd.count() == 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; root is the least node that links reach. ``links`` is read twice.

    Keys may be of any ordered type and must not be null. Links to itself make a component of one.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    if all(kind == "bigint" for _, kind in pairs.dtypes) and pairs.count() <= SMALL:
        return pairs.coalesce(1).mapInArrow(_united, "node long, root long")
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    alone = edges.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("root"))
    now = first = edges.where("u <> v")
    while True:
        # Large stars: each node's greater neighbours move to the least of its neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, least = _star(both)
        large = stored(large.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # Small stars: a node and its smaller neighbours move to the least of them.
        small, less = _star(large)
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = stored(small.where("u <> v").distinct(), "star")
        release(least, large, less)
        if now is not first:
            release(now)
        now = new
        if _settled(now):
            break
    star = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    reached = star.unionByName(roots)
    return reached.unionByName(alone.join(reached.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti"))
