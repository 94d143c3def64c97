"""Connected components of a graph that no machine has to hold: union-find in each partition, then contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import release, written


def _forest(batches):
    """The edges of a partition as a forest: (node, root) for each node that isn't its own root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 1 << 16):
        part = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_pydict({"a": pa.array([find(x) for x in part], pa.int64()), "b": pa.array(part, pa.int64())})


def _edges(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node reachable.

    Union-find first reduces each partition's edges to a forest. Then each round sends every node to its smallest neighbour and
    contracts the edges, which at least halves the nodes that still have edges; a hub is handled by partial minima."""
    spark = edges.sparkSession
    e = written(_edges(_edges(edges.select("a", "b")).mapInArrow(_forest, "a long, b long")), "edges")
    nodes, steps, old = None, [], []
    while not e.isEmpty():
        near = e.select(F.col("a").alias("v"), F.col("b").alias("u")).union(e.select("b", "a"))
        step = written(near.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("p")), "parents")
        steps.append(step)
        on_a, on_b = (step.select(F.col("v").alias(f"v{c}"), F.col("p").alias(f"p{c}")) for c in "ab")
        nxt = e.join(on_a, e["a"] == F.col("va")).join(on_b, e["b"] == F.col("vb"))
        old.append(e)
        e = written(_edges(nxt.select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "edges")
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    nodes = steps[0].select(F.col("v").alias("node"), F.col("p").alias("root"))
    for step in steps[1:]:
        nodes = nodes.join(step, nodes["root"] == step["v"], "left").select("node", F.coalesce("p", "root").alias("root"))
    nodes = written(nodes, "components")
    release(spark, *old, *steps)
    return nodes
