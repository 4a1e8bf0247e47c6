"""Connected components by alternating large-star and small-star, with every round kept in the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of a batch of edges as stars: (node, smallest node), without the centres."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def _reduce(batches):
    """Replace the edges of each batch by its spanning stars: no more rows, same components."""
    for b in batches:
        if b.num_rows:
            u, v = forest(b.column(0).to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. large: hang larger neighbours on the smallest one; small: smaller ones and the node itself."""
    near = edges.select("u", "v")
    if large:
        near = near.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _at_once(edges: DataFrame) -> DataFrame:
    """The components of edges that are few enough for the driver."""
    got = edges.select("u", "v").toArrow()
    node, low = forest(got.column("u").to_numpy(), got.column("v").to_numpy())
    centres = np.unique(low)
    table = pa.table({"node": pa.array(np.r_[node, centres], pa.int64()), "component": pa.array(np.r_[low, centres], pa.int64())})
    return edges.sparkSession.createDataFrame(table, "node long, component long")


def connected_components(edges: DataFrame, max_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """edges: (u long, v long). One row per node of an edge: node, component (the smallest node reachable).

    Up to at_once edges (settled ones, as they are counted first) are gathered and solved without a round; of more, every round is settled.
    """
    clean = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    if at_once and clean.count() <= at_once:
        return _at_once(clean)
    stars = clean.mapInArrow(_reduce, "u long, v long").distinct()
    state, seen = settle(stars), None
    for _ in range(max_rounds):
        mark = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        state = settle(_star(_star(state, True), False))
    else:
        raise RuntimeError("components did not settle")
    flat = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return flat.unionByName(flat.select(F.col("component").alias("node"), "component").distinct())
