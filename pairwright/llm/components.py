"""Connected components by alternating large-star and small-star operations on an edge table.

As a combiner in front of the rounds, each partition of the edges is contracted to stars of its own, which costs no shuffle
and removes links that a partition holds more than once. The rounds then run at every size, until nothing changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import discard, materialize

MAX_ROUNDS = 60
#: Edges contracted at a time (16 MB); a partition of more gives a star forest for each so many.
COMBINED_EDGES = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[:len(u)], at[len(u):]
    least = np.arange(len(nodes))
    while True:
        p, q = least[x], least[y]
        if (p == q).all():
            break
        np.minimum.at(least, np.maximum(p, q), np.minimum(p, q))
        while (least != least[least]).any():
            least = least[least]
    own = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[own], nodes[least[own]]


def _combine(batches, limit: int):
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        u, v = stars(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        held.clear()
        for i in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[i:i + 100_000], pa.int64()), pa.array(v[i:i + 100_000], pa.int64())], ["u", "v"])

    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        if sum(len(h[0]) for h in held) >= limit:
            yield from flush()
    if held:
        yield from flush()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest neighbour, itself included."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to its smallest neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected(edges: DataFrame, combined: int = COMBINED_EDGES) -> DataFrame:
    """node and component (its smallest reachable node) for every node of edges (u, v).

    Nodes are numbers; an edge from a node to itself counts nothing. Minima are taken by aggregation, so a hub's links are
    summed where they lie. A round is one large-star and one small-star operation; rounds go on until the edge
    table no longer changes. Each is written to the shared folder, and only its row count and a checksum come to the driver.
    """
    spark = edges.sparkSession
    links = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u <> v")
    current, path = materialize(links.mapInArrow(lambda batches: _combine(batches, combined), "u long, v long"), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("s")).first()
        if mark["n"] == 0 or mark == seen:
            break
        seen = mark
        following, next_path = materialize(_small_star(_large_star(current)), "links")
        discard(spark, path)
        current, path = following, next_path
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select("v", "v").distinct())
