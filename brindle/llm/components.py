"""Connected components of links kept in tables: no links or labels come to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, merged

#: Links that one task labels by itself; some 100 MB while it does.
ONE_TASK = 1 << 20


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> nodes, and the smallest node that each reaches: roots hang on smaller roots until no link has two."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        two = x != y
        if not two.any():
            return nodes, nodes[up]
        np.minimum.at(up, np.maximum(x, y)[two], np.minimum(x, y)[two])
        while (higher := up[up]).tobytes() != up.tobytes():
            up = higher


def _labelled(batches):
    held = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches]
    if held:
        node, component = labels(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], names=["node", "component"])


def components(edges: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(a, b) links of longs -> (node, component), the smallest node reachable; nodes without links are left out.

    Up to one_task links are labelled by one task. Beyond that large-star and small-star steps alternate (Kiveris et
    al., 2014), with the same result. A step groups by node with partial sums and joins the minima back, so a node
    with many links is a skewed join, which is split, never a list in one task. Each round's links are a table in
    the shared folder; the one before is deleted.
    """
    links = lambda d: d.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    kept = Kept(links(edges), "links")
    if kept.df.count() <= one_task:
        return kept.df.coalesce(1).mapInArrow(_labelled, "node long, component long")
    state = None
    for _ in range(rounds):
        e = kept.df
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = merged(both).join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = links(large)
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = merged(large).join(least, F.col("a") == F.col("k"))
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
        after = Kept(links(small), "links")
        kept.drop()
        kept = after
        now = tuple(kept.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    e = kept.df
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
