"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder that the session names; otherwise the plan is kept in memory and on disk."""
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return df.checkpoint() if sc.getCheckpointDir() else df.persist()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, component`` (the smallest node) for the nodes of ``src, dst``.

    Each round links every node to the smallest node around it, first from the larger side, then from the smaller;
    both group by node with a minimum that is combined before the shuffle, and join it back to the edges, so no
    neighbourhood is ever gathered in one task.  Ends when no edge changes.
    """
    current = checkpointed(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.where("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("x"), F.col("a").alias("y"), "m")
        nxt = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("y").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        before, current = current, checkpointed(nxt)
        before.unpersist()
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    label = current.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = current.select(F.col("b").alias("node")).distinct().join(label.select("node"), "node", "left_anti")
    return label.unionByName(roots.select("node", F.col("node").alias("component")))
