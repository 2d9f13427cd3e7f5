"""Connected components of a graph in Spark, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, work: Workspace, most: int = 60) -> DataFrame:
    """(u, label): the smallest node of the component, for each node but that one.

    ``edges`` has (u, v) of one orderable type.  Every round joins the edges with one minimum a node, which is
    written first, so that both sides of the join are shuffled and Spark can split a hot node's edges over tasks;
    partial minima are combined before the shuffle.  Rounds grow with the logarithm of the longest path.  Each is
    written to the shared folder; only two numbers come to the driver.
    """
    now = work.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = _signature(now)
    for _ in range(most):
        if not sign[0]:
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = work.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = work.save(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = work.save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = work.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        for done in (now, low, large, least):
            work.drop(done)
        now, (before, sign) = after, (sign, _signature(after))
        if sign == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select("u", F.col("v").alias("label"))
