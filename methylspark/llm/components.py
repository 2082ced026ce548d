"""Connected components of a link table by alternating stars, as rounds of joins.

Every round points each node's larger neighbours, then each node and its smaller ones, at the
smallest of them, until nothing changes: logarithmic rounds, and never more links than given.
Rounds are written to the shared folder, so a lost executor costs one round at most. Per-key minima
are combined before the shuffle; joins on hot nodes are left to adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylspark.llm.tables import Written

MAX_ROUNDS = 60


def _with_least(links: DataFrame) -> DataFrame:
    """``(u, v, m)``: links with the least of u and all its v."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return links.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def _round(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both).filter(F.col("v") > F.col("u")).select(
        F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    small = _with_least(large)
    return small.select(F.explode(F.array(
        F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").filter(
        "u <> v").distinct()


def components(links: DataFrame, keep: Written) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its least node.

    Null ends, loops and repeated links have no effect; no links give no rows.
    """
    now = keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"),
                                             F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, before = state, now
        now = keep(_round(before))
        keep.drop(before)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select(
        "node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
