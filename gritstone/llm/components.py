"""Connected components by alternating large and small stars, each round cut by a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, handed_on, save

#: Edges up to which a round is one job: a hub's are then few enough for a task. With more, what is gathered of each node is a table of its own. The
#: result is the same.
ONE_JOB = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id reachable) for each id of edges (u, v: bigint), where the two differ.

    A round hangs every neighbour of a node on the least of them; rounds end when the edges are a forest of stars, after about the
    logarithm of the longest path. The least neighbour of each node is a table of its own where there are many edges, so a hub is one row on that side
    of a
    join, and its neighbours on the other, which adaptive execution can split. No edges give no rows.
    """
    now = save(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        table = save if state[0] > ONE_JOB else lambda df, _: df
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = table(large, "large")
        lower = table(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        hung = large.join(lower, "a")
        old, now = now, save(hung.select("b", "m").where("b <> m").toDF("a", "b").unionByName(lower.toDF("a", "b")).distinct(), "edges")
        drop(old, least, large, lower)
        before, state = state, _state(now)
        if state == before:
            break
    return handed_on(now, now.select(F.col("a").alias("id"), F.col("b").alias("component")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).collect()[0])
