"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsynth.llm.common import forget, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node and component (its smallest reachable node) of each node that an edge joins to another.

    Edges with a null end or with equal ends join nothing; repeated ones count once. Each round is written to the shared
    folder, a hub's edges are joined, never gathered, and only two sums reach the driver.
    """
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    now = written(edges.where(f"{a} is not null and {b} is not null and {a} != {b}").select(hi, lo).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        # each node hangs on the least of its lower neighbours, and so do those
        small = large.join(root, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi != lo").distinct()
        last, now = now, written(small, "edges")
        forget(last)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components: no end within the given rounds")
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.union(now.select(F.col("lo"), F.col("lo")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
