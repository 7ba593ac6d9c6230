"""Connected components of an edge table by alternating large-star and small-star steps.

Labels only fall, and the loop ends when a whole pass changes nothing.  A hub's least neighbour is
found by partial aggregation, and its rows are joined under a skew join.  Nothing but one checksum a
pass reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechprep.llm.store import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or all smaller) neighbours to the least node of its neighbourhood."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # joined on ~u, so that both sides are exchanged for the join and the rows of a hub can be split by adaptive execution
    joined = both.join(least.select(F.bitwise_not("u").alias("w"), "m").hint("merge"), F.bitwise_not(both["u"]) == F.col("w"))
    kept = joined.filter(F.col("v") > F.col("u")) if large else joined
    out = kept.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``edges(u, v)`` of orderable nodes -> ``(node, root)`` for every node of an edge; root is the least node reached."""
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = cut(_star(_star(now, True), False), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
