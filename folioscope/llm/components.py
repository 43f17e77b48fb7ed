"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

ROUNDS = 60


def components(links: DataFrame, source: str, target: str) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) of every linked node.

    Each round lowers the parent of a node, and the parent of its parent, to
    the smallest parent among its neighbours and then skips one level of the
    tree, so that the number of rounds grows with the logarithm of a chain.
    Rounds are written to the shared folder, which cuts the lineage.  Minima
    are taken before the shuffle, so a node with very many links stays cheap;
    joins on such a node are left to adaptive skew splitting.

    Null nodes are left out.  No links give an empty table.
    """
    a = links.select(F.col(source).alias("u"), F.col(target).alias("v")).where("u <> v")
    both = a.unionAll(a.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = settle(both, "links")
    parents = settle(
        both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")),
        "parents",
    )
    for _ in range(ROUNDS):
        seen = both.join(parents.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("p").alias("m"))
        offers = parents.join(seen, "u").select("u", "p", F.least("p", "m").alias("m"))
        lower = offers.select("u", "m").unionAll(offers.select(F.col("p").alias("u"), "m"))
        lower = lower.groupBy("u").agg(F.min("m").alias("q"))
        above = lower.select(F.col("u").alias("q"), F.col("q").alias("r"))
        after = (
            parents.join(lower, "u")
            .join(above, "q")
            .select("u", F.least("q", "r").alias("p"), (F.least("q", "r") < F.col("p")).alias("changed"))
        )
        after = settle(after, "parents")
        parents = after.select("u", "p")
        if after.where("changed").isEmpty():
            return parents.select(F.col("u").alias("node"), F.col("p").alias("component"))
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
