"""Connected components of a link table, by large-star and small-star rounds of grouping and joining.

Each round hangs every node on the least node it knows; a chain of any length is folded in about the logarithm of its
length. Links are pre-aggregated per node before each shuffle, joins on hot nodes are left to the runtime's skew handling,
and each round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingworks.llm.common import drop_unused
from postingworks.session import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b), a > b, with each node's neighbours hung on the least among them and itself.

    large: the greater neighbours are hung; else the lesser ones and the node itself.
    """
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.where("v > u") if large else both
    moved = hung.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b) but the roots themselves; root is the component's least node.

    Nodes may be of any type with an order. Self-links and repeated or reversed links don't matter.
    """
    spark = links.sparkSession
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                      "links")

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()

    seen = mark(now)
    for _ in range(most_rounds):
        if not seen["n"]:
            break
        now = materialize(_star(_star(now, True), False), "links")
        drop_unused(spark)
        then = mark(now)
        if then == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = then
    if seen["n"]:
        raise RuntimeError(f"the components are not settled after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
