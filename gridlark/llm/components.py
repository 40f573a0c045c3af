"""Connected components of a link table by alternating large-star and small-star steps.

Links never meet on the driver or in one task by design: every step is a minimum by node and a join.
Each round is written to the shared folder, so a lost executor costs no more than one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b, distinct."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = both.join(least, "a")
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node but the roots; links has long columns a and b, in any order."""
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if not sums["n"] or (sums["n"], sums["s"]) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (sums["n"], sums["s"])
        now = materialize(_star(_star(now, True), False), "links")
