"""Connected components by alternating large-star and small-star rounds.

Every round is a grouped minimum and a join, so no node's neighbours are ever gathered. Rounds go
on until the edges are stars around their component's smallest node. Each round's edges are written
to the shared folder, which cuts the lineage; the round before is then deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, staged


def _star(sym: DataFrame, larger: bool) -> DataFrame:
    """Links each node's neighbours (the larger ones, or the smaller ones and itself) to the smallest of them and itself."""
    least = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = sym.join(least, "a")
    if larger:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of `edges` (a, b) that is not its component's smallest node, which is root.

    Loops and repeated edges do no harm; a or b may not be null. No edges give no rows.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if not sums.n or sums == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sums
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, True)
        after = staged(_star(large, False), "edges")
        discard(now)
        now = after
