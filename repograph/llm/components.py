"""Connected components of an edge table, by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _stars(edges: DataFrame) -> tuple[DataFrame, int, int]:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    large = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src != dst").distinct()
    # large now points from a greater node to a smaller one
    down = large.groupBy("src").agg(F.min("dst").alias("m"))
    small = large.join(down, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(down.select("src", F.col("m").alias("dst"))).filter("src != dst").distinct()
    out = staged(small, "components")
    row = out.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return out, row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of an edge table (src, dst: long) with the least node it is connected to.

    Self-loops and repeated edges do nothing; no edges give no rows. Rounds grow with the logarithm of
    the longest path; each is written to the shared folder.
    """
    now, seen = staged(edges.select("src", "dst").filter("src != dst").distinct(), "components"), None
    while True:
        now, n, mark = _stars(now)
        if (n, mark) == seen or n == 0:
            break
        seen = (n, mark)
    leaves = now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
