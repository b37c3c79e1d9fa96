"""Connected components of a link table, by alternating large and small stars.

Every round is two star steps over the whole table; each step is one grouped
minimum (combined before the shuffle, so a hub is one small row per task) and
one join of the links with the stored minima (both sides are plain shuffles,
so a hub's rows are split).  Rounds are written to the shared checkpoint
folder, and the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wideflow.session import release

from .common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable, the node itself
    included) for every node of ``links`` (columns ``a``, ``b``; either
    direction, repeats and self-links allowed; links with a NULL are ignored).
    Nodes that occur only in self-links are left out; no links give no rows."""
    e = stored(links.where(F.col("a") != F.col("b"))
               .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _state(e)
    while seen[0]:
        both = e.union(e.select("v", "u"))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = stored(both.join(low, "u").where(F.col("v") > F.col("u"))
                       .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        new = stored(large.join(low2, "u").where(F.col("v") != F.col("m"))
                     .select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .union(low2.select("u", F.col("m").alias("v"))).distinct())
        release(e, low, large, low2)
        e, before, seen = new, seen, _state(new)
        if seen == before:
            break
    out = stored(e.select(F.col("u").alias("node"), F.col("v").alias("component"))
                 .union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    release(e)
    return out


def _state(e: DataFrame) -> tuple:
    """A fingerprint of the link table that does not depend on its order."""
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
              F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(r)
