"""Connected components of links between 'earlier' and 'later' texts, without a driver-side graph."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every end of the links (columns a, b), root being the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014):
    each is one map-side combined minimum per node and one join, so hubs are
    split by the planner and no component is ever gathered. Every round is
    written to the shared folder; the number of rounds grows with the
    logarithm of the longest path. Null ends and loops are ignored; an empty
    input gives an empty result.
    """
    now = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") > F.col("v")).distinct(), "links")
    state = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if found == state or not found[0]:
            break
        state = found
        now = stage(_small_star(_large_star(now)), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select("v", "u"))
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    others = links.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(low.select("u", F.col("m").alias("v"))).distinct()
