"""Connected components by alternating large-star and small-star rounds.

Links stay distributed; only two sums a round come to the driver. Each round's
links are written as tables, so the plan stays short and lost executors cost a
re-read, not a recomputation. Minimum labels are pre-aggregated before the
shuffle and cut, so that both sides of the joins back to the links are plain
exchanges, which adaptive execution splits where one node holds many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for each node of a link; label is the component's smallest node.

    Self-links, repeated links and null ends are ignored; an empty table gives an
    empty result.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    # Tables, as a checkpoint keeps what the optimizer inferred of its plan, which would grow with each round.
    with Scratch(links.sparkSession) as scratch:
        now = scratch.table(links.where(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct())
        mark = None
        while True:
            both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
            least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
            large = scratch.table(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
            low = scratch.table(large.groupBy("hi").agg(F.min("lo").alias("m")))
            small = large.join(low, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(low.select("hi", F.col("m").alias("lo")))
            now = scratch.table(small.distinct())
            seen = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
            if seen == mark:
                break
            mark = seen
        return cut(now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()))
