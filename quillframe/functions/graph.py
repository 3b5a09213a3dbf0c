"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions.ordered import reliable_checkpoint


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links, as rows ``node, root`` with the smallest node of each component.

    Every round links each node's larger neighbours, and then its smaller ones, to the
    smallest node it knows (large and small stars), so chains halve. A node's links are
    only grouped by ``min``, and each round is checkpointed; nothing is collected but a
    count and a sum. Nodes without links are not returned. Empty links give no rows.
    """
    x, y = F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    links = reliable_checkpoint(edges.select(x, y).where("lo < hi").distinct())
    known = None
    while True:
        both = links.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(
            links.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        # large star: neighbours above n go to the smallest of n and its neighbours
        low = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("r"))
        large = (both.where("m > n").join(low, "n").select(F.col("r").alias("lo"), F.col("m").alias("hi"))
                 .where("lo < hi").distinct())
        # small star: n and its neighbours below go to the smallest of them
        least = large.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("r"))
        small = (large.withColumnRenamed("hi", "n").join(least, "n")
                 .select(F.explode(F.array(F.struct(F.col("r").alias("lo"), F.col("lo").alias("hi")),
                                           F.struct(F.col("r").alias("lo"), F.col("n").alias("hi")))).alias("e"))
                 .select("e.*").where("lo < hi").distinct())
        links = reliable_checkpoint(small)
        now = links.agg(F.count("*").alias("c"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("s")).first()
        if known == (now["c"], now["s"]):
            break
        known = (now["c"], now["s"])
    roots = links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
