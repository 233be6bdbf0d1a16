"""Connected components by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin, unpin


def connected(edges: DataFrame) -> DataFrame:
    """(u, v): for each node v but the least of its component, that least node u. Large and small stars in turn."""

    def seen(df: DataFrame):
        r = df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        return r[0], r[1]

    e = pin(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    was = seen(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), "v"), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = pin(small)
        unpin(e)
        e, now = new, seen(new)
        if now == was:
            break
        was = now
    return e
