"""Splitting, scanning and reading apart, on documents of polygons as large as asked for: python bench_gml.py [MB] [cores]."""

from __future__ import annotations

import math
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkgml.api import ReadOptions, read, scan
from sparkgml.queries import HEAD, TAIL, tag
from sparkgml.sources.split import split_features

#: Polygons of a document, each of 32 vertices.
ROWS = 10_000


def main(mb: int = 1024, cores: int = 8) -> None:
    spark = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", "10g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", str(cores)).config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    steps = [(100 * math.cos(2 * math.pi * k / 32), 100 * math.sin(2 * math.pi * k / 32)) for k in range(33)]
    x, y = F.col("id") % 9000 * 50 + 200000, F.floor(F.col("id") / 9000) * 50 + 300000
    ring = F.concat_ws(" ", *[F.round(v + d, 2).cast("string") for dx, dy in steps for v, d in ((x, dx), (y, dy))])
    shape = F.concat(F.lit('<gml:Polygon srsName="EPSG:2180"><gml:exterior><gml:LinearRing><gml:posList>'), ring, F.lit("</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>"))
    feature = tag("Building", tag("no", F.col("id")), tag("kind", F.lit("house")), tag("height", F.col("id") % 40 + 0.5), tag("shape", shape), attrs=F.concat(F.lit(' gml:id="B.'), F.col("id").cast("string"), F.lit('"')))
    member = F.concat(F.lit("<gml:featureMember>"), feature, F.lit("</gml:featureMember>"))
    documents = max(cores, mb // 9)
    docs = spark.range(0, documents * ROWS, 1, documents).select(F.spark_partition_id().cast("string").alias("name"), member.alias("m")).groupBy("name").agg(F.array_join(F.collect_list("m"), "").alias("body"))  # ROWS features each
    with tempfile.TemporaryDirectory() as folder:
        docs.select("name", F.encode(F.concat(F.lit(HEAD), "body", F.lit(TAIL)), "utf-8").alias("content")).repartition(documents).write.parquet(f"{folder}/docs")
        docs = spark.read.parquet(f"{folder}/docs")
        size = docs.agg(F.sum(F.length("content"))).first()[0] / 1e6
        schema = {"no": "bigint", "kind": "text", "height": "double", "shape": "geometry(Polygon)"}
        read(spark, docs.limit(cores), "Building", schema, ReadOptions(axis_order="xy")).write.format("noop").mode("overwrite").save()
        for what, run in (
            ("split", lambda: split_features(docs).where("kind = 'feature'").agg(F.count(F.lit(1))).collect()),
            ("scan", lambda: scan(spark, docs)),
            ("read", lambda: read(spark, docs, "Building", schema, ReadOptions(axis_order="xy")).write.format("noop").mode("overwrite").save()),
        ):
            began = time.time()
            run()
            took = time.time() - began
            print(f"{what}: {took:.1f} s, {size / took:.0f} MB/s, {documents * ROWS / took / 1000:.0f} k features/s ({size:.0f} MB, {cores} cores)", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(*map(int, sys.argv[1:]))
