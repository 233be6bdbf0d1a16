"""Arriving documents as a stream of rows, under a given schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import ReadPlan, parse_layer
from ..plans.schema import LayerSchema
from ..sources.inputs import SCHEMA, opened
from ..sources.split import SplitOptions, split_features


def read_stream(spark: SparkSession, path: str, schema: LayerSchema, *, options: SplitOptions | None = None, plan: ReadPlan | None = None, max_files: int = 1000, glob: str = "*.{gml,xml,gz,zst,zip}") -> DataFrame:
    """Rows of a layer of every file that arrives in a folder.

    A stream can't look ahead, so its schema is given and the axis order is a
    fixed mode of `plan` (or what names alone tell). Each file is read once;
    repeated features go with dropDuplicatesWithinWatermark on the user's
    columns.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", max_files).option("pathGlobFilter", glob).load(path)
    docs = files.select(F.col("path").alias("name"), "content").mapInArrow(opened({}), SCHEMA)
    return parse_layer(split_features(docs, options), plan or ReadPlan(schema))
