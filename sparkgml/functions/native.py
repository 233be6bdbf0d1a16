"""Geometries as nested columns of separate coordinates, and several polygons as one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geometry import GeometryError, fit_kind, read_wkb, with_dimension, write_wkb

#: How deep positions stand in each kind, and the names of the encodings.
DEPTH = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}


def nested_type(kind: str, dim: int = 2) -> T.DataType:
    out: T.DataType = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"[:dim]])
    for _ in range(DEPTH[kind]):
        out = T.ArrayType(out)
    return out


def nested(wkb: bytes, kind: str, dim: int):
    """A geometry as lists of {x, y}; single ones as the one member of a column of several."""
    found, _, parts = with_dimension(fit_kind(read_wkb(bytes(wkb)), kind), dim)
    position = lambda p: dict(zip("xyz"[:dim], p, strict=True))
    line = lambda ps: [position(p) for p in ps]
    if found == "Point":
        return None if not parts else position(parts)
    if found == "LineString":
        return line(parts)
    if found == "Polygon":
        return [line(r) for r in parts]
    inner = [p[2] for p in parts]
    return line(inner) if found == "MultiPoint" else [line(p) for p in inner] if found == "MultiLineString" else [[line(r) for r in p] for p in inner]


def with_geoarrow(df: DataFrame, column: str, kind: str, dim: int = 2) -> DataFrame:
    """`df` with a WKB column as the native layout of one kind; curves and other kinds are errors."""
    if kind not in DEPTH:
        raise GeometryError(f"no native layout of {kind}")
    old = df.schema[column]
    field = T.StructField(column, nested_type(kind, dim), old.nullable, (old.metadata or {}) | {"ARROW:extension:name": f"geoarrow.{kind.lower()}"})
    schema = T.StructType([field if f.name == column else f for f in df.schema.fields])
    at = df.columns.index(column)

    def work(batches: Iterator[pa.RecordBatch]):
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(field.dataType)
        for b in batches:
            values = pa.array([None if v is None else nested(v, kind, dim) for v in b.column(at).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([values if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    out = df.mapInArrow(work, schema)
    return out.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=dict(f.metadata or {})) for f in schema.fields])


@F.pandas_udf(T.BinaryType())
def multi_polygon(g: pd.Series) -> bytes | None:
    """An aggregate: all polygons of a group, members of several ones too, as one MultiPolygon."""
    parts = []
    for v in g:
        if v is None:
            continue
        x = read_wkb(bytes(v))
        if x[0] not in ("Polygon", "MultiPolygon"):
            raise GeometryError(f"{x[0]} among polygons")
        parts += x[2] if x[0] == "MultiPolygon" else [x]
    return write_wkb(("MultiPolygon", max(p[1] for p in parts), parts)) if parts else None
