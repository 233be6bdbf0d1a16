"""Vectorised functions on WKB and coordinate columns, and their SQL registrations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.split import parse_element
from .crs import parse_srs
from .geometry import Geometry, bbox, linearize, read_wkb, reverse, swap_xy, wkt, write_wkb
from .gml_geometry import Scope, geometry, srs_of
from .geodesic import polygon_area, solve_direct, solve_inverse
from .project import Transform

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])
INVERSE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("azimuth1", "azimuth2", "distance")])
DIRECT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("lon", "lat", "azimuth")])
XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def each(s: pd.Series, f: Callable[[Geometry], object]) -> list:
    return [None if v is None else f(read_wkb(bytes(v))) for v in s]


def points_of(g: pd.Series) -> np.ndarray | None:
    """Positions of a column of two-dimensional little-endian points; None if it has anything else."""
    if not len(g) or g.isna().any() or not (g.str.len() == 21).all():
        return None
    raw = np.frombuffer(b"".join(g), np.dtype([("head", "u1", 5), ("xy", "<f8", 2)]))
    return raw["xy"] if (raw["head"] == [1, 1, 0, 0, 0]).all() else None


@F.pandas_udf(BOX)
def wkb_bbox(g: pd.Series) -> pd.DataFrame:
    """Box of each geometry, arcs as far as they reach; NaN for empty ones, null for null."""
    if (xy := points_of(g)) is not None:
        return pd.DataFrame(np.concatenate([xy, xy], axis=1), columns=["xmin", "ymin", "xmax", "ymax"])
    boxes = each(g, lambda x: (bbox(x) or (np.nan,) * 4)[:4])
    return pd.DataFrame([(None,) * 4 if b is None else b for b in boxes], columns=["xmin", "ymin", "xmax", "ymax"], dtype=object)


@F.pandas_udf(T.StringType())
def wkb_text(g: pd.Series) -> pd.Series:
    return pd.Series(each(g, wkt), dtype=object)


@F.pandas_udf(T.StringType())
def wkb_kind(g: pd.Series) -> pd.Series:
    return pd.Series(each(g, lambda x: x[0]), dtype=object)


@F.pandas_udf(T.BinaryType())
def wkb_swap_xy(g: pd.Series) -> pd.Series:
    return pd.Series(each(g, lambda x: write_wkb(swap_xy(x))), dtype=object)


@F.pandas_udf(T.BinaryType())
def wkb_reverse(g: pd.Series) -> pd.Series:
    return pd.Series(each(g, lambda x: write_wkb(reverse(x))), dtype=object)


@F.pandas_udf(T.BinaryType())
def wkb_linearize(g: pd.Series) -> pd.Series:
    return pd.Series(each(g, lambda x: write_wkb(linearize(x))), dtype=object)


def wkb_transform(g: Column, source: int, target: int) -> Column:
    """Geometries from one CRS to another, easting first on both sides."""

    @F.pandas_udf(T.BinaryType())
    def convert(s: pd.Series) -> pd.Series:
        from ..operators.parse import converted_all

        return pd.Series([None if g is None else write_wkb(g) for g in converted_all(each(s, lambda x: x), Transform(source, target))], dtype=object)

    return convert(g)


def convert_xy(x: Column, y: Column, source: int, target: int, authority_order: bool = False) -> Column:
    """struct<x, y> of converted coordinates, whole batches at once."""

    @F.pandas_udf(XY)
    def convert(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        u, v = Transform(source, target, authority_order=authority_order).convert(a.to_numpy(float), b.to_numpy(float))
        return pd.DataFrame({"x": u, "y": v})

    return convert(x, y)


@F.pandas_udf(INVERSE)
def geod_inverse(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.DataFrame:
    a, b, s, _ = solve_inverse(lon1.to_numpy(float), lat1.to_numpy(float), lon2.to_numpy(float), lat2.to_numpy(float))
    return pd.DataFrame({"azimuth1": a, "azimuth2": b, "distance": s})


@F.pandas_udf(DIRECT)
def geod_direct(lon: pd.Series, lat: pd.Series, azimuth: pd.Series, distance: pd.Series) -> pd.DataFrame:
    x, y, a = solve_direct(lon.to_numpy(float), lat.to_numpy(float), azimuth.to_numpy(float), distance.to_numpy(float))
    return pd.DataFrame({"lon": x, "lat": y, "azimuth": a})


AREA = T.StructType([T.StructField(n, T.DoubleType()) for n in ("area", "perimeter")])


@F.pandas_udf(AREA)
def geod_area(g: pd.Series) -> pd.DataFrame:
    """Area and perimeter on WGS 84 of polygons of longitudes and latitudes: shells count, holes are taken off."""

    def one(x: Geometry) -> tuple[float, float]:
        kind, _, parts = x
        if kind == "MultiPolygon":
            return tuple(map(sum, zip(*map(one, parts), strict=True))) if parts else (0.0, 0.0)
        if kind != "Polygon":
            return 0.0, 0.0
        rings = [polygon_area([p[0] for p in r], [p[1] for p in r]) for r in parts]
        return sum((abs(a) if i == 0 else -abs(a)) for i, (a, _) in enumerate(rings)), sum(p for _, p in rings)

    return pd.DataFrame([(None, None) if v is None else v for v in each(g, one)], columns=["area", "perimeter"], dtype=object)


@F.pandas_udf(T.BinaryType())
def gml_to_wkb(xml: pd.Series) -> pd.Series:
    """One GML geometry element as WKB, as written; prefixes gml and xlink need no declaration."""
    prefixes = {"gml": "http://www.opengis.net/gml/3.2", "xlink": "http://www.w3.org/1999/xlink"}

    def one(text: str | None):
        if text is None:
            return None
        node = parse_element(text.encode("utf-8"), prefixes)
        return write_wkb(geometry(node, Scope(srs_of(node))))

    return pd.Series([one(v) for v in xml], dtype=object)


@F.pandas_udf(T.StringType())
def srs_code(name: pd.Series) -> pd.Series:
    """EPSG:code of a srsName in any spelling, null if it isn't known."""
    return pd.Series([None if v is None else parse_srs(v).authority_code() for v in name], dtype=object)


def strip_local_hash(ref: Column) -> Column:
    return F.regexp_replace(ref, "^#", "")


@F.pandas_udf(T.BinaryType())
def wkb_transform_codes(g: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
    """wkb_transform() for SQL, where the codes are columns."""
    from ..operators.parse import converted

    known: dict[tuple[int, int], Transform] = {}

    def one(v, a, b):
        if v is None:
            return None
        key = int(a), int(b)
        if key not in known:
            known[key] = Transform(*key)
        return write_wkb(converted(read_wkb(bytes(v)), known[key]))

    return pd.Series([one(*r) for r in zip(g, source, target, strict=True)], dtype=object)


@F.pandas_udf(XY)
def convert_xy_codes(x: pd.Series, y: pd.Series, source: pd.Series, target: pd.Series) -> pd.DataFrame:
    """convert_xy() for SQL, where the codes are columns."""
    out = pd.DataFrame({"x": np.nan, "y": np.nan}, index=x.index)
    for (a, b), at in x.groupby([source, target]).groups.items():
        u, v = Transform(int(a), int(b)).convert(x[at].to_numpy(float), y[at].to_numpy(float))
        out.loc[at, "x"], out.loc[at, "y"] = u, v
    return out


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL."""
    for name, f in (("wkb_bbox", wkb_bbox), ("wkb_text", wkb_text), ("wkb_kind", wkb_kind), ("wkb_swap_xy", wkb_swap_xy), ("wkb_linearize", wkb_linearize), ("wkb_reverse", wkb_reverse), ("srs_code", srs_code), ("wkb_transform", wkb_transform_codes), ("convert_xy", convert_xy_codes), ("geod_inverse", geod_inverse), ("geod_direct", geod_direct), ("geod_area", geod_area), ("gml_to_wkb", gml_to_wkb)):
        spark.udf.register(name, f)
