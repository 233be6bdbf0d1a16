"""Queries over each way to write a geometry, and over what can be done with geometries; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import ReadOptions, read, read_layer
from .functions.columns import wkb_bbox, wkb_kind, wkb_linearize, wkb_reverse, wkb_text, wkb_transform
from .queries import documents, table, tag

XY = ReadOptions(axis_order="xy")
RING = "0 0 {s} 0 {s} {s} 0 0"
LINE, POLYGON = "<gml:LineString><gml:posList>0 0 {s} 0</gml:posList></gml:LineString>", f"<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>{RING}</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>"
PATCH = f"<gml:exterior><gml:LinearRing><gml:posList>{RING}</gml:posList></gml:LinearRing></gml:exterior>"
CE = 'xmlns:ce="http://www.opengis.net/gml/3.3/ce"'
WKT_RING, WKT_LINE = "(0 0, {s} 0, {s} {s}, 0 0)", "LINESTRING (0 0, {s} 0, {s} {s})"

#: Name: markup with {s} for a row's size, and the WKT that reading it gives.
FORMS = {
    "line_string": ("<gml:LineString><gml:posList>0 0 {s} 0 {s} {s}</gml:posList></gml:LineString>", WKT_LINE),
    "pos_elements": ("<gml:LineString><gml:pos>0 0</gml:pos><gml:pos>{s} 0</gml:pos><gml:pointProperty><gml:Point><gml:pos>{s} {s}</gml:pos></gml:Point></gml:pointProperty></gml:LineString>", WKT_LINE),
    "coordinates": ('<gml:LineString><gml:coordinates decimal="." cs="," ts=" ">0,0 {s},0 {s},{s}</gml:coordinates></gml:LineString>', WKT_LINE),
    "coordinates_marks": ('<gml:LineString><gml:coordinates decimal="," cs=";" ts="|">0,5;0|{s},5;0</gml:coordinates></gml:LineString>', "LINESTRING (0.5 0, {s}.5 0)"),
    "coord": ("<gml:LineString><gml:coord><gml:X>0</gml:X><gml:Y>1</gml:Y></gml:coord><gml:coord><gml:X>{s}</gml:X><gml:Y>1</gml:Y></gml:coord></gml:LineString>", "LINESTRING (0 1, {s} 1)"),
    "point_3d": ('<gml:Point srsDimension="3"><gml:pos>{s} 1 2</gml:pos></gml:Point>', "POINT Z ({s} 1 2)"),
    "polygon_hole": ("<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 9{s} 0 9{s} 9{s} 0 9{s} 0 0</gml:posList></gml:LinearRing></gml:exterior><gml:interior><gml:LinearRing><gml:posList>1 1 2 1 2 2 1 1</gml:posList></gml:LinearRing></gml:interior></gml:Polygon>", "POLYGON ((0 0, 9{s} 0, 9{s} 9{s}, 0 9{s}, 0 0), (1 1, 2 1, 2 2, 1 1))"),
    "polygon_gml2": ("<gml:Polygon><gml:outerBoundaryIs><gml:LinearRing><gml:coordinates>0,0 {s},0 {s},{s} 0,0</gml:coordinates></gml:LinearRing></gml:outerBoundaryIs></gml:Polygon>", f"POLYGON ({WKT_RING})"),
    "surface": (f"<gml:Surface><gml:patches><gml:PolygonPatch>{PATCH}</gml:PolygonPatch></gml:patches></gml:Surface>", f"POLYGON ({WKT_RING})"),
    "surface_patches": (f"<gml:Surface><gml:patches><gml:Triangle>{PATCH}</gml:Triangle><gml:Rectangle><gml:exterior><gml:LinearRing><gml:posList>-1 -1 -2 -1 -2 -2 -1 -2 -1 -1</gml:posList></gml:LinearRing></gml:exterior></gml:Rectangle></gml:patches></gml:Surface>", f"MULTIPOLYGON ({WKT_RING.join('()')}, ((-1 -1, -2 -1, -2 -2, -1 -2, -1 -1)))"),
    "orientable_curve": ('<gml:OrientableCurve orientation="-"><gml:baseCurve><gml:LineString><gml:posList>0 0 {s} 0 {s} {s}</gml:posList></gml:LineString></gml:baseCurve></gml:OrientableCurve>', "LINESTRING ({s} {s}, {s} 0, 0 0)"),
    "orientable_surface": (f'<gml:OrientableSurface orientation="-"><gml:baseSurface>{POLYGON}</gml:baseSurface></gml:OrientableSurface>', "POLYGON ((0 0, {s} {s}, {s} 0, 0 0))"),
    "composite_surface": (f"<gml:CompositeSurface><gml:surfaceMember>{POLYGON}</gml:surfaceMember><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 {{s}} {{s}} 0 {{s}} 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:CompositeSurface>".replace("{{s}}", "{s}"), f"MULTIPOLYGON ({WKT_RING.join('()')}, ((0 0, {{s}} {{s}}, 0 {{s}}, 0 0)))".replace("{{s}}", "{s}")),
    "curve_segments": ("<gml:Curve><gml:segments><gml:LineStringSegment><gml:posList>0 0 {s} 0</gml:posList></gml:LineStringSegment><gml:LineStringSegment><gml:posList>{s} 0 {s} {s}</gml:posList></gml:LineStringSegment></gml:segments></gml:Curve>", WKT_LINE),
    "compound_curve": ("<gml:Curve><gml:segments><gml:LineStringSegment><gml:posList>-99 0 -{s} 0</gml:posList></gml:LineStringSegment><gml:Arc><gml:posList>-{s} 0 0 {s} {s} 0</gml:posList></gml:Arc></gml:segments></gml:Curve>", "COMPOUNDCURVE ((-99 0, -{s} 0), CIRCULARSTRING (-{s} 0, 0 {s}, {s} 0))"),
    "arc_string": ("<gml:Curve><gml:segments><gml:ArcString><gml:posList>0 0 1 1 2 0 3 -1 4 {s}</gml:posList></gml:ArcString></gml:segments></gml:Curve>", "CIRCULARSTRING (0 0, 1 1, 2 0, 3 -1, 4 {s})"),
    "arc_bulge": ('<gml:Curve><gml:segments><gml:ArcByBulge numArc="1"><gml:posList>0 0 {s} 0</gml:posList><gml:bulge>1</gml:bulge><gml:normal>1</gml:normal></gml:ArcByBulge></gml:segments></gml:Curve>', None),
    "composite_curve": ("<gml:CompositeCurve><gml:curveMember><gml:LineString><gml:posList>0 0 {s} 0</gml:posList></gml:LineString></gml:curveMember><gml:curveMember><gml:LineString><gml:posList>{s} 0 {s} {s}</gml:posList></gml:LineString></gml:curveMember></gml:CompositeCurve>", WKT_LINE),
    "ring_of_curves": (f"<gml:Polygon><gml:exterior><gml:Ring><gml:curveMember>{LINE}</gml:curveMember><gml:curveMember><gml:LineString><gml:posList>{{s}} 0 {{s}} {{s}} 0 0</gml:posList></gml:LineString></gml:curveMember></gml:Ring></gml:exterior></gml:Polygon>".replace("{{s}}", "{s}"), f"POLYGON ({WKT_RING})"),
    "multi_point": ("<gml:MultiPoint><gml:pointMember><gml:Point><gml:pos>0 0</gml:pos></gml:Point></gml:pointMember><gml:pointMembers><gml:Point><gml:pos>{s} 0</gml:pos></gml:Point><gml:Point><gml:pos>1 1</gml:pos></gml:Point></gml:pointMembers></gml:MultiPoint>", "MULTIPOINT ((0 0), ({s} 0), (1 1))"),
    "multi_line_gml2": ("<gml:MultiLineString><gml:lineStringMember><gml:LineString><gml:coordinates>0,0 {s},0</gml:coordinates></gml:LineString></gml:lineStringMember></gml:MultiLineString>", "MULTILINESTRING ((0 0, {s} 0))"),
    "multi_curve": (f"<gml:MultiCurve><gml:curveMember>{LINE}</gml:curveMember></gml:MultiCurve>", "MULTILINESTRING ((0 0, {s} 0))"),
    "multi_surface": (f"<gml:MultiSurface><gml:surfaceMember>{POLYGON}</gml:surfaceMember></gml:MultiSurface>", f"MULTIPOLYGON (({WKT_RING}))"),
    "multi_geometry": (f"<gml:MultiGeometry><gml:geometryMember><gml:Point><gml:pos>{{s}} 0</gml:pos></gml:Point></gml:geometryMember><gml:geometryMember>{LINE}</gml:geometryMember></gml:MultiGeometry>".replace("{{s}}", "{s}"), "GEOMETRYCOLLECTION (POINT ({s} 0), LINESTRING (0 0, {s} 0))"),
    "envelope": ("<gml:Envelope><gml:lowerCorner>0 0</gml:lowerCorner><gml:upperCorner>{s} 1</gml:upperCorner></gml:Envelope>", "POLYGON ((0 0, {s} 0, {s} 1, 0 1, 0 0))"),
    "box_gml2": ("<gml:Box><gml:coordinates>0,0 {s},1</gml:coordinates></gml:Box>", "POLYGON ((0 0, {s} 0, {s} 1, 0 1, 0 0))"),
    "simple_polygon": (f"<ce:SimplePolygon {CE}><gml:posList>0 0 {{s}} 0 {{s}} {{s}}</gml:posList></ce:SimplePolygon>".replace("{{s}}", "{s}"), f"POLYGON ({WKT_RING})"),
    "simple_rectangle": (f"<ce:SimpleRectangle {CE}><gml:posList>0 0 {{s}} 0 {{s}} 1 0 1</gml:posList></ce:SimpleRectangle>".replace("{{s}}", "{s}"), "POLYGON ((0 0, {s} 0, {s} 1, 0 1, 0 0))"),
}
FORMS = {k: (a.replace("{{s}}", "{s}"), b.replace("{{s}}", "{s}") if b else b) for k, (a, b) in FORMS.items() if b}


def of_parts(spark: SparkSession, sf_dir: str, markup: str, column: str = "g") -> DataFrame:
    """Documents with a geometry of each part's size."""
    p = table(spark, sf_dir, "part")
    shape = F.replace(F.lit(markup), F.lit("{s}"), (F.col("p_size") + 1).cast("string"))
    return documents(p, "p_partkey", tag("P", tag("key", F.col("p_partkey")), tag(column, shape)))


SHAPE = {"key": "bigint", "g": "geometry"}


def form_query(markup: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, of_parts(spark, sf_dir, markup), "P", SHAPE, XY).select("key", wkb_text("g").alias("wkt"))

    return run


def form_sql(text: str) -> str:
    return f"SELECT p_partkey AS key, replace('{text}', '{{s}}', CAST(p_size + 1 AS VARCHAR)) AS wkt FROM part"


def extent(df: DataFrame) -> DataFrame:
    """Kind, the kind without arcs, and the box to a millionth."""
    df = df.select("key", wkb_kind("g").alias("kind"), wkb_kind(wkb_linearize("g")).alias("linear"), wkb_bbox("g").alias("b"))
    return df.select("key", "kind", "linear", *[(F.round(f"b.{c}", 6) + 0.0).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


CENTRE = "<gml:Curve><gml:segments><gml:{0} numArc=\"1\"><gml:pos>0 0</gml:pos><gml:radius uom=\"m\">{{s}}</gml:radius>{1}</gml:{0}></gml:segments></gml:Curve>"


def arc_by_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From north to south by way of east: angles of planar arcs count from the first axis."""
    arc = CENTRE.format("ArcByCenterPoint", '<gml:startAngle uom="deg">0</gml:startAngle><gml:endAngle uom="deg">180</gml:endAngle>')
    return extent(read(spark, of_parts(spark, sf_dir, arc), "P", SHAPE, XY))


def circle_by_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extent(read(spark, of_parts(spark, sf_dir, CENTRE.format("CircleByCenterPoint", "")), "P", SHAPE, XY))


def circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    markup = "<gml:Curve><gml:segments><gml:Circle><gml:posList>{s} 0 0 {s} -{s} 0</gml:posList></gml:Circle></gml:segments></gml:Curve>"
    return extent(read(spark, of_parts(spark, sf_dir, markup), "P", SHAPE, XY))


def arc_by_bulge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulge of 1 on a chord of twice the size."""
    markup = '<gml:Curve><gml:segments><gml:ArcByBulge numArc="1"><gml:posList>-{s} 0 {s} 0</gml:posList><gml:bulge>1</gml:bulge><gml:normal>1</gml:normal></gml:ArcByBulge></gml:segments></gml:Curve>'
    return extent(read(spark, of_parts(spark, sf_dir, markup), "P", SHAPE, XY)).select("key", "kind", "linear", "xmin", "xmax", "ymax")


def bounded_by_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = (F.col("p_size") + 1).cast("string")
    bounds = F.concat(F.lit("<gml:boundedBy><gml:Envelope><gml:lowerCorner>0 1</gml:lowerCorner><gml:upperCorner>"), size, F.lit(" "), size, F.lit("</gml:upperCorner></gml:Envelope></gml:boundedBy>"))
    df = read(spark, documents(p, "p_partkey", tag("P", bounds, tag("key", F.col("p_partkey")))), "P", {"key": "bigint", "box": {"type": "geometry(Box)", "path": "boundedBy"}}, XY)
    return df.select("key", "box.xmin", "box.ymin", "box.xmax", "box.ymax")


def array_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array property's members become one multi geometry."""
    df = read(spark, of_parts(spark, sf_dir, "<gml:Point><gml:pos>0 0</gml:pos></gml:Point><gml:Point><gml:pos>{s} 1</gml:pos></gml:Point>", "gArrayProperty"), "P", {"key": "bigint", "g": {"type": "geometry", "path": "gArrayProperty"}}, XY)
    return df.select("key", wkb_text("g").alias("wkt"))


def unsupported_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A solid can't be held: the geometry is null, and the report says so."""
    options = ReadOptions(axis_order="xy", on_feature_error="null_geometry")
    layer = read_layer(spark, of_parts(spark, sf_dir, "<gml:Solid/>"), "P", SHAPE, options)
    rows = layer.df.agg(F.count(F.lit(1)).alias("n"), F.count("g").alias("n_geometries"))
    return rows.crossJoin(layer.report().groupBy("kind").agg(F.count(F.lit(1)).alias("n_reports")))  # one row each


def reversed_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, of_parts(spark, sf_dir, FORMS["line_string"][0]), "P", SHAPE, XY)
    return df.select("key", wkb_text(wkb_reverse("g")).alias("wkt"))


def bbox_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes meet a window: what a reader of a covering column filters by."""
    df = read(spark, of_parts(spark, sf_dir, POLYGON), "P", SHAPE, XY).withColumn("b", wkb_bbox("g"))
    return df.where("b.xmax >= 10 and b.ymax >= 10 and b.xmin <= 20 and b.ymin <= 20").select("key")


def either_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of two geometry columns is filled; the other's place is taken."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    f = tag("P", tag("key", k), F.when(k % 2 == 0, tag("at", F.lit("<gml:Point><gml:pos>1 2</gml:pos></gml:Point>"))).otherwise(tag("area", F.replace(F.lit(POLYGON), F.lit("{s}"), F.lit("3")))))
    df = read(spark, documents(p, "p_partkey", f), "P", {"key": "bigint", "at": "geometry", "area": "geometry"}, XY)
    return df.groupBy(wkb_kind(F.coalesce("at", "area")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def world_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World Mercator has the ellipsoid's ordinate; an equal-area grid and back keeps every point."""
    df = read(spark, of_parts(spark, sf_dir, '<gml:Point srsName="EPSG:4326"><gml:pos>{s} {s}</gml:pos></gml:Point>'), "P", SHAPE, XY)
    df = df.select("key", wkb_bbox(wkb_transform(F.col("g"), 4326, 3395)).alias("m"), wkb_bbox(wkb_transform(wkb_transform(F.col("g"), 4326, 6933), 6933, 4326)).alias("b"))
    return df.select("key", F.round("m.xmin", 3).alias("x"), F.round("m.ymin", 3).alias("y"), F.round("b.xmin", 7).alias("lon"), F.round("b.ymin", 7).alias("lat"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"form_{k}": form_query(a) for k, (a, _) in FORMS.items()} | {f.__name__: f for f in (
    arc_by_centre, circle_by_centre, circle, arc_by_bulge, bounded_by_box, array_property, unsupported_to_null, reversed_line, bbox_prefilter, either_geometry, world_mercator,
)}

_S = "CAST(p_size + 1 AS DOUBLE)"
_CIRCLE = f"SELECT p_partkey AS key, 'CircularString' AS kind, 'LineString' AS linear, -{_S} AS xmin, -{_S} AS ymin, {_S} AS xmax, {_S} AS ymax FROM part"
ORACLE_SQL: dict[str, str] = {f"form_{k}": form_sql(b) for k, (_, b) in FORMS.items()} | {
    "arc_by_centre": f"SELECT p_partkey AS key, 'CircularString' AS kind, 'LineString' AS linear, -{_S} AS xmin, CAST(0 AS DOUBLE) AS ymin, {_S} AS xmax, {_S} AS ymax FROM part",
    "circle_by_centre": _CIRCLE,
    "circle": _CIRCLE,
    "arc_by_bulge": f"SELECT p_partkey AS key, 'CircularString' AS kind, 'LineString' AS linear, -{_S} AS xmin, {_S} AS xmax, CAST(1 AS DOUBLE) AS ymax FROM part",
    "bounded_by_box": f"SELECT p_partkey AS key, CAST(0 AS DOUBLE) AS xmin, CAST(1 AS DOUBLE) AS ymin, {_S} AS xmax, {_S} AS ymax FROM part",
    "array_property": "SELECT p_partkey AS key, 'MULTIPOINT ((0 0), (' || (p_size + 1) || ' 1))' AS wkt FROM part",
    "unsupported_to_null": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_geometries, 'warning' AS kind, count(*) AS n_reports FROM part",
    "reversed_line": form_sql("LINESTRING ({s} {s}, {s} 0, 0 0)"),
    "bbox_prefilter": "SELECT p_partkey AS key FROM part WHERE p_size + 1 >= 10",
    "either_geometry": "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'Point' ELSE 'Polygon' END AS kind, count(*) AS n FROM part GROUP BY 1",
    "world_mercator": """WITH p AS (SELECT p_partkey AS key, CAST(p_size + 1 AS DOUBLE) AS s, radians(CAST(p_size + 1 AS DOUBLE)) AS f, 0.0818191908426215 AS e FROM part)
        SELECT key, round(6378137.0 * f, 3) AS x, round(6378137.0 * (ln(tan(pi() / 4 + f / 2)) + e / 2 * ln((1 - e * sin(f)) / (1 + e * sin(f)))), 3) AS y, s AS lon, s AS lat FROM p""",
}
