import pytest
from pyspark.sql import functions as F

from sparkgml.api import ReadOptions, read, scan
from sparkgml.functions.columns import wkb_text
from sparkgml.functions.geometry import GeometryError
from sparkgml.functions.native import multi_polygon, with_geoarrow
from sparkgml.functions.project import Transform
from sparkgml.plans.infer import tz_shape
from sparkgml.plans.schema import SchemaError
from sparkgml.proj import TransformerGroup

from .test_reading import doc

XY = ReadOptions(axis_order="xy")


def geometry(inner):
    return f'<t:A><t:k>1</t:k><t:g>{inner}</t:g></t:A>'


POLYGON = "<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 4 0 4 4 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>"


def test_native_layouts(spark):
    points = read(spark, {"d": doc(geometry("<gml:Point><gml:pos>1 2</gml:pos></gml:Point>"), "<t:A><t:k>2</t:k></t:A>")}, "A", {"k": "bigint", "g": "geometry"}, XY)
    flat = with_geoarrow(points, "g", "Point")
    assert [(r.k, r.g.asDict() if r.g else None) for r in flat.orderBy("k").collect()] == [(1, {"x": 1.0, "y": 2.0}), (2, None)] and flat.schema["g"].metadata["ARROW:extension:name"] == "geoarrow.point"
    shapes = read(spark, {"d": doc(geometry(POLYGON))}, "A", {"k": "bigint", "g": "geometry"}, XY)
    assert [[(p.x, p.y) for p in r] for r in with_geoarrow(shapes, "g", "Polygon").first().g] == [[(0, 0), (4, 0), (4, 4), (0, 0)]]
    assert len(with_geoarrow(shapes, "g", "MultiPolygon", 3).first().g[0][0]) == 4
    with pytest.raises(Exception, match="Polygon in a column of Point"):
        with_geoarrow(shapes, "g", "Point").collect()
    with pytest.raises(GeometryError):
        with_geoarrow(shapes, "g", "CurvePolygon")


def test_polygons_of_a_group(spark):
    df = read(spark, {"d": doc(geometry(POLYGON), geometry(f"<gml:MultiSurface><gml:surfaceMember>{POLYGON}</gml:surfaceMember></gml:MultiSurface>"), "<t:A><t:k>2</t:k></t:A>")}, "A", {"k": "bigint", "g": "geometry"}, XY)
    got = {r.k: r.wkt for r in df.groupBy("k").agg(multi_polygon("g").alias("g")).select("k", wkb_text("g").alias("wkt")).collect()}
    assert got == {1: "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 0)), ((0 0, 4 0, 4 4, 0 0)))", 2: None}
    assert df.agg(F.count("g")).first()[0] == 2


def test_warnings_and_options(spark):
    point = '<gml:Point srsName="{}"><gml:pos>50 10</gml:pos></gml:Point>'
    data = doc(geometry(point.format("urn:nobody:1")), geometry(point.format("EPSG:1")), geometry(point.format("EPSG:4258"))).replace(b"<gml:featureMember>", b'<gml:featureMember xlink:href="#x"/><gml:featureMember>', 1)
    found = scan(spark, {"d": data, "e": b'<f:FeatureCollection xmlns:f="http://www.opengis.net/wfs"/>'})
    assert [k for k, _ in found.warnings()] == ["skipped source", "referenced member", "unknown CRS", "unknown srsName", "axis conflict"]
    options = ReadOptions.from_json('{"axis_order": "xy", "inference": {"preset": "strings", "per_layer": [["A", {"lists": false}]]}, "split": {"layers": ["A"]}}')
    assert options.inference.for_layer("A").lists is False and options.split.layers == ["A"] and {c.type for c in scan(spark, {"d": data}, options).schema("A").columns} == {"string", "geometry"}
    for bad in ('{"nope": 1}', '{"inference": {"nope": 1}}'):
        with pytest.raises(SchemaError):
            ReadOptions.from_json(bad)
    assert [tz_shape({"n_zone": z, "n_values": 2, "zone_min": a, "zone_max": b}) for z, a, b in ((0, None, None), (1, 0, 0), (2, 0, 0), (2, 0, 60))] == ["absent", "inconsistent", "fixed", "mixed"]


def test_bounds_and_groups():
    arctic = Transform(3995, 4326)
    assert arctic.convert_bounds((-1e6, -1e6, 1e6, 1e6))[2:] == (180.0, 90.0)
    west, _, east, _ = Transform(32601, 4326).convert_bounds((100000, 0, 400000, 100000))
    assert west > 0 > east and 179 < west < 180 and -179 < east < -177
    assert Transform(32633, 4326).convert_bounds((400000, 5400000, 600000, 5600000))[0] == pytest.approx(13.6, abs=0.1)
    group = TransformerGroup(5514, 4326, always_xy=True)
    assert group.accuracies == [1.0, 6.0] and group.transformers[0].transform(-744000.0, -1042000.0) != group.transformers[1].transform(-744000.0, -1042000.0)
