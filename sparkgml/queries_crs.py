"""Queries over CRSs, operations, geodesics and table functions, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .api import ReadOptions, read, scan
from .functions.columns import XY as PAIR
from .functions.columns import geod_area, geod_direct, geod_inverse, register
from .functions.crs_text import Compound, from_user_input, identify, to_proj, to_projjson, to_wkt
from .functions.geodesic import Ellipsoid
from .functions.operations import Pipeline, SelectedTransform
from .plans.infer import InferenceOptions
from .queries import documents, orders_gml, place_xy, places, table, tag
from .queries_geometry import XY
from .queries_sources import schema_rows, written
from .sources.udtf import register as register_functions
from .sources.wfs import hint_of

PLACE = {"key": "bigint", "at": "geometry(Point)"}


def lune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles between two meridians, the equator and the pole: known shares of the whole ellipsoid."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    width = (k % 170 + 1).cast("string")
    ring = F.concat(F.lit('<gml:Polygon srsName="EPSG:4326"><gml:exterior><gml:LinearRing><gml:posList>0 0 '), width, F.lit(" 0 0 90 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>"))
    df = read(spark, documents(s, "s_suppkey", tag("S", tag("key", k), tag("shape", ring))), "S", {"key": "bigint", "shape": "geometry"}, XY)
    return df.select("key", geod_area("shape").alias("a")).select("key", F.round(F.col("a.area") / 1e6, 1).alias("km2"), F.round("a.perimeter", 3).alias("perimeter"))


def there_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct problem takes what the inverse gives, also nearly to the other end of the world."""
    k = F.col("s_suppkey")
    lon, lat = (k % 179).cast("double"), (k % 89).cast("double")
    s = table(spark, sf_dir, "supplier").select(k.alias("key"), geod_inverse(F.lit(0.0), F.lit(-0.5), lon, lat).alias("g"))
    s = s.select("key", geod_direct(F.lit(0.0), F.lit(-0.5), F.col("g.azimuth1"), F.col("g.distance")).alias("p"))
    return s.select("key", (F.round("p.lon", 8) + 0.0).alias("lon"), (F.round("p.lat", 8) + 0.0).alias("lat"))


def antipodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    lon = (k % 360 - 180).cast("double")
    s = table(spark, sf_dir, "supplier").select(k.alias("key"), geod_inverse(lon, F.lit(0.0), lon + 180, F.lit(0.0)).alias("g"))
    return s.select("key", F.round("g.distance", 3).alias("distance"))


#: What users write for a CRS, and the codes that mean the same.
TEXTS = {
    "EPSG:2180": "2180", "+proj=utm +zone=33 +datum=WGS84": "32633", "+proj=utm +zone=33 +south +datum=WGS84": "32733", "+proj=longlat +datum=WGS84": "4326", "WGS 84 / World Mercator": "3395",
    "+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80": "3035", "urn:ogc:def:crs,crs:EPSG::25832,crs:EPSG::7837": "25832+7837",
}


def crs_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for text in TEXTS:
        crs = from_user_input(text)
        rows.append((text, f"{crs.horizontal.code}+{crs.vertical}" if isinstance(crs, Compound) else str(identify(crs)[0])))
    return spark.createDataFrame(rows, "given string, code string")


ROUND_TRIPS = (4326, 4258, 3395, 2180, 3035, 3034, 2154, 5070, 27700, 28992, 32633)


def crs_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions without their codes, through each kind of text, are found again."""
    rows = []
    for code in ROUND_TRIPS:
        crs = from_user_input(code)
        bare = {"wkt2": to_wkt(crs).replace(f',ID["EPSG",{code}]', ""), "wkt1": to_wkt(crs, 1).replace(f',AUTHORITY["EPSG","{code}"]', ""), "projjson": {k: v for k, v in to_projjson(crs).items() if k != "id"}} | ({"proj": to_proj(crs)} if crs.datum in ("WGS84", "ETRS89") else {})
        rows += [(code, kind, code in identify(from_user_input(text))) for kind, text in bare.items()]
    return spark.createDataFrame(rows, "code bigint, kind string, found boolean")


def run_pipeline(x: Column, y: Column, text: str) -> Column:
    @F.pandas_udf(PAIR)
    def convert(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        u, v, *_ = Pipeline(text).convert(a.to_numpy(float), b.to_numpy(float))
        return pd.DataFrame({"x": u, "y": v})

    return convert(x, y)


def pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latitude first, in degrees, to three projections of a sphere."""
    x, y = place_xy()
    text = "+proj=pipeline +R=6371000 +step +proj=axisswap +order=2,1 +step +proj=unitconvert +xy_in=deg +xy_out=rad +step +proj={}"
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), *[run_pipeline(y, x, text.format(m)).alias(m) for m in ("merc", "sinu", "cea")])
    return s.select("key", *[F.round(f"{m}.{c}", 3).alias(f"{m}_{c}") for m in ("merc", "sinu", "cea") for c in "xy"])


def helmert_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid to geocentric, seven parameters, back to the grid by the inverse pipeline."""
    text = "+proj=pipeline +step +inv +proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy +step +proj=cart +ellps=airy +step +proj=helmert +x=446.448 +y=-125.157 +z=542.06 +rx=0.15 +ry=0.247 +rz=0.842 +s=-20.489 +convention=position_vector"

    @F.pandas_udf(PAIR)
    def back(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        u, v, *_ = Pipeline(text).convert(*Pipeline(text).convert(a.to_numpy(float), b.to_numpy(float))[:3], inverse=True)
        return pd.DataFrame({"x": u, "y": v})

    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("key"), back((400000 + k % 1000 * 100).cast("double"), (200000 + k % 1000 * 100).cast("double")).alias("p"))
    return s.select("key", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


def operation_for_each_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better operation holds in the west of the datum's area only."""

    @F.pandas_udf(T.DoubleType())
    def accuracy(lon: pd.Series, lat: pd.Series) -> pd.Series:
        t = SelectedTransform(5514, 4326)
        return pd.Series([t.candidates[i].accuracy for i in t.chosen(lon.to_numpy(float), lat.to_numpy(float))])

    k = F.col("s_suppkey")
    lon = (k % 10).cast("double") + 12.5
    return table(spark, sf_dir, "supplier").select(k.alias("key"), accuracy(lon, F.lit(49.0)).alias("accuracy"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered functions within SQL."""
    register(spark)
    read(spark, places(spark, sf_dir, "EPSG:4326", False), "S", PLACE, XY).createOrReplaceTempView("sparkgml_places")
    return spark.sql("SELECT key, round(b.xmin, 3) AS x, round(b.ymin, 3) AS y FROM (SELECT key, wkb_bbox(wkb_transform(at, 4326, 3857)) AS b FROM sparkgml_places)")


def read_gml_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_functions(spark)
    path = written(orders_gml(spark, sf_dir), ("gml", "zip", "gml.gz"))
    return spark.sql(f"SELECT key, status FROM read_gml('{path}', 'Order', 'axis_order=xy') WHERE urgent")


def read_gml_files_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function over a table of files: Spark deals them to its tasks."""
    register_functions(spark)
    spark.read.format("binaryFile").load(written(orders_gml(spark, sf_dir), ("gml", "zip"))).createOrReplaceTempView("sparkgml_files")
    settings = '{"format_version": 1, "layers": {"Order": {"key": "bigint", "status": "text"}}}'
    return spark.sql(f"SELECT status, count(*) AS n, sum(key) AS total FROM read_gml_files(TABLE(SELECT path, content FROM sparkgml_files), 'Order', '{settings}') GROUP BY status")


def gml_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    heads = {"2": '<gml:FeatureCollection xmlns:gml="http://www.opengis.net/gml" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:t="urn:test" xsi:schemaLocation="u http://schemas.opengis.net/gml/2.1.2/feature.xsd">', "3.1": '<gml:FeatureCollection xmlns:gml="http://www.opengis.net/gml" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:t="urn:test" xsi:schemaLocation="u http://schemas.opengis.net/gml/3.1.1/base/gml.xsd">', "3.2": '<gml:FeatureCollection xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:t="urn:test">', "3.3": '<gml:FeatureCollection xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:ce="http://www.opengis.net/gml/3.3/ce" xmlns:t="urn:test">'}
    return spark.createDataFrame([(v, scan(spark, documents(n, "n_nationkey", tag("N", tag("key", F.col("n_nationkey"))), head)).schema("N").versions) for v, head in heads.items()], "written string, found string")


XSD = b'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="N" type="t:NType"/><xs:complexType name="NType"><xs:sequence><xs:element name="key" type="xs:string"/><xs:element name="empty" type="xs:int"/><xs:element name="never" type="xs:date"/><xs:element name="place" type="gml:PointPropertyType"/></xs:sequence></xs:complexType></xs:schema>'


def declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared types fill in where no value was seen, and never override what was."""
    n = table(spark, sf_dir, "nation")
    options = ReadOptions(inference=InferenceOptions(hint=hint_of(XSD, "t:N")))
    return schema_rows(spark, scan(spark, documents(n, "n_nationkey", tag("N", tag("key", F.col("n_nationkey")), tag("empty"))), options).schema("N"))


def geometry_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    point = F.concat(F.lit('<gml:Point gml:id="P.'), k.cast("string"), F.lit('"><gml:pos>1 2</gml:pos></gml:Point>'))
    df = read(spark, documents(n, "n_nationkey", tag("N", tag("key", k), tag("at", point))), "N", None, ReadOptions(axis_order="xy", inference=InferenceOptions(geometry_ids=True)))
    return df.select("key", F.col("`@id`").alias("id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    lune, there_and_back, antipodes, crs_texts, crs_round_trips, pipelines, helmert_chain, operation_for_each_point, sql_functions, read_gml_sql, read_gml_files_sql, gml_versions, declared_types, geometry_identifiers,
)}

_QUARTER = float(10001965.729312731)  # from the equator to a pole
_PLACE = "SELECT s_suppkey AS key, CAST(s_suppkey % 80 + 0.5 AS DOUBLE) AS x, CAST(s_suppkey % 40 + 40.25 AS DOUBLE) AS y FROM supplier"
ORACLE_SQL: dict[str, str] = {
    "lune": f"SELECT s_suppkey AS key, round({Ellipsoid().area / 1e6!r} * (s_suppkey % 170 + 1) / 720.0, 1) AS km2, round(2 * {_QUARTER!r} + 6378137.0 * radians(CAST(s_suppkey % 170 + 1 AS DOUBLE)), 3) AS perimeter FROM supplier",
    "there_and_back": "SELECT s_suppkey AS key, CAST(s_suppkey % 179 AS DOUBLE) AS lon, CAST(s_suppkey % 89 AS DOUBLE) AS lat FROM supplier",
    "antipodes": f"SELECT s_suppkey AS key, round(2 * CAST({_QUARTER!r} AS DOUBLE), 3) AS distance FROM supplier",
    "crs_texts": f"SELECT * FROM (VALUES {', '.join(str(x) for x in TEXTS.items())}) t(given, code)",
    "crs_round_trips": f"SELECT CAST(c AS BIGINT) AS code, kind, true AS found FROM (VALUES {', '.join(f'({c})' for c in ROUND_TRIPS)}) a(c), (VALUES ('wkt2'), ('wkt1'), ('projjson'), ('proj')) b(kind) WHERE kind <> 'proj' OR c NOT IN (5070, 27700, 28992)",
    "pipelines": f"SELECT key, round(6371000 * radians(x), 3) AS merc_x, round(6371000 * ln(tan(pi() / 4 + radians(y) / 2)), 3) AS merc_y, round(6371000 * radians(x) * cos(radians(y)), 3) AS sinu_x, round(6371000 * radians(y), 3) AS sinu_y, round(6371000 * radians(x), 3) AS cea_x, round(6371000 * sin(radians(y)), 3) AS cea_y FROM ({_PLACE})",
    "helmert_chain": "SELECT s_suppkey AS key, CAST(400000 + s_suppkey % 1000 * 100 AS DOUBLE) AS x, CAST(200000 + s_suppkey % 1000 * 100 AS DOUBLE) AS y FROM supplier",
    "operation_for_each_point": "SELECT s_suppkey AS key, CASE WHEN s_suppkey % 10 + 12.5 <= 18.86 THEN 1.0 ELSE 6.0 END AS accuracy FROM supplier",
    "sql_functions": f"SELECT key, round(6378137.0 * radians(x), 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(y) / 2)), 3) AS y FROM ({_PLACE})",
    "read_gml_sql": "SELECT o_orderkey AS key, o_orderstatus AS status FROM orders WHERE o_orderpriority = '1-URGENT'",
    "read_gml_files_sql": "SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1",
    "gml_versions": "SELECT v AS written, v AS found FROM (VALUES ('2'), ('3.1'), ('3.2'), ('3.3')) t(v)",
    "declared_types": "SELECT * FROM (VALUES ('key', 'key', 'bigint'), ('empty', 'empty', 'bigint'), ('never', 'never', 'date'), ('place', 'place', 'geometry')) t(name, path, type)",
    "geometry_identifiers": "SELECT n_nationkey AS key, 'P.' || n_nationkey AS id FROM nation",
}
