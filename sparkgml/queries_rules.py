"""Queries over single rules of reading and inference, with their SQL."""

from __future__ import annotations

import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .api import ReadOptions, pick, read, read_layer, scan
from .functions.columns import wkb_bbox, wkb_text
from .functions.geometry import ends, read_wkb, simplify_types, wkt
from .operators.observe import observations_of, observe
from .plans.infer import InferenceOptions
from .plans.schema import LayerSchema, SchemaError, column_names, parse_type, portable, split_path, type_string
from .queries import HEAD, TAIL, documents, orders_gml, table, tag
from .queries_geometry import XY, of_parts
from .queries_sources import folder, schema_rows
from .sources.inputs import filesystem_read
from .sources.split import SplitOptions, split_features
from .operators.sinks import write_geoparquet


class Files(BaseHTTPRequestHandler):
    """Gives one document; fails at first, as services do."""

    body = b""
    failures = [1]

    def log_message(self, *_) -> None:
        pass

    def do_GET(self) -> None:
        if self.failures:
            self.failures.pop()
            self.send_error(503)
            return
        self.send_response(200)
        self.end_headers()
        self.wfile.write(self.body)


def http_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of a web server, asked for again after a failure."""
    members = "".join(f"<gml:featureMember><t:N><t:key>{r.n_nationkey}</t:key></t:N></gml:featureMember>" for r in table(spark, sf_dir, "nation").collect())
    host = spark.conf.get("spark.driver.host", "127.0.0.1")
    server = ThreadingHTTPServer((host, 0), type("Nations", (Files,), {"body": (HEAD + members + TAIL).encode(), "failures": [1]}))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return read(spark, f"http://{host}:{server.server_port}/nations.gml", "N", {"key": "bigint"})


def refused_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DTD, an end tag too many, a document that ends early, no document: each is refused for its own reason."""
    kinds = F.array(*map(F.lit, ("<!DOCTYPE a><a/>", "<a></b>", "<a><c>", "", "<gml:a/>")))
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.encode(F.element_at(kinds, (F.col("n_nationkey") % 5 + 1).cast("int")), "utf-8").alias("content"))
    seen = split_features(docs, SplitOptions(skip_malformed=True))
    reason = F.regexp_replace(F.get_json_object("info", "$.error"), r"( [a-z]*)? (at|after) byte.*", "")
    return seen.groupBy("kind", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def inherited_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection's envelope hands its CRS and dimension down to geometries without any."""
    head = HEAD + '<gml:boundedBy><gml:Envelope srsName="urn:ogc:def:crs:EPSG::4326" srsDimension="3"><gml:lowerCorner>40 0 0</gml:lowerCorner><gml:upperCorner>60 90 9</gml:upperCorner></gml:Envelope></gml:boundedBy>'
    k = F.col("s_suppkey")
    point = F.concat(F.lit("<gml:LineString><gml:posList>"), (k % 10 + 50).cast("string"), F.lit(" 1 2 50 3 4</gml:posList></gml:LineString>"))
    docs = documents(table(spark, sf_dir, "supplier"), "s_suppkey", tag("S", tag("key", k), tag("g", point)), head)
    return read(spark, docs, "S", {"key": "bigint", "g": "geometry"}, ReadOptions(axis_order="authority")).select("key", wkb_text("g").alias("wkt"))


def two_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of one local name in two namespaces are told apart by Clark names; the local name alone is ambiguous."""
    k = F.col("n_nationkey")
    f = F.concat(F.when(k % 2 == 0, F.lit('<N xmlns="urn:a"><key>')).otherwise(F.lit('<N xmlns="urn:b"><key>')), k.cast("string"), F.lit("</key></N>"))
    docs = documents(table(spark, sf_dir, "nation"), "n_nationkey", f)
    layers = scan(spark, docs).layers
    try:
        pick("N", layers)
    except SchemaError as e:
        ambiguous = "ambiguous" in str(e)
    return read(spark, docs, "{urn:b}N", {"key": "bigint"}).select("key", F.lit(",".join(sorted(layers))).alias("layers"), F.lit(ambiguous).alias("ambiguous"))


def column_name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest ends of paths that are unique, and numbers where whole paths are equal."""
    cases = [["a/x", "b/x", "c"], ["a/b/x", "c/b/x"], ["a", "a"], ["p/x", "x"]]
    rows = [(i, p, n) for i, paths in enumerate(cases) for p, n in zip(paths, column_names([split_path(p) for p in paths]), strict=True)]
    return spark.createDataFrame(rows, "no int, path string, name string")


def type_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of types, and how they are written in settings."""
    given = ["varchar", "int4", "int8[]", "float8", "timestamptz", "geometry(point,xyz)", "geometry(MultiPolygon)[]", "bool", "bytea"]
    rows = [(g, type_string(LayerSchema.given("A", {"c": g}).columns[0])) for g in given]
    assert all(parse_type(s) for _, s in rows)
    return spark.createDataFrame(rows, "given string, written string")


def time_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One zone for all values is kept in the metadata, several make date-times aware, some with and some without make text."""
    k = F.col("s_suppkey")
    day, clock = F.lit("2021-03-04"), F.lit("2021-03-04T05:06:07")
    zone = F.when(k % 2 == 0, F.lit("Z")).otherwise(F.lit("+02:00"))
    f = tag("S", tag("fixed", clock, "+02:00"), tag("mixed", F.concat(clock, zone)), tag("plain", clock), tag("some", F.concat(clock, F.when(k % 2 == 0, F.lit("Z")).otherwise(F.lit("")))), tag("day", F.concat(day, F.lit("-05:00"))), tag("days", F.concat(day, zone)), tag("hour", F.lit("05:06:07Z")))
    s = scan(spark, documents(table(spark, sf_dir, "supplier"), "s_suppkey", f)).schema("S")
    return spark.createDataFrame([(c.name, c.type, c.metadata.get("gml:tz_offset")) for c in s.columns], "name string, type string, zone string")


def number_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading zeros, signs, exponents, long numbers: what a type can give back is typed, all else stays text."""
    k = F.col("s_suppkey").cast("string")
    f = tag("S", tag("whole", k), tag("zeros", F.concat(F.lit("00"), k)), tag("plus", F.concat(F.lit("+"), k)), tag("point", F.concat(k, F.lit(".50"))), tag("power", F.concat(k, F.lit("e3"))), tag("long", F.concat(F.lit("9007199254740993.1"), k)), tag("huge", F.concat(F.lit("99999999999999999999"), k)), tag("special", F.lit("INF")))
    return schema_rows(spark, scan(spark, documents(table(spark, sf_dir, "supplier"), "s_suppkey", f)).schema("S"))


def float_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits after the point and significant digits, as written."""
    seen = observe(observations_of(orders_gml(spark, sf_dir), SplitOptions())).where("path = 'price'")
    return seen.select("max_scale", "max_digits")


def innermost_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists within lists are one list: its anchor is the innermost repeated element."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(tag("line", tag("part", tag("no", F.col("l_linenumber"))), tag("part", tag("no", F.col("l_linenumber") + 10)))), "").alias("lines"))
    docs = documents(o, "l_orderkey", tag("Order", tag("key", F.col("l_orderkey")), F.col("lines")))
    found = scan(spark, docs)
    paths = ",".join(sorted(c.path for c in found.schema("Order").columns))
    return read(spark, docs, "Order", found.schema("Order")).agg(F.sum(F.size("no")).alias("n"), F.sum(F.aggregate("no", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("total"), F.first(F.lit(paths)).alias("paths"))


def optional_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second value is an error of its feature, and so is a missing one that has to be there."""
    k = F.col("s_suppkey")
    v = F.when(k % 3 == 0, F.concat(tag("v", k), tag("v", k))).when(k % 3 == 1, tag("v", k))
    docs = documents(table(spark, sf_dir, "supplier"), "s_suppkey", tag("S", tag("key", k), v))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("v", T.LongType(), False)])
    layer = read_layer(spark, docs, "S", schema, ReadOptions(on_feature_error="skip"))
    return layer.report().groupBy("message").agg(F.count(F.lit(1)).alias("n")).unionByName(layer.df.agg(F.lit("read").alias("message"), F.count(F.lit(1)).alias("n")))


def wildcard_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """* stands for any one element, {uri}name for one of a namespace."""
    k = F.col("s_suppkey")
    f = tag("S", F.when(k % 2 == 0, tag("a", tag("v", k))).otherwise(tag("b", tag("v", k))), F.lit('<x:w xmlns:x="urn:x">1</x:w>'), tag("w", F.lit("2")))
    return read(spark, documents(table(spark, sf_dir, "supplier"), "s_suppkey", f), "S", {"v": {"type": "bigint", "path": "*/v"}, "w": {"type": "bigint", "path": "{urn:x}w"}})


def geometry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated geometries are a list of them."""
    k = F.col("p_partkey")
    points = [tag("at", F.concat(F.lit("<gml:Point><gml:pos>"), (F.col("p_size") + i).cast("string"), F.lit(" 0</gml:pos></gml:Point>"))) for i in range(2)]
    df = read(spark, documents(table(spark, sf_dir, "part"), "p_partkey", tag("P", tag("key", k), *points)), "P", {"key": "bigint", "at": {"type": "geometry(Point)[]", "path": "at[]"}}, XY)
    return df.select("key", F.explode("at").alias("g")).select("key", wkb_bbox("g")["xmin"].alias("x")).groupBy("key").agg(F.sum("x").alias("x"))


@F.pandas_udf(T.StringType())
def facts(g: pd.Series) -> pd.Series:
    """The simplest type of a geometry, and whether it ends where it starts."""
    out = []
    for v in g:
        x = simplify_types(read_wkb(bytes(v)))
        out.append(f"{wkt(x).partition(' ')[0]} {ends(x)[0] == ends(x)[1]}")
    return pd.Series(out)


def simple_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of straight segments are lines; a ring is closed."""
    markup = "<gml:Curve><gml:segments><gml:LineStringSegment><gml:posList>0 0 {s} 0 {s} {s} 0 0</gml:posList></gml:LineStringSegment></gml:segments></gml:Curve>"
    return read(spark, of_parts(spark, sf_dir, markup), "P", {"key": "bigint", "g": "geometry"}, XY).groupBy(facts("g").alias("facts")).agg(F.count(F.lit(1)).alias("n"))


def geo_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What GeoParquet files say of themselves."""
    import io
    import json

    import pyarrow.parquet as pq

    path = folder(spark)
    polygon = '<gml:Polygon srsName="EPSG:2180"><gml:exterior><gml:LinearRing><gml:posList>0 0 {s} 0 {s} {s} 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>'
    layer = read_layer(spark, of_parts(spark, sf_dir, polygon), "P", None, XY)
    files = write_geoparquet(layer.df, path, settings="{}").collect()
    seen = [pq.ParquetFile(io.BytesIO(filesystem_read(f"{path}/{r.file}"))).metadata for r in files]
    columns = [json.loads(m.metadata[b"geo"])["columns"]["g"] for m in seen]
    rows = {(c["encoding"], ",".join(c["geometry_types"]), c["crs"]["id"]["code"], c["covering"]["bbox"]["xmin"][0]) for c in columns}
    return spark.createDataFrame([(*r, sum(m.num_rows for m in seen), max(c["bbox"][2] for c in columns)) for r in rows], "encoding string, kinds string, code bigint, covering string, n bigint, xmax double")


def merged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas of files that differ in their numbers are the same once what is local to a file is left out."""
    k = F.col("s_suppkey")
    docs = [documents(table(spark, sf_dir, "supplier"), "s_suppkey", tag("S", tag("key", k), tag("x", F.concat(k.cast("string"), F.lit(end))))) for end in (".5", ".25")]
    structs = [scan(spark, d).schema("S").struct() for d in docs]
    same = [a == b for a, b in ((structs[0].jsonValue(), structs[1].jsonValue()), (portable(structs[0]).jsonValue(), portable(structs[1]).jsonValue()))]
    return spark.createDataFrame([tuple(same)], "as_inferred boolean, portable boolean")


def conservative_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a sample, values are only typed where enough were seen."""
    options = ReadOptions(sample_total=20, inference=InferenceOptions(min_typed_values=10))
    few = ReadOptions(sample_total=5, inference=InferenceOptions(min_typed_values=10))
    docs = orders_gml(spark, sf_dir)
    rows = [(n, next(c.type for c in scan(spark, docs, o).schema("Order").columns if c.name == "key")) for n, o in ((20, options), (5, few))]
    return spark.createDataFrame(rows, "n bigint, type string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    http_url, refused_documents, inherited_bounds, two_namespaces, column_name_rules, type_strings, time_zones, number_rules, float_shape, innermost_anchor, optional_values, wildcard_paths,
    geometry_list, simple_types, geo_metadata, merged_files, conservative_sample,
)}

ORACLE_SQL: dict[str, str] = {
    "http_url": "SELECT n_nationkey AS key FROM nation",
    "refused_documents": "SELECT 'skipped' AS kind, list_extract(['a DTD is not supported', 'not well formed: end tag', 'not well formed: no </c', 'not well formed: no element', 'not well formed: unbound prefix gml'], CAST(n_nationkey % 5 + 1 AS INTEGER)) AS reason, count(*) AS n FROM nation GROUP BY 1, 2",
    "inherited_bounds": "SELECT s_suppkey AS key, 'LINESTRING Z (1 ' || (s_suppkey % 10 + 50) || ' 2, 3 50 4)' AS wkt FROM supplier",
    "two_namespaces": "SELECT n_nationkey AS key, '{urn:a}N,{urn:b}N' AS layers, true AS ambiguous FROM nation WHERE n_nationkey % 2 = 1",
    "column_name_rules": "SELECT CAST(no AS INTEGER) AS no, path, name FROM (VALUES (0, 'a/x', 'a/x'), (0, 'b/x', 'b/x'), (0, 'c', 'c'), (1, 'a/b/x', 'a/b/x'), (1, 'c/b/x', 'c/b/x'), (2, 'a', 'a'), (2, 'a', 'a#2'), (3, 'p/x', 'p/x'), (3, 'x', 'x')) t(no, path, name)",
    "type_strings": "SELECT * FROM (VALUES ('varchar', 'text'), ('int4', 'integer'), ('int8[]', 'bigint[]'), ('float8', 'double'), ('timestamptz', 'timestamptz'), ('geometry(point,xyz)', 'geometry(Point,XYZ)'), ('geometry(MultiPolygon)[]', 'geometry(MultiPolygon)[]'), ('bool', 'boolean'), ('bytea', 'bytea')) t(given, written)",
    "time_zones": "SELECT * FROM (VALUES ('fixed', 'timestamp', '+02:00'), ('mixed', 'timestamp', NULL), ('plain', 'timestamp_ntz', NULL), ('some', 'string', NULL), ('day', 'date', '-05:00'), ('days', 'string', NULL), ('hour', 'time', '+00:00')) t(name, type, zone)",
    "number_rules": "SELECT * FROM (VALUES ('whole', 'whole', 'bigint'), ('zeros', 'zeros', 'string'), ('plus', 'plus', 'string'), ('point', 'point', 'double'), ('power', 'power', 'double'), ('long', 'long', 'string'), ('huge', 'huge', 'string'), ('special', 'special', 'string')) t(name, path, type)",
    "float_shape": "SELECT max(CASE WHEN strpos(p, '.') > 0 THEN length(p) - strpos(p, '.') ELSE 0 END) AS max_scale, max(length(replace(p, '.', ''))) AS max_digits FROM (SELECT CAST(o_totalprice AS VARCHAR) AS p FROM orders)",
    "innermost_anchor": "SELECT CAST(2 * count(*) AS BIGINT) AS n, CAST(sum(2 * l_linenumber + 10) AS BIGINT) AS total, 'key,line/part[]/no' AS paths FROM lineitem",
    "optional_values": "SELECT CASE s_suppkey % 3 WHEN 0 THEN 'v: a second value' WHEN 2 THEN 'v: no value' ELSE 'read' END AS message, count(*) AS n FROM supplier GROUP BY 1",
    "wildcard_paths": "SELECT s_suppkey AS v, CAST(1 AS BIGINT) AS w FROM supplier",
    "geometry_list": "SELECT p_partkey AS key, CAST(2 * p_size + 1 AS DOUBLE) AS x FROM part",
    "simple_types": "SELECT 'LINESTRING True' AS facts, count(*) AS n FROM part",
    "geo_metadata": "SELECT 'WKB' AS encoding, 'Polygon' AS kinds, CAST(2180 AS BIGINT) AS code, 'g_bbox' AS covering, count(*) AS n, CAST(max(p_size) + 1 AS DOUBLE) AS xmax FROM part",
    "merged_files": "SELECT false AS as_inferred, true AS portable",
    "conservative_sample": "SELECT CAST(n AS BIGINT) AS n, type FROM (VALUES (20, 'bigint'), (5, 'string')) t(n, type)",
}
