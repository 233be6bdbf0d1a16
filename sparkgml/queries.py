"""The engine's queries over the test tables and their SQL.

The tables hold no GML, so each query writes documents from a table's rows
with SQL string functions, one for each bucket of keys, and reads them back
through the engine; the SQL says the same of the table itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .api import ReadOptions, read, read_layer, scan
from .functions.columns import convert_xy, geod_inverse, strip_local_hash, wkb_bbox, wkb_kind, wkb_linearize, wkb_swap_xy, wkb_text, wkb_transform
from .functions.lexical import as_type
from .operators.observe import observations, observe
from .sources.split import SplitOptions, split_features

FLAGSHIP = "typed_scalars"
HEAD = '<gml:FeatureCollection xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:t="urn:test">'
TAIL = "</gml:FeatureCollection>"
#: Keys of one document's bucket: rows of a document, not documents, stay few as tables grow.
DOC_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tag(name: str, *values: Column | str, attrs: Column | str = "") -> Column:
    """<name attrs>values</name>; null values are left out."""
    parts = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return F.concat(F.lit(f"<t:{name}"), attrs if isinstance(attrs, Column) else F.lit(attrs), F.lit(">"), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.lit(f"</t:{name}>"))


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def documents(rows: DataFrame, key: str, feature: Column, head: str = HEAD) -> DataFrame:
    """(name, content): one document for each bucket of keys."""
    member = F.concat(F.lit("<gml:featureMember>"), feature, F.lit("</gml:featureMember>"))
    parts = rows.sparkSession.sparkContext.defaultParallelism  # a given number: small texts, but much work on each
    docs = rows.select(F.floor(F.col(key) / DOC_ROWS).cast("string").alias("name"), member.alias("m")).repartition(parts, "name").groupBy("name").agg(F.array_join(F.collect_list("m"), "\n").alias("body"))
    return docs.select("name", F.encode(F.concat(F.lit(head), "body", F.lit(TAIL)), "utf-8").alias("content"))


def orders_gml(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    f = tag("Order", tag("key", F.col("o_orderkey")), tag("customer", attrs=F.concat(F.lit(' xlink:href="#C.'), F.col("o_custkey").cast("string"), F.lit('"'))), tag("price", F.col("o_totalprice")), tag("date", F.date_format("o_orderdate", "yyyy-MM-dd"), "Z"), tag("at", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")), tag("urgent", (F.col("o_orderpriority") == "1-URGENT").cast("string")), tag("status", F.col("o_orderstatus")), attrs=F.concat(F.lit(' gml:id="O.'), F.col("o_orderkey").cast("string"), F.lit('"')))
    return documents(o, "o_orderkey", f)


ORDER = {"id": {"type": "text", "path": "@id"}, "key": "bigint", "customer": {"type": "text", "path": "customer/@href"}, "price": "double", "date": "date", "at": "timestamp", "urgent": "boolean", "status": "text"}
XY = ReadOptions(axis_order="xy")


def split_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = split_features(orders_gml(spark, sf_dir))
    return features.where("kind = 'feature'").groupBy(F.col("source").cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def layer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    f = F.when(F.col("k") % 3 == 0, tag("Road", tag("key", F.col("k")))).otherwise(tag("Building", tag("key", F.col("k"))))
    features = split_features(documents(s, "k", f), SplitOptions(layers=["t:Road"]))
    return features.where("kind = 'feature'").groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, orders_gml(spark, sf_dir), "Order", ORDER)


def typed_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir)
    return df.withColumns({"date": df["date"].cast("string"), "at": df["at"].cast("string")})


def column_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", as_type(F.concat(F.lit(" +"), F.col("o_orderkey").cast("string")), "bigint").alias("k"), as_type(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("+02:00")), "date").cast("string").alias("d"), as_type(F.lit("yes"), "boolean").alias("b"), as_type(F.col("o_totalprice").cast("string"), "double").alias("price"))


def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(spark, orders_gml(spark, sf_dir))
    return spark.createDataFrame([(c.name, c.path, c.type) for c in s.schema("Order").columns], "name string, path string, type string")


def leading_zero_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    docs = documents(s, "s_suppkey", tag("S", tag("code", F.lpad(F.col("s_suppkey").cast("string"), 8, "0"))))
    return read(spark, docs, "S")


def type_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observe(observations(split_features(orders_gml(spark, sf_dir))))
    return seen.where("path <> ''").select("path", F.col("exact").cast("bigint").alias("exact"), "n_values")


def lines_gml(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = tag("line", tag("no", F.col("l_linenumber")), F.when(F.col("l_returnflag") != "N", tag("flag", F.col("l_returnflag"))))
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), line.alias("x")))).alias("lines"))
    return documents(o, "l_orderkey", tag("Order", tag("key", F.col("l_orderkey")), F.array_join(F.col("lines.x"), "")))


def anchored_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, lines_gml(spark, sf_dir), "Order", {"key": "bigint", "no": {"type": "bigint[]", "path": "line[]/no"}, "flag": {"type": "text[]", "path": "line[]/flag"}})
    return df.select("key", F.inline(F.arrays_zip("no", "flag")))


def inferred_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, lines_gml(spark, sf_dir), "Order")
    return df.select("key", F.size("no").cast("bigint").alias("n"), F.size(F.filter("flag", lambda x: x.isNull())).cast("bigint").alias("n_null"))


def never_occurred_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of all customers; urgent ones are elements of a name of their own, which some customers lack."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.when(urgent, tag("order", F.col("o_orderkey"))).otherwise(tag("later", F.col("o_orderkey")))), "").alias("os"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    f = tag("C", tag("key", F.col("c_custkey")), F.coalesce("os", F.lit("")))
    df = read(spark, documents(c, "c_custkey", f), "C", {"key": "bigint", "orders": {"type": "bigint[]", "path": "order[]"}})
    return df.where(F.col("orders").isNull()).select("key")


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    f = tag("P", tag("size", F.col("p_size"), attrs=F.concat(F.lit(' uom="cm" kind="'), (F.col("p_partkey") % 2).cast("string"), F.lit('"'))), tag("key", F.col("p_partkey")))
    layer = read_layer(spark, documents(p, "p_partkey", f), "P")
    uom = layer.df.schema["size"].metadata["gml:attr:uom"]
    return layer.df.select("key", "size", F.col("`@kind`").alias("kind"), F.lit(uom).alias("uom"))


def xlink_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, orders_gml(spark, sf_dir), "Order", {"key": "bigint", "ref": {"type": "text", "path": "customer/@href"}})
    c = table(spark, sf_dir, "customer")
    f = tag("C", tag("segment", F.col("c_mktsegment")), attrs=F.concat(F.lit(' gml:id="C.'), F.col("c_custkey").cast("string"), F.lit('"')))
    c = read(spark, documents(c, "c_custkey", f), "C", {"id": {"type": "text", "path": "@id"}, "segment": "text"})
    return o.join(c, strip_local_hash(o["ref"]) == c["id"]).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


def unresolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order refers to its customer and every urgent one to an agent that no document has."""
    t = table(spark, sf_dir, "orders")
    ref = lambda name, prefix, of: tag(name, attrs=F.concat(F.lit(f' xlink:href="#{prefix}.'), F.col(of).cast("string"), F.lit('"')))
    agent = F.when(F.col("o_orderpriority") == "1-URGENT", ref("ref", "A", "o_orderkey"))
    docs = documents(t, "o_orderkey", tag("Order", tag("key", F.col("o_orderkey")), ref("ref", "C", "o_custkey"), agent))
    o = read(spark, docs, "Order", {"key": "bigint", "ref": {"type": "text[]", "path": "ref[]/@href"}}).select("key", F.explode("ref").alias("ref"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C."), F.col("c_custkey").cast("string")).alias("id"))
    return o.join(c, o["ref"] == c["id"], "left_anti").agg(F.count(F.lit(1)).alias("n"))


def nil_and_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    v = F.when(k % 3 == 0, tag("v", attrs=' xsi:nil="true"')).when(k % 3 == 1, tag("v", "  ")).otherwise(tag("v", k))
    return read(spark, documents(s, "s_suppkey", tag("S", tag("key", k), v)), "S", {"key": "bigint", "v": "bigint"})


def subtree_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "nation")
    f = tag("N", tag("key", F.col("n_nationkey")), tag("info", tag("name", F.col("n_name"), attrs=' lang="en"'), tag("in", tag("region", F.col("n_regionkey")))))
    df = read(spark, documents(e, "n_nationkey", f), "N", {"key": "bigint", "info": "map"})
    return df.select("key", F.col("info")["name"].alias("name"), F.col("info")["name/@lang"].alias("lang"), F.col("info")["in/region"].alias("region"), F.size("info").cast("bigint").alias("n"))


def raw_and_inner_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "region")
    f = tag("R", tag("key", F.col("r_regionkey")), tag("note", "<b>", F.col("r_name"), "</b> of the world"))
    df = read(spark, documents(e, "r_regionkey", f), "R", {"key": "bigint", "raw": {"type": "text", "path": "note"}, "inner": {"type": "text", "path": "note", "content": "inner"}})
    return df.select("key", F.col("raw"), F.col("inner"))


def skip_bad_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    docs = documents(s, "s_suppkey", tag("S", tag("key", k), tag("v", F.when(k % 7 == 0, F.lit("seven")).otherwise(k.cast("string")))))
    return read(spark, docs, "S", {"key": "bigint", "v": "bigint"}, ReadOptions(on_feature_error="skip"))


def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    docs = documents(s, "s_suppkey", tag("S", tag("key", k), tag("v", F.when(k % 7 == 0, F.lit("seven")).otherwise(k.cast("string")))))
    layer = read_layer(spark, docs, "S", {"key": "bigint", "v": "bigint"}, ReadOptions(on_feature_error="skip"))
    return layer.report().groupBy("kind", "message").agg(F.count(F.lit(1)).alias("n"))


def lon(k: Column | str) -> Column:
    return (F.col(k) % 3600) / 10.0 - 180 if isinstance(k, str) else (k % 3600) / 10.0 - 180


def point(x: Column, y: Column, srs: str) -> Column:
    return F.concat(F.lit(f'<gml:Point srsName="{srs}"><gml:pos>'), x.cast("string"), F.lit(" "), y.cast("string"), F.lit("</gml:pos></gml:Point>"))


def place_xy() -> tuple[Column, Column]:
    """Longitude and latitude of a row, from its key."""
    k = F.col("s_suppkey")
    return (k % 80).cast("double") + 0.5, (k % 40).cast("double") + 40.25


def places(spark: SparkSession, sf_dir: str, srs: str, swapped: bool) -> DataFrame:
    x, y = place_xy()
    s = table(spark, sf_dir, "supplier")
    return documents(s, "s_suppkey", tag("S", tag("key", F.col("s_suppkey")), tag("at", point(y, x, srs) if swapped else point(x, y, srs))))


PLACE = {"key": "bigint", "at": "geometry(Point)"}


def boxed(df: DataFrame) -> DataFrame:
    return df.select("key", wkb_bbox("at").alias("b")).select("key", F.col("b.xmin").alias("x"), F.col("b.ymin").alias("y"))


def point_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxed(read(spark, places(spark, sf_dir, "EPSG:4326", False), "S", PLACE, XY))


def axis_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxed(read(spark, places(spark, sf_dir, "urn:ogc:def:crs:EPSG::4326", True), "S", PLACE, ReadOptions(axis_order="authority")))


def axis_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxed(read(spark, places(spark, sf_dir, "urn:ogc:def:crs:EPSG::4326", True), "S", PLACE))


def axis_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, places(spark, sf_dir, "EPSG:4326", True), "S", PLACE, XY)
    return boxed(df.select("key", wkb_swap_xy("at").alias("at")))


def point_wkb_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "region"), "r_regionkey", tag("R", tag("key", F.col("r_regionkey")), tag("at", point(F.lit("1"), F.lit("2"), "EPSG:4326"))))
    return read(spark, docs, "R", PLACE, XY).select("key", F.hex("at").alias("wkb"))


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    s = (F.col("p_size") + 1).cast("string")
    ring = F.concat(F.lit('<gml:Polygon srsName="EPSG:2180"><gml:exterior><gml:LinearRing><gml:posList>0 0 '), s, F.lit(" 0 "), s, F.lit(" "), s, F.lit(" 0 "), s, F.lit(" 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>"))
    return documents(p, "p_partkey", tag("P", tag("key", F.col("p_partkey")), tag("shape", ring)))


def polygon_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, squares(spark, sf_dir), "P", {"key": "bigint", "shape": "geometry(Polygon,XY)"}, XY)
    return df.select("key", wkb_text("shape").alias("wkt"))


def promoted_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, squares(spark, sf_dir), "P", {"key": "bigint", "shape": "geometry(MultiPolygon)"}, XY)
    return df.groupBy(wkb_kind("shape").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def bbox_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, squares(spark, sf_dir), "P", {"key": "bigint", "shape": "geometry"}, XY).select(wkb_bbox("shape").alias("b"))
    return df.agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    r = (F.col("p_size") + 1).cast("string")
    arc = F.concat(F.lit('<gml:Curve srsName="EPSG:2180"><gml:segments><gml:Arc><gml:posList>-'), r, F.lit(" 0 0 "), r, F.lit(" "), r, F.lit(" 0</gml:posList></gml:Arc></gml:segments></gml:Curve>"))
    df = read(spark, documents(p, "p_partkey", tag("P", tag("key", F.col("p_partkey")), tag("line", arc))), "P", {"key": "bigint", "line": "geometry"}, XY)
    line = df.select("key", wkb_kind("line").alias("kind"), wkb_kind(wkb_linearize("line")).alias("linear"), wkb_bbox("line").alias("b"))
    return line.select("key", "kind", "linear", F.round("b.xmax", 6).alias("xmax"), F.round("b.ymax", 6).alias("ymax"), F.round("b.ymin", 6).alias("ymin"))


def web_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = place_xy()
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), convert_xy(x, y, 4326, 3857).alias("p"))
    return s.select("key", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


def read_to_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = boxed(read(spark, places(spark, sf_dir, "EPSG:4326", False), "S", PLACE, ReadOptions(axis_order="xy", target_crs=3857)))
    return df.select("key", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def projection_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, places(spark, sf_dir, "EPSG:4258", False), "S", PLACE, XY)
    back = df.select("key", wkb_transform(wkb_transform(F.col("at"), 4258, 3035), 3035, 4258).alias("at"))
    return boxed(back).select("key", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"))


def geodesic_meridian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Along a meridian the geodesic is the meridian's arc; along the equator an arc of the semi-major axis."""
    k = F.col("s_suppkey")
    north, east = geod_inverse(F.lit(7.0), F.lit(0.0), F.lit(7.0), (k % 90).cast("double")), geod_inverse(F.lit(0.0), F.lit(0.0), (k % 90).cast("double"), F.lit(0.0))
    s = table(spark, sf_dir, "supplier").select(k.alias("key"), north.alias("n"), east.alias("e"))
    return s.select("key", F.round("n.distance", 3).alias("meridian"), F.round("e.distance", 3).alias("equator"))


def skipped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole web pages, well formed or not: none holds a feature."""
    docs = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("name"), F.encode("html", "utf-8").alias("content"))
    seen = split_features(docs, SplitOptions(allow_single_feature_root=False, skip_malformed=True))
    return seen.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir)
    return df.rollup("status", "urgent").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("price"))


def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("customer").orderBy(F.desc("price"), "key"))
    return df.select("customer", "key", place.cast("bigint").alias("place")).where("place <= 2")


def limit_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).orderBy(F.desc("price"), "key").limit(10).select("key", "price")


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of customers, of one reading: different rows of a few flags for each customer are kept for the three of them."""
    df = orders(spark, sf_dir).select("customer", "urgent", (F.col("status") == "O").alias("open"), (F.col("price") > 450000).alias("dear")).distinct().persist(StorageLevel.DISK_ONLY)
    return df.where("urgent").select("customer").intersect(df.where("open").select("customer")).subtract(df.where("dear").select("customer"))


def location_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, orders_gml(spark, sf_dir), "Order", {"key": "bigint"}, ReadOptions(location_column=True))
    return df.groupBy(F.col("_location.source").cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max((F.col("_location.end") > F.col("_location.start")).cast("bigint")).alias("whole"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    split_count, layer_filter, typed_scalars, column_lexical, infer_types, leading_zero_text, type_bitmask, anchored_lists, inferred_lists, never_occurred_anchor, attributes, xlink_join,
    unresolved_references, nil_and_empty, subtree_map, raw_and_inner_text, skip_bad_features, error_report, point_coordinates, axis_authority, axis_auto, axis_swap, point_wkb_hex, polygon_text,
    promoted_kinds, bbox_extent, arcs, web_mercator, read_to_mercator, projection_round_trip, geodesic_meridian, skipped_sources, group_rollup, window_rank, limit_topk, set_ops, location_column,
)}

_ORDERS = """SELECT 'O.' || o_orderkey AS id, o_orderkey AS key, 'C.' || o_custkey AS customer, o_totalprice AS price, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date,
    CAST(CAST(o_orderdate AS TIMESTAMP) AS VARCHAR) AS "at", o_orderpriority = '1-URGENT' AS urgent, o_orderstatus AS status FROM orders"""
_PLACE = "SELECT s_suppkey AS key, CAST(s_suppkey % 80 + 0.5 AS DOUBLE) AS x, CAST(s_suppkey % 40 + 40.25 AS DOUBLE) AS y FROM supplier"
_MERCATOR = f"SELECT key, round(6378137.0 * radians(x), 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(y) / 2)), 3) AS y FROM ({_PLACE})"

ORACLE_SQL: dict[str, str] = {
    "split_count": f"SELECT CAST(floor(o_orderkey / {DOC_ROWS}.0) AS BIGINT) AS bucket, count(*) AS n FROM orders GROUP BY 1",
    "layer_filter": "SELECT 'Road' AS layer, count(*) AS n FROM supplier WHERE s_suppkey % 3 = 0",
    "typed_scalars": _ORDERS,
    "column_lexical": "SELECT o_orderkey, o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, CAST(NULL AS BOOLEAN) AS b, o_totalprice AS price FROM orders",
    "infer_types": "SELECT * FROM (VALUES ('@id', '@id', 'string'), ('key', 'key', 'bigint'), ('customer', 'customer/@href', 'string'), ('price', 'price', 'double'), ('date', 'date', 'date'), ('at', 'at', 'timestamp_ntz'), ('urgent', 'urgent', 'boolean'), ('status', 'status', 'string')) t(name, path, type)",
    "leading_zero_text": "SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS code FROM supplier",
    "type_bitmask": "WITH n AS (SELECT count(*) AS n FROM orders) SELECT path, CAST(exact AS BIGINT) AS exact, CASE WHEN has THEN n ELSE 0 END AS n_values FROM n, (VALUES ('@id', 64, true), ('key', 70, true), ('customer', 127, false), ('customer/@href', 64, true), ('price', 68, true), ('date', 72, true), ('at', 80, true), ('urgent', 65, true), ('status', 64, true)) t(path, exact, has)",
    "anchored_lists": "SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS no, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag FROM lineitem",
    "inferred_lists": "SELECT l_orderkey AS key, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS n_null FROM lineitem GROUP BY 1",
    "never_occurred_anchor": "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "attributes": "SELECT p_partkey AS key, CAST(p_size AS BIGINT) AS size, CAST(p_partkey % 2 AS BIGINT) AS kind, 'cm' AS uom FROM part",
    "xlink_join": "SELECT c_mktsegment AS segment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "unresolved_references": "SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'",
    "nil_and_empty": "SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 2 THEN s_suppkey END AS v FROM supplier",
    "subtree_map": "SELECT n_nationkey AS key, n_name AS name, 'en' AS lang, CAST(n_regionkey AS VARCHAR) AS region, CAST(3 AS BIGINT) AS n FROM nation",
    "raw_and_inner_text": "SELECT r_regionkey AS key, '<b>' || r_name || '</b> of the world' AS raw, r_name || ' of the world' AS inner FROM region",
    "skip_bad_features": "SELECT s_suppkey AS key, s_suppkey AS v FROM supplier WHERE s_suppkey % 7 <> 0",
    "error_report": "SELECT 'value' AS kind, 'v: ''seven'' isn''t bigint' AS message, count(*) AS n FROM supplier WHERE s_suppkey % 7 = 0 HAVING count(*) > 0",
    "point_coordinates": _PLACE,
    "axis_authority": _PLACE,
    "axis_auto": _PLACE,
    "axis_swap": _PLACE,
    "point_wkb_hex": "SELECT r_regionkey AS key, '0101000000000000000000F03F0000000000000040' AS wkb FROM region",
    "polygon_text": "SELECT p_partkey AS key, 'POLYGON ((0 0, ' || s || ' 0, ' || s || ' ' || s || ', 0 ' || s || ', 0 0))' AS wkt FROM (SELECT p_partkey, CAST(p_size + 1 AS VARCHAR) AS s FROM part)",
    "promoted_kinds": "SELECT 'MultiPolygon' AS kind, count(*) AS n FROM part",
    "bbox_extent": "SELECT CAST(0 AS DOUBLE) AS xmin, CAST(0 AS DOUBLE) AS ymin, CAST(max(p_size) + 1 AS DOUBLE) AS xmax, CAST(max(p_size) + 1 AS DOUBLE) AS ymax FROM part",
    "arcs": "SELECT p_partkey AS key, 'CircularString' AS kind, 'LineString' AS linear, CAST(p_size + 1 AS DOUBLE) AS xmax, CAST(p_size + 1 AS DOUBLE) AS ymax, CAST(0 AS DOUBLE) AS ymin FROM part",
    "web_mercator": _MERCATOR,
    "read_to_mercator": _MERCATOR,
    "projection_round_trip": _PLACE,
    "geodesic_meridian": """WITH p AS (SELECT s_suppkey AS key, radians(CAST(s_suppkey % 90 AS DOUBLE)) AS f, CAST(0.0016792203863837047 AS DOUBLE) AS n FROM supplier)
        SELECT key, round(6378137.0 / (1 + n) * ((1 + n * n / 4 + n * n * n * n / 64) * f - 1.5 * (n - n * n * n / 8) * sin(2 * f) + 15.0 / 16 * (n * n - n * n * n * n / 4) * sin(4 * f)
                - 35.0 / 48 * n * n * n * sin(6 * f) + 315.0 / 512 * n * n * n * n * sin(8 * f)), 3) AS meridian, round(6378137.0 * f, 3) AS equator FROM p""",
    "skipped_sources": "SELECT 'skipped' AS kind, count(*) AS n FROM pages",
    "group_rollup": f"SELECT status, urgent, count(*) AS n, round(sum(price), 2) AS price FROM ({_ORDERS}) GROUP BY ROLLUP (status, urgent)",
    "window_rank": f"SELECT customer, key, place FROM (SELECT customer, key, row_number() OVER (PARTITION BY customer ORDER BY price DESC, key) AS place FROM ({_ORDERS})) WHERE place <= 2",
    "limit_topk": f"SELECT key, price FROM ({_ORDERS}) ORDER BY price DESC, key LIMIT 10",
    "set_ops": f"WITH o AS ({_ORDERS}) SELECT customer FROM o WHERE urgent INTERSECT SELECT customer FROM o WHERE status = 'O' EXCEPT SELECT customer FROM o WHERE price > 450000",
    "location_column": f"SELECT CAST(floor(o_orderkey / {DOC_ROWS}.0) AS BIGINT) AS bucket, count(*) AS n, CAST(1 AS BIGINT) AS whole FROM orders GROUP BY 1",
}
