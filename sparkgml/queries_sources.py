"""Queries over sources, sinks, streams, options and schemas, with their SQL."""

from __future__ import annotations

import gzip
import io
import json
import tempfile
import threading
import urllib.parse
import uuid
import zipfile
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import ReadOptions, read, scan
from .functions.columns import srs_code, wkb_bbox
from .operators.observe import observations, observations_of, observe
from .operators.sinks import filesystem, write_geoparquet, write_ipc
from .plans.infer import InferenceOptions
from .plans.schema import LayerSchema
from .queries import DOC_ROWS, HEAD, TAIL, documents, lines_gml, orders_gml, squares, table, tag
from .sources.datasource import register
from .sources.split import SplitOptions, split_features
from .sources.wfs import WfsClient
from .streaming.reader import read_stream

XY = ReadOptions(axis_order="xy")
#: Triggers of a stream over files that are all there.
TRIGGERS = 8
_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="documents-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def packed(name: str, data: bytes, kind: str) -> bytes:
    """A document as the kinds of files that are read."""
    if kind == "gml.gz":
        return gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :])
    if kind == "gml.zst":
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "zstd") as z:
            z.write(data)
        return sink.getvalue().to_pybytes()
    if kind == "zip":
        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(f"{name}/one.gml", data)
            z.writestr("notes.txt", "no document")
        return sink.getvalue()
    if kind == "xml":
        return b'<?xml version="1.0" encoding="iso-8859-2"?>' + data.decode().encode("iso-8859-2")
    return data if kind == "gml" else b"\xff\xfe" + data.decode().encode("utf-16-le")


KINDS = ("gml", "gml.gz", "gml.zst", "zip", "xml", "utf16.gml")


def written(docs: DataFrame, kinds: tuple[str, ...] = KINDS) -> str:
    """A folder with a file for each document, of one kind after another."""
    path = folder(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]):
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                kind = kinds[int(name) % len(kinds)]
                with fs.open_output_stream(f"{root}/d{name}.{kind}", compression=None) as out:
                    out.write(packed(name, data, kind))
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"])

    docs.select("name", "content").mapInArrow(work, "n long").agg(F.sum("n")).first()
    return path


KEYED = {"key": "bigint", "status": "text"}


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, gzip of two members, zstd, zip, ISO 8859-2 and UTF-16 files of one folder."""
    return read(spark, written(orders_gml(spark, sf_dir)), "Order", KEYED)


def zip_member_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = folder(spark) + ".zip"
    sink = io.BytesIO()
    doc = (HEAD + "".join(f"<gml:featureMember><t:R><t:key>{r.r_regionkey}</t:key></t:R></gml:featureMember>" for r in table(spark, sf_dir, "region").collect()) + TAIL).encode()
    with zipfile.ZipFile(sink, "w") as z:
        for name in ("a/one.gml", "a/two.gml", "a/b/three.gml", "four.gml"):
            z.writestr(name, doc)
    fs, path = filesystem(archive)
    with fs.open_output_stream(path) as out:
        out.write(sink.getvalue())
    df = read(spark, f"{archive}!/a/*.gml", "R", {"key": "bigint"})
    return df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def format_gml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data source, with the columns that are asked for and the layer that is filtered by."""
    register(spark)
    settings = json.dumps({"format_version": 1, "layers": {"Order": {"key": "bigint", "price": "double", "status": "text"}}})
    df = spark.read.format("gml").option("layer", "Order").option("settings", settings).load(written(orders_gml(spark, sf_dir), ("gml", "gml.gz", "zip")))
    return df.where("price > 100000").select("key", "status")


def geoparquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    files = write_geoparquet(read(spark, squares(spark, sf_dir), "P", {"key": "bigint", "shape": "geometry(Polygon,XY)"}, XY), path).collect()
    df = spark.read.parquet(*[f"{path}/{r.file}" for r in files])
    return df.select("key", wkb_bbox("shape")["xmax"].alias("xmax"), F.col("shape_bbox.ymax").alias("ymax"))


def ipc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    files = write_ipc(read(spark, orders_gml(spark, sf_dir), "Order", KEYED), path)

    def back(batches: Iterator[pa.RecordBatch]):
        fs, root = filesystem(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}") as f:
                    yield from (x.select(["key", "status"]) for x in pa.ipc.open_file(f).read_all().to_batches())

    return files.select("file").mapInArrow(back, "key bigint, status string")


def settings_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = orders_gml(spark, sf_dir)
    return read(spark, docs, "Order", scan(spark, docs).save()).select("key", "status", "urgent")


def preserve_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features in the order of their documents: their places count up within each."""
    options = ReadOptions(preserve_order=True, location_column=True)
    df = read(spark, orders_gml(spark, sf_dir), "Order", {"key": "bigint"}, options)
    row = F.monotonically_increasing_id()
    df = df.select("key", F.col("_location.source").alias("source"), F.col("_location.start").alias("start"), row.alias("row"))
    pair = F.array_sort(F.collect_list(F.struct("row", "start"))).alias("rows")
    rows = df.groupBy(F.col("source").cast("bigint").alias("bucket")).agg(pair, F.count(F.lit(1)).alias("n"))  # a document's features
    return rows.select("bucket", "n", (F.col("rows.start") == F.array_sort("rows.start")).alias("in_order"))


def sample_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark, orders_gml(spark, sf_dir), ReadOptions(sample_features=7))
    return spark.createDataFrame(list(found.counts.items()), "layer string, n bigint")


def columns_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, orders_gml(spark, sf_dir), "Order", None, ReadOptions(columns=["status", "key"]))


def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    f = F.when(F.col("k") % 3 == 0, tag("Road", tag("key", F.col("k")))).otherwise(tag("Building", tag("key", F.col("k"))))
    return spark.createDataFrame(list(scan(spark, documents(s, "k", f)).counts.items()), "layer string, n bigint")


def observed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observe(observations_of(lines_gml(spark, sf_dir), SplitOptions()))
    return seen.select("path", "instances", "parents", "max_occurs", "n_values", "empty", "max_len", F.col("int_min").cast("bigint").alias("int_min"), F.col("int_max").cast("bigint").alias("int_max"))


def observed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observe(observations(split_features(orders_gml(spark, sf_dir))))
    return seen.where("path in ('price', 'date', 'status')").select("path", "max_scale", "n_zone", F.col("zone_min").cast("bigint").alias("zone_min"), F.size("values").cast("bigint").alias("n_distinct"))


def observed_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observe(observations(split_features(squares(spark, sf_dir)))).where("path = 'shape'")
    return seen.select("n_geometry", F.array_join("kinds", ",").alias("kinds"), "curves", F.array_join("srs", ",").alias("srs"), F.array_join(F.col("dims").cast("array<string>"), ",").alias("dims"))


def column_crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column's CRS is the most frequent one, whatever its name."""
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.lit("EPSG:2180")).otherwise(F.lit("EPSG:4326"))
    point = F.concat(F.lit('<gml:Point srsName="'), name, F.lit('"><gml:pos>15 50</gml:pos></gml:Point>'))
    docs = documents(table(spark, sf_dir, "part"), "p_partkey", tag("P", tag("at", point)))
    column = next(c for c in scan(spark, docs).schema("P").columns if c.name == "at")
    return spark.createDataFrame([(column.metadata["gml:srs_name"], column.geom_kind)], "srs string, kind string")


def other_crs_is_an_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.lit("EPSG:2180")).otherwise(F.lit("EPSG:4326"))
    point = F.concat(F.lit('<gml:Point srsName="'), name, F.lit('"><gml:pos>15 50</gml:pos></gml:Point>'))
    docs = documents(table(spark, sf_dir, "part"), "p_partkey", tag("P", tag("key", k), tag("at", point)))
    return read(spark, docs, "P", None, ReadOptions(axis_order="xy", on_feature_error="skip")).select("key")


def schema_rows(spark: SparkSession, schema: LayerSchema) -> DataFrame:
    return spark.createDataFrame([(c.name, c.path, c.type + "[]" * c.is_list) for c in schema.columns], "name string, path string, type string")


def things(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with a wrapper, attributes, mixed text, a null with a reason, a rare element and a bounding box."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    bounds = '<gml:boundedBy><gml:Envelope srsName="EPSG:2180"><gml:lowerCorner>0 0</gml:lowerCorner><gml:upperCorner>1 1</gml:upperCorner></gml:Envelope></gml:boundedBy>'
    empty = tag("gone", attrs=F.concat(F.lit(' xsi:nil="true" nilReason="'), F.when(k % 2 == 0, F.lit("unknown")).otherwise(F.lit("missing")), F.lit('"')))
    return documents(s, "s_suppkey", tag("S", F.lit(bounds), tag("key", k), tag("part", tag("Part", tag("size", k % 100))), tag("code", F.lpad(k.cast("string"), 6, "0"), attrs=F.concat(F.lit(' kind="'), (k % 2).cast("string"), F.lit('"'))), tag("note", F.lit("a <t:b>bold</t:b> word")), empty, tag("ref", attrs=F.concat(F.lit(' xlink:href="#S.'), k.cast("string"), F.lit('" xlink:title="t'), (k % 2).cast("string"), F.lit('"'))), tag("when", F.lit("10:11:12")), F.when(k % 50 == 1, tag("rare", k + 100))))


def with_options(**of) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return schema_rows(spark, scan(spark, things(spark, sf_dir), ReadOptions(inference=InferenceOptions(**of))).schema("S"))

    return run


def reinferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another schema from the same observation, without a pass."""
    found = scan(spark, things(spark, sf_dir))
    return schema_rows(spark, found.schema_with("S", InferenceOptions(preset="strings")))


def lists_never(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_rows(spark, scan(spark, lines_gml(spark, sf_dir), ReadOptions(inference=InferenceOptions(lists=False))).schema("Order"))


def wrapper_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, things(spark, sf_dir), "S").select("key", "size", "code", "note", "ref")


def member_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of another name, one feature in each, and a collection within a member."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    body = F.concat(F.lit("<t:entry>"), tag("S", tag("key", k)), F.lit("</t:entry>"))
    rows = s.select(F.floor(k / DOC_ROWS).cast("string").alias("name"), body.alias("m")).groupBy("name").agg(F.array_join(F.collect_list("m"), "").alias("body"))  # DOC_ROWS keys each
    docs = rows.select("name", F.encode(F.concat(F.lit('<t:list xmlns:t="urn:test">'), "body", F.lit("</t:list>")), "utf-8").alias("content"))
    return read(spark, docs, "S", {"key": "bigint"}, ReadOptions(split=SplitOptions(member_rules=[("urn:test", "entry", False)])))


def single_feature_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    docs = n.select(F.col("n_nationkey").cast("string").alias("name"), F.encode(F.concat(F.lit('<Nation xmlns="urn:n"><key>'), F.col("n_nationkey").cast("string"), F.lit("</key><name>"), "n_name", F.lit("</name></Nation>")), "utf-8").alias("content"))
    return read(spark, docs, "Nation", {"key": "bigint", "name": "text"})


def referenced_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that only refer are counted; the collection says how many it matched."""
    n = table(spark, sf_dir, "nation")
    ref = F.concat(F.lit('<w:member xlink:href="#N.'), F.col("n_nationkey").cast("string"), F.lit('"/>'))
    own = F.concat(F.lit("<w:member>"), tag("N", tag("key", F.col("n_nationkey"))), F.lit("</w:member>"))
    rows = n.groupBy("n_regionkey").agg(F.array_join(F.collect_list(F.concat(own, F.when(F.col("n_nationkey") % 2 == 0, ref).otherwise(F.lit("")))), "").alias("body"), F.count(F.lit(1)).alias("c"))
    head = F.concat(F.lit('<w:FeatureCollection xmlns:w="http://www.opengis.net/wfs/2.0" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:t="urn:test" numberMatched="'), F.col("c").cast("string"), F.lit('">'))
    docs = rows.select(F.col("n_regionkey").cast("string").alias("name"), F.encode(F.concat(head, "body", F.lit("</w:FeatureCollection>")), "utf-8").alias("content"))
    seen = split_features(docs).where("kind = 'header'")
    return seen.select(F.col("source").cast("bigint").alias("region"), F.get_json_object("info", "$.referenced").cast("bigint").alias("referenced"), F.get_json_object("info", "$.features").cast("bigint").alias("features"), F.get_json_object("info", "$.attributes.numberMatched").cast("bigint").alias("matched"))


def nested_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    f = F.concat(F.lit("<gml:FeatureCollection><gml:featureMember>"), tag("N", tag("key", F.col("n_nationkey"))), F.lit("</gml:featureMember></gml:FeatureCollection>"))
    return read(spark, documents(n, "n_nationkey", f), "N", {"key": "bigint"})


def hidden_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, CDATA and quoted angle brackets hide no end of a feature."""
    n = table(spark, sf_dir, "nation")
    f = tag("N", F.lit("<!-- </t:N> -->"), tag("key", F.col("n_nationkey")), tag("name", F.lit("<![CDATA[</t:N>"), F.col("n_name"), F.lit("]]>"), attrs=' a="1 > 0"'))
    return read(spark, documents(n, "n_nationkey", f), "N", {"key": "bigint", "name": "text"})


#: Spellings of a CRS, and what they stand for.
SPELLINGS = {"EPSG:2180": "EPSG:2180", "urn:ogc:def:crs:EPSG::25832": "EPSG:25832", "http://www.opengis.net/gml/srs/epsg.xml#4326": "EPSG:4326", "http://www.opengis.net/def/crs/EPSG/0/4258": "EPSG:4258", "urn:ogc:def:crs,crs:EPSG::25832,crs:EPSG::7837": "EPSG:25832+7837", "CRS:84": "OGC:CRS84", "urn:adv:crs:ETRS89_UTM32*DE_DHHN2016_NH": "EPSG:25832", "+init=epsg:2180": "EPSG:2180"}


def srs_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("n_nationkey") % len(SPELLINGS) + 1).cast("int"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), srs_code(names).alias("code"))


def repeated_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer refers to all its orders: exploded and joined with them."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(tag("order", attrs=F.concat(F.lit(' xlink:href="#O.'), F.col("o_orderkey").cast("string"), F.lit('"')))), "").alias("refs"))
    c = read(spark, documents(o, "o_custkey", tag("C", tag("key", F.col("o_custkey")), F.col("refs"))), "C", {"key": "bigint", "ref": {"type": "text[]", "path": "order[]/@href"}})
    orders = read(spark, orders_gml(spark, sf_dir), "Order", {"id": {"type": "text", "path": "@id"}, "status": "text"})
    return c.select("key", F.explode("ref").alias("id")).join(orders, "id").groupBy("key", "status").agg(F.count(F.lit(1)).alias("n"))


def stream_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as they arrive; an order that comes twice counts once across batches, within the watermark.

    What a trigger costs besides its files (state, logs, a look at the folder)
    is paid a bounded number of times: beyond TRIGGERS * 8 files, triggers
    grow.
    """
    docs = orders_gml(spark, sf_dir)
    path, state, out = written(docs, ("gml", "gml.gz")), folder(spark), folder(spark)
    fs, root = filesystem(path)
    n_files = len(fs.get_file_info(pafs.FileSelector(root)))
    df = read_stream(spark, path, LayerSchema.given("Order", {"key": "bigint"}), max_files=max(8, -(-n_files // TRIGGERS)))
    df = df.withColumn("arrived", F.lit("2020-01-01").cast("timestamp")).withWatermark("arrived", "1 hour").dropDuplicatesWithinWatermark(["key"])
    # each of the state's partitions is written in every trigger: as many as there are cores, and their keys on disk, not in the heap
    own = {"spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism), "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    given = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        query = df.select("key").writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    finally:  # the query has its own copy
        for k, v in given.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema("key bigint").parquet(out)


class Pages(BaseHTTPRequestHandler):
    """A WFS that gives seven features at a time, whatever it is asked for."""

    rows: list[tuple] = []

    def log_message(self, *_) -> None:
        pass

    def do_GET(self) -> None:
        asked = {k.lower(): v for k, v in urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query)}
        if asked.get("request") == "GetCapabilities":
            body = '<w:WFS_Capabilities version="2.0.0" xmlns:w="http://www.opengis.net/wfs/2.0" xmlns:o="http://www.opengis.net/ows/1.1"><o:OperationsMetadata><o:Constraint name="ImplementsResultPaging"><o:DefaultValue>TRUE</o:DefaultValue></o:Constraint><o:Constraint name="CountDefault"><o:DefaultValue>10</o:DefaultValue></o:Constraint></o:OperationsMetadata><w:FeatureTypeList><w:FeatureType><w:Name>t:N</w:Name></w:FeatureType></w:FeatureTypeList></w:WFS_Capabilities>'
        else:
            start, count = int(asked.get("startindex", 0)), min(int(asked.get("count", 7)), 7)
            some = [] if asked.get("resulttype") == "hits" else self.rows[start : start + count]
            body = f'<w:FeatureCollection xmlns:w="http://www.opengis.net/wfs/2.0" xmlns:t="urn:test" numberMatched="{len(self.rows)}" numberReturned="{len(some)}">' + "".join(f"<w:member><t:N><t:key>{k}</t:key><t:name>{n}</t:name></t:N></w:member>" for k, n in some) + "</w:FeatureCollection>"
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())


def wfs_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service on the driver, read by tasks of ten features each; its pages are short."""
    handler = type("Nations", (Pages,), {"rows": sorted((r.n_nationkey, r.n_name) for r in table(spark, sf_dir, "nation").collect())})
    host = spark.conf.get("spark.driver.host", "127.0.0.1")
    server = ThreadingHTTPServer((host, 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = WfsClient(f"http://{host}:{server.server_port}/wfs")
    return read(spark, client.sources(spark, "t:N", sort_by="key"), "N", {"key": "bigint", "name": "text"})


BASE = [("key", "key", "bigint"), ("size", "part/*/size", "bigint"), ("code", "code", "string"), ("@kind", "code/@kind", "bigint"), ("note", "note", "string"), ("@nilReason", "gone/@nilReason", "string"), ("ref", "ref/@href", "string"), ("when", "when", "time"), ("rare", "rare", "bigint")]
#: Choices of inference, and what they change in the schema of things().
CHOICES: dict[str, tuple[dict, list[tuple[str, str, str]]]] = {
    "default": ({}, BASE),
    "strings": ({"preset": "strings"}, [(n, p, "string") for n, p, _ in BASE]),
    "smallest_integers": ({"integers": "smallest"}, [(n, p, "smallint" if t == "bigint" else t) for n, p, t in BASE]),
    "no_attributes": ({"attributes": False}, [c for c in BASE if c[0] != "@kind"]),
    "no_nil_reason": ({"nil_reason": False}, [("gone", "gone", "string") if c[0] == "@nilReason" else c for c in BASE]),
    "no_references": ({"xlink": "drop"}, [("ref", "ref", "string") if c[0] == "ref" else c for c in BASE]),
    "full_references": ({"xlink": "full"}, [x for c in BASE for x in ([c, ("@title", "ref/@title", "string")] if c[0] == "ref" else [c])]),
    "bounding_box": ({"bounded_by": "box"}, [("boundedBy", "boundedBy", "geometry"), *BASE]),
    "overrides": ({"overrides": {"S/part/**": "drop", "*/rare": "text", "S/code": "bigint"}}, [("rare", "rare", "string") if c[0] == "rare" else ("code", "code", "bigint") if c[0] == "code" else c for c in BASE if c[0] != "size"]),
    "lossy_numbers": ({"lossless": False}, [("@kind", "code/@kind", "boolean") if c[0] == "@kind" else c for c in BASE]),
    "no_wrappers": ({"collapse_wrappers": False}, [("size", "part/Part/size", "bigint") if c[0] == "size" else c for c in BASE]),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    mixed_files, zip_member_glob, format_gml, geoparquet_round_trip, ipc_round_trip, settings_round_trip, preserve_order, sample_features, columns_option, layer_counts, observed_counts, observed_numbers,
    observed_geometry, column_crs, other_crs_is_an_error, reinferred, lists_never, wrapper_values, member_rules, single_feature_root, referenced_members, nested_collections, hidden_markup, srs_names,
    repeated_references, stream_of_files, wfs_pages,
)} | {f"schema_{k}": with_options(**of) for k, (of, _) in CHOICES.items()}


def values(rows: list[tuple[str, str, str]]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(str(r) for r in rows)}) t(name, path, type)"


_KEYED = "SELECT o_orderkey AS key, o_orderstatus AS status FROM orders"
_BUCKETS = f"CAST(floor(o_orderkey / {DOC_ROWS}.0) AS BIGINT)"
ORACLE_SQL: dict[str, str] = {
    "mixed_files": _KEYED,
    "zip_member_glob": "SELECT r_regionkey AS key, CAST(2 AS BIGINT) AS n FROM region",
    "format_gml": f"{_KEYED} WHERE o_totalprice > 100000",
    "geoparquet_round_trip": "SELECT p_partkey AS key, CAST(p_size + 1 AS DOUBLE) AS xmax, CAST(p_size + 1 AS DOUBLE) AS ymax FROM part",
    "ipc_round_trip": _KEYED,
    "settings_round_trip": "SELECT o_orderkey AS key, o_orderstatus AS status, o_orderpriority = '1-URGENT' AS urgent FROM orders",
    "preserve_order": f"SELECT {_BUCKETS} AS bucket, count(*) AS n, true AS in_order FROM orders GROUP BY 1",
    "sample_features": f"SELECT 'Order' AS layer, CAST(sum(least(7, n)) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM orders GROUP BY {_BUCKETS})",
    "columns_option": "SELECT o_orderstatus AS status, o_orderkey AS key FROM orders",
    "layer_counts": "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'Road' ELSE 'Building' END AS layer, count(*) AS n FROM supplier GROUP BY 1",
    "observed_counts": """WITH l AS (SELECT count(*) AS n, count(*) FILTER (l_returnflag <> 'N') AS f, max(l_linenumber) AS most, min(l_linenumber) AS least FROM lineitem),
        o AS (SELECT count(*) AS orders, max(c) AS lines, max(l_orderkey) AS kmax, min(l_orderkey) AS kmin FROM (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1))
        SELECT '' AS path, orders AS instances, CAST(0 AS BIGINT) AS parents, CAST(0 AS BIGINT) AS max_occurs, CAST(0 AS BIGINT) AS n_values, CAST(0 AS BIGINT) AS empty, CAST(0 AS BIGINT) AS max_len, NULL AS int_min, NULL AS int_max FROM o
        UNION ALL SELECT 'key', orders, orders, 1, orders, 0, length(CAST(kmax AS VARCHAR)), kmin, kmax FROM o
        UNION ALL SELECT 'line', n, orders, lines, 0, 0, 0, NULL, NULL FROM l, o
        UNION ALL SELECT 'line/no', n, n, 1, n, 0, length(CAST(most AS VARCHAR)), least, most FROM l
        UNION ALL SELECT 'line/flag', f, f, 1, f, 0, 1, NULL, NULL FROM l""",
    "observed_numbers": """SELECT 'price' AS path, max(CASE WHEN strpos(p, '.') > 0 THEN length(p) - strpos(p, '.') ELSE 0 END) AS max_scale, CAST(0 AS BIGINT) AS n_zone, NULL AS zone_min, CAST(NULL AS BIGINT) AS n_distinct
            FROM (SELECT CAST(o_totalprice AS VARCHAR) AS p FROM orders)
        UNION ALL SELECT 'date', 0, count(*), 0, NULL FROM orders UNION ALL SELECT 'status', 0, 0, NULL, count(DISTINCT o_orderstatus) FROM orders""",
    "observed_geometry": "SELECT count(*) AS n_geometry, 'Polygon' AS kinds, false AS curves, 'EPSG:2180' AS srs, '2' AS dims FROM part",
    "column_crs": "SELECT 'EPSG:4326' AS srs, 'Point' AS kind",
    "other_crs_is_an_error": "SELECT p_partkey AS key FROM part WHERE p_partkey % 5 <> 0",
    "reinferred": values(CHOICES["strings"][1]),
    "lists_never": values([("key", "key", "bigint"), ("no", "line/no", "bigint"), ("flag", "line/flag", "string")]),
    "wrapper_values": "SELECT s_suppkey AS key, CAST(s_suppkey % 100 AS BIGINT) AS size, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, 'a <t:b>bold</t:b> word' AS note, 'S.' || s_suppkey AS ref FROM supplier",
    "member_rules": "SELECT s_suppkey AS key FROM supplier",
    "single_feature_root": "SELECT n_nationkey AS key, n_name AS name FROM nation",
    "referenced_members": "SELECT n_regionkey AS region, count(*) FILTER (n_nationkey % 2 = 0) AS referenced, count(*) AS features, count(*) AS matched FROM nation GROUP BY 1",
    "nested_collections": "SELECT n_nationkey AS key FROM nation",
    "hidden_markup": "SELECT n_nationkey AS key, '</t:N>' || n_name AS name FROM nation",
    "srs_names": f"SELECT n_nationkey AS key, list_extract([{', '.join(repr(x) for x in SPELLINGS.values())}], CAST(n_nationkey % {len(SPELLINGS)} + 1 AS INTEGER)) AS code FROM nation",
    "repeated_references": "SELECT o_custkey AS key, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2",
    "stream_of_files": "SELECT o_orderkey AS key FROM orders",
    "wfs_pages": "SELECT n_nationkey AS key, n_name AS name FROM nation",
} | {f"schema_{k}": values(rows) for k, (_, rows) in CHOICES.items()}
