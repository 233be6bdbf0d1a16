"""Versions, hints, patches, prefixes, merged schemas, table functions."""

import os
import zipfile

import pytest
from pyspark.sql import types as T

from sparkgml.api import ReadOptions, read, scan
from sparkgml.functions.version import detect_version
from sparkgml.plans.infer import InferenceOptions
from sparkgml.plans.schema import LayerSchema, SchemaError, load_settings, merged, portable, prefixes_for
from sparkgml.sources.udtf import options_of, register
from sparkgml.sources.wfs import hint_of

from .test_reading import FEATURES, doc

GML, GML32 = "http://www.opengis.net/gml", "http://www.opengis.net/gml/3.2"
XSD = b'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:gml="http://www.opengis.net/gml/3.2"><xs:element name="A" type="t:AType"/><xs:complexType name="AType"><xs:sequence><xs:element name="n" type="xs:string"/><xs:element name="gone" type="xs:int"/><xs:element name="never" type="xs:date"/><xs:element name="where" type="gml:PointPropertyType"/><xs:element name="odd" type="t:Other"/></xs:sequence></xs:complexType></xs:schema>'


def test_versions(spark):
    assert detect_version({GML32, "http://www.opengis.net/gml/3.3/ce"}) == "3.3" and detect_version({GML32}) == "3.2" and detect_version({GML32}, "x http://schemas.opengis.net/gml/3.3/gml.xsd") == "3.3"
    assert detect_version({GML}, "http://a http://schemas.opengis.net/gml/3.1.1/base/gml.xsd") == "3.1" and detect_version({GML}, "u /gml/2.1.2/feature.xsd u /gml/3.1.1/base/gml.xsd") == "3.1"
    assert [detect_version({GML}, output_format=f) for f in ("text/xml; subtype=gml/3.1.1", "application/gml+xml; version=3.2", "GML2", "GML3", "json")] == ["3.1", "3.2", "2", "3.1", None]
    assert [detect_version({GML}, wfs_version=v) for v in ("1.0.0", "1.1.0", "2.0.0")] == ["2", "3.1", "3.2"]
    assert detect_version(dialects={"gml3", "gml2"}) == "3.1" and detect_version(dialects={"gml3"}, poslist_dimension=True) == "3.0" and detect_version(dialects={"gml2"}) == "2" and detect_version() is None
    found = scan(spark, {"d": doc(*FEATURES)})
    assert found.schema("A").versions == "3.2" and found.schema("A").struct().fields[0].metadata["gml:versions"] == "3.2"


def test_hint(spark):
    hint = hint_of(XSD, "t:A")
    assert hint == {"n": "text", "gone": "bigint", "never": "date", "where": "geometry"}
    data = {"d": doc("<t:A><t:n>1</t:n><t:gone/></t:A>")}
    plain, hinted = (scan(spark, data, ReadOptions(inference=InferenceOptions(hint=h))).schema("A") for h in ({}, hint))
    assert [(c.name, c.type) for c in plain.columns] == [("n", "bigint"), ("gone", "string")]
    assert [(c.name, c.type) for c in hinted.columns] == [("n", "bigint"), ("gone", "bigint"), ("never", "date"), ("where", "geometry")]
    assert read(spark, data, "A", None, ReadOptions(inference=InferenceOptions(hint=hint))).first().asDict() == {"n": 1, "gone": None, "never": None, "where": None}


def test_ids_of_geometries_and_patches(spark):
    point = '<t:g><gml:Point gml:id="p{0}" srsName="EPSG:4326"><gml:pos>1 2</gml:pos></gml:Point></t:g>'
    data = {"d": doc(*(f"<t:A>{point.format(i)}<t:n>{i}</t:n></t:A>" for i in range(3)), "<t:B><t:n>1</t:n></t:B>")}
    options = ReadOptions(inference=InferenceOptions(geometry_ids=True, per_layer=[("*", {"integers": "smallest"}), ("B", {"preset": "strings"})]))
    found = scan(spark, data, options)
    assert [(c.name, c.path, c.type) for c in found.schema("A").columns] == [("g", "g", "geometry"), ("@id", "g/*/@id", "string"), ("n", "n", "smallint")] and found.schema("B").columns[0].type == "string"
    assert sorted(r["@id"] for r in read(spark, data, "A", None, options).collect()) == ["p0", "p1", "p2"]
    assert found.plain_axis() == ("xy", {}) and '"axis_order": "xy"' in found.save() and load_settings(found.save())[1]["axis_order"] == "xy"


def test_schemas_of_several_files():
    a, b = LayerSchema.given("A", {"n": "smallint", "s": "date", "x": "double"}), LayerSchema.given("A", {"n": "bigint", "s": "boolean", "k": "text[]"})
    both = merged([a, b])
    assert [(c.name, c.type, c.is_list) for c in both.columns] == [("n", "bigint", False), ("s", "string", False), ("x", "double", False), ("k", "string", True)]
    assert [(c.name, c.type, c.is_list) for c in merged([LayerSchema.given("A", {"k": "bigint"}), LayerSchema.given("A", {"k": "bigint[]"})]).columns] == [("k", "bigint", True)]
    struct = T.StructType([T.StructField("x", T.DoubleType(), True, {"gml:max_scale": 2, "gml:path": "a/x"})])
    assert portable(struct).fields[0].metadata == {"gml:path": "a/x"}
    assert prefixes_for(["urn:t", GML32, "urn:u", GML], {"t": "urn:t"}) == {"urn:t": "t", GML32: "gml", "urn:u": "ns1", GML: "ns2"}


def test_options():
    assert ReadOptions.parse({"preserve_order": "true", "crs": "EPSG:3857"}).target_crs == 3857
    for k in ("batch_size", "threads", "no_grids", "grid_dir", "nope"):
        with pytest.raises(SchemaError):
            ReadOptions.parse({k: "1"})
    assert options_of(["a.json", "preset=strings"]) == {"settings": "a.json", "preset": "strings"}
    for bad in (["preset=strings", "a.json"], ["nope=1"]):
        with pytest.raises(SchemaError):
            options_of(bad)


def test_table_functions(spark, tmp_path):
    register(spark)
    (tmp_path / "a.gml").write_bytes(doc(*FEATURES))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("one.gml", doc(*FEATURES))
    settings = scan(spark, str(tmp_path / "a.gml")).save()
    (tmp_path / "s.json").write_text(settings)
    got = spark.sql(f"SELECT n, code, k FROM read_gml('{tmp_path}/a.gml', 'A') WHERE n > 1").collect()
    assert [(r.n, r.code, r.k) for r in got] == [(2, "12", None)]
    assert spark.sql(f"SELECT count(*) AS c FROM read_gml('{tmp_path}', 'A', '{tmp_path}/s.json')").first().c == 4
    assert dict(spark.sql(f"SELECT * FROM read_gml('{tmp_path}/a.gml', 'A', 'preset=strings')").dtypes)["n"] == "string"
    spark.read.format("binaryFile").load([f"{tmp_path}/a.gml", f"{tmp_path}/b.zip"]).createOrReplaceTempView("binary_files")
    text = settings.replace("'", "\\'").replace("\n", " ")
    assert spark.sql(f"SELECT sum(n) AS c FROM read_gml_files(TABLE(SELECT path, content FROM binary_files), 'A', '{text}')").first().c == 6
    for bad in ("'A', 'nope=1'", "'Nope'"):
        with pytest.raises(Exception, match="read_gml"):
            spark.sql(f"SELECT * FROM read_gml('{tmp_path}/a.gml', {bad})").collect()


def test_read_gml_is_many_tasks(spark, tmp_path):
    register(spark)
    for i in range(8):
        (tmp_path / f"{i}.gml").write_bytes(doc(*FEATURES))
    got = spark.sql(f"SELECT n FROM read_gml('{tmp_path}', 'A')")
    assert got.rdd.getNumPartitions() > 1
    assert got.count() == 8 * len(FEATURES)
    with pytest.raises(Exception, match="read_gml: layer has to be a text"):
        spark.sql(f"SELECT * FROM read_gml('{tmp_path}', 1)").collect()


def test_stream_has_few_triggers(spark, tmp_path):
    import __spark_entry__ as entry

    rows = spark.range(40_000).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "'O' AS o_orderstatus", "1.5D AS o_totalprice", "timestamp'2020-01-02 03:04:05' AS o_orderdate", "'1-URGENT' AS o_orderpriority")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    before = {q: spark.conf.get(q, None) for q in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    old = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    got = entry.queries()["stream_of_files"](spark, str(tmp_path))
    assert got.count() == got.distinct().count() == 40_000
    triggers = [len([n for n in os.listdir(f"{shared}/{d}/commits") if n.isdigit()]) for d in set(os.listdir(shared)) - old if os.path.isdir(f"{shared}/{d}/commits")]
    assert len(triggers) == 1 and 1 < triggers[0] <= 8  # of 80 files
    assert {q: spark.conf.get(q, None) for q in before} == before


def test_table_function_reads_batches(monkeypatch):
    """A file's usual features are read by column, others by row, with the same rows."""
    from sparkgml.operators.parse import RowReader
    from sparkgml.sources.udtf import rows_of

    schema = LayerSchema.given("A", {"n": "bigint", "code": "text"})
    walked, read_row = [], RowReader.read
    monkeypatch.setattr(RowReader, "read", lambda self, *a: (walked.append(1), read_row(self, *a))[1])
    usual = "".join(f"<gml:featureMember><t:A><t:n>{i}</t:n><t:code>c</t:code></t:A></gml:featureMember>" for i in range(5))
    for end, by_row in (("", 0), ("<gml:featureMember><t:A><t:n>5</t:n><t:code><t:b>c</t:b></t:code></t:A></gml:featureMember>", 6)):
        text = f'<gml:FeatureCollection xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:t="urn:t">{usual}{end}</gml:FeatureCollection>'
        got = list(rows_of(iter([("a", text.encode())]), schema, "A", {}))
        assert got == [(i, "c") for i in range(5)] + ([(5, "<t:b>c</t:b>")] if end else [])
        assert len(walked) == by_row


def test_set_ops_read_once(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["set_ops"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().withCachedData().toString()
    assert plan.count("InMemoryRelation") == 3 and plan.index("InMemoryRelation") < plan.index("MapInArrow")
