import gzip
import io
import json
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sparkgml.api import NoFeatures, ReadOptions, read, read_layer, scan
from sparkgml.functions.geometry import read_wkb, wkt
from sparkgml.operators.sinks import SinkError, write_geoparquet, write_ipc
from sparkgml.plans.infer import InferenceOptions
from sparkgml.plans.schema import LayerSchema, SchemaError, column_names, load_settings, parse_type, pattern_matches, specificity, split_path
from sparkgml.sources.inputs import SourceError, as_utf8, encoding_of, glob_matches, sources
from sparkgml.sources.split import SplitError, SplitOptions, Splitter, split_by_tag, split_features

HEAD = '<gml:FeatureCollection xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:t="urn:t">'
TAIL = "</gml:FeatureCollection>"


def doc(*features, head=HEAD):
    return (head + "".join(f"<gml:featureMember>{f}</gml:featureMember>" for f in features) + TAIL).encode()


def names(data, **options):
    return [x[4] for x in Splitter(data, SplitOptions(**options)).run()]


def test_splitter():
    assert names(doc("<t:A/>", "<t:B><t:A/></t:B>")) == ["A", "B"]
    assert names(doc('<t:A x="a > b"/>', "<t:A><![CDATA[</t:A>]]><!-- </t:A> --></t:A>")) == ["A", "A"]
    many = HEAD + "<gml:featureMembers><t:A/><t:B/></gml:featureMembers>" + TAIL
    assert names(many.encode()) == ["A", "B"]
    assert names(doc("<t:A/>", "<t:B/>"), layers=["t:B"]) == ["B"] and names(doc("<t:A/>"), layers=["{urn:t}A"]) == ["A"] and names(doc("<t:A/>"), layers=["u:A"]) == []
    nested = '<w:FeatureCollection xmlns:w="http://www.opengis.net/wfs/2.0"><w:member><w:FeatureCollection><w:member><A xmlns="urn:t"/></w:member></w:FeatureCollection></w:member><w:additionalObjects><w:SimpleFeatureCollection><w:member><B xmlns="urn:t"/></w:member></w:SimpleFeatureCollection></w:additionalObjects></w:FeatureCollection>'
    assert names(nested.encode()) == ["A", "B"]
    assert names(b'<A xmlns="urn:t"><x>1</x></A>') == ["A"] and names(b"<A/>", allow_single_feature_root=False) == []
    s = Splitter(doc('<t:A/>').replace(b"<gml:featureMember>", b'<gml:featureMember xlink:href="#x"/><gml:featureMember>', 1), SplitOptions())
    assert [x[4] for x in s.run()] == ["A"] and s.referenced == 1
    for start, stop, xml in ((x[1], x[2], x[7]) for x in Splitter(doc("<t:A>é</t:A>"), SplitOptions()).run()):
        assert doc("<t:A>é</t:A>")[start:stop] == xml == "<t:A>é</t:A>".encode()
    for bad in (b"<!DOCTYPE a><a/>", b"<a>", b"<a></b>"):
        with pytest.raises(SplitError):
            list(Splitter(bad, SplitOptions()).run())


def test_inputs(spark, tmp_path):
    plain = doc("<t:A><t:v>ą</t:v></t:A>")
    (tmp_path / "a.gml").write_bytes(plain)
    (tmp_path / "b.gml.gz").write_bytes(gzip.compress(plain[:50]) + gzip.compress(plain[50:]))
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as z:
        z.write(plain)
    (tmp_path / "c.gml.zst").write_bytes(sink.getvalue().to_pybytes())
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("x/one.gml", plain)
        z.writestr("two.gml", plain)
        z.writestr("readme.txt", "no")
    (tmp_path / "e.xml").write_bytes(b'<?xml version="1.0" encoding="iso-8859-2"?>' + plain.decode().encode("iso-8859-2"))
    (tmp_path / "notes.txt").write_bytes(b"no")
    got = sources(spark, str(tmp_path)).collect()
    assert sorted(r.name.rsplit("/", 1)[1] for r in got) == ["a.gml", "b.gml.gz", "c.gml.zst", "e.xml", "one.gml", "two.gml"]
    assert all(bytes(r.content).endswith(plain) for r in got)
    assert [r.name.partition("!/")[2] for r in sources(spark, f"{tmp_path}/d.zip!/*.gml").collect()] == ["two.gml"]
    assert read(spark, str(tmp_path), "A").count() == 6
    assert glob_matches("a/b.gml", "a/*.gml") and not glob_matches("a/b.gml", "*.gml")
    assert encoding_of("<a/>".encode("utf-16")) == "utf-16" and encoding_of(b'<?xml version="1.0" encoding="UTF-16"?><a/>') == "utf-8"
    assert as_utf8("<ą/>".encode("utf-16-le")) == "<ą/>".encode()
    with pytest.raises(SourceError):
        as_utf8(b'<?xml version="1.0" encoding="nope"?><a/>')
    with pytest.raises(SourceError):
        sources(spark, [])
    (tmp_path / "v1.0").mkdir()
    (tmp_path / "v1.0" / "a.gml").write_bytes(plain)
    (tmp_path / "v1.0" / "odd.txt").write_bytes(plain)
    assert [r.name.rsplit("/", 1)[1] for r in sources(spark, f"{tmp_path}/v1.0").collect()] == ["a.gml"] and sources(spark, f"{tmp_path}/v1.0/odd.txt").count() == 1
    for bad in ("http://x/a.zip", "http://x/a.zip!/b.gml"):
        with pytest.raises(SourceError, match="archives"):
            sources(spark, bad)


def test_split_by_tag(spark, tmp_path):
    (tmp_path / "a.gml").write_bytes(doc(*[f"<t:A><t:v>{i}</t:v></t:A>" for i in range(200)]))
    got = split_by_tag(spark, f"{tmp_path}/a.gml", namespaces={"t": "urn:t", "gml": "http://www.opengis.net/gml/3.2"})
    assert got.count() == 200 and {r.layer for r in got.collect()} == {"A"}


FEATURES = [
    '<t:A gml:id="a1"><t:n>1</t:n><t:code>0012</t:code><t:ref xlink:href="#x"/><t:item><t:k>1</t:k><t:w>p</t:w></t:item><t:item><t:k>2</t:k></t:item><t:size uom="m">1.5</t:size><t:when>2021-03-04T10:00:00Z</t:when><t:part><t:Part><t:p>7</t:p></t:Part></t:part><t:mix>a<b/>c</t:mix></t:A>',
    '<t:A gml:id="a2"><t:n>2</t:n><t:code>12</t:code><t:ref xlink:href="#y"/><t:size uom="m">2</t:size><t:when>2021-03-04T10:00:00Z</t:when><t:part><t:Part><t:p>8</t:p></t:Part></t:part><t:geom><gml:Point srsName="EPSG:4326"><gml:pos>1 2</gml:pos></gml:Point></t:geom></t:A>',
]


def test_inference(spark):
    found = scan(spark, {"d": doc(*FEATURES)})
    got = {c.name: (c.type, c.path, c.is_list) for c in found.schema("A").columns}
    assert got == {
        "@id": ("string", "@id", False), "n": ("bigint", "n", False), "code": ("string", "code", False), "ref": ("string", "ref/@href", False), "k": ("bigint", "item[]/k", True), "w": ("string", "item[]/w", True),
        "size": ("double", "size", False), "when": ("timestamp", "when", False), "p": ("bigint", "part/*/p", False), "mix": ("string", "mix", False), "geom": ("geometry", "geom", False),
    }
    meta = {c.name: c.metadata for c in found.schema("A").columns}
    assert meta["size"]["gml:attr:uom"] == "m" and meta["when"]["gml:tz_offset"] == "+00:00" and meta["size"]["gml:max_scale"] == 1
    assert found.counts == {"A": 2} and "n: bigint" in found.explain()
    a, b = read(spark, {"d": doc(*FEATURES)}, "A").orderBy("n").collect()
    assert (a.code, a.ref, a.k, a.w, a.p, a.mix) == ("0012", "x", [1, 2], ["p", None], 7, "a<b/>c") and b.k is None and wkt(read_wkb(bytes(b.geom))) == "POINT (1 2)"
    strings = found.schema_with("A", InferenceOptions(preset="strings"))
    assert {c.type for c in strings.columns} == {"string", "geometry"}
    over = found.schema_with("A", InferenceOptions(overrides={"A/item/**": "drop", "A/n": "text", "**/geom": "raw"}))
    assert [(c.name, c.type) for c in over.columns if c.name in ("n", "k")] == [("n", "string")]
    small = found.schema_with("A", InferenceOptions(integers="smallest"))
    assert next(c for c in small.columns if c.name == "n").type == "smallint"
    sampled = scan(spark, {"d": doc(*FEATURES)}, ReadOptions(sample_features=1))
    assert not sampled.is_complete and found.is_complete and scan(spark, {"d": doc(*FEATURES), "e": doc(*FEATURES)}, ReadOptions(sample_total=3)).counts == {"A": 3}
    assert sampled.counts == {"A": 1} and next(c for c in sampled.schema("A").columns if c.name == "n").type == "string"


def test_settings_round_trip(spark):
    found = scan(spark, {"d": doc(*FEATURES)})
    layers, _ = load_settings(found.save())
    assert [(c.name, c.type, c.path) for c in layers["A"].columns] == [(c.name, c.type, c.path) for c in found.schema("A").columns]
    assert read(spark, {"d": doc(*FEATURES)}, "A", found.save()).count() == 2
    assert read(spark, {"d": doc(*FEATURES)}, "A", found.save(), ReadOptions(spread=True)).count() == 2
    again = LayerSchema.of_struct("A", found.schema("A").struct())
    assert [(c.name, c.path, c.is_list) for c in again.columns] == [(c.name, c.path, c.is_list) for c in found.schema("A").columns]


def test_order_of_tasks_does_not_matter(spark):
    docs = spark.createDataFrame([(f"d{i}", doc(f"<t:A><t:x{i % 3}>{i}</t:x{i % 3}></t:A>")) for i in range(9)], "name string, content binary")
    one, many = (scan(spark, docs.repartition(n)).schema("A") for n in (1, 5))
    assert [(c.name, c.type) for c in one.columns] == [(c.name, c.type) for c in many.columns] == [("x0", "bigint"), ("x1", "bigint"), ("x2", "bigint")]


def test_errors_and_policies(spark):
    data = {"d": doc("<t:A><t:n>1</t:n></t:A>", "<t:A><t:n>x</t:n></t:A>", '<t:A><t:n>3</t:n><t:g><gml:Point><gml:pos>a</gml:pos></gml:Point></t:g></t:A>', "<t:A><t:n>4</t:n><t:n>5</t:n></t:A>")}
    schema = {"n": "bigint", "g": "geometry"}
    with pytest.raises(Exception, match="isn't bigint"):
        read(spark, data, "A", schema).collect()
    skip = read_layer(spark, data, "A", schema, ReadOptions(on_feature_error="skip"))
    assert [r.n for r in skip.df.collect()] == [1] and {r.kind for r in skip.report().collect()} == {"value", "geometry"}
    null = read_layer(spark, {"d": doc('<t:A><t:g><gml:Solid/></t:g></t:A>')}, "A", {"g": "geometry"}, ReadOptions(on_feature_error="null_geometry"))
    assert null.df.first().g is None and null.report().count() == 1
    with pytest.raises(NoFeatures):
        scan(spark, {"d": (HEAD + TAIL).encode()})


def test_location_and_given_types(spark):
    f = "<t:A><t:b>1</t:b><t:d>2021-01-01</t:d><t:m><t:x a='1'>v</t:x></t:m><gml:boundedBy><gml:Envelope><gml:lowerCorner>0 1</gml:lowerCorner><gml:upperCorner>2 3</gml:upperCorner></gml:Envelope></gml:boundedBy></t:A>"
    df = read(spark, {"d": doc(f)}, "A", {"b": "boolean", "d": "date", "m": "map", "box": {"type": "geometry(Box)", "path": "boundedBy"}}, ReadOptions(location_column=True))
    r = df.first()
    assert r.b is True and r.m == {"x": "v", "x/@a": "1"} and r.box.ymax == 3.0 and r._location.source == "d" and r._location.end > r._location.start
    with pytest.raises(Exception, match="no value"):
        read(spark, {"d": doc("<t:A/>")}, "A", StructType([StructField("x", LongType(), False)])).collect()
    assert read(spark, {"d": doc("<t:A><t:x>5</t:x></t:A>")}, "A", StructType([StructField("x", LongType())])).first().x == 5


def test_path_language():
    assert split_path("{http://a/b}c/d") == ["{http://a/b}c", "d"]
    for bad in ("a//b", "@a/b", "a[]/b[]"):
        with pytest.raises(SchemaError):
            split_path(bad)
    assert column_names([["a", "x"], ["b", "x"], ["c"]]) == ["a/x", "b/x", "c"] and column_names([["a"], ["a"]]) == ["a", "a#2"]
    assert parse_type("geometry(Point,XYZ)[]") == {"type": "geometry", "is_list": True, "geom_kind": "Point", "geom_dim": 3}
    for bad in ("numeric", "geometry(Foo)", "nope"):
        with pytest.raises(SchemaError):
            parse_type(bad)
    assert pattern_matches("A/**/x", "A", "b/c/x") and pattern_matches("*/x*", "A", "x1") and not pattern_matches("A/x", "A", "y/x")
    assert specificity("A/x") > specificity("A/*") > specificity("**")


def test_sinks(spark, tmp_path):
    poly = '<t:g><gml:Polygon srsName="EPSG:2180"><gml:exterior><gml:LinearRing><gml:posList>0 0 4 0 4 4 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></t:g>'
    layer = read_layer(spark, {"d": doc(f"<t:A><t:n>1</t:n>{poly}</t:A>", "<t:A><t:n>2</t:n></t:A>")}, "A")
    done = write_geoparquet(layer.df.coalesce(1), str(tmp_path / "p"), settings="{}").collect()
    file = pq.ParquetFile(tmp_path / "p" / done[0].file)
    geo = json.loads(file.metadata.metadata[b"geo"])
    assert geo["columns"]["g"]["geometry_types"] == ["Polygon"] and geo["columns"]["g"]["bbox"] == [0, 0, 4, 4] and geo["columns"]["g"]["crs"]["id"]["code"] == 2180
    assert geo["columns"]["g"]["covering"]["bbox"]["xmin"] == ["g_bbox", "xmin"] and file.metadata.metadata[b"gml:settings"] == b"{}"
    assert file.read().column("g_bbox").to_pylist()[0]["xmax"] == 4.0 and sorted(x.name for x in (tmp_path / "p").iterdir()) == ["_files.json", done[0].file]
    ipc = write_ipc(layer.df.coalesce(1), str(tmp_path / "i")).collect()
    assert pa.ipc.open_file(io.BytesIO((tmp_path / "i" / ipc[0].file).read_bytes())).read_all().num_rows == 2
    arc = '<t:g><gml:Curve><gml:segments><gml:Arc><gml:posList>0 0 1 1 2 0</gml:posList></gml:Arc></gml:segments></gml:Curve></t:g>'
    with pytest.raises(Exception, match="linearize"):
        write_geoparquet(read(spark, {"d": doc(f"<t:A>{arc}</t:A>")}, "A"), str(tmp_path / "q"))
    assert issubclass(SinkError, ValueError)


def test_data_source(spark, tmp_path):
    from sparkgml.sources.datasource import register

    register(spark)
    (tmp_path / "a.gml").write_bytes(doc(*FEATURES))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("one.gml", doc(*FEATURES))
    settings = scan(spark, str(tmp_path / "a.gml")).save()
    df = spark.read.format("gml").option("layer", "A").option("settings", settings).load(str(tmp_path))
    assert df.count() == 4 and df.where("n = 2").select("p").first().p == 8
    own = spark.read.format("gml").schema("n bigint, code string").option("layer", "A").load(str(tmp_path / "a.gml"))
    assert sorted(tuple(r) for r in own.collect()) == [(1, "0012"), (2, "12")]


def test_stream(spark, tmp_path):
    from sparkgml.streaming.reader import read_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gml").write_bytes(doc(*FEATURES))
    df = read_stream(spark, str(tmp_path / "in"), LayerSchema.given("A", {"n": "bigint"}))
    q = df.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("arrived").collect()) == [1, 2]


def test_skipped_sources(spark):
    seen = split_features(spark.createDataFrame([("a", doc("<t:A/>")), ("b", b'<f:FeatureCollection xmlns:f="http://www.opengis.net/wfs"/>')], "name string, content binary"))
    assert sorted((r.source, r.kind) for r in seen.where("kind <> 'feature'").collect()) == [("a", "header"), ("b", "skipped")]
    assert isinstance(seen.schema["source"].dataType, StringType)


def test_small_files_share_tasks(tmp_path):
    from sparkgml.sources.datasource import expand, grouped

    for i in range(1000):
        (tmp_path / f"{i}.gml").write_bytes(b"<a/>")
    groups = grouped(expand(str(tmp_path)))
    assert len(groups) <= 100
    assert sorted(p.path for g in groups for p in g.parts) == sorted(str(tmp_path / f"{i}.gml") for i in range(1000))
    (tmp_path / "0.gml").write_bytes(b"<a/>" * 1000)
    assert len(grouped(expand(str(tmp_path / "[01].gml")))) == 2
