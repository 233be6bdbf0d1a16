"""The columnar reader gives what the row reader gives, or leaves a batch to it."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from sparkgml.operators.columns import ColumnReader
from sparkgml.operators.parse import ReadPlan, RowReader, output_type, rows_of, walk
from sparkgml.plans.schema import LayerSchema
from sparkgml.sources.split import SplitError, SplitOptions, Splitter

NS = {"gml": "http://www.opengis.net/gml/3.2", "xlink": "http://www.w3.org/1999/xlink", "xsi": "http://www.w3.org/2001/XMLSchema-instance", "t": "urn:t"}
SCHEMAS = [
    {"id": {"type": "text", "path": "@id"}, "n": "bigint", "s": "text", "d": "date", "at": "timestamp", "z": "timestamptz", "b": "boolean", "x": "double", "ref": {"type": "text", "path": "r/@href"}, "hour": "time"},
    {"k": {"type": "bigint[]", "path": "i[]/k"}, "w": {"type": "text[]", "path": "i[]/w"}, "u": {"type": "text[]", "path": "i[]/@u"}, "v": {"type": "bigint[]", "path": "v[]"}, "deep": {"type": "text", "path": "a/b/c"}},
    {"g": "geometry", "n": "int"}, {"g": "geometry(MultiPoint)", "x": "real"}, {"m": "map", "n": "bigint"}, {"k": {"type": "text[]", "path": "o/i[]/k"}},
]
#: Values that fit their types, and the odd ones.
GOOD = {"n": ["1", " -7 ", "0", "999999999999999999"], "s": ["a", " é ", "", "x &amp; y", "<![CDATA[<q>]]>"], "d": ["2021-03-04", "1999-12-31Z", "2020-02-29+02:00"], "at": ["2021-03-04T05:06:07", "2021-03-04T05:06:07.25"], "z": ["2021-03-04T05:06:07Z", "2021-03-04T05:06:07+01:30"], "b": ["true", "0"], "x": ["1.5", ".5", "1e3", "-2"], "hour": ["01:02:03"]}
ODD = {"n": ["x", "1.0", "+5"], "s": ["<q>1</q>", "a<!-- c -->b"], "d": ["2021-02-30", "0000-01-01"], "at": ["2021-03-04T25:00:00", "2021-03-04T05:06:07Z"], "z": ["2021-03-04T05:06:07"], "b": ["yes"], "x": ["INF", "1,5"], "hour": ["25:00:00"]}


def feature(rng, odd):
    def value(name):
        return rng.choice(ODD[name] if rng.random() < odd else GOOD[name])

    parts = [f"<t:{k}>{value(k)}</t:{k}>" for k in GOOD if rng.random() < 0.8]
    if rng.random() < 0.3:
        parts.append(f'<t:n xsi:nil="true">{value("n")}</t:n>' if rng.random() < odd else "<t:other>1</t:other>")
    if rng.random() < 0.7:
        parts.append(f'<t:r xlink:href="{rng.choice(["#", ""])}c{rng.randint(0, 9)}"/>')
    parts += [f'<t:i{rng.choice([" u=" + chr(34) + "m" + chr(34), ""])}>' + "".join(f"<t:{k}>{rng.randint(0, 9)}</t:{k}>" for k in ("k", "w") if rng.random() < 0.6) + "</t:i>" for _ in range(rng.randint(0, 3))]
    parts += [f"<t:v>{rng.choice(['1', '', '2'])}</t:v>" for _ in range(rng.randint(0, 2))] + ["<t:a><t:b><t:c>deep</t:c></t:b></t:a>"] * rng.randint(0, 1) + ["<t:o><t:i><t:k>1</t:k></t:i><t:i/></t:o>"] * rng.randint(0, 1)
    if rng.random() < 0.7:
        parts.append(rng.choice(['<t:g><gml:Point srsName="EPSG:4326"><gml:pos>1 2</gml:pos></gml:Point></t:g>', "<t:g/>"]) if rng.random() >= odd else "<t:g><gml:Point><gml:pos>a</gml:pos></gml:Point></t:g>")
    rng.shuffle(parts)
    return f'<t:A gml:id="f{rng.randint(0, 99)}">{"".join(parts)}</t:A>'


def batch_of(features):
    n = len(features)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (["d"] * n, list(range(n)), ["urn:t"] * n, ["A"] * n, [json.dumps(NS, sort_keys=True)] * n)] + [pa.nulls(n, pa.string()), pa.array([f.encode() for f in features], pa.binary()), pa.array([i + 1 for i in range(n)])], ["source", "start", "layer_ns", "layer", "ns", "bounded", "xml", "end"])


@pytest.mark.parametrize("schema", range(len(SCHEMAS)))
def test_columns_equal_rows(schema):
    plan = ReadPlan(LayerSchema.given("A", SCHEMAS[schema]), "skip", axis_mode="xy")
    arrow, taken, rng = to_arrow_schema(output_type(plan)), 0, random.Random(schema)
    for turn in range(60):
        batch = batch_of([feature(rng, 0.2 if turn % 3 == 0 else 0.0) for _ in range(rng.randint(1, 6))])
        rows = [row for *_, row, _, error in walk(plan, iter([batch])) if error is None]
        want = [dict(zip(arrow.names, r, strict=True)) for r in rows]
        got = pa.Table.from_batches(rows_of(plan)(iter([batch])), arrow).to_pylist()
        plain = pa.Table.from_pylist([{k: dict(v) if isinstance(v, dict) else v for k, v in r.items()} for r in want], arrow).to_pylist()
        assert got == plain
        reader = RowReader(plan)
        taken += ColumnReader(plan.schema.columns, reader.wkb_of, True).read(*(batch.column(i).to_pylist() for i in (0, 6, 4, 5))) is not None
    assert taken > 20 or "m" in SCHEMAS[schema]


def test_location_and_other_layers():
    plan = ReadPlan(LayerSchema.given("t:A", {"n": "bigint"}), location=True)
    batch = batch_of(["<t:A><t:n>1</t:n></t:A>", "<t:A><t:n>2</t:n></t:A>"])
    other = pa.RecordBatch.from_arrays([batch.column(i) if i != 2 else pa.array(["urn:t", "urn:u"]) for i in range(8)], batch.schema.names)
    assert [r for b in rows_of(plan)(iter([other])) for r in b.to_pylist()] == [{"n": 1, "_location": {"source": "d", "start": 0, "end": 1}}]


def test_splitter_against_the_parser():
    """Features and scopes of random documents, with markup that hides tags, as a full parser sees them."""
    import xml.etree.ElementTree as ET

    rng = random.Random(8)
    for _ in range(200):
        inner = lambda: "".join(rng.choice(['<x a="1 > 2"/>', "<!-- </t:A> <t:A> -->", "<![CDATA[</t:A>]]>", "<t:A>n</t:A>", "<t:A/>", "<?p </t:A> ?>", "<t:AB>1</t:AB>", "té", '<t:A q="</x"/>'.replace("</x", "&lt;/x")]) for _ in range(rng.randint(0, 5)))
        own = lambda: rng.choice(["", ' xmlns:u="urn:u"', " xmlns='urn:d'", ' gml:id="a&amp;b"'])
        members = "".join(rng.choice([f"<gml:featureMember>{f}</gml:featureMember>", f"<!-- <gml:featureMember> -->{f'<gml:featureMembers >{f}{f}</gml:featureMembers>'}", f"<gml:featureMember><gml:FeatureCollection><gml:featureMember>{f}</gml:featureMember></gml:FeatureCollection></gml:featureMember>", "<gml:description>x<y/></gml:description>"]) for f in [f"<t:{n}{own()}>{inner()}</t:{n} >" for n in rng.choices("AB", k=rng.randint(0, 4))])
        data = ('<?xml version="1.0"?><!-- c -->' + f"<gml:FeatureCollection {' '.join(f'xmlns:{k}=' + chr(34) + v + chr(34) for k, v in NS.items())}>{members}</gml:FeatureCollection>\n").encode()
        root = ET.fromstring(data)
        want = []

        def collect(e):
            for c in e:
                if c.tag.endswith(("featureMember", "featureMembers")):
                    for f in c:
                        collect(f) if f.tag.endswith("FeatureCollection") else want.append(ET.tostring(f, "unicode").strip())
        collect(root)
        got = []
        for *_, context, _, xml in Splitter(data, SplitOptions()).run():
            scope = "".join(f' xmlns{":" + p if p else ""}="{u}"' for p, u in json.loads(context).items())
            (f,) = ET.fromstring(f"<_{scope}>{xml.decode()}</_>")
            f.tail = None
            got.append(ET.tostring(f, "unicode").strip())
        assert [ET.canonicalize(x) for x in got] == [ET.canonicalize(x) for x in want]
    for bad in (b"<a><b></a>", b"x<a/>", b"<a/>y", b"<a/><b/>", b"", b"<p:a/>", b"<a x='", b"<a><!-- </a>", b"<a", b"<a " + b"b" * 5000, b"<a><b"):
        with pytest.raises(SplitError):
            list(Splitter(bad, SplitOptions()).run())


def test_shapes_observe_what_walking_does():
    """Features of a shape that was met give their values alone; the statistics are those of walking each."""
    from itertools import product
    from xml.etree import ElementTree

    from sparkgml.operators.observe import Observer

    xlink, xsi = 'xmlns:x="http://www.w3.org/1999/xlink"', 'xmlns:i="http://www.w3.org/2001/XMLSchema-instance"'
    parts = ["<a>{n}</a>", "<a/>", "<b k='{n}' e=' '> w{n} </b><b/>", "<c><d>{n}.5</d><d>7</d></c>", "<c>mixed<d>x</d></c>", f"<r {xlink} x:href='#{{n}}'/>", f"<r {xlink} x:href='#{{n}}'>t</r>", f"<v {xsi} i:nil='true'>gone</v>", f"<v {xsi} i:nil='false'>{{n}}</v>", "<deep>" + "<q>" * 20 + "1" + "</q>" * 20 + "</deep>", "<boundedBy><z/></boundedBy>", '<g><p:Point xmlns:p="http://www.opengis.net/gml/3.2" srsName="EPSG:4326"><p:pos>1 {n}</p:pos></p:Point></g>']
    nodes = [ElementTree.fromstring(f"<A id='{n}' {xsi} i:nil='true'>{''.join(p)}</A>".replace("{n}", str(n % 90))) for n, p in enumerate(list(product(parts, parts, ["", parts[0]])) * 3)]
    fast, slow = Observer(), Observer()
    for i, node in enumerate(nodes):
        fast.feature("s", i, "u", "A", node)
        slow.walk("s", i, "u", "A", node)
        if i % 100 == 99:
            fast.settle()
            slow.settle()
    assert 0 < fast.unshaped < len(nodes) / 2 and len(fast.shapes) > 100
    for of in (Observer.rows, Observer.axis_rows):
        assert [b.to_pylist() for b in of(fast)] == [b.to_pylist() for b in of(slow)]
