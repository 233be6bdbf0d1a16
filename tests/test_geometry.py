import math

import pytest

from sparkgml.functions.geometry import GeometryError, bbox, fit_kind, linearize, read_wkb, reverse, swap_xy, with_dimension, wkt, write_wkb
from sparkgml.functions.gml_geometry import Scope, geometry, srs_of
from sparkgml.sources.split import parse_element

NS = {"gml": "http://www.opengis.net/gml/3.2", "ce": "http://www.opengis.net/gml/3.3/ce", "xlink": "http://www.w3.org/1999/xlink"}


def read(xml, **scope):
    s = Scope(**scope)
    node = parse_element(xml.encode(), NS)
    s.srs = srs_of(node)
    return geometry(node, s), s.warnings


@pytest.mark.parametrize("xml, text", [
    ("<gml:Point><gml:pos>1 2</gml:pos></gml:Point>", "POINT (1 2)"),
    ("<gml:Point><gml:pos>1 2 3</gml:pos></gml:Point>", "POINT Z (1 2 3)"),
    ("<gml:Point/>", "POINT EMPTY"),
    ("<gml:Point><gml:coordinates decimal=',' cs=';'>1,5;2</gml:coordinates></gml:Point>", "POINT (1.5 2)"),
    ("<gml:Point><gml:coord><gml:X>1</gml:X><gml:Y>2</gml:Y></gml:coord></gml:Point>", "POINT (1 2)"),
    ("<gml:LineString><gml:posList srsDimension='3'>1 2 3 4 5 6</gml:posList></gml:LineString>", "LINESTRING Z (1 2 3, 4 5 6)"),
    ("<gml:LineString><gml:posList count='2'>1 2 3 4 5 6</gml:posList></gml:LineString>", "LINESTRING Z (1 2 3, 4 5 6)"),
    ("<gml:Polygon><gml:outerBoundaryIs><gml:LinearRing><gml:coordinates>0,0 4,0 4,4 0,0</gml:coordinates></gml:LinearRing></gml:outerBoundaryIs><gml:innerBoundaryIs><gml:LinearRing><gml:coordinates>1,1 2,1 2,2 1,1</gml:coordinates></gml:LinearRing></gml:innerBoundaryIs></gml:Polygon>", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))"),
    ("<ce:SimplePolygon><gml:posList>0 0 1 0 1 1</gml:posList></ce:SimplePolygon>", "POLYGON ((0 0, 1 0, 1 1, 0 0))"),
    ("<gml:MultiPoint><gml:pointMember><gml:Point><gml:pos>1 2</gml:pos></gml:Point></gml:pointMember><gml:pointMembers><gml:Point><gml:pos>3 4</gml:pos></gml:Point></gml:pointMembers></gml:MultiPoint>", "MULTIPOINT ((1 2), (3 4))"),
    ("<gml:Envelope><gml:lowerCorner>0 1</gml:lowerCorner><gml:upperCorner>2 3</gml:upperCorner></gml:Envelope>", "POLYGON ((0 1, 2 1, 2 3, 0 3, 0 1))"),
    ("<gml:Curve><gml:segments><gml:LineStringSegment><gml:posList>0 0 1 0</gml:posList></gml:LineStringSegment><gml:Arc><gml:posList>1 0 2 1 3 0</gml:posList></gml:Arc></gml:segments></gml:Curve>", "COMPOUNDCURVE ((0 0, 1 0), CIRCULARSTRING (1 0, 2 1, 3 0))"),
    ("<gml:OrientableCurve orientation='-'><gml:baseCurve><gml:LineString><gml:posList>0 0 1 1</gml:posList></gml:LineString></gml:baseCurve></gml:OrientableCurve>", "LINESTRING (1 1, 0 0)"),
    ("<gml:Curve><gml:segments><gml:ArcByBulge><gml:posList>0 0 2 0</gml:posList><gml:bulge>1</gml:bulge><gml:normal>1</gml:normal></gml:ArcByBulge></gml:segments></gml:Curve>", "CIRCULARSTRING (0 0, 1 1, 2 0)"),
])
def test_reading(xml, text):
    g, _ = read(xml)
    assert wkt(g) == text and read_wkb(write_wkb(g)) == g and read_wkb(write_wkb(g, little=False)) == g


def test_arc_by_centre():
    g, _ = read("<gml:Curve><gml:segments><gml:CircleByCenterPoint><gml:pos>0 0</gml:pos><gml:radius uom='km'>1</gml:radius></gml:CircleByCenterPoint></gml:segments></gml:Curve>")
    assert [tuple(round(v) for v in p) for p in g[2]] == [(-1000, 0), (0, 1000), (1000, 0), (0, -1000), (-1000, 0)]
    with pytest.raises(GeometryError):
        read("<gml:Curve><gml:segments><gml:CircleByCenterPoint><gml:pos>0 0</gml:pos><gml:radius uom='m'>1</gml:radius></gml:CircleByCenterPoint></gml:segments></gml:Curve>", geographic=True)


@pytest.mark.parametrize("xml", [
    "<gml:LineString><gml:posList>1 2</gml:posList></gml:LineString>", "<gml:LineString><gml:posList>1 2 3</gml:posList></gml:LineString>", "<gml:Point><gml:pos>a b</gml:pos></gml:Point>",
    "<gml:Polygon><gml:interior><gml:LinearRing><gml:posList>0 0 1 0 1 1 0 0</gml:posList></gml:LinearRing></gml:interior></gml:Polygon>", "<gml:Solid/>", "<gml:Curve/>",
    "<gml:LineString><gml:posList count='3'>1 2 3 4</gml:posList></gml:LineString>",
])
def test_errors(xml):
    with pytest.raises(GeometryError):
        read(xml)


def test_warnings():
    assert read("<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 1 0 1 1</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>")[1] == ["ring was not closed"]
    assert read("<gml:CompositeCurve><gml:curveMember><gml:LineString><gml:posList>0 0 1 0</gml:posList></gml:LineString></gml:curveMember><gml:curveMember><gml:LineString><gml:posList>5 0 6 0</gml:posList></gml:LineString></gml:curveMember></gml:CompositeCurve>")[1] == ["gap between segments"]


def test_model():
    arc = ("CircularString", 2, [(-1.0, 0.0), (0.0, 1.0), (1.0, 0.0)])
    assert bbox(arc) == pytest.approx((-1, 0, 1, 1))
    line = linearize(arc)
    assert line[0] == "LineString" and (0.0, 1.0) in line[2] and all(math.isclose(math.hypot(*p), 1) for p in line[2])
    assert reverse(arc)[2][0] == (1.0, 0.0) and swap_xy(arc)[2][0] == (0.0, -1.0)
    assert fit_kind(("Point", 2, (1.0, 2.0)), "MultiPoint") == ("MultiPoint", 2, [("Point", 2, (1.0, 2.0))])
    with pytest.raises(GeometryError):
        fit_kind(("Point", 2, (1.0, 2.0)), "Polygon")
    with pytest.raises(GeometryError):
        with_dimension(("Point", 3, (1.0, 2.0, 3.0)), 2)
    assert math.isnan(with_dimension(("Point", 2, (1.0, 2.0)), 3)[2][2])
    for bad in (b"", b"\x01\x01\0\0\0", b"\x01\xff\0\0\0", write_wkb(arc) + b"x"):
        with pytest.raises(GeometryError):
            read_wkb(bad)


def test_first_position():
    from sparkgml.functions.geometry import positions
    from sparkgml.functions.gml_geometry import Scope, first_position, geometry
    from sparkgml.queries_geometry import FORMS
    from sparkgml.sources.split import parse_element

    scope = {"gml": "http://www.opengis.net/gml/3.2", "ce": "http://www.opengis.net/gml/3.3/ce"}
    for name, (markup, _) in FORMS.items():
        node = parse_element(markup.replace("{s}", "7").encode(), scope)
        if node.name not in ("Envelope", "Box") and not name.startswith("orientable"):
            assert first_position(node) == next(positions(geometry(node, Scope())))[:2], name
    assert first_position(parse_element(b"<gml:Point><gml:pos>1</gml:pos></gml:Point>", scope)) is None and first_position(parse_element(b"<gml:Solid/>", scope)) is None


def test_plain_shape():
    """What counting says of a geometry is what reading it says."""
    from xml.etree import ElementTree

    from sparkgml.functions.geometry import positions
    from sparkgml.functions.gml_geometry import GeometryError, Scope, geometry
    from sparkgml.operators.observe import plain_shape
    from sparkgml.queries_geometry import FORMS
    from sparkgml.sources.split import tree_of

    forms = [m for m, _ in FORMS.values()] + [
        "<gml:Point><gml:pos>1 2 3</gml:pos></gml:Point>", "<gml:Point><gml:pos>1</gml:pos></gml:Point>", "<gml:Point/>", '<gml:LineString srsDimension="3"><gml:posList>1 2 3 4 5 6</gml:posList></gml:LineString>', '<gml:LineString><gml:posList srsDimension="3">1 2 3 4 5 6</gml:posList></gml:LineString>',
        "<gml:LineString><gml:posList>1 2 3</gml:posList></gml:LineString>", "<gml:LineString><gml:posList>1 x 3 4</gml:posList></gml:LineString>", "<gml:Polygon/>", "<gml:LineString><gml:posList/></gml:LineString>",
    ]
    taken = 0
    for markup in forms:
        (e,) = ElementTree.fromstring(f'<_ xmlns:gml="http://www.opengis.net/gml/3.2">{markup.replace("{s}", "7")}</_>')
        for inherited in (None, 2, 3):
            found = plain_shape(e, inherited)
            if found is not None:
                g = geometry(tree_of(e), Scope(None, inherited))
                assert found == (g[0], g[1], next(positions(g))[:2]), markup
                taken += 1
    assert taken >= 9
    with pytest.raises(GeometryError):
        geometry(tree_of(ElementTree.fromstring('<gml:Point xmlns:gml="http://www.opengis.net/gml/3.2"><gml:pos>1</gml:pos></gml:Point>')), Scope())


def test_conversion_of_many():
    from sparkgml.functions.project import Transform
    from sparkgml.operators.parse import converted, converted_all

    t = Transform(4326, 3857)
    many = [("Point", 2, (1.0, 2.0)), None, ("LineString", 3, [(1.0, 2.0, 5.0), (3.0, 4.0, 6.0)]), ("Polygon", 2, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], []]), ("GeometryCollection", 2, [("Point", 2, (7.0, 8.0)), ("MultiPoint", 2, [("Point", 2, (9.0, 1.0))])]), ("Point", 2, None)]
    assert converted_all(many, t) == [None if g is None else converted(g, t) for g in many] and converted_all([None], t) == [None]
