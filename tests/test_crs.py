import numpy as np
import pytest

from sparkgml.functions.crs import KNOWN, Context, Crs, Evidence, add_user_crs, crs_of, decide, parse_srs, projjson
from sparkgml.functions.project import METHODS, Transform, laea, lcc, projection, sterea, tmerc


@pytest.mark.parametrize("raw, code", [
    ("EPSG:2180", "EPSG:2180"), ("http://www.opengis.net/gml/srs/epsg.xml#4326", "EPSG:4326"), ("urn:ogc:def:crs:EPSG::25832", "EPSG:25832"), ("urn:ogc:def:crs:EPSG:6.9:4326", "EPSG:4326"),
    ("urn:x-ogc:def:crs:EPSG:4326", "EPSG:4326"), ("http://www.opengis.net/def/crs/EPSG/0/4258", "EPSG:4258"), ("urn:ogc:def:crs,crs:EPSG::25832,crs:EPSG::7837", "EPSG:25832+7837"),
    ("http://www.opengis.net/def/crs-compound?1=http://www.opengis.net/def/crs/EPSG/0/25832&2=http://www.opengis.net/def/crs/EPSG/0/7837", "EPSG:25832+7837"),
    ("urn:adv:crs:ETRS89_UTM32*DE_DHHN2016_NH", "EPSG:25832"), ("4326", "EPSG:4326"), ("CRS:84", "OGC:CRS84"), ("+init=epsg:2180", "EPSG:2180"), ("WGS84", "EPSG:4326"), ("nonsense", None),
])
def test_names(raw, code):
    assert parse_srs(raw).authority_code() == code


def test_projjson():
    assert '"code": 2180' in projjson("EPSG:2180") and projjson("EPSG:1") is None and "CRS84" in projjson("CRS:84")


def test_decisions():
    urn, short = "urn:ogc:def:crs:EPSG::4326", "EPSG:4326"
    assert decide(urn, "gml3", None, Context()).swap and not decide(short, "gml3", None, Context()).swap
    assert decide(urn, "gml3", Evidence((100, 170), (10, 20)), Context()).swap is False  # only this reading fits
    assert decide(short, "gml3", Evidence((1, 2), (3, 4), ["Lat Long"]), Context()).reason == "axis labels"
    assert decide(short, "gml3", Evidence((1, 2), (3, 4), ["Lat Long"]), Context()).conflicts
    assert not decide(urn, "gml2", None, Context()).swap and not decide(urn, "gml3", None, Context(wfs_version="1.0")).swap
    assert decide(short, "gml3", None, Context(), "authority").swap and decide(short, "gml3", None, Context(), "yx").swap
    assert decide(short, "gml3", None, Context(), "xy", {short: "yx"}).swap
    assert decide("x", "gml3", None, Context()).reason == "unknown CRS"


def test_range_and_producers():
    urn, short = "urn:ogc:def:crs:EPSG::4258", "EPSG:4326"
    north = decide(urn, "gml3", Evidence((42, 42), (30, 30)), Context())
    assert north.swap and north.reason == "coordinate range"  # as (30, 42) it is in the area, as (42, 30) 1.8 degrees beyond
    add_user_crs(Crs(999998, "across", "N", True, "GRS80", (170, -40, -170, -10), "WGS84"))
    across = [decide("EPSG:999998", "gml3", Evidence(a, b), Context()) for a, b in (((-20, -15), (175, 179)), ((175, 179), (-20, -15)), ((-20, -15), (-179, 178)))]
    assert [(d.swap, d.reason) for d in across] == [(True, "coordinate range"), (False, "coordinate range"), (True, "coordinate range")]
    assert decide(short, "gml3", None, Context("fme")).swap and not decide("http://www.opengis.net/gml/srs/epsg.xml#4326", "gml3", None, Context("fme")).swap
    assert decide(short, "gml3", None, Context("mapserver.gis.umn.edu", "1.1.0")).swap and not decide(short, "gml3", None, Context("mapserver.gis.umn.edu", "1.0.0")).swap
    assert decide(short, "gml3", None, Context("/wfsserver", "1.1.0")).reason == "ArcGIS Server's WFS 1.1"
    assert decide(short, "gml3", None, Context("", "1.1.0", "urn:ogc:def:crs:EPSG::4326")).swap and not decide(short, "gml3", None, Context("", "1.1.0")).swap
    warned = decide(short, "gml3", Evidence((10, 11), (50, 51), [], (49, 9, 52, 12)), Context(requested_box=(49, 9, 52, 12)))
    assert len(warned.conflicts) == 2 and not warned.swap


def test_published_examples():
    """Worked examples of the EPSG guidance note on coordinate conversions."""
    lon, lat = np.array([0.5]), np.array([50.5])
    assert np.allclose(tmerc("airy", 49, -2, 0.9996012717, 400000, -100000)[0](lon, lat), [[577274.99], [69740.50]], atol=0.02)
    assert np.allclose(laea("GRS80", 52, 10, 4321000, 3210000)[0](np.array([5.0]), np.array([50.0])), [[3962799.45], [2999718.85]], atol=0.01)
    assert np.allclose(sterea("bessel", 52.15616055555555, 5.38763888888889, 0.9999079, 155000, 463000)[0](np.array([6.0]), np.array([53.0])), [[196105.283], [557057.739]], atol=0.002)
    assert np.allclose(lcc("clrk66", 27.833333333333332, -99, 28.383333333333333, 30.283333333333335, 2000000 * 1200 / 3937, 0)[0](np.array([-96.0]), np.array([28.5])), [[2963503.91 * 1200 / 3937], [254759.80 * 1200 / 3937]], atol=0.01)


def dms(d, m, s):
    return d + m / 60 + s / 3600


def test_published_examples_of_other_methods():
    link = 0.201166195164
    x, y = METHODS["cass"]("clrk58", dms(10, 26, 30), -dms(61, 20, 0), 430000 * link, 325000 * link)[0](np.array([-62.0]), np.array([10.0]))
    assert np.allclose([x / link, y / link], [[66644.94], [82536.22]], atol=0.01)
    krovak = METHODS["krovak"]("bessel", 49.5, dms(24, 50, 0), dms(30, 17, 17.3031), 78.5, 0.9999, 0, 0)[0](np.array([dms(16, 50, 59.179)]), np.array([dms(50, 12, 32.442)]))
    assert np.allclose(krovak, [[-568990.995], [-1050538.63]], atol=0.01)
    omerc = METHODS["omerc"]("evrst67", 4, 115, dms(53, 18, 56.9537), dms(53, 7, 48.3685), 0.99984, 590476.87, 442857.65)[0](np.array([dms(115, 48, 19.8196)]), np.array([dms(5, 23, 14.1129)]))
    assert np.allclose(omerc, [[679245.73], [596562.78]], atol=0.01)


@pytest.mark.parametrize("method, parameters", [
    ("bonne", ("GRS80", 40.0, 10.0, 0.0, 0.0)), ("eqdc", ("GRS80", 40.0, 10.0, 30.0, 50.0, 0.0, 0.0)), ("poly", ("GRS80", 0.0, 10.0, 0.0, 0.0)), ("eqc", ("WGS84", 30.0, 10.0, 0.0, 0.0)), ("sinu", ("WGS84", 10.0, 0.0, 0.0)), ("moll", ("WGS84", 10.0, 0.0, 0.0)),
    *[(m, ("sphere", 30.0, 10.0, 0.0, 0.0)) for m in ("aeqd_sphere", "ortho_sphere", "gnom", "stere_sphere")], *[(m, ("sphere", 10.0, 0.0, 0.0)) for m in ("mill", "gall", "natearth", "eck3", "craster", "wag3", "eck1", "eck2", "eck4", "eck5", "eck6", "wag6", "kav7", "putp1", "collg", "nell", "nell_h", "qua_aut", "times", "fahey", "robin", "patterson", "comill", "cc", "hammer", "aitoff", "wintri", "boggs")],
    ("somerc", ("bessel", 46.95240555555556, 7.439583333333333, 1.0, 0.0, 0.0)), ("geos", ("GRS80", 35785831.0, 9.0, 0.0, 0.0)), ("ob_tran", ("sphere", "longlat", 40.0, -170.0, 10.0)), ("ob_tran", ("sphere", "moll", 45.0, -100.0, 0.0)),
    ("loxim", ("sphere", 20.0, 10.0, 0.0, 0.0)), ("nsper", ("sphere", 30.0, 10.0, 3e6, 0.0, 0.0)),
])
def test_other_round_trips(method, parameters):
    forward, inverse = METHODS[method](*parameters)
    lon, lat = inverse(*forward(np.array([12.0, 8.0]), np.array([35.0, 42.0])))
    assert np.allclose(lon, [12, 8], atol=1e-9) and np.allclose(lat, [35, 42], atol=1e-9)


@pytest.mark.parametrize("code", [c for c in KNOWN if not KNOWN[c].geographic] + [32633, 32733, 25832, 26917, 31468, 3879, 5110, 3946, 3012, 28355, 31983])
def test_round_trips(code):
    crs = crs_of(code)
    west, south, east, north = crs.area
    lon = np.array([west + (east - west) * t for t in (0.2, 0.5, 0.7)])
    lat = np.clip(np.array([south + (north - south) * t for t in (0.2, 0.5, 0.8)]), -89, 89)
    forward, inverse = projection(crs)
    x, y = inverse(*forward(lon, lat))
    assert np.allclose((x - lon + 180) % 360, 180, atol=1e-9) and np.allclose(y, lat, atol=1e-9)


def test_oblique_and_grids():
    assert Transform(Crs(0, "", "E", True, "bessel", (0, 0, 1, 1), "CH1903+"), 2056).convert(7.439583333333333, 46.952405555555565) == pytest.approx((2600000, 1200000), abs=1e-6)
    forward, inverse = METHODS["nzmg"]("intl", -41.0, 173.0, 2510000.0, 6023150.0)
    assert np.allclose(forward(172.739194, -34.444066), (2487100.638, 6751049.719), atol=0.1) and np.allclose(inverse(2487100.638, 6751049.719), (172.739194, -34.444066), atol=1e-6)
    assert np.isnan(METHODS["geos"]("GRS80", 35785831.0, 0.0, 0.0, 0.0)[0](np.array([120.0]), np.array([0.0]))[0]).all()
    pole = METHODS["ob_tran"]("sphere", "longlat", 30.0, 0.0, 0.0)[0](np.array([180.0]), np.array([30.0]))
    assert pole[1] == pytest.approx(90.0, abs=1e-5)
    from sparkgml.functions.crs_text import from_proj

    assert Transform(from_proj("+proj=ob_tran +o_proj=merc +o_lat_p=90 +o_lon_p=0 +R=6371000"), from_proj("+proj=merc +R=6371000")).convert(1e6, 2e6) == pytest.approx((1e6, 2e6), abs=1e-3)


def test_zones():
    names = {31468: "DHDN / 3-degree Gauss-Kruger zone 4", 3879: "ETRS89 / GK25FIN", 5110: "ETRS89 / NTM zone 10", 3946: "RGF93 v1 / CC46", 3011: "SWEREF99 18 00", 28355: "GDA94 / MGA zone 55", 31983: "SIRGAS 2000 / UTM zone 23S"}
    assert {k: crs_of(k).name for k in names} == names and crs_of(31470) is None
    assert Transform(4258, 3946).convert(3.0, 46.0) == pytest.approx((1700000, 5200000), abs=1) and Transform(4258, 3879).convert(25.0, 0.0) == pytest.approx((25500000, 0), abs=1e-6)


def test_transform():
    t = Transform(27700, 4326)
    assert t.operations() == ["inverse tmerc", "Helmert OSGB36 to WGS84"]
    x, y = t.inverse().convert(*t.convert(577274.99, 69740.50))
    assert abs(x - 577274.99) < 0.01 and abs(y - 69740.5) < 0.01
    assert Transform(4326, 3857, authority_order=True).convert(0.0, 180.0)[0] == pytest.approx(20037508.342789244)
    assert Transform(4326, 3857).convert_bounds((0, 0, 180, 10))[2] == pytest.approx(20037508.342789244)
    add_user_crs(Crs(999999, "own", "E", False, "GRS80", (0, 0, 6, 50), "ETRS89", ("tmerc", 0.0, 3.0, 1.0, 0.0, 0.0)))
    assert abs(float(Transform(4258, 999999).convert(3.0, 0.0)[0])) < 1e-6
