import json

import numpy as np
import pytest

from sparkgml.functions.crs import CRS84, KNOWN, crs_of
from sparkgml.functions.crs_text import METHOD_NAMES, Compound, by_name, classified, equivalent, from_proj, from_projjson, from_user_input, from_wkt, identify, to_proj, to_projjson, to_wkt, wkt_tree
from sparkgml.functions.geodesic import Ellipsoid, line_positions, polygon_area, solve_direct, solve_inverse
from sparkgml.functions.project import ProjectionError, Transform

WRITABLE = [c for c in KNOWN.values() if c.dimension == 2 and (c.geographic or c.projection[0] in METHOD_NAMES)]


@pytest.mark.parametrize("crs", WRITABLE, ids=lambda c: str(c.code))
def test_round_trips(crs):
    """By code, and by definition where the code is taken out."""
    for text in (to_wkt(crs), to_wkt(crs, 1), json.dumps(to_projjson(crs))):
        assert from_user_input(text) == crs
    for version, mark in ((2, f',ID["EPSG",{crs.code}]'), (1, f',AUTHORITY["EPSG","{crs.code}"]')):
        bare = from_wkt(to_wkt(crs, version).replace(mark, ""))
        assert bare.code == 0 and equivalent(bare, crs) and crs.code in identify(bare)
    data = to_projjson(crs)
    del data["id"]
    assert equivalent(from_projjson(data), crs)
    back = from_proj(to_proj(crs))
    assert equivalent(back, crs, False) or crs.datum not in ("WGS84", "ETRS89")


def test_user_input():
    assert [classified(x) for x in ("EPSG:4326", "4326", "+proj=longlat", "proj=utm zone=33", "urn:ogc:def:crs:EPSG::4326", "WGS 84 / World Mercator", '{"type": 1}', "PROJCS[]")] == ["epsg", "epsg", "proj", "proj", "srs", "name", "projjson", "wkt"]
    assert from_user_input("wgs 84 / pseudo-mercator").code == 3857 and by_name("ETRS89-extended / LAEA Europe").code == 3035 and from_user_input(32633).code == 32633
    both = from_user_input("urn:ogc:def:crs,crs:EPSG::25832,crs:EPSG::7837")
    assert isinstance(both, Compound) and both.vertical == 7837 and both.horizontal.code == 25832
    assert equivalent(from_wkt(f'COMPOUNDCRS["x",{to_wkt(both.horizontal)},VERTCRS["h",VDATUM["d"],CS[vertical,1],AXIS["h",up],ID["EPSG",7837]]]'), both) and not equivalent(both, both.horizontal)
    assert from_proj("+init=epsg:2180").code == 2180 and identify(from_proj("+proj=utm +zone=33 +datum=WGS84")) == [32633] and identify(from_proj("+proj=utm +zone=33 +south +datum=WGS84")) == [32733]
    assert not equivalent(CRS84, crs_of(4326)) and equivalent(CRS84, crs_of(4326), False)
    old = from_wkt('PROJCS["a",GEOGCS["b",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["Degree",0.017453292519943295]],PROJECTION["Transverse_Mercator"],PARAMETER["false_easting",500000],PARAMETER["central_meridian",15],PARAMETER["scale_factor",0.9996],PARAMETER["latitude_of_origin",0],UNIT["Meter",1]]')
    assert identify(old) == [32633]
    for bad in ("+proj=nope", "+proj=utm +zone=1 +ellps=nope", "PROJCS[", "no such name", 1, "GEOGCS[\"a\"]"):
        with pytest.raises(ProjectionError):
            from_user_input(bad)
    assert wkt_tree('A["x ""y""",1.5,B[north]]') == ["A", 'x "y"', 1.5, ["B", "north"]]


def test_proj_string_converts():
    a, b = Transform(from_proj("+proj=utm +zone=33 +datum=WGS84"), 4326), Transform(32633, 4326)
    assert np.allclose(a.convert(400000.0, 5500000.0), b.convert(400000.0, 5500000.0), atol=1e-12)
    feet = Transform(from_proj("+proj=tmerc +lon_0=15 +k=0.9996 +x_0=500000 +ellps=WGS84 +units=us-ft"), 4326)
    assert np.allclose(feet.convert(400000 * 3937 / 1200, 5500000 * 3937 / 1200), b.convert(400000.0, 5500000.0), atol=1e-9)


def test_geodesics():
    """Published values, antipodes, poles, and lines there and back."""
    az1, az2, s, _ = solve_inverse(-5.71475, 50.06632, -3.07009, 58.64402)
    assert float(s) == pytest.approx(969954.166, abs=1e-3) and float(az1) == pytest.approx(9.1418775, abs=1e-6)
    assert float(solve_inverse(0, 0, 179.5, 0.5)[2]) == pytest.approx(19936288.578965, abs=1e-5)
    assert float(solve_inverse(0, 0, 180, 0)[2]) == pytest.approx(20003931.458625, abs=1e-5)
    rng = np.random.default_rng(1)
    lon1, lat1, lon2, lat2 = rng.uniform(-180, 180, 500), rng.uniform(-90, 90, 500), rng.uniform(-180, 180, 500), rng.uniform(-90, 90, 500)
    lat1[:4], lat2[:4] = (90, -90, 0, 0), (0, 90, 90, 0)
    az1, az2, s, _ = solve_inverse(lon1, lat1, lon2, lat2)
    lon, lat, az = solve_direct(lon1, lat1, az1, s)
    away = lambda d: np.abs((d + 180) % 360 - 180)
    assert (away(lon - lon2) * np.cos(np.radians(lat2)) < 1e-10).all() and (np.abs(lat - lat2) < 1e-10).all() and (away(az - az2)[4:] < 1e-8).all()
    lon, lat = line_positions(0, 0, 90, 0, 2)
    assert np.allclose(lon, [30, 60]) and np.allclose(lat, 0)


def test_areas():
    whole = Ellipsoid().area
    assert whole == pytest.approx(510065621724088.44, rel=1e-12)
    assert polygon_area([0, 90, 0], [0, 0, 90])[0] == pytest.approx(whole / 8, rel=1e-12)
    assert polygon_area([0, 0, 90], [0, 90, 0])[0] == pytest.approx(-whole / 8, rel=1e-12)
    cap, length = polygon_area([0, 90, 180, 270], [60, 60, 60, 60])
    assert 2.0e13 < cap < whole / 8 and length == pytest.approx(4 * float(solve_inverse(0, 60, 90, 60)[2]))
    assert polygon_area([0, 1, 1, 0, 0], [0, 0, 1, 1, 0]) == (pytest.approx(12308778361.469, abs=1e-2), pytest.approx(443770.917, abs=1e-3))
    assert polygon_area([179, -179, -179, 179], [0, 0, 1, 1])[0] == pytest.approx(polygon_area([0, 2, 2, 0], [0, 0, 1, 1])[0], rel=1e-10)
    assert polygon_area([1], [2]) == (0.0, 0.0)
