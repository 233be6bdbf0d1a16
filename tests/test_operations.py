import numpy as np
import pytest

from sparkgml.functions.operations import CATALOG, Operation, Pipeline, SelectedTransform, candidates, deduplicated, filtered, inside, overlap, ranked
from sparkgml.functions.project import ProjectionError, Transform
from sparkgml.proj import CRS, Geod, Proj, Transformer


def test_search_filter_rank():
    found = ranked(candidates("S-JTSK", "WGS84"))
    assert [c.accuracy for c in found] == [1.0, 6.0] and str(found[0]) == "S-JTSK to WGS84"
    slovakia, czech = (17.5, 47.8, 22.0, 49.3), (13.0, 49.0, 15.0, 50.5)
    assert ranked(candidates("S-JTSK", "WGS84"), slovakia)[0].accuracy == 6.0 and ranked(candidates("S-JTSK", "WGS84"), czech)[0].accuracy == 1.0
    assert filtered(candidates("OSGB36", "WGS84"), (100, 0, 110, 10)) == [] and [c.accuracy for c in filtered(candidates("OSGB36", "WGS84"), None, 5.0)][0] == 2.0
    pair = ranked(candidates("BD72", "Amersfoort"))[0]
    assert [s.name for s in pair.steps] == ["BD72 to WGS84", "WGS84 to Amersfoort"] and pair.accuracy == pytest.approx(2**0.5)
    assert all(c.steps[0].target == "ETRS89" for c in candidates("OSGB36", "WGS84", via="ETRS89")) and candidates("WGS84", "WGS84")[0].steps == ()
    double = [*CATALOG, CATALOG[2]]
    assert len(deduplicated(candidates("OSGB36", "WGS84", catalog=double))) < len(candidates("OSGB36", "WGS84", catalog=double))
    assert overlap((170, 0, -170, 10), (175, 0, 179, 10)) == 40 and inside((170, 0, -170, 10), np.array([175, -175, 0]), np.array([5, 5, 5])).tolist() == [True, True, False]
    assert Operation("a", "b", None, (0, 0, 1, 1), 1.0).inverse().name == "b to a"


def test_selected():
    t = SelectedTransform(5514, 4326)
    east, west = Transform(4326, 5514).convert(20.0, 49.0), Transform(4326, 5514).convert(14.5, 50.0)
    assert t.chosen(np.array([20.0, 14.5]), np.array([49.0, 50.0])).tolist() == [1, 0]
    lon, lat = t.convert(*np.transpose([east, west]))
    assert abs(lon[0] - 20.0) < 1e-7 and 1e-6 < abs(lon[1] - 14.5) < 1e-3  # heights go; the better operation is another one there
    same = SelectedTransform(27700, 4326)
    assert np.allclose(same.convert(577274.99, 69740.50), Transform(27700, 4326).convert(577274.99, 69740.50), atol=1e-12)
    back = SelectedTransform(4326, 27700).convert(*same.convert(577274.99, 69740.50))
    assert np.allclose(back, (577274.99, 69740.50), atol=0.01)
    with pytest.raises(ProjectionError):
        SelectedTransform(27700, 4326, area=(100, 0, 110, 10))


def test_pipelines():
    utm = Pipeline("+proj=pipeline +step +proj=axisswap +order=2,1 +step +proj=unitconvert +xy_in=deg +xy_out=rad +step +proj=utm +zone=33 +ellps=WGS84")
    x, y, *_ = utm.convert(50.0, 15.0)
    assert np.allclose((x, y), Transform(4326, 32633).convert(15.0, 50.0), atol=1e-9)
    assert np.allclose(utm.convert(x, y, inverse=True)[:2], (50.0, 15.0), atol=1e-12)
    shift = Pipeline("+proj=pipeline +step +inv +proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy +step +proj=cart +ellps=airy +step +proj=helmert +x=446.448 +y=-125.157 +z=542.06 +rx=0.15 +ry=0.247 +rz=0.842 +s=-20.489 +convention=position_vector +step +inv +proj=cart +ellps=WGS84 +step +proj=unitconvert +xy_in=rad +xy_out=deg")
    assert np.allclose(shift.convert(577274.99, 69740.50)[:2], Transform(27700, 4326).convert(577274.99, 69740.50), atol=1e-10)
    frame, vector = (Pipeline(f"+proj=helmert +x=1 +rx={r} +convention={c}") for r, c in ((2, "coordinate_frame"), (-2, "position_vector")))
    assert np.allclose(frame.convert(1e6, 2e6, 3e6), vector.convert(1e6, 2e6, 3e6))
    pivot = Pipeline("+proj=molobadekas +x=10 +rz=3 +px=1000000 +py=2000000 +pz=3000000 +convention=position_vector")
    assert np.allclose(pivot.convert(1e6, 2e6, 3e6)[:3], (1000010, 2e6, 3e6)) and np.allclose(pivot.convert(*pivot.convert(5e5, 6e5, 7e5), inverse=True)[:3], (5e5, 6e5, 7e5))
    off = Pipeline("+proj=pipeline +step +proj=unitconvert +xy_in=deg +xy_out=rad +step +proj=geogoffset +dlon=3600 +dlat=-1800 +step +proj=unitconvert +xy_in=rad +xy_out=deg")
    assert np.allclose(off.convert(10, 20)[:2], (11, 19.5)) and np.allclose(Pipeline("+proj=pipeline +inv " + off.text.split("pipeline ")[1]).convert(11, 19.5)[:2], (10, 20))
    flat = Pipeline("+proj=affine +xoff=5 +s11=2 +s12=1")
    assert np.allclose(flat.convert(1, 3)[:2], (10, 3)) and np.allclose(flat.convert(10, 3, inverse=True)[:2], (1, 3))
    kept = Pipeline("+proj=pipeline +step +proj=push +v_3 +step +proj=affine +zoff=9 +step +proj=pop +v_3")
    assert kept.convert(0, 0, 4)[2] == 4
    assert Pipeline("+proj=axisswap +order=2,-1").convert(1, 2)[:2] == (2, -1) and Pipeline("+proj=axisswap +order=2,-1").convert(2, -1, inverse=True)[:2] == (1, 2)
    with pytest.raises(ProjectionError):
        Pipeline("+proj=nope")


def test_objects():
    crs = CRS("EPSG:2180")
    assert crs.is_projected and crs.to_epsg() == 2180 and crs.axis_directions == ["north", "east"] and CRS(crs.to_wkt()) == crs and CRS.from_epsg(4326).is_geographic
    assert CRS(crs.to_json_dict()) == crs and CRS("CRS:84").to_authority() == ("OGC", "CRS84") and CRS("+proj=utm +zone=33 +datum=WGS84").to_epsg() == 32633 and not CRS(4326) == CRS(3857)
    t = Transformer.from_crs(4326, 3857)
    assert t.transform(0.0, 180.0)[0] == pytest.approx(20037508.342789244) and Transformer.from_crs(4326, 3857, always_xy=True).transform(180.0, 0.0)[0] == pytest.approx(20037508.342789244)
    assert t.transform(*t.transform(10.0, 20.0), inverse=True) == pytest.approx((10.0, 20.0)) and list(t.itransform([(0.0, 0.0)])) == [pytest.approx((0.0, 0.0), abs=1e-6)]
    assert Transformer.from_pipeline("+proj=affine +xoff=1").transform(1.0, 2.0) == (2.0, 2.0) and "WGS84" in Transformer.from_crs(27700, 4326).description
    g = Geod()
    assert g.inv(0, 0, 0, 1)[2] == pytest.approx(110574.389, abs=1e-3) and g.npts(0, 0, 90, 0, 1)[0] == pytest.approx((45, 0)) and g.line_length([0, 1, 2], [0, 0, 0]) == pytest.approx(2 * 111319.490793, abs=1e-4)
    assert g.polygon_area_perimeter([0, 90, 0], [0, 0, 90])[0] > 0 and Geod(a=1.0).inv(0, 0, 90, 0)[2] == pytest.approx(np.pi / 2) and g.fwd(0, 0, 90, 111319.49079327358)[0] == pytest.approx(1.0)
    p = Proj("+proj=merc +ellps=WGS84")
    assert p(*p(12.0, 34.0), inverse=True) == pytest.approx((12.0, 34.0))
