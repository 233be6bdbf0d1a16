"""Coordinate reference systems: names as documents write them, facts, axis order decided from evidence."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache

from .gml_geometry import Node, is_legacy


@dataclass(frozen=True)
class Crs:
    """What is known of a CRS. area: west, south, east, north in degrees; projection: method and parameters, none if geographic."""

    code: int
    name: str
    first_axis: str  # N or E: what the authority's first axis points to
    geographic: bool
    ellipsoid: str
    area: tuple[float, float, float, float]
    datum: str
    projection: tuple = ()
    unit: float = 1.0
    dimension: int = 2


#: Names, axes, areas and projection parameters of common systems, from the published EPSG dataset.
KNOWN = {c.code: c for c in (
    Crs(4326, "WGS 84", "N", True, "WGS84", (-180, -90, 180, 90), "WGS84"),
    Crs(4979, "WGS 84 (3D)", "N", True, "WGS84", (-180, -90, 180, 90), "WGS84", dimension=3),
    Crs(4258, "ETRS89", "N", True, "GRS80", (-16.1, 32.88, 40.18, 84.73), "ETRS89"),
    Crs(4937, "ETRS89 (3D)", "N", True, "GRS80", (-16.1, 32.88, 40.18, 84.73), "ETRS89", dimension=3),
    Crs(4269, "NAD83", "N", True, "GRS80", (-172.54, 14.92, -47.74, 86.46), "NAD83"),
    Crs(4171, "RGF93 v1", "N", True, "GRS80", (-9.86, 41.15, 10.38, 51.56), "ETRS89"),
    Crs(3857, "WGS 84 / Pseudo-Mercator", "E", False, "WGS84", (-180, -85.06, 180, 85.06), "WGS84", ("webmerc", 0.0, 0.0)),
    Crs(3395, "WGS 84 / World Mercator", "E", False, "WGS84", (-180, -80, 180, 84), "WGS84", ("merc", 0.0, 0.0, 1.0, 0.0, 0.0)),
    Crs(2180, "ETRF2000-PL / CS92", "N", False, "GRS80", (14.14, 49, 24.15, 55.93), "ETRS89", ("tmerc", 0.0, 19.0, 0.9993, 500000.0, -5300000.0)),
    Crs(2176, "ETRF2000-PL / CS2000/15", "N", False, "GRS80", (14.14, 50.25, 16.5, 55.35), "ETRS89", ("tmerc", 0.0, 15.0, 0.999923, 5500000.0, 0.0)),
    Crs(2177, "ETRF2000-PL / CS2000/18", "N", False, "GRS80", (16.5, 49.33, 19.5, 55.93), "ETRS89", ("tmerc", 0.0, 18.0, 0.999923, 6500000.0, 0.0)),
    Crs(2178, "ETRF2000-PL / CS2000/21", "N", False, "GRS80", (19.5, 49.09, 22.5, 54.55), "ETRS89", ("tmerc", 0.0, 21.0, 0.999923, 7500000.0, 0.0)),
    Crs(2179, "ETRF2000-PL / CS2000/24", "N", False, "GRS80", (22.5, 49, 24.15, 54.51), "ETRS89", ("tmerc", 0.0, 24.0, 0.999923, 8500000.0, 0.0)),
    Crs(3035, "ETRS89-extended / LAEA Europe", "N", False, "GRS80", (-35.58, 24.6, 44.83, 84.73), "ETRS89", ("laea", 52.0, 10.0, 4321000.0, 3210000.0)),
    Crs(3034, "ETRS89-extended / LCC Europe", "N", False, "GRS80", (-35.58, 24.6, 44.83, 84.73), "ETRS89", ("lcc", 52.0, 10.0, 35.0, 65.0, 4000000.0, 2800000.0)),
    Crs(2154, "RGF93 v1 / Lambert-93", "E", False, "GRS80", (-9.86, 41.15, 10.38, 51.56), "ETRS89", ("lcc", 46.5, 3.0, 49.0, 44.0, 700000.0, 6600000.0)),
    Crs(3812, "ETRS89 / Belgian Lambert 2008", "E", False, "GRS80", (2.5, 49.5, 6.4, 51.51), "ETRS89", ("lcc", 50.797815, 4.359215833333333, 49.833333333333336, 51.166666666666664, 649328.0, 665262.0)),
    Crs(3301, "Estonian Coordinate System of 1997", "N", False, "GRS80", (20.37, 57.52, 28.2, 60), "ETRS89", ("lcc", 57.517553930555555, 24.0, 59.333333333333336, 58.0, 500000.0, 6375000.0)),
    Crs(27700, "OSGB36 / British National Grid", "E", False, "airy", (-9.01, 49.75, 2.01, 61.01), "OSGB36", ("tmerc", 49.0, -2.0, 0.9996012717, 400000.0, -100000.0)),
    Crs(31255, "MGI / Austria GK Central", "N", False, "bessel", (11.83, 46.4, 14.84, 48.8), "MGI", ("tmerc", 0.0, 13.333333333333334, 1.0, 0.0, -5000000.0)),
    Crs(31370, "BD72 / Belgian Lambert 72", "E", False, "intl", (2.5, 49.5, 6.4, 51.51), "BD72", ("lcc", 90.0, 4.367486666666666, 51.16666723333333, 49.8333339, 150000.013, 5400088.438)),
    Crs(5070, "NAD83 / Conus Albers", "E", False, "GRS80", (-124.79, 24.41, -66.91, 49.38), "NAD83", ("aea", 23.0, -96.0, 29.5, 45.5, 0.0, 0.0)),
    Crs(3031, "WGS 84 / Antarctic Polar Stereographic", "E", False, "WGS84", (-180, -90, 180, -60), "WGS84", ("stere", -71.0, 0.0, 0.0, 0.0)),
    Crs(3995, "WGS 84 / Arctic Polar Stereographic", "E", False, "WGS84", (-180, 60, 180, 90), "WGS84", ("stere", 71.0, 0.0, 0.0, 0.0)),
    Crs(28992, "Amersfoort / RD New", "E", False, "bessel", (3.2, 50.75, 7.22, 53.7), "Amersfoort", ("sterea", 52.15616055555555, 5.38763888888889, 0.9999079, 155000.0, 463000.0)),
    Crs(5514, "S-JTSK / Krovak East North", "E", False, "bessel", (12.09, 47.73, 22.56, 51.06), "S-JTSK", ("krovak", 49.5, 24.833333333333332, 30.28813975277778, 78.5, 0.9999, 0.0, 0.0)),
    Crs(6933, "WGS 84 / NSIDC EASE-Grid 2.0 Global", "E", False, "WGS84", (-180, -86, 180, 86), "WGS84", ("cea", 30.0, 0.0, 0.0, 0.0)),
    Crs(8857, "WGS 84 / Equal Earth Greenwich", "E", False, "WGS84", (-180, -90, 180, 90), "WGS84", ("eqearth", 0.0, 0.0, 0.0)),
)}
#: More national systems of the dataset, by transverse Mercator.
KNOWN |= {c.code: c for c in (
    Crs(3006, "SWEREF99 TM", "N", False, "GRS80", (10.03, 54.96, 24.17, 69.07), "ETRS89", ("tmerc", 0.0, 15.0, 0.9996, 500000.0, 0.0)),
    Crs(3059, "LKS92 / Latvia TM", "N", False, "GRS80", (19.06, 55.67, 28.24, 58.09), "ETRS89", ("tmerc", 0.0, 24.0, 0.9996, 500000.0, -6000000.0)),
    Crs(3346, "LKS94 / Lithuania TM", "N", False, "GRS80", (19.02, 53.89, 26.82, 56.45), "ETRS89", ("tmerc", 0.0, 24.0, 0.9998, 500000.0, 0.0)),
    Crs(3067, "ETRS89 / TM35FIN(E,N)", "E", False, "GRS80", (19.08, 58.84, 31.59, 70.09), "ETRS89", ("tmerc", 0.0, 27.0, 0.9996, 500000.0, 0.0)),
    Crs(3765, "HTRS96 / Croatia TM", "E", False, "GRS80", (13.0, 41.62, 19.43, 46.54), "ETRS89", ("tmerc", 0.0, 16.5, 0.9999, 500000.0, 0.0)),
    Crs(2157, "IRENET95 / Irish Transverse Mercator", "E", False, "GRS80", (-10.56, 51.39, -5.34, 55.43), "ETRS89", ("tmerc", 53.5, -8.0, 0.99982, 600000.0, 750000.0)),
    Crs(3763, "ETRS89 / Portugal TM06", "E", False, "GRS80", (-9.56, 36.95, -6.19, 42.16), "ETRS89", ("tmerc", 39.66825833333333, -8.133108333333334, 1.0, 0.0, 0.0)),
    Crs(2193, "NZGD2000 / New Zealand Transverse Mercator 2000", "N", False, "GRS80", (166.37, -47.33, 178.63, -34.1), "NZGD2000", ("tmerc", 0.0, 173.0, 0.9996, 1600000.0, 10000000.0)),
    Crs(2056, "CH1903+ / LV95", "E", False, "bessel", (5.96, 45.82, 10.49, 47.81), "CH1903+", ("somerc", 46.952405555555565, 7.439583333333333, 1.0, 2600000.0, 1200000.0)),
    Crs(21781, "CH1903 / LV03", "E", False, "bessel", (5.96, 45.82, 10.49, 47.81), "CH1903+", ("somerc", 46.952405555555565, 7.439583333333333, 1.0, 600000.0, 200000.0)),
    Crs(27200, "NZGD49 / New Zealand Map Grid", "N", False, "intl", (166.37, -47.33, 178.63, -34.1), "NZGD49", ("nzmg", -41.0, 173.0, 2510000.0, 6023150.0)),
    Crs(4283, "GDA94", "N", True, "GRS80", (93.41, -60.55, 173.34, -8.47), "GDA94"), Crs(4167, "NZGD2000", "N", True, "GRS80", (160.6, -55.95, -171.2, -25.88), "NZGD2000"), Crs(4674, "SIRGAS 2000", "N", True, "GRS80", (-122.19, -59.87, -25.28, 32.72), "SIRGAS2000"),
    Crs(4277, "OSGB36", "N", True, "airy", (-9.01, 49.75, 2.01, 61.01), "OSGB36"), Crs(4312, "MGI", "N", True, "bessel", (9.53, 46.4, 17.17, 49.02), "MGI"), Crs(4289, "Amersfoort", "N", True, "bessel", (3.2, 50.75, 7.22, 53.7), "Amersfoort"), Crs(4313, "BD72", "N", True, "intl", (2.5, 49.5, 6.4, 51.51), "BD72"), Crs(4156, "S-JTSK", "N", True, "bessel", (12.09, 47.73, 22.56, 51.06), "S-JTSK"), Crs(4314, "DHDN", "N", True, "bessel", (5.86, 47.27, 13.84, 55.09), "DHDN"),
)}


def by_zone(code: int) -> Crs | None:
    """Systems that follow from the number of a zone."""
    if 31466 <= code <= 31469:
        zone = code - 31464
        return Crs(code, f"DHDN / 3-degree Gauss-Kruger zone {zone}", "N", False, "bessel", (zone * 3 - 1.5, 47.27, zone * 3 + 1.5, 55.09), "DHDN", ("tmerc", 0.0, zone * 3.0, 1.0, zone * 1e6 + 500000, 0.0))
    if 3873 <= code <= 3885:
        zone = code - 3854
        return Crs(code, f"ETRS89 / GK{zone}FIN", "N", False, "GRS80", (zone - 0.5, 59.3, zone + 0.5, 70.09), "ETRS89", ("tmerc", 0.0, float(zone), 1.0, zone * 1e6 + 500000, 0.0))
    if 5105 <= code <= 5130:
        zone = code - 5100
        return Crs(code, f"ETRS89 / NTM zone {zone}", "N", False, "GRS80", (float(zone), 57.9, zone + 1.0, 71.24), "ETRS89", ("tmerc", 58.0, zone + 0.5, 1.0, 100000.0, 1000000.0))
    if 3942 <= code <= 3950:
        zone = code - 3900
        return Crs(code, f"RGF93 v1 / CC{zone}", "E", False, "GRS80", (-4.87, zone - 1.0, 9.63, zone + 1.0), "ETRS89", ("lcc", float(zone), 3.0, zone - 0.75, zone + 0.75, 1700000.0, (zone - 41) * 1e6 + 200000))
    if 3007 <= code <= 3018:
        middle = (12.0, 13.5, 15.0, 16.5, 18.0, 14.25, 15.75, 17.25, 18.75, 20.25, 21.75, 23.25)[code - 3007]
        return Crs(code, f"SWEREF99 {int(middle)} {round(middle % 1 * 60):02d}", "N", False, "GRS80", (middle - 1.0, 54.96, middle + 1.0, 69.07), "ETRS89", ("tmerc", 0.0, middle, 1.0, 150000.0, 0.0))
    for base, first, last, datum, title in ((28300, 48, 58, "GDA94", "GDA94 / MGA zone"), (31960, 18, 25, "SIRGAS2000", "SIRGAS 2000 / UTM zone")):
        zone = code - base
        if first <= zone <= last:
            west = zone * 6 - 186.0
            return Crs(code, f"{title} {zone}" + ("S" if base == 31960 else ""), "E", False, "GRS80", (west, -60.0, west + 6, 0.0), datum, ("tmerc", 0.0, west + 3, 0.9996, 500000.0, 10000000.0))
    return None


#: Names that stand for a code.
NAMED = {"wgs84": 4326, "wgs 84": 4326, "etrs89": 4258, "crs84": -84, "ogc:crs84": -84, "wgs 84 / pseudo-mercator": 3857, "google": 3857}
CRS84 = Crs(-84, "WGS 84 (CRS84)", "E", True, "WGS84", (-180, -90, 180, 90), "WGS84")
_user: dict[int, Crs] = {}


def add_user_crs(crs: Crs) -> None:
    """An entry of the user's own; it wins over a known one."""
    _user[crs.code] = crs
    crs_of.cache_clear()


@lru_cache(maxsize=4096)
def crs_of(code: int) -> Crs | None:
    """Facts by EPSG code; UTM zones follow from their numbers."""
    if code in _user:
        return _user[code]
    if code in KNOWN:
        return KNOWN[code]
    if code == -84:
        return CRS84
    if (crs := by_zone(code)) is not None:
        return crs
    for base, south, datum, ellipsoid in ((32600, False, "WGS84", "WGS84"), (32700, True, "WGS84", "WGS84"), (25800, False, "ETRS89", "GRS80"), (26900, False, "NAD83", "GRS80")):
        zone = code - base
        if 1 <= zone <= 60 and (base != 25800 or 28 <= zone <= 38) and (base != 26900 or zone <= 23):
            west = zone * 6 - 186.0
            area = (west, -80.0 if south else 0.0, west + 6, 0.0 if south else 84.0)
            return Crs(code, f"{datum} / UTM zone {zone}{'S' if south else 'N'}", "E", False, ellipsoid, area, datum, ("tmerc", 0.0, west + 3, 0.9996, 500000.0, 10000000.0 if south else 0.0))
    return None


@dataclass(frozen=True)
class SrsName:
    """A srsName: its form, the code found, a vertical part if it is compound."""

    raw: str
    form: str  # short, legacy, urn, x-ogc, uri, kvp, compound, adv, proj, bare, name, unknown
    code: int | None = None
    vertical: int | None = None

    def authority_code(self) -> str | None:
        if self.code == -84:
            return "OGC:CRS84"
        return None if self.code is None else f"EPSG:{self.code}" + (f"+{self.vertical}" if self.vertical else "")


#: Names of the German surveyors' scheme.
ADV = {"ETRS89_UTM31": 25831, "ETRS89_UTM32": 25832, "ETRS89_UTM33": 25833, "ETRS89_Lat-Lon": 4258, "WGS84_Lat-Lon": 4326}


@lru_cache(maxsize=4096)
def parse_srs(raw: str) -> SrsName:
    """The spellings that documents use for a CRS."""
    s = raw.strip()
    low = s.lower()
    if low.startswith("urn:ogc:def:crs,crs:"):
        codes = [int(c) for c in re.findall(r"crs:epsg:[^:,]*:(\d+)", low)]
        return SrsName(raw, "compound", *codes[:2]) if codes else SrsName(raw, "unknown")
    if m := re.match(r"https?://www\.opengis\.net/def/crs-compound\?(.*)", s, re.I):
        codes = [int(c) for c in re.findall(r"/def/crs/EPSG/[^/]*/(\d+)", m[1], re.I)]
        return SrsName(raw, "compound", *codes[:2]) if codes else SrsName(raw, "unknown")
    for form, pattern in (("short", r"epsg:(\d+)"), ("legacy", r"https?://www\.opengis\.net/gml/srs/epsg\.xml#(\d+)"), ("urn", r"urn:ogc:def:crs:epsg:[^:]*:(\d+)"), ("x-ogc", r"urn:x-ogc:def:crs:epsg:(?:[^:]*:)?(\d+)"), ("urn", r"urn:epsg:geographiccrs:(\d+)"), ("urn", r"urn:epsg:def:crs:[^:]*:[^:]*:(\d+)"), ("uri", r"https?://www\.opengis\.net/def/crs/epsg/[^/]*/(\d+)"), ("kvp", r"https?://.*[?&]code=(\d+).*"), ("bare", r"(\d{4,6})")):
        if m := re.fullmatch(pattern, low):
            return SrsName(raw, form, int(m[1]))
    if re.fullmatch(r"(urn:(x-)?ogc:def:crs:ogc:[^:]*:crs84|https?://www\.opengis\.net/def/crs/ogc/[^/]*/crs84|ogc:crs84|crs:84)", low):
        return SrsName(raw, "uri" if low.startswith("http") else "urn", -84)
    if m := re.fullmatch(r"urn:adv:crs:([\w-]+?)(?:\*[\w-]+)?", s, re.I):
        return SrsName(raw, "adv", ADV.get(m[1]))
    if s.startswith("+"):
        m = re.search(r"\+init=epsg:(\d+)", low)
        return SrsName(raw, "proj", int(m[1]) if m else None)
    return SrsName(raw, "name", NAMED[low]) if low in NAMED else SrsName(raw, "unknown")


def projjson(srs: str) -> str | None:
    """PROJJSON of a srsName's CRS, if it is known."""
    from .crs_text import to_projjson

    name = parse_srs(srs)
    crs = crs_of(name.code) if name.code else None
    return None if crs is None else json.dumps(to_projjson(crs))


def dialect_of(node: Node) -> str:
    return "gml2" if is_legacy(node) else "gml3"


@dataclass
class Evidence:
    """Ranges of first positions as written; axisLabels; corners of envelopes (least a, least b, greatest a, greatest b)."""

    a: tuple[float, float]
    b: tuple[float, float]
    labels: list[str] = field(default_factory=list)
    envelope: tuple[float, float, float, float] | None = None


@dataclass
class Context:
    """Of a source: who made it, the WFS version it says, the srsName and box that were asked for."""

    producer: str = ""
    wfs_version: str = ""
    requested_srs: str = ""
    requested_box: tuple[float, float, float, float] | None = None


@dataclass
class Decision:
    """Whether to swap, why, and which other votes disagreed."""

    swap: bool
    reason: str
    conflicts: list[str] = field(default_factory=list)


def label_vote(labels: list[str]) -> str | None:
    votes = set()
    for text in labels:
        first = re.split(r"[\s,]+", (text or "").strip().lower())[0]
        if first in ("lat", "latitude", "φ", "phi", "n", "northing", "y"):
            votes.add("N")
        elif first in ("lon", "long", "longitude", "λ", "lambda", "e", "easting", "x"):
            votes.add("E")
    return votes.pop() if len(votes) == 1 else None


#: What a coordinate may lie beyond the published area of use, in the CRS's units.
SLACK = 0.1


def writes_authority_order(context: Context, form: str) -> str | None:
    """A producer that writes short srsNames in the order of the CRS."""
    if form != "short":
        return None
    who = context.producer.lower()
    if "fme" in who:
        return "FME"
    if context.wfs_version.startswith("1.1"):
        if "mapserver.gis.umn.edu" in who:
            return "MapServer's WFS 1.1"
        if "/wfsserver" in who:
            return "ArcGIS Server's WFS 1.1"
    return None


def wfs_vote(context: Context, form: str) -> tuple[str, str] | None:
    """What the version of the service says of a CRS with north first."""
    version = context.wfs_version
    if version.startswith("1.0"):
        return "WFS 1.0", "E"
    if not version.startswith(("1.1", "2")):
        return None
    if form == "legacy":
        return "legacy name from a WFS", "E"
    if version.startswith("2"):
        return "WFS 2.0", "N"
    if form in ("short", "unknown"):
        form = parse_srs(context.requested_srs).form if context.requested_srs else form
    return None if form == "unknown" else ("WFS 1.1", "E" if form in ("short", "legacy") else "N")


def meets(a: tuple[float, float, float, float], b: tuple[float, float, float, float]) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def envelope_warnings(e: Evidence, context: Context, swap: bool) -> list[str]:
    """Boxes that disagree with the order decided; they don't vote."""
    out = []
    seen, turned = (e.a[0], e.b[0], e.a[1], e.b[1]), (e.b[0], e.a[0], e.b[1], e.a[1])
    if e.envelope and not meets(seen, e.envelope) and meets(turned, e.envelope):
        out.append("boundedBy is written in the other order than the geometries")
    if context.requested_box:
        read, other = (turned, seen) if swap else (seen, turned)
        if not meets(read, context.requested_box) and meets(other, context.requested_box):
            out.append("only in the other order the geometries are in the requested box")
    return out


def range_vote(crs: Crs, e: Evidence) -> str | None:
    """The reading that fits the area of use, if just one does."""
    from .project import area_in

    west, south, east, north = area_in(crs)

    def within(v: float, low: float, high: float) -> bool:
        if low <= high:
            return low - SLACK <= v <= high + SLACK
        return v >= low - SLACK or v <= high + SLACK  # an area across the antimeridian

    def fits(x: tuple[float, float], y: tuple[float, float]) -> bool:
        return all(within(v, west, east) for v in x) and all(within(v, south, north) for v in y)

    xy, yx = fits(e.a, e.b), fits(e.b, e.a)
    return None if xy == yx else "E" if xy else "N"


def decide(srs: str, dialect: str, evidence: Evidence | None, context: Context, mode: str = "auto", overrides: dict[str, str] | None = None) -> Decision:
    """Whether the written order has to be swapped to have easting first.

    Modes: auto, xy (written so), yx, as-written, authority. The votes of
    auto, in order: labels, range, producer's habit, GML 2, WFS version, and
    at last what the form of the name says. Later votes that disagree are
    conflicts.
    """
    name = parse_srs(srs)
    mode = (overrides or {}).get(srs, mode)
    if mode in ("xy", "as-written"):
        return Decision(False, mode)
    if mode == "yx":
        return Decision(True, mode)
    crs = crs_of(name.code) if name.code else None
    if crs is None:
        return Decision(False, "unknown CRS")
    if mode == "authority":
        return Decision(crs.first_axis == "N", mode)
    votes: list[tuple[str, str]] = []
    if evidence:
        if v := label_vote(evidence.labels):
            votes.append(("axis labels", v))
        if v := range_vote(crs, evidence):
            votes.append(("coordinate range", v))
    if crs.first_axis == "N":
        if who := writes_authority_order(context, name.form):
            votes.append((who, "N"))
        if dialect == "gml2":
            votes.append(("GML 2", "E"))
        if v := wfs_vote(context, name.form):
            votes.append(v)
        votes.append(("form of the name", "E" if name.form in ("short", "legacy", "bare", "kvp", "proj") else "N"))
    else:
        votes.append(("authority", "E"))
    reason, first = votes[0]
    conflicts = [f"{r} says {v} first" for r, v in votes[1:] if v != first]
    return Decision(first == "N", reason, conflicts + (envelope_warnings(evidence, context, first == "N") if evidence else []))
