"""Reading GML 2, 3.1, 3.2 and 3.3 geometry elements."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from .geometry import Geometry, GeometryError, Position, ends, linearize, reverse, simplify_types, swap_xy

#: Namespaces.
GML = "http://www.opengis.net/gml"
GML32 = "http://www.opengis.net/gml/3.2"
GML33 = "http://www.opengis.net/gml/3.3/ce"
SPACES = (GML, GML32, GML33)
XLINK = "http://www.w3.org/1999/xlink"
XSI = "http://www.w3.org/2001/XMLSchema-instance"

POINTS = {"Point"}
CURVES = {"LineString", "LinearRing", "Curve", "CompositeCurve", "OrientableCurve", "Ring", "SimpleLineString"}
SURFACES = {"Polygon", "Surface", "PolyhedralSurface", "CompositeSurface", "OrientableSurface", "SimplePolygon", "SimpleRectangle", "SimpleTriangle"}
AGGREGATES = {"MultiPoint", "MultiLineString", "MultiCurve", "MultiPolygon", "MultiSurface", "MultiGeometry", "GeometricAggregate", "SimpleMultiPoint"}
BOXES = {"Envelope", "Box"}
UNSUPPORTED = {"Solid", "CompositeSolid", "MultiSolid", "Clothoid", "Tin", "TriangulatedSurface", "Grid", "RectifiedGrid", "Geodesic", "GeodesicString", "OffsetCurve", "BSpline", "Bezier", "CubicSpline", "Cone", "Cylinder", "Sphere", "GeometricComplex"}
GEOMETRIES = POINTS | CURVES | SURFACES | AGGREGATES | BOXES | UNSUPPORTED
#: Metres of length units, degrees of angle units.
METRES = {"m": 1.0, "metre": 1.0, "meter": 1.0, "9001": 1.0, "km": 1000.0, "9036": 1000.0, "nmi": 1852.0, "9030": 1852.0, "mi": 1609.344, "9093": 1609.344, "ft": 0.3048, "9002": 0.3048, "us-ft": 1200 / 3937, "9003": 1200 / 3937}
DEGREES = {"deg": 1.0, "degree": 1.0, "9102": 1.0, "9122": 1.0, "rad": 180 / math.pi, "radian": 180 / math.pi, "9101": 180 / math.pi, "grad": 0.9, "gon": 0.9, "9105": 0.9}
MAX_DEPTH = 128


class Node:
    """An element: name as (namespace, local), attributes, text before the first child, children, place in document order."""

    __slots__ = ("ns", "name", "attrs", "text", "children", "index", "element")

    def __init__(self, ns: str, name: str, attrs: dict[str, str], text: str = "", index: int = 0, element=None):
        self.ns, self.name, self.attrs, self.text, self.index, self.element = ns, name, attrs, text, index, element
        self.children: list[Node] = []

    @property
    def all_text(self) -> str:
        """All text below, without markup."""
        return "".join(self.element.itertext())

    def attr(self, name: str) -> str | None:
        return self.attrs.get(name)


@dataclass
class Scope:
    """What a geometry inherits, and what reading it finds."""

    srs: str | None = None
    dimension: int | None = None
    crs_dimension: int | None = None
    geographic: bool = False
    linear: bool = False
    swap: bool = False
    warnings: list[str] = field(default_factory=list)


def is_geometry(node: Node) -> bool:
    return node.name in GEOMETRIES and node.ns in SPACES


def floats(text: str) -> list[float]:
    try:
        return list(map(float, text.split()))
    except ValueError:
        raise GeometryError(f"not numbers: {text[:40]!r}") from None


def grouped(values: list[float], dim: int) -> list[Position]:
    if len(values) % dim:
        raise GeometryError(f"{len(values)} values don't divide by {dim}")
    return list(zip(*[iter(values)] * dim))


def dimension(node: Node, scope: Scope, values: int, single: bool) -> int:
    own = node.attr("srsDimension") or node.attr("dimension")
    dim = int(own) if own else scope.dimension or scope.crs_dimension
    if dim is None and single and values in (2, 3):
        dim = values
    if dim is None and (count := node.attr("count")) and int(count):
        dim = values // int(count)
    if dim is None:
        dim = 2
        if values % 3 == 0 and values % 2:
            scope.warnings.append("values divide by three, read as pairs")
    if dim not in (2, 3):
        raise GeometryError(f"dimension {dim}")
    return dim


def coordinates(node: Node) -> list[Position]:
    """A GML 2 list with its own marks for decimals, ordinates and positions."""
    decimal, cs, ts = node.attr("decimal") or ".", node.attr("cs") or ",", node.attr("ts") or " "
    text = node.text.strip()
    tuples = text.split() if ts.isspace() else [x for x in text.split(ts) if x.strip()]
    if ts.isspace() and cs.isspace():
        raise GeometryError("no way to tell ordinates from positions")
    out = []
    for t in tuples:
        parts = [p.strip().replace(decimal, ".") for p in (t.split() if cs.isspace() else t.split(cs))]
        p = tuple(floats(" ".join(parts)))
        if len(p) not in (2, 3):
            raise GeometryError(f"position of {len(p)} values")
        out.append(p)
    return out


def carried(node: Node, scope: Scope) -> list[Position]:
    """Positions of all children that carry some; others are passed over."""
    out: list[Position] = []
    inner = inherited(node, scope)
    for c in node.children:
        if c.name == "pos":
            values = floats(c.text)
            if values:
                out += grouped(values, dimension(c, inner, len(values), True))
        elif c.name == "posList":
            values = floats(c.text)
            points = grouped(values, dimension(c, inner, len(values), False))
            if (count := c.attr("count")) and int(count) != len(points):
                raise GeometryError(f"count {count}, but {len(points)} positions")
            out += points
        elif c.name == "coordinates":
            out += coordinates(c)
        elif c.name == "coord":
            out.append(tuple(floats(x.text)[0] for k in "XYZ" for x in c.children if x.name == k))
        elif c.name in ("pointProperty", "pointRep"):
            for p in c.children:
                out += carried(p, inner)
    if len({len(p) for p in out}) > 1:
        raise GeometryError("positions of two and of three values")
    return out


def inherited(node: Node, scope: Scope) -> Scope:
    own = node.attr("srsDimension")
    srs = node.attr("srsName")
    if srs and scope.srs and srs.strip() != scope.srs:
        scope.warnings.append(f"inner srsName {srs.strip()}")
    return Scope(scope.srs or srs, int(own) if own else scope.dimension, scope.crs_dimension, scope.geographic, scope.linear, scope.swap, scope.warnings)


def dim_of(points: list[Position], scope: Scope) -> int:
    return len(points[0]) if points else scope.dimension or 2


def ring(points: list[Position], scope: Scope, quiet: bool = False) -> list[Position]:
    if points and points[0] != points[-1]:
        if not quiet:
            scope.warnings.append("ring was not closed")
        points = [*points, points[0]]
    if points and len(points) < 4:
        raise GeometryError(f"ring of {len(points)} positions")
    return points


def scale(node: Node, scope: Scope, uom: str | None) -> float:
    key = re.split(r"[:#/]", uom or "")[-1]
    known = METRES.get(uom or "") or METRES.get(key)
    if known is not None and scope.geographic:
        raise GeometryError("a radius in length units under a geographic CRS")
    return known or 1.0


def angle(node: Node | None, default: float) -> float:
    """Degrees."""
    if node is None:
        return default
    uom = node.attr("uom") or "deg"
    factor = DEGREES.get(uom) or DEGREES.get(re.split(r"[:#/]", uom)[-1])
    if factor is None:
        raise GeometryError(f"angle unit {uom}")
    return floats(node.text)[0] * factor


def child(node: Node, name: str) -> Node | None:
    return next((c for c in node.children if c.name == name), None)


def segment(node: Node, scope: Scope) -> Geometry:
    name = node.name
    inner = inherited(node, scope)
    if name in ("ArcByCenterPoint", "CircleByCenterPoint"):
        centre = carried(node, scope)
        radius = child(node, "radius")
        if len(centre) != 1 or radius is None:
            raise GeometryError(f"{name} needs a centre and a radius")
        x, y = (centre[0][1], centre[0][0]) if scope.swap else centre[0][:2]
        r = floats(radius.text)[0] * scale(radius, scope, radius.attr("uom"))
        if name == "CircleByCenterPoint":
            angles = [180.0, 90.0, 0.0, 270.0, 180.0]
        else:
            a, b = angle(child(node, "startAngle"), 0.0), angle(child(node, "endAngle"), 360.0)
            angles = [a, (a + b) / 2, b]
        pts = [(x + r * math.cos(math.radians(t)), y + r * math.sin(math.radians(t)), *centre[0][2:]) for t in angles]
        if scope.swap:  # angles run in output order; the whole geometry is swapped later
            pts = [(p[1], p[0], *p[2:]) for p in pts]
        return "CircularString", len(pts[0]), pts
    pts = carried(node, inner)
    dim = dim_of(pts, inner)
    if name in ("LineStringSegment", "LineString"):
        if len(pts) == 1:
            raise GeometryError("line of one position")
        return "LineString", dim, pts
    if name in ("Arc", "ArcString"):
        if len(pts) < 3 or len(pts) % 2 == 0 or name == "Arc" and len(pts) != 3:
            raise GeometryError(f"{name} of {len(pts)} positions")
        return "CircularString", dim, pts
    if name == "Circle":
        if len(pts) != 3:
            raise GeometryError("Circle needs three positions")
        from .geometry import circle_of, sweep

        circle = circle_of(*pts)
        if not circle:
            raise GeometryError("Circle of three positions in line")
        x, y, r = circle
        start, turn = sweep(*pts, x, y)
        rest = start + turn + ((2 * math.pi - turn) if turn > 0 else (-2 * math.pi - turn)) / 2
        return "CircularString", dim, [*pts, (x + r * math.cos(rest), y + r * math.sin(rest), *pts[0][2:]), pts[0]]
    if name in ("ArcByBulge", "ArcStringByBulge"):
        bulges = [v for c in node.children if c.name == "bulge" for v in floats(c.text)]
        normals = [v for c in node.children if c.name == "normal" for v in floats(c.text)] or [1.0] * len(bulges)
        if len(bulges) != len(pts) - 1 or len(pts) < 2:
            raise GeometryError("a bulge for each pair of positions")
        out = [pts[0]]
        for p, q, bulge, n in zip(pts, pts[1:], bulges, normals, strict=False):
            length = math.dist(p[:2], q[:2]) or 1.0
            nx, ny = (p[1] - q[1]) / length, (q[0] - p[0]) / length
            sign = math.copysign(1.0, n)
            z = ((p[2] + q[2]) / 2,) if len(p) > 2 else ()
            out += [((p[0] + q[0]) / 2 + bulge * sign * nx, (p[1] + q[1]) / 2 + bulge * sign * ny, *z), q]
        return "CircularString", dim, out
    raise GeometryError(f"segment {name}")


COMPUTED = {"ArcByCenterPoint", "CircleByCenterPoint"}


def chain(parts: list[tuple[Geometry, bool]], scope: Scope) -> Geometry:
    """Pieces one after another; shared ends once, gaps bridged by lines. The flag says that an end was computed."""
    parts = [p for p in parts if p[0][2]]
    if not parts:
        return "LineString", scope.dimension or 2, []
    flat = [p for g, _ in parts for p in (q for h in (g[2] if g[0] == "CompoundCurve" else [g]) for q in h[2])]
    size = max(max(p[i] for p in flat) - min(p[i] for p in flat) for i in (0, 1))
    tolerance = 1e-9 * size
    pieces: list[list] = []  # [kind, positions, computed]
    for g, computed in parts:
        for kind, _, pts in g[2] if g[0] == "CompoundCurve" else [g]:
            pts = list(pts)
            if pieces:
                last = pieces[-1]
                end = last[1][-1]
                if math.dist(end[:2], pts[0][:2]) <= tolerance:
                    shared = pts[0] if last[2] and not computed else end
                    last[1][-1] = pts[0] = shared
                else:
                    scope.warnings.append("gap between segments")
                    if last[0] == "LineString":
                        last[1].append(pts[0])
                    elif kind == "LineString":
                        pts.insert(0, end)
                    else:
                        pieces.append(["LineString", [end, pts[0]], False])
                last = pieces[-1]
                if last[0] == kind:
                    last[1] += pts[1:]
                    last[2] = computed
                    continue
            pieces.append([kind, pts, computed])
    dim = len(flat[0])
    if len(pieces) == 1:
        return pieces[0][0], dim, pieces[0][1]
    return "CompoundCurve", dim, [(k, dim, p) for k, p, _ in pieces]


def curve(node: Node, scope: Scope) -> Geometry:
    name, inner = node.name, inherited(node, scope)
    if name in ("LineString", "SimpleLineString"):
        pts = carried(node, scope)
        if len(pts) == 1:
            raise GeometryError("line of one position")
        return "LineString", dim_of(pts, inner), pts
    if name == "LinearRing":
        pts = ring(carried(node, scope), scope)
        return "LineString", dim_of(pts, inner), pts
    if name == "Curve":
        segments = child(node, "segments")
        if segments is None:
            raise GeometryError("Curve without segments")
        return chain([(segment(s, inner), s.name in COMPUTED) for s in segments.children], scope)
    if name == "OrientableCurve":
        base = child(node, "baseCurve")
        if base is None or not base.children:
            raise GeometryError("OrientableCurve without base")
        g = curve(base.children[0], inner)
        return reverse(g) if node.attr("orientation") == "-" else g
    if name in ("CompositeCurve", "Ring"):
        members = [c for m in node.children if m.name in ("curveMember", "curveMembers") for c in m.children]
        g = chain([(curve(c, inner), False) for c in members], scope)
        if name == "Ring" and g[2]:
            a, b = ends(g)
            if a[:2] != b[:2]:
                size = max(abs(a[0] - b[0]), abs(a[1] - b[1]))
                scope.warnings.append("ring was not closed") if size else None
                g = chain([(g, False), (("LineString", g[1], [b, a]), False)], scope)
        return g
    raise GeometryError(f"curve {name}")


def surface(node: Node, scope: Scope) -> list[Geometry]:
    """One polygon for each patch or member."""
    name, inner = node.name, inherited(node, scope)
    if name in ("Polygon", "PolygonPatch", "Triangle", "Rectangle"):
        rings: list[Geometry] = []
        outer = [c for c in node.children if c.name in ("exterior", "outerBoundaryIs")]
        holes = [c for c in node.children if c.name in ("interior", "innerBoundaryIs")]
        if not outer:
            if holes or node.children:
                raise GeometryError("polygon without exterior")
            return [("Polygon", inner.dimension or 2, [])]
        for b in [outer[0], *holes]:
            for r in b.children:
                rings.append(curve(r, inner))
        rings = [r for r in rings if r[2]]
        dim = rings[0][1] if rings else inner.dimension or 2
        if all(r[0] == "LineString" for r in rings):
            return [("Polygon", dim, [ring(r[2], scope) for r in rings])]
        return [("CurvePolygon", dim, rings)]
    if name in ("SimplePolygon", "SimpleRectangle", "SimpleTriangle"):
        pts = ring(carried(node, scope), scope, quiet=True)
        return [("Polygon", dim_of(pts, inner), [pts] if pts else [])]
    if name in ("Surface", "PolyhedralSurface"):
        patches = child(node, "patches") or child(node, "polygonPatches")
        if patches is None:
            raise GeometryError("Surface without patches")
        return [g for p in patches.children for g in surface(p, inner)]
    if name == "OrientableSurface":
        base = child(node, "baseSurface")
        if base is None or not base.children:
            raise GeometryError("OrientableSurface without base")
        out = surface(base.children[0], inner)
        return [reverse(g) for g in out] if node.attr("orientation") == "-" else out
    if name == "CompositeSurface":
        return [g for m in node.children if m.name in ("surfaceMember", "surfaceMembers") for c in m.children for g in surface(c, inner)]
    raise GeometryError(f"surface {name}")


def together(parts: list[Geometry], kind: str, curved: str, dim: int) -> Geometry:
    dim = max([g[1] for g in parts], default=dim)
    plain = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}[kind]
    return (kind if all(g[0] == plain for g in parts) else curved), dim, parts


def as_written(node: Node, scope: Scope, depth: int = 0) -> Geometry:
    name, inner = node.name, inherited(node, scope)
    if depth > MAX_DEPTH:
        raise GeometryError("geometry nested too deep")
    if name in UNSUPPORTED:
        raise GeometryError(f"{name} is not supported")
    if name == "Point":
        pts = carried(node, scope)
        if len(pts) > 1:
            raise GeometryError(f"Point of {len(pts)} positions")
        return "Point", dim_of(pts, inner), pts[0] if pts else None
    if name in CURVES:
        return curve(node, scope)
    if name in SURFACES:
        parts = surface(node, scope)
        if name == "CompositeSurface" or len(parts) != 1:
            return together(parts, "MultiPolygon", "MultiSurface", inner.dimension or 2)
        return parts[0]
    if name in BOXES:
        return box_polygon(envelope(node, scope))
    if name == "SimpleMultiPoint":
        pts = carried(node, scope)
        return "MultiPoint", dim_of(pts, inner), [("Point", len(p), p) for p in pts]
    if name in AGGREGATES:
        parts = []
        for m in node.children:
            if not re.search("[mM]embers?$", m.name):
                continue
            if m.name == "lineStringMember" and not m.children:
                raise GeometryError("empty lineStringMember")
            for c in m.children:
                if is_geometry(c):
                    g = as_written(c, inner, depth + 1)
                    parts += g[2] if g[0].startswith("Multi") and name != "MultiGeometry" else [g]
        if name == "MultiPoint":
            return together(parts, "MultiPoint", "GeometryCollection", inner.dimension or 2)
        if name in ("MultiLineString", "MultiCurve"):
            return together(parts, "MultiLineString", "MultiCurve", inner.dimension or 2)
        if name in ("MultiPolygon", "MultiSurface"):
            return together(parts, "MultiPolygon", "MultiSurface", inner.dimension or 2)
        return "GeometryCollection", max([g[1] for g in parts], default=2), parts
    raise GeometryError(f"{name} is not a geometry")


def envelope(node: Node, scope: Scope) -> tuple[Position, Position]:
    """Lower and upper corner, in any of the forms."""
    pts = {c.name: floats(c.text) for c in node.children if c.name in ("lowerCorner", "upperCorner")}
    if len(pts) == 2:
        lower, upper = tuple(pts["lowerCorner"]), tuple(pts["upperCorner"])
    else:
        found = carried(node, scope)
        if len(found) != 2:
            raise GeometryError("an envelope has two corners")
        lower, upper = found
    if len(lower) != len(upper) or len(lower) not in (2, 3):
        raise GeometryError("corners of an envelope differ in size")
    return lower, upper


def box_polygon(corners: tuple[Position, Position]) -> Geometry:
    (x0, y0, *_), (x1, y1, *_) = corners
    return "Polygon", 2, [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


def srs_of(node: Node, outer: str | None = None) -> str | None:
    """The root's srsName, else the inherited one, else the first inside."""
    own = node.attr("srsName") or outer
    if own:
        return own.strip()
    for c in node.children:
        if found := srs_of(c):
            return found
    return None


def first_position(node: Node) -> Position | None:
    """The first two numbers that a geometry carries, without reading the rest; None if there are none."""
    if node.name in ("pos", "posList", "lowerCorner"):
        numbers = floats(" ".join(node.text.split(maxsplit=2)[:2]))
        return tuple(numbers) if len(numbers) == 2 else None
    if node.name == "coordinates":
        found = coordinates(node)
        return found[0][:2] if found else None
    if node.name == "coord":
        found = tuple(floats(x.text)[0] for k in "XY" for x in node.children if x.name == k)
        return found if len(found) == 2 else None
    return next((p for c in node.children if (p := first_position(c)) is not None), None)


def geometry(node: Node, scope: Scope) -> Geometry:
    """As written, then axes swapped, then without curves if asked for."""
    g = simplify_types(as_written(node, scope))
    if scope.swap:
        g = swap_xy(g)
    return linearize(g) if scope.linear else g


def is_legacy(node: Node) -> bool:
    """Whether the geometry is written the GML 2 way."""
    if node.name in ("Box", "MultiLineString", "MultiPolygon") or node.name in ("outerBoundaryIs", "innerBoundaryIs", "coordinates", "coord"):
        return True
    return any(is_legacy(c) for c in node.children)
