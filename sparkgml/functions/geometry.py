"""Geometries that keep curves: model, ISO WKB, boxes, linear forms, text.

A geometry is a tuple (kind, dimension, parts). Point: parts is a position or
None. LineString and CircularString: a list of positions. Polygon: a list of
rings, each a list of positions. Others: a list of geometries. A position is a
tuple of two or three floats.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from typing import Any

Position = tuple[float, ...]
Geometry = tuple[str, int, Any]

#: ISO codes of geometry types; 1000 is added with a third ordinate.
CODES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7, "CircularString": 8, "CompoundCurve": 9, "CurvePolygon": 10, "MultiCurve": 11, "MultiSurface": 12}
KINDS = {v: k for k, v in CODES.items()}
CURVES = {"CircularString", "CompoundCurve", "CurvePolygon", "MultiCurve", "MultiSurface"}
MULTI = {"Point": "MultiPoint", "LineString": "MultiLineString", "Polygon": "MultiPolygon"}
SIMPLE = {"CurvePolygon": "Polygon", "MultiCurve": "MultiLineString", "MultiSurface": "MultiPolygon", "CompoundCurve": "LineString"}


class GeometryError(ValueError):
    """A geometry that can't be read, written or converted."""


def positions(g: Geometry) -> Iterator[Position]:
    kind, _, parts = g
    if kind == "Point":
        if parts is not None:
            yield parts
    elif kind in ("LineString", "CircularString"):
        yield from parts
    elif kind == "Polygon":
        for ring in parts:
            yield from ring
    else:
        for p in parts:
            yield from positions(p)


def mapped(g: Geometry, f: Callable[[list[Position]], list[Position]], dim: int | None = None) -> Geometry:
    """Every list of positions replaced by f of it."""
    kind, d, parts = g
    d = dim or d
    if kind == "Point":
        return kind, d, None if parts is None else f([parts])[0]
    if kind in ("LineString", "CircularString"):
        return kind, d, f(parts)
    if kind == "Polygon":
        return kind, d, [f(r) for r in parts]
    return kind, d, [mapped(p, f, dim) for p in parts]


def has_curves(g: Geometry) -> bool:
    return g[0] in CURVES or g[0] == "GeometryCollection" and any(map(has_curves, g[2]))


def write_wkb(g: Geometry, little: bool = True) -> bytes:
    out: list[bytes] = []
    e = "<" if little else ">"

    def points(ps: list[Position], d: int) -> None:
        out.append(struct.pack(f"{e}I", len(ps)))
        out.append(struct.pack(f"{e}{len(ps) * d}d", *[v for p in ps for v in p]))

    def one(g: Geometry) -> None:
        kind, d, parts = g
        out.append(struct.pack(f"{e}BI", little, CODES[kind] + (1000 if d == 3 else 0)))
        if kind == "Point":
            out.append(struct.pack(f"{e}{d}d", *(parts or (math.nan,) * d)))
        elif kind in ("LineString", "CircularString"):
            points(parts, d)
        else:
            out.append(struct.pack(f"{e}I", len(parts)))
            for p in parts:
                points(p, d) if kind == "Polygon" else one(p)

    one(g)
    return b"".join(out)


def read_wkb(data: bytes) -> Geometry:
    at = 0

    def take(fmt: str) -> tuple:
        nonlocal at
        try:
            values = struct.unpack_from(fmt, data, at)
        except struct.error:
            raise GeometryError("WKB ends early") from None
        at += struct.calcsize(fmt)
        return values

    def points(e: str, d: int) -> list[Position]:
        (n,) = take(f"{e}I")
        if n * d * 8 > len(data) - at:
            raise GeometryError("WKB ends early")
        flat = take(f"{e}{n * d}d")
        return [flat[i : i + d] for i in range(0, n * d, d)]

    def one(depth: int) -> Geometry:
        (order,) = take("B")
        if order > 1 or depth > 128:
            raise GeometryError("not WKB")
        e = "<" if order else ">"
        (code,) = take(f"{e}I")
        kind, d = KINDS.get(code % 1000), {0: 2, 1: 3}.get(code // 1000)
        if kind is None or d is None:
            raise GeometryError(f"WKB type {code}")
        if kind == "Point":
            p = take(f"{e}{d}d")
            return kind, d, None if all(map(math.isnan, p)) else p
        if kind in ("LineString", "CircularString"):
            return kind, d, points(e, d)
        (n,) = take(f"{e}I")
        return kind, d, [points(e, d) if kind == "Polygon" else one(depth + 1) for _ in range(n)]

    g = one(0)
    if at != len(data):
        raise GeometryError("bytes after the WKB")
    return g


def circle_of(a: Position, b: Position, c: Position) -> tuple[float, float, float] | None:
    """Centre and radius of the circle through three points; None if they are in line."""
    if a[:2] == c[:2]:  # a full circle: b is opposite
        return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2, math.dist(a[:2], b[:2]) / 2
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    det = 2 * (bx * cy - by * cx)
    if abs(det) <= 1e-12 * max(abs(bx), abs(by), abs(cx), abs(cy), 1e-300) ** 2:
        return None
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    x, y = (cy * b2 - by * c2) / det, (bx * c2 - cx * b2) / det
    return a[0] + x, a[1] + y, math.hypot(x, y)


def sweep(a: Position, b: Position, c: Position, x: float, y: float) -> tuple[float, float]:
    """Start angle and signed turn of the arc a, b, c about (x, y)."""
    start = math.atan2(a[1] - y, a[0] - x)
    if a[:2] == c[:2]:
        return start, 2 * math.pi
    to_b = (math.atan2(b[1] - y, b[0] - x) - start) % (2 * math.pi)
    to_c = (math.atan2(c[1] - y, c[0] - x) - start) % (2 * math.pi)
    return start, to_c if to_b <= to_c else to_c - 2 * math.pi


def arc_extremes(a: Position, b: Position, c: Position) -> list[Position]:
    """The ends of an arc and where it reaches furthest along an axis."""
    circle = circle_of(a, b, c)
    if not circle:
        return [a, b, c]
    x, y, r = circle
    start, turn = sweep(a, b, c, x, y)
    out = [a, b, c]
    for k in range(4):
        angle = k * math.pi / 2
        delta = (angle - start) % (2 * math.pi)
        if delta <= turn if turn > 0 else delta - 2 * math.pi >= turn:
            out.append((x + r * math.cos(angle), y + r * math.sin(angle)))
    return out


def bbox(g: Geometry) -> tuple[float, ...] | None:
    """(xmin, ymin, xmax, ymax) and with a third ordinate (…, zmin, zmax); None if empty. Arcs count as far as they reach."""
    pts = list(positions(g))
    if not pts:
        return None
    flat = [p[:2] for p in pts]

    def arcs(g: Geometry) -> None:
        if g[0] == "CircularString":
            for i in range(0, len(g[2]) - 2, 2):
                flat.extend(arc_extremes(*g[2][i : i + 3]))
        elif g[0] in ("CompoundCurve", "CurvePolygon", "MultiCurve", "MultiSurface", "GeometryCollection"):
            for p in g[2]:
                arcs(p)

    arcs(g)
    xs, ys = [p[0] for p in flat], [p[1] for p in flat]
    box = (min(xs), min(ys), max(xs), max(ys))
    zs = [p[2] for p in pts if len(p) > 2 and not math.isnan(p[2])]
    return box + ((min(zs), max(zs)) if zs else ())


def line_of(points: list[Position], step: float = math.radians(4), max_gap: float | None = None) -> list[Position]:
    """Arcs of a circular string as short lines; its control points stay, a third ordinate is interpolated."""
    out = [points[0]] if points else []
    for i in range(0, len(points) - 2, 2):
        a, b, c = points[i : i + 3]
        circle = circle_of(a, b, c)
        if not circle:
            out += [b, c]
            continue
        x, y, r = circle
        start, turn = sweep(a, b, c, x, y)
        mid = (math.atan2(b[1] - y, b[0] - x) - start) % (2 * math.pi)
        mid = mid if turn > 0 else mid - 2 * math.pi
        limit = min(step, 2 * math.acos(max(-1.0, 1 - max_gap / r))) if max_gap and max_gap < r else step
        for p, q, t0, t1 in ((a, b, 0.0, mid), (b, c, mid, turn)):
            n = max(1, math.ceil(abs(t1 - t0) / limit - 1e-9))
            for k in range(1, n):
                t, angle = k / n, start + t0 + (t1 - t0) * k / n
                z = (p[2] + (q[2] - p[2]) * t,) if len(p) > 2 else ()
                out.append((x + r * math.cos(angle), y + r * math.sin(angle), *z))
            out.append(q)
    return out


def linearize(g: Geometry, step_degrees: float = 4.0, max_gap: float | None = None) -> Geometry:
    """The geometry without curves."""
    kind, d, parts = g
    step = math.radians(step_degrees)
    if kind == "CircularString":
        return "LineString", d, line_of(parts, step, max_gap)
    if kind == "CompoundCurve":
        out: list[Position] = []
        for p in parts:
            pts = linearize(p, step_degrees, max_gap)[2]
            out += pts[1:] if out and pts and out[-1] == pts[0] else pts
        return "LineString", d, out
    if kind == "CurvePolygon":
        return "Polygon", d, [linearize(p, step_degrees, max_gap)[2] for p in parts]
    if kind in ("MultiCurve", "MultiSurface", "GeometryCollection"):
        return SIMPLE.get(kind, kind), d, [linearize(p, step_degrees, max_gap) for p in parts]
    return g


def simplify_types(g: Geometry) -> Geometry:
    """Curve types that hold no arc as their linear counterparts."""
    kind, d, parts = g
    if kind not in CURVES and kind != "GeometryCollection":
        return g
    if kind == "CircularString":
        return g
    parts = [simplify_types(p) for p in parts]
    if kind == "CompoundCurve" and all(p[0] == "LineString" for p in parts):
        return linearize((kind, d, parts))
    if kind == "CurvePolygon" and all(p[0] == "LineString" for p in parts):
        return "Polygon", d, [p[2] for p in parts]
    if kind in ("MultiCurve", "MultiSurface") and all(p[0] == {"MultiCurve": "LineString", "MultiSurface": "Polygon"}[kind] for p in parts):
        return SIMPLE[kind], d, parts
    return kind, d, parts


def swap_xy(g: Geometry) -> Geometry:
    return mapped(g, lambda ps: [(p[1], p[0], *p[2:]) for p in ps])


def with_dimension(g: Geometry, dim: int) -> Geometry:
    """Two ordinates in a three-dimensional column get a NaN third; the other way round is an error."""
    if g[1] == dim:
        return g
    if g[1] > dim:
        raise GeometryError("three ordinates in a column of two")
    return mapped(g, lambda ps: [(*p, math.nan) for p in ps], dim)


def fit_kind(g: Geometry, kind: str) -> Geometry:
    """The geometry as the kind of its column: single ones become multiple ones."""
    if kind in ("Geometry", g[0]):
        return g
    if MULTI.get(g[0]) == kind:
        return kind, g[1], [] if g[0] == "Point" and g[2] is None else [g]
    if kind == "MultiSurface" and g[0] in ("Polygon", "CurvePolygon") or kind == "MultiCurve" and g[0] in ("LineString", "CircularString", "CompoundCurve"):
        return kind, g[1], [g]
    raise GeometryError(f"{g[0]} in a column of {kind}")


def reverse(g: Geometry) -> Geometry:
    kind, d, parts = g
    if kind in ("CompoundCurve", "MultiCurve"):
        return kind, d, [reverse(p) for p in (parts[::-1] if kind == "CompoundCurve" else parts)]
    if kind in ("CurvePolygon", "MultiSurface", "MultiPolygon", "MultiLineString"):
        return kind, d, [reverse(p) for p in parts]
    return mapped(g, lambda ps: ps[::-1])


def ends(g: Geometry) -> tuple[Position, Position]:
    ps = list(positions(g))
    return ps[0], ps[-1]


def wkt(g: Geometry, digits: int | None = None) -> str:
    """Well-known text, for reading and tests."""
    number = (lambda v: repr(float(v)).removesuffix(".0")) if digits is None else (lambda v: f"{v:.{digits}f}")
    point = lambda p: " ".join(map(number, p))
    line = lambda ps: f"({', '.join(map(point, ps))})" if ps else "EMPTY"

    def body(g: Geometry) -> str:
        kind, _, parts = g
        if kind == "Point":
            return "EMPTY" if parts is None else f"({point(parts)})"
        if not parts:
            return "EMPTY"
        if kind in ("LineString", "CircularString"):
            return line(parts)
        if kind == "Polygon":
            return f"({', '.join(map(line, parts))})"
        bare = {"MultiPoint", "MultiLineString", "MultiPolygon"}
        default = {"CompoundCurve": "LineString", "CurvePolygon": "LineString", "MultiCurve": "LineString", "MultiSurface": "Polygon"}
        return "(" + ", ".join(body(p) if kind in bare or default.get(kind) == p[0] else wkt(p, digits) for p in parts) + ")"

    return f"{g[0].upper()}{' Z' if g[1] == 3 else ''} {body(g)}"
