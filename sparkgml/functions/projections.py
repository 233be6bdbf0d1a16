"""More map projections: conics, obliques, azimuthals and world maps."""

from __future__ import annotations

import math

import numpy as np

from .project import ELLIPSOIDS, METHODS, axes, from_isometric, isometric

#: Ellipsoids of the systems that use these methods.
ELLIPSOIDS.update({"clrk58": (6378293.645208759, 294.2606763692569), "evrst67": (6377298.556, 300.8017), "sphere": (6371007.0, 1e12)})


def meridian_series(e: float):
    """Distance along the meridian from the equator on an ellipsoid of unit axis, and its inverse."""
    e2 = e * e
    c = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)

    def distance(phi):
        return c[0] * phi - c[1] * np.sin(2 * phi) + c[2] * np.sin(4 * phi) - c[3] * np.sin(6 * phi)

    def latitude(m):
        phi = m / c[0]
        for _ in range(12):
            slope = c[0] - 2 * c[1] * np.cos(2 * phi) + 4 * c[2] * np.cos(4 * phi) - 6 * c[3] * np.cos(6 * phi)
            phi = phi - (distance(phi) - m) / slope
        return phi

    return distance, latitude


def cass(el: str, lat0: float, lon0: float, fe: float, fn: float):
    """Cassini-Soldner."""
    a, e = axes(el)
    e2 = e * e
    distance, latitude = meridian_series(e)
    m0 = float(distance(math.radians(lat0)))

    def forward(lon, lat):
        phi = np.radians(lat)
        nu = 1 / np.sqrt(1 - e2 * np.sin(phi) ** 2)
        t, big, c = np.tan(phi) ** 2, np.radians(lon - lon0) * np.cos(phi), e2 * np.cos(phi) ** 2 / (1 - e2)
        x = nu * (big - t * big**3 / 6 - (8 - t + 8 * c) * t * big**5 / 120)
        y = distance(phi) - m0 + nu * np.tan(phi) * (big**2 / 2 + (5 - t + 6 * c) * big**4 / 24)
        return fe + a * x, fn + a * y

    def inverse(x, y):
        p1 = latitude(m0 + (y - fn) / a)
        w = 1 - e2 * np.sin(p1) ** 2
        nu, rho, t = 1 / np.sqrt(w), (1 - e2) / w**1.5, np.tan(p1) ** 2
        d = (x - fe) / (a * nu)
        phi = p1 - nu * np.tan(p1) / rho * (d**2 / 2 - (1 + 3 * t) * d**4 / 24)
        lam = (d - t * d**3 / 3 + (1 + 3 * t) * t * d**5 / 15) / np.cos(p1)
        return lon0 + np.degrees(lam), np.degrees(phi)

    return forward, inverse


def krovak(el: str, latc: float, lon0: float, tilt: float, lat_p: float, k: float, fe: float, fn: float):
    """Oblique conic of the Czech and Slovak grids; easting is minus westing, northing minus southing."""
    a, e = axes(el)
    pc, ac, pp = map(math.radians, (latc, tilt, lat_p))
    big = a * math.sqrt(1 - e * e) / (1 - (e * math.sin(pc)) ** 2)
    b = math.sqrt(1 + e * e * math.cos(pc) ** 4 / (1 - e * e))
    g0 = math.asin(math.sin(pc) / b)
    t0 = math.tan(math.pi / 4 + g0 / 2) * ((1 + e * math.sin(pc)) / (1 - e * math.sin(pc))) ** (e * b / 2) / math.tan(math.pi / 4 + pc / 2) ** b
    n, r0 = math.sin(pp), k * big / math.tan(pp)

    def forward(lon, lat):
        phi = np.radians(lat)
        s = e * np.sin(phi)
        u = 2 * (np.arctan(t0 * np.tan(phi / 2 + math.pi / 4) ** b / ((1 + s) / (1 - s)) ** (e * b / 2)) - math.pi / 4)
        v = b * np.radians(lon0 - lon)
        t = np.arcsin(math.cos(ac) * np.sin(u) + math.sin(ac) * np.cos(u) * np.cos(v))
        d = np.arcsin(np.cos(u) * np.sin(v) / np.cos(t))
        r = r0 * (math.tan(math.pi / 4 + pp / 2) / np.tan(t / 2 + math.pi / 4)) ** n
        return fe - r * np.sin(n * d), fn - r * np.cos(n * d)

    def inverse(x, y):
        south, west = fn - y, fe - x
        r, theta = np.hypot(south, west), np.arctan2(west, south)
        d = theta / n
        t = 2 * (np.arctan((r0 / r) ** (1 / n) * math.tan(math.pi / 4 + pp / 2)) - math.pi / 4)
        u = np.arcsin(math.cos(ac) * np.sin(t) - math.sin(ac) * np.cos(t) * np.cos(d))
        v = np.arcsin(np.cos(t) * np.sin(d) / np.cos(u))
        phi = u
        for _ in range(20):
            s = e * np.sin(phi)
            phi = 2 * (np.arctan(t0 ** (-1 / b) * np.tan(u / 2 + math.pi / 4) ** (1 / b) * ((1 + s) / (1 - s)) ** (e / 2)) - math.pi / 4)
        return lon0 - np.degrees(v / b), np.degrees(phi)

    return forward, inverse


def omerc(el: str, latc: float, lonc: float, azimuth: float, gamma: float, k: float, ec: float, nc: float):
    """Hotine oblique Mercator, variant B: false coordinates at the centre."""
    a, e = axes(el)
    pc, al, gc = map(math.radians, (latc, azimuth, gamma))
    b = math.sqrt(1 + e * e * math.cos(pc) ** 4 / (1 - e * e))
    big = a * b * k * math.sqrt(1 - e * e) / (1 - (e * math.sin(pc)) ** 2)
    t0 = float(isometric(np.float64(pc), e))
    d = b * math.sqrt(1 - e * e) / (math.cos(pc) * math.sqrt(1 - (e * math.sin(pc)) ** 2))
    f = d + math.sqrt(max(d * d - 1, 0.0)) * math.copysign(1.0, latc)
    h = f * t0**b
    g0 = math.asin(math.sin(al) / d)
    l0 = math.radians(lonc) - math.asin((f - 1 / f) / 2 * math.tan(g0)) / b
    uc = big / b * math.atan2(math.sqrt(max(d * d - 1, 0.0)), math.cos(al)) * math.copysign(1.0, latc)
    if abs(azimuth - 90) < 1e-12:
        uc = big * (math.radians(lonc) - l0)

    def forward(lon, lat):
        q = h / isometric(np.radians(lat), e) ** b
        s, t = (q - 1 / q) / 2, (q + 1 / q) / 2
        lam = b * (np.radians(lon) - l0)
        v = np.sin(lam)
        w = (-v * math.cos(g0) + s * math.sin(g0)) / t
        across = big * np.log((1 - w) / (1 + w)) / (2 * b)
        along = big / b * np.arctan2(s * math.cos(g0) + v * math.sin(g0), np.cos(lam)) - abs(uc) * math.copysign(1.0, latc)
        return ec + across * math.cos(gc) + along * math.sin(gc), nc + along * math.cos(gc) - across * math.sin(gc)

    def inverse(x, y):
        across = (x - ec) * math.cos(gc) - (y - nc) * math.sin(gc)
        along = (y - nc) * math.cos(gc) + (x - ec) * math.sin(gc) + abs(uc) * math.copysign(1.0, latc)
        q = np.exp(-b * across / big)
        s, t, v = (q - 1 / q) / 2, (q + 1 / q) / 2, np.sin(b * along / big)
        w = (v * math.cos(g0) + s * math.sin(g0)) / t
        iso = (h / np.sqrt((1 + w) / (1 - w))) ** (1 / b)
        lam = np.arctan2(s * math.cos(g0) - v * math.sin(g0), np.cos(b * along / big))
        return np.degrees(l0 - lam / b), np.degrees(from_isometric(iso, e))

    return forward, inverse


def bonne(el: str, lat1: float, lon0: float, fe: float, fn: float):
    a, e = axes(el)
    p1 = math.radians(lat1)
    distance, latitude = meridian_series(e)
    m = lambda phi: np.cos(phi) / np.sqrt(1 - (e * np.sin(phi)) ** 2)
    top = float(m(p1) / math.sin(p1))
    m1 = float(distance(p1))

    def forward(lon, lat):
        phi = np.radians(lat)
        rho = top + m1 - distance(phi)
        turn = np.where(rho == 0, 0.0, m(phi) * np.radians(lon - lon0) / np.where(rho == 0, 1, rho))
        return fe + a * rho * np.sin(turn), fn + a * (top - rho * np.cos(turn))

    def inverse(x, y):
        dx, dy = (x - fe) / a, top - (y - fn) / a
        rho = math.copysign(1.0, p1) * np.hypot(dx, dy)
        phi = latitude(top + m1 - rho)
        return lon0 + np.degrees(rho / np.maximum(m(phi), 1e-15) * np.arctan2(math.copysign(1.0, p1) * dx, math.copysign(1.0, p1) * dy)), np.degrees(phi)

    return forward, inverse


def eqdc(el: str, lat0: float, lon0: float, lat1: float, lat2: float, fe: float, fn: float):
    """Equidistant conic."""
    a, e = axes(el)
    p0, p1, p2 = map(math.radians, (lat0, lat1, lat2))
    distance, latitude = meridian_series(e)
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    n = math.sin(p1) if abs(p1 - p2) < 1e-12 else (m(p1) - m(p2)) / float(distance(p2) - distance(p1))
    g = m(p1) / n + float(distance(p1))
    r0 = g - float(distance(p0))

    def forward(lon, lat):
        r, turn = g - distance(np.radians(lat)), n * np.radians(lon - lon0)
        return fe + a * r * np.sin(turn), fn + a * (r0 - r * np.cos(turn))

    def inverse(x, y):
        dx, dy = (x - fe) / a, r0 - (y - fn) / a
        r = math.copysign(1.0, n) * np.hypot(dx, dy)
        return lon0 + np.degrees(np.arctan2(math.copysign(1.0, n) * dx, math.copysign(1.0, n) * dy) / n), np.degrees(latitude(g - r))

    return forward, inverse


def poly(el: str, lat0: float, lon0: float, fe: float, fn: float):
    """American polyconic; the inverse solves both equations by Newton's method with differences."""
    a, e = axes(el)
    distance, _ = meridian_series(e)
    m0 = float(distance(math.radians(lat0)))

    def plane(lam, phi):
        s = np.sin(phi)
        level = np.abs(phi) < 1e-12
        cot = 1 / np.tan(np.where(level, 1.0, phi))
        nu = 1 / np.sqrt(1 - (e * s) ** 2)
        turn = lam * s
        return np.where(level, lam, nu * cot * np.sin(turn)), np.where(level, -m0, distance(phi) - m0 + nu * cot * (1 - np.cos(turn)))

    def forward(lon, lat):
        x, y = plane(np.radians(lon - lon0), np.radians(lat))
        return fe + a * x, fn + a * y

    def inverse(x, y):
        gx, gy = (np.asarray(x, float) - fe) / a, (np.asarray(y, float) - fn) / a
        phi = gy + m0
        lam = gx / np.maximum(np.cos(phi), 0.1)
        for _ in range(30):
            u, v = plane(lam, phi)
            step = 1e-7
            ul, vl = plane(lam + step, phi)
            up, vp = plane(lam, phi + step)
            j11, j21, j12, j22 = (ul - u) / step, (vl - v) / step, (up - u) / step, (vp - v) / step
            det = j11 * j22 - j12 * j21
            du, dv = gx - u, gy - v
            lam, phi = lam + (du * j22 - dv * j12) / det, phi + (dv * j11 - du * j21) / det
        return lon0 + np.degrees(lam), np.degrees(phi)

    return forward, inverse


def azimuthal(radius, angle):
    """An azimuthal projection of the sphere from its radius by angular distance, and back."""

    def build(el: str, lat0: float, lon0: float, fe: float, fn: float):
        a, _ = axes(el)
        p0 = math.radians(lat0)

        def forward(lon, lat):
            phi, lam = np.radians(lat), np.radians(lon - lon0)
            cos_c = np.clip(math.sin(p0) * np.sin(phi) + math.cos(p0) * np.cos(phi) * np.cos(lam), -1, 1)
            c = np.arccos(cos_c)
            k = np.where(c < 1e-12, 1.0, radius(c) / np.where(c < 1e-12, 1, np.sin(c)))
            return fe + a * k * np.cos(phi) * np.sin(lam), fn + a * k * (math.cos(p0) * np.sin(phi) - math.sin(p0) * np.cos(phi) * np.cos(lam))

        def inverse(x, y):
            dx, dy = (x - fe) / a, (y - fn) / a
            r = np.hypot(dx, dy)
            c = angle(r)
            safe = np.where(r == 0, 1.0, r)
            phi = np.arcsin(np.clip(np.cos(c) * math.sin(p0) + dy * np.sin(c) * math.cos(p0) / safe, -1, 1))
            lam = np.arctan2(dx * np.sin(c), r * math.cos(p0) * np.cos(c) - dy * math.sin(p0) * np.sin(c))
            return lon0 + np.degrees(np.where(r == 0, 0.0, lam)), np.degrees(np.where(r == 0, p0, phi))

        return forward, inverse

    return build


def cylinder(height, latitude):
    """A cylindrical projection of the sphere from its ordinate by latitude, and back."""

    def build(el: str, lon0: float, fe: float, fn: float):
        a, _ = axes(el)
        return (lambda lon, lat: (fe + a * np.radians(lon - lon0), fn + a * height(np.radians(lat)))), (lambda x, y: (lon0 + np.degrees((x - fe) / a), np.degrees(latitude((y - fn) / a))))

    return build


def pseudo(across, up, latitude):
    """A pseudocylindrical projection of the sphere: x = across(phi) * lambda, y = up(phi)."""

    def build(el: str, lon0: float, fe: float, fn: float):
        a, _ = axes(el)

        def forward(lon, lat):
            phi = np.radians(lat)
            return fe + a * across(phi) * np.radians(lon - lon0), fn + a * up(phi)

        def inverse(x, y):
            phi = latitude((y - fn) / a)
            return lon0 + np.degrees((x - fe) / (a * across(phi))), np.degrees(phi)

        return forward, inverse

    return build


def solved(f, low=-math.pi / 2, high=math.pi / 2):
    """The inverse of a rising function on an interval, by bisection."""

    def back(y):
        a, b = np.full_like(np.asarray(y, float), low), np.full_like(np.asarray(y, float), high)
        for _ in range(60):
            middle = (a + b) / 2
            up = f(middle) < y
            a, b = np.where(up, middle, a), np.where(up, b, middle)
        return (a + b) / 2

    return back


def natural_earth(phi):
    return phi * (1.007226 + phi**2 * (0.015085 + phi**6 * (-0.044475 + phi**2 * (0.028874 - 0.005916 * phi**2))))  # fixed values of the method


def natural_earth_width(phi):
    return 0.8707 + phi**2 * (-0.131979 + phi**2 * (-0.013791 + phi**8 * (0.003971 - 0.001529 * phi**2)))  # fixed values of the method


METHODS.update({
    "cass": cass, "krovak": krovak, "omerc": omerc, "bonne": bonne, "eqdc": eqdc, "poly": poly,
    "aeqd_sphere": azimuthal(lambda c: c, lambda r: r), "ortho_sphere": azimuthal(np.sin, lambda r: np.arcsin(np.clip(r, -1, 1))), "gnom": azimuthal(np.tan, np.arctan),
    "stere_sphere": azimuthal(lambda c: 2 * np.tan(c / 2), lambda r: 2 * np.arctan(r / 2)),
    "mill": cylinder(lambda p: 1.25 * np.log(np.tan(math.pi / 4 + 0.4 * p)), lambda y: 2.5 * (np.arctan(np.exp(0.8 * y)) - math.pi / 4)),
    "gall": cylinder(lambda p: (1 + math.sqrt(2)) * np.tan(p / 2), lambda y: 2 * np.arctan(y / (1 + math.sqrt(2)))),
    "natearth": pseudo(natural_earth_width, natural_earth, solved(natural_earth)),
    "eck3": pseudo(lambda p: 0.42223820031577125 * (1 + np.sqrt(np.maximum(1 - 4 * p**2 / math.pi**2, 0))), lambda p: 0.8444764006315425 * p, lambda y: y / 0.8444764006315425),
    "craster": pseudo(lambda p: 0.97720502380583984317 * (2 * np.cos(2 * p / 3) - 1), lambda p: 3.06998012383946546542 * np.sin(p / 3), lambda y: 3 * np.arcsin(y / 3.06998012383946546542)),
    "wag3": pseudo(lambda p: np.cos(2 * p / 3), lambda p: p, lambda y: y),
})


def through(angle, across, up, low: float = -math.pi / 2, high: float = math.pi / 2):
    """A pseudocylindrical projection by an auxiliary angle t with angle(t) = right(phi): (t -> angle, scale), x = across(t) * lambda, y = up(t)."""
    left, right = angle
    back = solved(left, low, high)
    height = solved(up, low, high)

    def build(el: str, lon0: float, fe: float, fn: float):
        a, _ = axes(el)

        def forward(lon, lat):
            t = back(right(np.radians(lat)))
            return fe + a * across(t) * np.radians(lon - lon0), fn + a * up(t)

        def inverse(x, y):
            t = height((np.asarray(y, float) - fn) / a)
            phi = np.arcsin(np.clip(left(t) / right(math.pi / 2), -1, 1))
            return lon0 + np.degrees((x - fe) / (a * across(t))), np.degrees(phi)

        return forward, inverse

    return build


def of_family(cx: float, cy: float, a0: float):
    """x = cx * lambda * (a0 + sqrt(1 - 3 phi^2 / pi^2)), y = cy * phi."""
    return pseudo(lambda p: cx * (a0 + np.sqrt(np.maximum(1 - 3 * p**2 / math.pi**2, 0))), lambda p: cy * p, lambda y: y / cy)


def hammer(el: str, lon0: float, fe: float, fn: float):
    a, _ = axes(el)

    def forward(lon, lat):
        phi, half = np.radians(lat), np.radians(lon - lon0) / 2
        d = np.sqrt(2 / (1 + np.cos(phi) * np.cos(half)))
        return fe + a * 2 * d * np.cos(phi) * np.sin(half), fn + a * d * np.sin(phi)

    def inverse(x, y):
        u, v = (x - fe) / a, (y - fn) / a
        z = np.sqrt(np.maximum(1 - u * u / 16 - v * v / 4, 0))
        return lon0 + np.degrees(2 * np.arctan2(z * u, 2 * (2 * z * z - 1))), np.degrees(np.arcsin(np.clip(z * v, -1, 1)))

    return forward, inverse


def by_newton(plane):
    """A projection of the sphere from plane(lambda, phi); its inverse by Newton's method from the cylindrical guess."""

    def build(el: str, lon0: float, fe: float, fn: float):
        a, _ = axes(el)

        def forward(lon, lat):
            u, v = plane(np.radians(lon - lon0), np.radians(lat))
            return fe + a * u, fn + a * v

        def inverse(x, y):
            gx, gy = (np.asarray(x, float) - fe) / a, (np.asarray(y, float) - fn) / a
            phi, lam, step = np.clip(gy, -1.5, 1.5), gx.copy() if np.ndim(gx) else gx, 1e-6
            for _ in range(60):
                u, v = plane(lam, phi)
                (ul, vl), (us, vs) = plane(lam + step, phi), plane(lam - step, phi)
                (up, vp), (uq, vq) = plane(lam, phi + step), plane(lam, phi - step)
                j11, j21, j12, j22 = (ul - us) / (2 * step), (vl - vs) / (2 * step), (up - uq) / (2 * step), (vp - vq) / (2 * step)
                det = j11 * j22 - j12 * j21
                du, dv = gx - u, gy - v
                lam, phi = lam + np.clip((du * j22 - dv * j12) / det, -0.5, 0.5), np.clip(phi + np.clip((dv * j11 - du * j21) / det, -0.5, 0.5), -1.57, 1.57)
            return lon0 + np.degrees(lam), np.degrees(phi)

        return forward, inverse

    return build


def aitoff_plane(lam, phi):
    angle = np.arccos(np.clip(np.cos(phi) * np.cos(lam / 2), -1, 1))
    k = np.where(angle < 1e-9, 1.0, angle / np.where(angle < 1e-9, 1, np.sin(angle)))
    return 2 * np.cos(phi) * np.sin(lam / 2) * k, np.sin(phi) * k


def winkel_tripel_plane(lam, phi):
    x, y = aitoff_plane(lam, phi)
    return (x + lam * 2 / math.pi) / 2, (y + phi) / 2  # standard parallel arccos(2 / pi)


def boggs_plane(lam, phi):
    t = solved(lambda v: 2 * v + np.sin(2 * v))(math.pi * np.sin(phi))
    return 2.00276 * lam / (1 / np.cos(phi) + 1.11072 / np.cos(t)), 0.49931 * (phi + math.sqrt(2) * np.sin(t))


#: Robinson's table, every five degrees.
ROBINSON_X = np.array([1, 0.9986, 0.9954, 0.99, 0.9822, 0.973, 0.96, 0.9427, 0.9216, 0.8962, 0.8679, 0.835, 0.7986, 0.7597, 0.7186, 0.6732, 0.6213, 0.5722, 0.5322])
ROBINSON_Y = np.array([0, 0.062, 0.124, 0.186, 0.248, 0.31, 0.372, 0.434, 0.4958, 0.5571, 0.6176, 0.6769, 0.7346, 0.7903, 0.8435, 0.8936, 0.9394, 0.9761, 1])


def tabled(values: np.ndarray, degrees):
    """A cubic through four neighbours of a table for every five degrees."""
    at = np.clip(np.abs(degrees) / 5, 0, 18)
    i = np.clip(np.floor(at).astype(int), 1, 16)
    t = at - i
    a, b, c, d = (values[i + k] for k in (-1, 0, 1, 2))
    return b + t * ((c - a / 3 - b / 2 - d / 6) + t * ((a + c) / 2 - b + t * ((d - a) / 6 + (b - c) / 2)))


def perspective(el: str, lat0: float, lon0: float, h: float, fe: float, fn: float):
    """The sphere seen from a height above a point."""
    a, _ = axes(el)
    p = 1 + h / a

    def angle(r):
        r = np.maximum(r, 1e-15)
        return np.arcsin(np.clip((p - np.sqrt(np.maximum(1 - r * r * (p + 1) / (p - 1), 0))) / ((p - 1) / r + r / (p - 1)), -1, 1))

    return azimuthal(lambda c: (p - 1) * np.sin(c) / (p - np.cos(c)), angle)(el, lat0, lon0, fe, fn)


def loximuthal(el: str, lat1: float, lon0: float, fe: float, fn: float):
    a, _ = axes(el)
    p1 = math.radians(lat1)

    def width(phi):
        d = phi - p1
        near = np.abs(d) < 1e-9
        gap = np.log(np.tan(math.pi / 4 + phi / 2) / math.tan(math.pi / 4 + p1 / 2))
        return np.where(near, math.cos(p1), d / np.where(near, 1, gap))

    return (lambda lon, lat: (fe + a * width(np.radians(lat)) * np.radians(lon - lon0), fn + a * (np.radians(lat) - p1))), (lambda x, y: (lon0 + np.degrees((x - fe) / (a * width((y - fn) / a + p1))), np.degrees((y - fn) / a + p1)))


# Constants of the published methods.
METHODS.update({
    "eck1": pseudo(lambda p: 0.92131773192356127802 * (1 - np.abs(p) / math.pi), lambda p: 0.92131773192356127802 * p, lambda y: y / 0.92131773192356127802),
    "eck2": pseudo(lambda p: 0.46065886596178063902 * np.sqrt(4 - 3 * np.sin(np.abs(p))), lambda p: np.sign(p) * 1.44720250911653531871 * (2 - np.sqrt(4 - 3 * np.sin(np.abs(p)))), solved(lambda p: np.sign(p) * 1.44720250911653531871 * (2 - np.sqrt(4 - 3 * np.sin(np.abs(p)))))),
    "eck4": through((lambda t: t + np.sin(t) * np.cos(t) + 2 * np.sin(t), lambda p: (2 + math.pi / 2) * np.sin(p)), lambda t: 0.42223820031577120149 * (1 + np.cos(t)), lambda t: 1.32650042817700232218 * np.sin(t)),
    "eck5": pseudo(lambda p: 0.44101277172455148219 * (1 + np.cos(p)), lambda p: 0.88202554344910296438 * p, lambda y: y / 0.88202554344910296438),
    "eck6": through((lambda t: t + np.sin(t), lambda p: (1 + math.pi / 2) * np.sin(p)), lambda t: (1 + np.cos(t)) / math.sqrt(2 + math.pi), lambda t: 2 * t / math.sqrt(2 + math.pi)),
    "wag6": of_family(1.0, 1.0, 0.0), "kav7": of_family(0.8660254037844, 1.0, 0.0), "putp1": of_family(1.89490, 0.94745, -0.5),
    "collg": pseudo(lambda p: 1.12837916709551257390 * np.sqrt(np.maximum(1 - np.sin(p), 0)), lambda p: 1.77245385090551602729 * (1 - np.sqrt(np.maximum(1 - np.sin(p), 0))), lambda y: np.arcsin(np.clip(1 - (1 - y / 1.77245385090551602729) ** 2, -1, 1))),
    "nell": through((lambda t: t + np.sin(t), lambda p: 2 * np.sin(p)), lambda t: 0.5 * (1 + np.cos(t)), lambda t: t), "nell_h": pseudo(lambda p: 0.5 * (1 + np.cos(p)), lambda p: 2 * (p - np.tan(p / 2)), solved(lambda p: 2 * (p - np.tan(p / 2)))),
    "qua_aut": pseudo(lambda p: np.cos(p) / np.cos(p / 2), lambda p: 2 * np.sin(p / 2), lambda y: 2 * np.arcsin(np.clip(y / 2, -1, 1))),
    "times": pseudo(lambda p: 0.74482 - 0.34588 * np.sin(math.pi / 4 * np.tan(p / 2)) ** 2, lambda p: 1.70711 * np.tan(p / 2), lambda y: 2 * np.arctan(y / 1.70711)),
    "fahey": pseudo(lambda p: 0.819152 * np.sqrt(np.maximum(1 - np.tan(p / 2) ** 2, 0)), lambda p: 1.819152 * np.tan(p / 2), lambda y: 2 * np.arctan(y / 1.819152)),
    "robin": pseudo(lambda p: 0.8487 * tabled(ROBINSON_X, np.degrees(p)), lambda p: 1.3523 * np.sign(p) * tabled(ROBINSON_Y, np.degrees(p)), solved(lambda p: 1.3523 * np.sign(p) * tabled(ROBINSON_Y, np.degrees(p)))),
    "patterson": cylinder(lambda p: p * (1.0148 + p**4 * (0.23185 + p**2 * (-0.14499 + 0.02406 * p**2))), solved(lambda p: p * (1.0148 + p**4 * (0.23185 + p**2 * (-0.14499 + 0.02406 * p**2))))),
    "comill": cylinder(lambda p: p * (0.9902 + p**2 * (0.1604 - 0.03054 * p**2)), solved(lambda p: p * (0.9902 + p**2 * (0.1604 - 0.03054 * p**2)))), "cc": cylinder(np.tan, np.arctan),
    "hammer": hammer, "aitoff": by_newton(aitoff_plane), "wintri": by_newton(winkel_tripel_plane), "boggs": by_newton(boggs_plane), "nsper": perspective, "loxim": loximuthal,
})


def swiss(el: str, lat0: float, lon0: float, k0: float, fe: float, fn: float):
    """Oblique Mercator by way of a conformal sphere, centred on a point."""
    a, e = axes(el)
    p0 = math.radians(lat0)
    c = math.sqrt(1 + e * e * math.cos(p0) ** 4 / (1 - e * e))
    q0 = math.asin(math.sin(p0) / c)

    def stretched(phi):
        s = e * np.sin(phi)
        return np.log(np.tan(math.pi / 4 + phi / 2)) - e / 2 * np.log((1 + s) / (1 - s))

    shift = math.log(math.tan(math.pi / 4 + q0 / 2)) - c * stretched(p0)
    r = a * k0 * math.sqrt(1 - e * e) / (1 - (e * math.sin(p0)) ** 2)

    def forward(lon, lat):
        phi = 2 * np.arctan(np.exp(c * stretched(np.radians(lat)) + shift)) - math.pi / 2
        lam = c * np.radians(lon - lon0)
        up = np.arcsin(math.cos(q0) * np.sin(phi) - math.sin(q0) * np.cos(phi) * np.cos(lam))
        across = np.arcsin(np.cos(phi) * np.sin(lam) / np.cos(up))
        return fe + r * across, fn + r * np.log(np.tan(math.pi / 4 + up / 2))

    def inverse(x, y):
        up, across = 2 * (np.arctan(np.exp((y - fn) / r)) - math.pi / 4), (x - fe) / r
        phi = np.arcsin(math.cos(q0) * np.sin(up) + math.sin(q0) * np.cos(up) * np.cos(across))
        lam = np.arcsin(np.cos(up) * np.sin(across) / np.cos(phi))
        goal = (np.log(np.tan(math.pi / 4 + phi / 2)) - shift) / c
        for _ in range(20):
            s = e * np.sin(phi)
            phi = phi - (stretched(phi) - goal) * np.cos(phi) * (1 - s * s) / (1 - e * e)
        return lon0 + np.degrees(lam / c), np.degrees(phi)

    return forward, inverse


#: Series of the New Zealand Map Grid, latitude to isometric latitude and that to the plane.
NZ_PSI = np.array([0.6399175073, -0.1358797613, 0.063294409, -0.02526853, 0.0117879, -0.0055161, 0.0026906, -0.001333, 0.00067, -0.00034])
NZ_PLANE = np.array([0.7557853228, 0.249204646 + 0.003371507j, -0.001541739 + 0.041058560j, -0.10162907 + 0.01727609j, -0.26623489 - 0.36249218j, -0.6870983 - 1.1651967j])


def nzmg(el: str, lat0: float, lon0: float, fe: float, fn: float):
    """New Zealand Map Grid: a complex polynomial of longitude and isometric latitude."""
    a, _ = axes(el)
    unit = math.radians(1e5 / 3600)  # of latitude in the series

    def series(z, coefficients):
        out = 0 * z
        for k in coefficients[::-1]:
            out = (out + k) * z
        return out

    def slope(z, coefficients):
        out = 0 * z
        for n, k in list(enumerate(coefficients, 1))[::-1]:
            out = out * z + n * k
        return out

    def forward(lon, lat):
        z = series(np.asarray(np.radians(np.asarray(lat, float) - lat0) / unit, float), NZ_PSI) + 1j * np.radians(lon - lon0)
        w = series(z, NZ_PLANE)
        return fe + a * w.imag, fn + a * w.real

    def inverse(x, y):
        w = (np.asarray(y, float) - fn + 1j * (np.asarray(x, float) - fe)) / a
        z = w / NZ_PLANE[0]
        for _ in range(12):
            z = z - (series(z, NZ_PLANE) - w) / slope(z, NZ_PLANE)
        d = z.real / NZ_PSI[0]
        for _ in range(12):
            d = d - (series(d, NZ_PSI) - z.real) / slope(d, NZ_PSI)
        return lon0 + np.degrees(z.imag), lat0 + np.degrees(d * unit)

    return forward, inverse


def geostationary(el: str, h: float, lon0: float, fe: float, fn: float):
    """Scanning angles of a satellite above the equator, times its height; NaN where it doesn't see."""
    a, e = axes(el)
    near, far, p2 = h / a, 1 + h / a, 1 - e * e

    def forward(lon, lat):
        lam, phi = np.radians(lon - lon0), np.arctan(p2 * np.tan(np.radians(lat)))
        r = math.sqrt(p2) / np.hypot(math.sqrt(p2) * np.cos(phi), np.sin(phi))
        x, y, z = r * np.cos(lam) * np.cos(phi), r * np.sin(lam) * np.cos(phi), r * np.sin(phi)
        seen = (far - x) * x - y * y - z * z / p2 >= 0
        ahead = far - x
        return np.where(seen, fe + a * near * np.arctan(y / ahead), np.nan), np.where(seen, fn + a * near * np.arctan(z / np.hypot(y, ahead)), np.nan)

    def inverse(x, y):
        v = np.tan((x - fe) / (a * near))
        w = np.tan((y - fn) / (a * near)) * np.hypot(1, v)
        square = v * v + w * w / p2 + 1
        k = (far - np.sqrt(far * far - square * (far * far - 1))) / square
        lam = np.arctan2(v * k, far - k)
        return lon0 + np.degrees(lam), np.degrees(np.arctan(np.tan(np.arctan(w * k * np.cos(lam) / (far - k))) / p2))

    return forward, inverse


def rotated(inner: tuple, pole_lat: float, pole_lon: float, lon0: float):
    """Another projection of the sphere after moving the pole; `inner` is its pair of functions."""
    tilt, turn = math.radians(pole_lat), math.radians(pole_lon)

    def forward(lon, lat):
        lam, phi = np.radians(lon - lon0), np.radians(lat)
        new = np.arctan2(np.cos(phi) * np.sin(lam), math.sin(tilt) * np.cos(phi) * np.cos(lam) + math.cos(tilt) * np.sin(phi)) + turn
        up = np.arcsin(np.clip(math.sin(tilt) * np.sin(phi) - math.cos(tilt) * np.cos(phi) * np.cos(lam), -1, 1))
        return inner[0]((np.degrees(new) + 180) % 360 - 180, np.degrees(up))

    def inverse(x, y):
        lon, lat = inner[1](x, y)
        lam, phi = np.radians(lon) - turn, np.radians(lat)
        new = np.arctan2(np.cos(phi) * np.sin(lam), math.sin(tilt) * np.cos(phi) * np.cos(lam) - math.cos(tilt) * np.sin(phi))
        up = np.arcsin(np.clip(math.sin(tilt) * np.sin(phi) + math.cos(tilt) * np.cos(phi) * np.cos(lam), -1, 1))
        return (lon0 + np.degrees(new) + 180) % 360 - 180, np.degrees(up)

    return forward, inverse


def oblique(el: str, inner: str, pole_lat: float, pole_lon: float, lon0: float, *more: float):
    """Any method by name with a moved pole; plain longitudes and latitudes if it is longlat."""
    pair = (lambda lon, lat: (lon, lat),) * 2 if inner in ("longlat", "latlon") else METHODS[inner](el, *(more or (0.0, 0.0, 0.0)))
    return rotated(pair, pole_lat, pole_lon, lon0)


METHODS.update({"somerc": swiss, "nzmg": nzmg, "geos": geostationary, "ob_tran": oblique})
