"""CRSs as text and back: PROJ strings, WKT 1 and 2, PROJJSON, names; compound CRSs, equivalence, identification."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from typing import Any

from .crs import CRS84, KNOWN, Crs, add_user_crs, crs_of, parse_srs
from .project import ELLIPSOIDS, METHODS, ProjectionError

#: Parameters of each method in the order of project.METHODS, by their PROJ names.
PARAMETERS = {
    "tmerc": ("lat_0", "lon_0", "k_0", "x_0", "y_0"), "lcc": ("lat_0", "lon_0", "lat_1", "lat_2", "x_0", "y_0"), "merc": ("lat_ts", "lon_0", "k_0", "x_0", "y_0"), "webmerc": ("x_0", "y_0"), "laea": ("lat_0", "lon_0", "x_0", "y_0"),
    "aea": ("lat_0", "lon_0", "lat_1", "lat_2", "x_0", "y_0"), "stere": ("lat_ts", "lon_0", "x_0", "y_0"), "sterea": ("lat_0", "lon_0", "k_0", "x_0", "y_0"), "cea": ("lat_ts", "lon_0", "x_0", "y_0"), "eqearth": ("lon_0", "x_0", "y_0"),
    "eqc": ("lat_ts", "lon_0", "x_0", "y_0"), "sinu": ("lon_0", "x_0", "y_0"), "moll": ("lon_0", "x_0", "y_0"), "cass": ("lat_0", "lon_0", "x_0", "y_0"), "bonne": ("lat_1", "lon_0", "x_0", "y_0"), "eqdc": ("lat_0", "lon_0", "lat_1", "lat_2", "x_0", "y_0"), "poly": ("lat_0", "lon_0", "x_0", "y_0"),
    "somerc": ("lat_0", "lon_0", "k_0", "x_0", "y_0"), "nzmg": ("lat_0", "lon_0", "x_0", "y_0"), "geos": ("h", "lon_0", "x_0", "y_0"), "loxim": ("lat_1", "lon_0", "x_0", "y_0"), "nsper": ("lat_0", "lon_0", "h", "x_0", "y_0"), "gnom": ("lat_0", "lon_0", "x_0", "y_0"), "krovak": ("lat_0", "lon_0", "alpha", "lat_p", "k_0", "x_0", "y_0"),
    **dict.fromkeys("mill gall natearth eck1 eck2 eck3 eck4 eck5 eck6 wag3 wag6 kav7 putp1 collg craster nell nell_h qua_aut times fahey robin patterson comill cc hammer aitoff wintri boggs".split(), ("lon_0", "x_0", "y_0")),
}
#: Names of methods and parameters in WKT 2 and WKT 1.
METHOD_NAMES = {
    "tmerc": ("Transverse Mercator", "Transverse_Mercator"), "lcc": ("Lambert Conic Conformal (2SP)", "Lambert_Conformal_Conic_2SP"), "merc": ("Mercator (variant A)", "Mercator_1SP"), "webmerc": ("Popular Visualisation Pseudo Mercator", "Mercator_Auxiliary_Sphere"),
    "laea": ("Lambert Azimuthal Equal Area", "Lambert_Azimuthal_Equal_Area"), "aea": ("Albers Equal Area", "Albers_Conic_Equal_Area"), "stere": ("Polar Stereographic (variant B)", "Polar_Stereographic"), "sterea": ("Oblique Stereographic", "Oblique_Stereographic"),
    "cea": ("Lambert Cylindrical Equal Area", "Cylindrical_Equal_Area"), "eqearth": ("Equal Earth", "Equal_Earth"), "eqc": ("Equidistant Cylindrical", "Equirectangular"), "cass": ("Cassini-Soldner", "Cassini_Soldner"), "bonne": ("Bonne", "Bonne"), "poly": ("American Polyconic", "Polyconic"), "sinu": ("Sinusoidal", "Sinusoidal"),
}
PARAMETER_NAMES = {"lat_0": ("Latitude of natural origin", "latitude_of_origin"), "lon_0": ("Longitude of natural origin", "central_meridian"), "k_0": ("Scale factor at natural origin", "scale_factor"), "x_0": ("False easting", "false_easting"), "y_0": ("False northing", "false_northing"), "lat_1": ("Latitude of 1st standard parallel", "standard_parallel_1"), "lat_2": ("Latitude of 2nd standard parallel", "standard_parallel_2"), "lat_ts": ("Latitude of standard parallel", "standard_parallel_1")}
ALSO = {"latitude of false origin": "lat_0", "longitude of false origin": "lon_0", "easting at false origin": "x_0", "northing at false origin": "y_0", "latitude of projection centre": "lat_0", "longitude of projection centre": "lon_0", "latitude of center": "lat_0", "longitude of center": "lon_0"}
DATUM_NAMES = {"WGS84": "World Geodetic System 1984", "ETRS89": "European Terrestrial Reference System 1989", "NAD83": "North American Datum 1983", "OSGB36": "Ordnance Survey of Great Britain 1936", "MGI": "Militar-Geographische Institut", "BD72": "Reseau National Belge 1972", "S-JTSK": "System of the Unified Trigonometrical Cadastral Network", "Amersfoort": "Amersfoort", "GDA94": "Geocentric Datum of Australia 1994", "NZGD2000": "New Zealand Geodetic Datum 2000", "SIRGAS2000": "Sistema de Referencia Geocentrico para las AmericaS 2000", "DHDN": "Deutsches Hauptdreiecksnetz"}
ELLIPSOID_NAMES = {"WGS84": "WGS 84", "GRS80": "GRS 1980", "bessel": "Bessel 1841", "airy": "Airy 1830", "intl": "International 1924", "clrk66": "Clarke 1866", "krass": "Krassowsky 1940"}
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "us-ft": 1200 / 3937}
DATUM_OF_PROJ = {"WGS84": ("WGS84", "WGS84"), "NAD83": ("NAD83", "GRS80"), "OSGB36": ("OSGB36", "airy")}
WORLD = (-180.0, -90.0, 180.0, 90.0)


@dataclass(frozen=True)
class Compound:
    """A horizontal CRS and a vertical one, of which the code is known."""

    horizontal: Crs
    vertical: int

    @property
    def name(self) -> str:
        return f"{self.horizontal.name} + EPSG:{self.vertical}"


def name_key(name: str) -> str:
    """What names have in common that differ in case, spaces and marks."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def by_name(name: str) -> Crs | None:
    return next((c for c in [*KNOWN.values(), CRS84] if name_key(c.name) == name_key(name)), None)


def ellipsoid_of(a: float, rf: float) -> str:
    """A known ellipsoid by its axes; another one is added under a name of its own."""
    for key, (known_a, known_rf) in ELLIPSOIDS.items():
        if abs(a - known_a) < 1e-4 and abs(rf - known_rf) < 1e-6:
            return key
    key = f"{a!r}/{rf!r}"
    ELLIPSOIDS[key] = (a, rf)
    return key


def proj_items(text: str) -> dict[str, str]:
    return {k.lstrip("+"): v for k, _, v in (x.partition("=") for x in text.split()) if k.strip("+")}


def from_proj(text: str) -> Crs:
    """A CRS of a PROJ string: longlat, utm, or a method that is known."""
    items = proj_items(text)
    if m := re.fullmatch(r"epsg:(\d+)", items.get("init", "").lower()):
        return known(int(m[1]))
    method = items.get("proj")
    datum, ellipsoid = DATUM_OF_PROJ.get(items.get("datum", ""), (None, items.get("ellps")))
    if "a" in items:
        a = float(items["a"])
        rf = float(items["rf"]) if "rf" in items else a / (a - float(items["b"])) if "b" in items and float(items["b"]) != a else 0.0
        ellipsoid = ellipsoid_of(a, rf)
    if "R" in items:
        ellipsoid = ellipsoid_of(float(items["R"]), 0.0)
    ellipsoid = ellipsoid or "WGS84"
    if ellipsoid not in ELLIPSOIDS:
        raise ProjectionError(f"ellipsoid {ellipsoid}")
    datum = datum or {"WGS84": "WGS84", "GRS80": "ETRS89"}.get(ellipsoid, f"on {ellipsoid}")
    unit = float(items["to_meter"]) if "to_meter" in items else UNITS.get(items.get("units", "m"))
    if unit is None:
        raise ProjectionError(f"units {items['units']}")
    if method in ("longlat", "latlong", "lonlat", "latlon"):
        return Crs(0, "unknown", "E", True, ellipsoid, WORLD, datum)
    if method == "utm":
        zone, south = int(items["zone"]), "south" in items
        return Crs(0, f"unknown UTM {zone}", "E", False, ellipsoid, WORLD, datum, ("tmerc", 0.0, zone * 6 - 183.0, 0.9996, 500000.0, 10000000.0 if south else 0.0))
    if method == "ob_tran":
        inner = items.get("o_proj", "")
        if inner not in ("longlat", "latlon") and (inner not in PARAMETERS or inner not in METHODS):
            raise ProjectionError(f"method {inner}")
        more = [0.0 if p == "lon_0" else float(items.get(p, "1" if p == "k_0" else "0")) for p in PARAMETERS.get(inner, ())]
        return Crs(0, "unknown", "E", False, ellipsoid, WORLD, datum, ("ob_tran", inner, float(items.get("o_lat_p", "0")), float(items.get("o_lon_p", "0")), float(items.get("lon_0", "0")), *more), unit)
    if method not in PARAMETERS:
        raise ProjectionError(f"method {method}")
    defaults = {"k_0": items.get("k", "1"), "lat_ts": items.get("lat_1", "0"), "lat_2": items.get("lat_1", "0")}
    values = [float(items.get(p, defaults.get(p, "0"))) for p in PARAMETERS[method]]
    return Crs(0, "unknown", "E", False, ellipsoid, WORLD, datum, (method, *values), unit)


def to_proj(crs: Crs) -> str:
    """The PROJ string of a CRS."""
    if crs.geographic:
        head = ["+proj=longlat"]
    else:
        method, *values = crs.projection
        if method not in PARAMETERS:
            raise ProjectionError(f"method {method} has no PROJ string here")
        head = [f"+proj={method}"] + [f"+{p}={v:.12g}" for p, v in zip(PARAMETERS[method], values, strict=False)]
    a, rf = ELLIPSOIDS[crs.ellipsoid]
    shape = f"+ellps={crs.ellipsoid}" if crs.ellipsoid in ELLIPSOID_NAMES else f"+a={a!r} +rf={rf!r}" if rf else f"+R={a!r}"
    return " ".join([*head, "+datum=WGS84" if crs.datum == "WGS84" else shape, *([] if crs.geographic or crs.unit == 1 else [f"+to_meter={crs.unit!r}"]), "+no_defs"])


def known(code: int) -> Crs:
    crs = crs_of(code)
    if crs is None:
        raise ProjectionError(f"EPSG:{code} isn't known")
    return crs


WKT_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z_][A-Za-z0-9_]*)\s*(?=[\[(])|([A-Za-z_]\w*)|([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)|([\[\](),]))')


def wkt_tree(text: str) -> list:
    """[keyword, items...]; items are trees, strings and numbers."""
    at, stack, root = 0, [], None
    text = text.strip()
    while at < len(text):
        m = WKT_TOKEN.match(text, at)
        if not m:
            raise ProjectionError(f"WKT at character {at}")
        at = m.end()
        string, keyword, word, number, mark = m.groups()
        if keyword:
            node: list[Any] = [keyword.upper()]
            if stack:
                stack[-1].append(node)
            root = root or node
            stack.append(node)
        elif mark in (")", "]"):
            if not stack:
                raise ProjectionError("WKT: a bracket too many")
            stack.pop()
        elif mark is None:
            if not stack:
                raise ProjectionError("WKT: no keyword")
            stack[-1].append(string.replace('""', '"') if string is not None else word if word else float(number))
    if stack or root is None:
        raise ProjectionError("WKT ends early")
    return root


def parts(node: list, *names: str) -> list[list]:
    return [x for x in node if isinstance(x, list) and x[0] in names]


def within(node: list, *names: str) -> list | None:
    """The first such node, depth first."""
    for x in node:
        if isinstance(x, list):
            if x[0] in names:
                return x
            if (found := within(x, *names)) is not None:
                return found
    return None


def code_in(node: list) -> int | None:
    own = next(iter(parts(node, "ID", "AUTHORITY")), None)
    return int(float(own[2])) if own and str(own[1]).upper() == "EPSG" and re.fullmatch(r"\d+(\.0)?", str(own[2])) else None


def from_wkt(text: str) -> Crs | Compound:
    """A CRS of WKT 1 or 2; one whose code is known is that one."""
    return of_tree(wkt_tree(text))


def of_tree(tree: list) -> Crs | Compound:
    kind = tree[0]
    if kind in ("COMPOUNDCRS", "COMPD_CS"):
        both = parts(tree, "PROJCRS", "PROJCS", "GEOGCRS", "GEOGCS", "GEODCRS", "VERTCRS", "VERT_CS")
        return Compound(of_tree(both[0]), code_in(both[1]) or 0)
    if kind == "BOUNDCRS":
        return of_tree(parts(tree, "SOURCECRS")[0][1])
    if (code := code_in(tree)) and (crs := crs_of(code)):
        return crs
    if kind not in ("GEOGCRS", "GEOGCS", "GEODCRS", "PROJCRS", "PROJCS"):
        raise ProjectionError(f"WKT of {kind}")
    shape = within(tree, "ELLIPSOID", "SPHEROID")
    if shape is None:
        raise ProjectionError("WKT without an ellipsoid")
    ellipsoid = ellipsoid_of(shape[2], shape[3])
    frame = within(tree, "DATUM", "ENSEMBLE", "GEODETICDATUM", "TRF")
    title = frame[1] if frame else ""
    datum = next((k for k, v in DATUM_NAMES.items() if name_key(re.sub("^D_", "", title)).startswith((name_key(v), name_key(k)))), {"WGS84": "WGS84", "GRS80": "ETRS89"}.get(ellipsoid, f"on {ellipsoid}"))
    axes = parts(tree, "AXIS")
    first = "N" if axes and str(axes[0][2]).lower() in ("north", "south") else "E"
    if kind in ("GEOGCRS", "GEOGCS", "GEODCRS"):
        return Crs(0, tree[1], first if axes else "N", True, ellipsoid, WORLD, datum)
    conversion = next(iter(parts(tree, "CONVERSION")), tree)
    method = next(iter(parts(conversion, "METHOD", "PROJECTION")))[1]
    key = next((k for k, names in METHOD_NAMES.items() if name_key(method) in map(name_key, names)), {"lambertconformalconic1sp": "lcc", "lambertconicconformal1sp": "lcc", "mercatorvariantb": "merc", "mercator2sp": "merc"}.get(name_key(method)))
    if key is None:
        raise ProjectionError(f"method {method}")
    unit = next((float(x[2]) for x in parts(tree, "LENGTHUNIT", "UNIT")), 1.0)
    found: dict[str, float] = {}
    for p in parts(conversion, "PARAMETER"):
        name = ALSO.get(p[1].lower().replace("_", " "))
        for k, names in PARAMETER_NAMES.items():
            if name is None and name_key(p[1]) in map(name_key, names) and (k != "lat_1" or "lat_1" in PARAMETERS[key]):
                name = k
        if name:
            scale = next((float(u[2]) for u in parts(p, "LENGTHUNIT")), unit if kind == "PROJCS" else 1.0) if name in ("x_0", "y_0") else 1.0
            found[name] = p[2] * scale
    if key == "lcc":
        found.setdefault("lat_1", found.get("lat_0", 0.0))
        found.setdefault("lat_2", found["lat_1"])
    return Crs(0, tree[1], first, False, ellipsoid, WORLD, datum, (key, *[found.get(p, 1.0 if p == "k_0" else 0.0) for p in PARAMETERS[key]]), unit)


def to_wkt(crs: Crs, version: int = 2) -> str:
    """WKT of a CRS, 2 (2019) or 1."""
    a, rf = ELLIPSOIDS[crs.ellipsoid]
    new = version == 2
    identity = "" if crs.code <= 0 else f',ID["EPSG",{crs.code}]' if new else f',AUTHORITY["EPSG","{crs.code}"]'
    shape = f'{"ELLIPSOID" if new else "SPHEROID"}["{ELLIPSOID_NAMES.get(crs.ellipsoid, "unknown")}",{a!r},{rf!r}{",LENGTHUNIT[" + chr(34) + "metre" + chr(34) + ",1]" if new else ""}]'
    datum = f'DATUM["{DATUM_NAMES.get(crs.datum, crs.datum)}",{shape}]'
    degree = '"degree",0.0174532925199433'
    axes = lambda names, unit: "".join(f',AXIS["{n}",{d}{f",{unit}" if new else ""}]' for n, d in names)
    order = lambda x: x if crs.first_axis == "E" else x[::-1]
    lonlat = order([("Longitude", "east" if new else "EAST"), ("Latitude", "north" if new else "NORTH")])
    if crs.geographic:
        if new:
            return f'GEOGCRS["{crs.name}",{datum},CS[ellipsoidal,2]{axes(lonlat, f"ANGLEUNIT[{degree}]")}{identity}]'
        return f'GEOGCS["{crs.name}",{datum},PRIMEM["Greenwich",0],UNIT[{degree}]{axes(lonlat, "")}{identity}]'
    method, *values = crs.projection
    if method not in METHOD_NAMES:
        raise ProjectionError(f"method {method} has no WKT here")
    units = {"x_0": f'LENGTHUNIT["metre",1]', "y_0": f'LENGTHUNIT["metre",1]', "k_0": 'SCALEUNIT["unity",1]'}
    given = list(zip(PARAMETERS[method], values, strict=False))
    xy = order([("Easting", "east" if new else "EAST"), ("Northing", "north" if new else "NORTH")])
    if new:
        body = "".join(f',PARAMETER["{PARAMETER_NAMES[p][0]}",{v!r},{units.get(p, f"ANGLEUNIT[{degree}]")}]' for p, v in given)
        return f'PROJCRS["{crs.name}",BASEGEOGCRS["{crs.datum}",{datum}],CONVERSION["unnamed",METHOD["{METHOD_NAMES[method][0]}"]{body}],CS[Cartesian,2]{axes(xy, f"LENGTHUNIT[{chr(34)}metre{chr(34)},{crs.unit!r}]")},LENGTHUNIT["metre",{crs.unit!r}]{identity}]'
    body = "".join(f',PARAMETER["{PARAMETER_NAMES[p][1]}",{v / crs.unit if p in ("x_0", "y_0") else v!r}]' for p, v in given)
    return f'PROJCS["{crs.name}",GEOGCS["{crs.datum}",{datum},PRIMEM["Greenwich",0],UNIT[{degree}]],PROJECTION["{METHOD_NAMES[method][1]}"]{body},UNIT["metre",{crs.unit!r}]{axes(xy, "")}{identity}]'


def to_projjson(crs: Crs) -> dict[str, Any]:
    """PROJJSON of a CRS, with its datum, method and parameters."""
    a, rf = ELLIPSOIDS[crs.ellipsoid]
    datum = {"type": "GeodeticReferenceFrame", "name": DATUM_NAMES.get(crs.datum, crs.datum), "ellipsoid": {"name": ELLIPSOID_NAMES.get(crs.ellipsoid, "unknown"), "semi_major_axis": a} | ({"inverse_flattening": rf} if rf else {"radius": a})}
    order = lambda x: x if crs.first_axis == "E" else x[::-1]
    axis = lambda names, unit: [{"name": n, "abbreviation": s, "direction": d, "unit": unit} for n, s, d in order(names)]
    lonlat = {"subtype": "ellipsoidal", "axis": axis([("Longitude", "lon", "east"), ("Latitude", "lat", "north")], "degree")}
    out: dict[str, Any] = {"$schema": "https://proj.org/schemas/v0.7/projjson.schema.json", "type": "GeographicCRS" if crs.geographic else "ProjectedCRS", "name": crs.name}
    if crs.geographic:
        out |= {"datum": datum, "coordinate_system": lonlat}
    else:
        method, *values = crs.projection
        named = [{"name": PARAMETER_NAMES[p][0], "value": v, "unit": "metre" if p in ("x_0", "y_0") else "unity" if p == "k_0" else "degree"} for p, v in zip(PARAMETERS.get(method, ()), values, strict=False)]
        base = {"type": "GeographicCRS", "name": crs.datum, "datum": datum, "coordinate_system": {"subtype": "ellipsoidal", "axis": [{"name": "Latitude", "abbreviation": "lat", "direction": "north", "unit": "degree"}, {"name": "Longitude", "abbreviation": "lon", "direction": "east", "unit": "degree"}]}}
        out |= {"base_crs": base, "conversion": {"name": "unnamed", "method": {"name": METHOD_NAMES.get(method, (method,))[0]}, "parameters": named}, "coordinate_system": {"subtype": "Cartesian", "axis": axis([("Easting", "E", "east"), ("Northing", "N", "north")], "metre")}}
    if crs.code > 0:
        out["id"] = {"authority": "EPSG", "code": crs.code}
    elif crs.code == -84:
        out["id"] = {"authority": "OGC", "code": "CRS84"}
    return out


def from_projjson(data: dict[str, Any]) -> Crs | Compound:
    if data.get("type") == "CompoundCRS":
        a, b = data["components"]
        return Compound(from_projjson(a), int(b.get("id", {}).get("code", 0)))
    own = data.get("id", {})
    if own.get("authority") == "OGC" and own.get("code") == "CRS84":
        return CRS84
    if own.get("authority") == "EPSG" and (crs := crs_of(int(own["code"]))):
        return crs
    base = data.get("base_crs", data)
    frame = base.get("datum") or base.get("datum_ensemble") or {}
    shape = frame.get("ellipsoid", {})
    ellipsoid = ellipsoid_of(shape["semi_major_axis"], shape.get("inverse_flattening", 0.0)) if "semi_major_axis" in shape else "WGS84"
    datum = next((k for k, v in DATUM_NAMES.items() if name_key(frame.get("name", "")).startswith(name_key(v))), f"on {ellipsoid}")
    axes = data.get("coordinate_system", {}).get("axis", [{}])
    first = "N" if axes[0].get("direction") in ("north", "south") else "E"
    if data.get("type") in ("GeographicCRS", "GeodeticCRS"):
        return Crs(0, data.get("name", "unknown"), first, True, ellipsoid, WORLD, datum)
    method = data["conversion"]["method"]["name"]
    key = next((k for k, names in METHOD_NAMES.items() if name_key(method) == name_key(names[0])), None)
    if key is None:
        raise ProjectionError(f"method {method}")
    back = {name_key(v[0]): k for k, v in PARAMETER_NAMES.items()}
    found = {ALSO.get(p["name"].lower()) or back.get(name_key(p["name"])): p["value"] for p in data["conversion"].get("parameters", [])}
    return Crs(0, data.get("name", "unknown"), first, False, ellipsoid, WORLD, datum, (key, *[found.get(p, 1.0 if p == "k_0" else 0.0) for p in PARAMETERS[key]]))


def classified(text: str) -> str:
    """What kind of text a user gave: epsg, proj, wkt, projjson, srs or name."""
    s = text.strip()
    if s.startswith("{"):
        return "projjson"
    if re.match(r"(GEOGCRS|GEOGCS|GEODCRS|PROJCRS|PROJCS|COMPOUNDCRS|COMPD_CS|BOUNDCRS)\s*[\[(]", s, re.I):
        return "wkt"
    if s.startswith("+") or re.search(r"(^|\s)\+?(proj|init)=", s):
        return "proj"
    if re.fullmatch(r"(epsg:)?\d+", s, re.I):
        return "epsg"
    return "srs" if parse_srs(s).code is not None else "name"


def from_user_input(given: Any) -> Crs | Compound:
    """Codes, srsNames, PROJ strings, WKT, PROJJSON and names."""
    if isinstance(given, Crs | Compound):
        return given
    if isinstance(given, int):
        return known(given)
    if isinstance(given, dict):
        return from_projjson(given)
    kind = classified(given)
    if kind == "projjson":
        return from_projjson(json.loads(given))
    if kind == "wkt":
        return from_wkt(given)
    if kind == "proj":
        return from_proj(given)
    name = parse_srs(given if kind != "epsg" else f"EPSG:{given.split(':')[-1].strip()}")
    if name.code is not None:
        crs = known(name.code)
        return Compound(crs, name.vertical) if name.vertical else crs
    if (crs := by_name(given)) is None:
        raise ProjectionError(f"CRS {given!r}")
    return crs


def essence(crs: Crs) -> tuple:
    """What positions depend on; parameters to a billionth."""
    a, rf = ELLIPSOIDS[crs.ellipsoid]
    method, *values = crs.projection or ("",)
    return (round(a, 4), round(rf, 6), crs.datum, crs.geographic, method, *(round(float(v), 9) for v in values), round(crs.unit, 12))


def equivalent(a: Crs | Compound, b: Crs | Compound, axis_order: bool = True) -> bool:
    """Whether positions mean the same, whatever the names; the order of axes counts unless told not to."""
    if isinstance(a, Compound) or isinstance(b, Compound):
        return isinstance(a, Compound) and isinstance(b, Compound) and a.vertical == b.vertical and equivalent(a.horizontal, b.horizontal, axis_order)
    return essence(a) == essence(b) and (not axis_order or a.first_axis == b.first_axis)


def identify(crs: Crs) -> list[int]:
    """EPSG codes that mean the same, those with the same order of axes first."""
    if crs.code > 0:
        return [crs.code]
    utm = [crs_of(base + z) for base in (32600, 32700, 25800, 26900) for z in range(1, 61)]
    hits = [c for c in [*KNOWN.values(), *filter(None, utm)] if c.dimension == crs.dimension and equivalent(c, crs, False)]
    return [c.code for c in sorted(hits, key=lambda c: (c.first_axis != crs.first_axis, c.code))]


def registered(crs: Crs, code: int) -> Crs:
    """Make a CRS known under a code of the user's."""
    if crs.projection and crs.projection[0] not in METHODS:
        raise ProjectionError(f"method {crs.projection[0]}")
    own = replace(crs, code=code)
    add_user_crs(own)
    return own
