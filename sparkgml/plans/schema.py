"""Columns of a layer: paths, types and their aliases, Spark schemas, settings files."""

from __future__ import annotations

import fnmatch
import json
import re
from dataclasses import dataclass, field, replace
from functools import lru_cache
from typing import Any

from pyspark.sql import types as T

#: Names of types in settings, and the Spark type of each.
ALIASES = {
    "text": "string", "varchar": "string", "string": "string", "boolean": "boolean", "bool": "boolean", "smallint": "smallint", "int2": "smallint", "integer": "int", "int": "int", "int4": "int",
    "bigint": "bigint", "int8": "bigint", "real": "float", "float4": "float", "double": "double", "float8": "double", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "time": "time",
    "bytea": "binary", "blob": "binary", "map": "map", "geometry": "geometry",
}
PREFERRED = {"string": "text", "boolean": "boolean", "smallint": "smallint", "int": "integer", "bigint": "bigint", "float": "real", "double": "double", "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamptz", "time": "time", "binary": "bytea", "map": "map", "geometry": "geometry"}
SPARK = {"string": T.StringType(), "boolean": T.BooleanType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(), "timestamp": T.TimestampType(), "time": T.StringType(), "binary": T.BinaryType(), "geometry": T.BinaryType(), "map": T.MapType(T.StringType(), T.StringType())}
KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection", "Geometry", "Box")
LOCATION = T.StructType([T.StructField("source", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


class SchemaError(ValueError):
    """A path, type or schema that can't be read or bound."""


@dataclass
class Column:
    """One column: name, path, type of its values, whether it is a list, and what goes into the field's metadata."""

    name: str
    path: str
    type: str  # a key of SPARK
    is_list: bool = False
    geom_kind: str = "Geometry"
    geom_dim: int | None = None
    content: str = "value"  # value, raw, inner
    nullable: bool = True
    metadata: dict[str, Any] = field(default_factory=dict)
    reason: str = ""

    def steps(self) -> list[str]:
        return split_path(self.path)

    def field(self) -> T.StructField:
        base = box_type(self.geom_dim) if self.type == "geometry" and self.geom_kind == "Box" else SPARK[self.type]
        meta = dict(self.metadata)
        if self.path != self.name:
            meta["gml:path"] = self.path
        if self.content == "inner":
            meta["gml:content"] = "text"
        if self.type == "geometry":
            meta |= {"ARROW:extension:name": "geoarrow.wkb", "geom_kind": self.geom_kind} | ({"geom_dim": self.geom_dim} if self.geom_dim else {})
        if self.type == "time":
            meta["gml:type"] = "time"
        return T.StructField(self.name, T.ArrayType(base) if self.is_list else base, self.nullable, meta)


def box_type(dim: int | None) -> T.StructType:
    names = ["xmin", "ymin", "xmax", "ymax"] if dim != 3 else ["xmin", "ymin", "zmin", "xmax", "ymax", "zmax"]
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def split_path(path: str) -> list[str]:
    """Steps: child names, * for any one element, @name for an attribute, [] after the list's anchor; {uri}name may hold slashes."""
    steps, depth, part = [], 0, ""
    for c in path:
        depth += (c == "{") - (c == "}")
        if c == "/" and not depth:
            steps.append(part)
            part = ""
        else:
            part += c
    steps.append(part)
    if not all(steps) or any(s.startswith("@") for s in steps[:-1]) or sum(s.endswith("[]") for s in steps) > 1:
        raise SchemaError(f"path {path!r}")
    return steps


def parse_type(text: str) -> dict[str, Any]:
    """Type alias, `[]` for a list, geometry(Kind[,XY|XYZ])."""
    text = text.strip()
    is_list = text.endswith("[]")
    base = text[:-2].strip() if is_list else text
    if m := re.fullmatch(r"geometry\(\s*(\w+)\s*(?:,\s*(XYZ?)\s*)?\)", base, re.I):
        kind = next((k for k in KINDS if k.lower() == m[1].lower()), None)
        if kind is None:
            raise SchemaError(f"geometry kind {m[1]}")
        return {"type": "geometry", "is_list": is_list, "geom_kind": kind, "geom_dim": len(m[2]) if m[2] else None}
    if base.lower() in ("numeric", "decimal"):
        raise SchemaError(f"{base} isn't supported; use double or text")
    if base.lower() not in ALIASES:
        raise SchemaError(f"type {text!r}")
    return {"type": ALIASES[base.lower()], "is_list": is_list}


def type_string(c: Column) -> str:
    base = PREFERRED[c.type]
    if c.type == "geometry" and c.geom_kind != "Geometry":
        base = f"geometry({c.geom_kind}{',' + 'XYZ'[: c.geom_dim] if c.geom_dim else ''})"
    return base + "[]" * c.is_list


@dataclass
class LayerSchema:
    """A layer's name and columns."""

    layer: str
    columns: list[Column]
    namespace: str = ""
    versions: str = ""

    def struct(self) -> T.StructType:
        fields = [c.field() for c in self.columns]
        if fields and (self.namespace or self.versions):
            fields[0].metadata |= {"gml:layer_ns": self.namespace, "gml:versions": self.versions}
        return T.StructType(fields)

    def select(self, names: list[str]) -> LayerSchema:
        by = {c.name: c for c in self.columns}
        return LayerSchema(self.layer, [by[n] for n in names], self.namespace, self.versions)

    def explain(self) -> str:
        """One line for each column: name, type, path and why."""
        return "\n".join(f"{c.name}: {type_string(c)} <- {c.path}" + (f" ({c.reason})" if c.reason else "") for c in self.columns)

    @classmethod
    def given(cls, layer: str, columns: dict[str, str | dict[str, str]]) -> LayerSchema:
        """From {name: type or {type, path}}; a name is its own path if none is given."""
        out = []
        for name, spec in columns.items():
            spec = {"type": spec} if isinstance(spec, str) else spec
            parsed = parse_type(spec["type"])
            path = spec.get("path", name)
            if parsed["is_list"] and "[]" not in path:
                first, *rest = split_path(path)
                path = "/".join([first + "[]", *rest]) if not first.startswith("@") else path
            out.append(Column(name, path, content=spec.get("content", "value"), nullable=spec.get("nullable", True), **parsed))
        return cls(layer, out)

    @classmethod
    def of_struct(cls, layer: str, schema: T.StructType) -> LayerSchema:
        """From a Spark schema; gml:path in the metadata of a field names its path."""
        back = {str(v): k for k, v in SPARK.items() if k not in ("time", "geometry")}
        out = []
        for f in schema.fields:
            kind, is_list = f.dataType, isinstance(f.dataType, T.ArrayType)
            if is_list:
                kind = kind.elementType
            meta = dict(f.metadata or {})
            if isinstance(kind, T.StructType):
                if [x.name for x in kind.fields][:2] != ["xmin", "ymin"] or is_list:
                    raise SchemaError(f"{f.name}: structs aren't supported")
                parsed = {"type": "geometry", "geom_kind": "Box", "geom_dim": len(kind.fields) // 2}
            elif isinstance(kind, T.ArrayType):
                raise SchemaError(f"{f.name}: lists of lists aren't supported")
            else:
                name = "geometry" if "geom_kind" in meta else "time" if meta.get("gml:type") == "time" else back.get(str(kind))
                if name is None:
                    raise SchemaError(f"{f.name}: type {kind}")
                parsed = {"type": name, "geom_kind": meta.get("geom_kind", "Geometry"), "geom_dim": meta.get("geom_dim")}
            path = meta.get("gml:path", f.name)
            if is_list and "[]" not in path:
                first, *rest = split_path(path)
                path = "/".join([first + "[]", *rest])
            out.append(Column(f.name, path, is_list=is_list, nullable=f.nullable, content="inner" if meta.get("gml:content") == "text" else "value", **parsed))
        return cls(layer, out)


#: Metadata that only holds for the data it was inferred from.
LOCAL_METADATA = ("gml:max_scale", "gml:significant_digits", "gml:versions", "gml:tz_offset")


def portable(schema: T.StructType) -> T.StructType:
    """A schema whose metadata is the same for all files of a layer, so that schemas of several files merge."""
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {k: v for k, v in (f.metadata or {}).items() if k not in LOCAL_METADATA}) for f in schema.fields])


def merged(schemas: list[LayerSchema]) -> LayerSchema:
    """One layer of several files: all columns in order of appearance, of a type that holds both; lists stay lists."""
    wider = ["tinyint", "smallint", "int", "bigint", "double"]
    columns: dict[str, Column] = {}
    for c in (c for s in schemas for c in s.columns):
        old = columns.setdefault(c.path.replace("[]", ""), c)
        if (old.type, old.is_list, old.geom_kind, old.geom_dim) == (c.type, c.is_list, c.geom_kind, c.geom_dim):
            continue
        kind = old.type if old.type == c.type else max(old.type, c.type, key=wider.index) if old.type in wider and c.type in wider else "string"
        longer = old if old.is_list or not c.is_list else c
        same = old.geom_kind == c.geom_kind
        columns[c.path.replace("[]", "")] = replace(longer, name=old.name, type=kind, is_list=old.is_list or c.is_list, geom_kind=old.geom_kind if same else "Geometry", geom_dim=old.geom_dim if same and old.geom_dim == c.geom_dim else None, nullable=old.nullable or c.nullable)
    return LayerSchema(schemas[0].layer, list(columns.values()), schemas[0].namespace, ",".join(sorted({v for s in schemas for v in s.versions.split(",") if v})))


#: Prefixes that namespaces usually have.
WELL_KNOWN = {"http://www.opengis.net/gml": "gml", "http://www.opengis.net/gml/3.2": "gml", "http://www.opengis.net/wfs": "wfs", "http://www.opengis.net/wfs/2.0": "wfs", "http://www.w3.org/1999/xlink": "xlink", "http://www.w3.org/2001/XMLSchema-instance": "xsi"}


def prefixes_for(namespaces: list[str], declared: dict[str, str] | None = None) -> dict[str, str]:
    """A prefix for each namespace: the one that a document declares first, a well-known one, or ns1, ns2 ..."""
    out: dict[str, str] = {}
    own = {uri: p for p, uri in reversed(list((declared or {}).items())) if p}
    for ns in namespaces:
        taken = set(out.values())
        name = next((p for p in (own.get(ns), WELL_KNOWN.get(ns)) if p and p not in taken), None)
        out[ns] = name or next(f"ns{i}" for i in range(1, len(namespaces) + len(taken) + 2) if f"ns{i}" not in taken)
    return out


def settings_json(schemas: list[LayerSchema], options: dict[str, Any] | None = None, namespaces: dict[str, str] | None = None) -> str:
    """A settings file: what read() needs to read the same layers the same way."""
    layers = {s.layer: {c.name: type_string(c) if c.path == c.name and c.content == "value" else {"type": type_string(c), "path": c.path} | ({"content": c.content} if c.content != "value" else {}) for c in s.columns} for s in schemas}
    return json.dumps({"format_version": 1, "options": options or {}, "namespaces": namespaces or {}, "layers": layers}, indent=2, ensure_ascii=False)


def load_settings(text: str) -> tuple[dict[str, LayerSchema], dict[str, Any]]:
    data = json.loads(text)
    if data.get("format_version") != 1:
        raise SchemaError(f"settings of format version {data.get('format_version')}")
    return {k: LayerSchema.given(k, v) for k, v in data.get("layers", {}).items()}, data.get("options", {})


@lru_cache(maxsize=4096)
def _pattern(pattern: str) -> tuple[str, ...]:
    return tuple(pattern.split("/"))


def pattern_matches(pattern: str, layer: str, path: str) -> bool:
    """Globs within a step, ** for any number of steps; the first step is the layer."""
    steps = (layer, *[s.removesuffix("[]") for s in split_path(path)])

    def match(p: tuple[str, ...], s: tuple[str, ...]) -> bool:
        if not p:
            return not s
        if p[0] == "**":
            return any(match(p[1:], s[i:]) for i in range(len(s) + 1))
        return bool(s) and fnmatch.fnmatchcase(s[0], p[0]) and match(p[1:], s[1:])

    return match(_pattern(pattern), steps)


def specificity(pattern: str) -> int:
    """Literal steps weigh most, then partial globs, *, and ** nothing."""
    return sum(0 if s == "**" else 2 if s == "*" else 5 if re.search(r"[*?]", s) else 10 + 2 * s.startswith("{") for s in _pattern(pattern))


def column_names(steps: list[list[str]]) -> list[str]:
    """The shortest unique ends of paths; #2, #3 … where whole paths are equal."""
    use = [1] * len(steps)
    names = [""] * len(steps)
    while True:
        names = ["/".join(s[-n:]) for s, n in zip(steps, use, strict=True)]
        clash = {n for n in names if names.count(n) > 1}
        grown = False
        for i, n in enumerate(names):
            if n in clash and use[i] < len(steps[i]):
                use[i] += 1
                grown = True
        if not grown:
            break
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}#{seen[n]}")
    return out
