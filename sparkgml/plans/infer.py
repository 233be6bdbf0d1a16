"""Schemas from what was observed: flat, lossless, deterministic."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field, replace
from typing import Any

from ..functions.crs import parse_srs, projjson
from ..functions.lexical import BOOL, DATE_, DOUBLE, INTEGER, STRING, TIME_, TIMESTAMP
from .schema import Column, LayerSchema, column_names, parse_type, pattern_matches, specificity


@dataclass
class InferenceOptions:
    """Choices of inference; `preset` "strings" makes every value text."""

    preset: str = "default"
    lossless: bool = True
    integers: str = "bigint"  # or "smallest"
    lists: bool = True
    constants_to_metadata: bool = True
    collapse_wrappers: bool = True
    mixed: str = "raw"  # raw, text, drop
    gml_id: bool = True
    xlink: str = "href"  # href, full, drop
    nil_reason: bool = True
    bounded_by: str = "drop"  # drop, box, geometry
    attributes: bool = True
    overrides: dict[str, str] = field(default_factory=dict)  # pattern -> type, drop, raw, map, list, scalar
    sampled: bool = False
    min_typed_values: int = 100
    geometry_ids: bool = False  # identifiers of geometry elements as columns
    hint: dict[str, str] = field(default_factory=dict)  # direct properties and their declared types, see wfs.hint_of()
    per_layer: list[tuple[str, dict[str, Any]]] = field(default_factory=list)  # (glob of layers, other options), later ones win

    def for_layer(self, layer: str) -> InferenceOptions:
        out = self
        for glob, changes in self.per_layer:
            if fnmatch.fnmatchcase(layer.rpartition("}")[2], glob):
                out = replace(out, **changes)
        return out


class Node:
    """One path's merged statistics and what lies below it."""

    def __init__(self, name: str, stats: dict[str, Any]):
        self.name, self.s = name, stats
        self.children: list[Node] = []
        self.attributes: list[Node] = []


def tree(rows: list[dict[str, Any]]) -> Node:
    """Rows of one layer as a tree, in first-seen order."""
    root = Node("", next((r for r in rows if r["path"] == ""), {}))
    nodes = {"": root}
    for r in sorted((r for r in rows if r["path"]), key=lambda r: (r["path"].count("/"), tuple(r["first_seen"]))):
        parent, _, name = r["path"].rpartition("/")
        if parent not in nodes:
            continue
        nodes[r["path"]] = node = Node(name, r)
        (nodes[parent].attributes if name.startswith("@") else nodes[parent].children).append(node)
    return root


def tz_shape(s: dict[str, Any]) -> str:
    """What times say of their zones: absent, fixed (one for all), mixed, or inconsistent (some have none)."""
    if not s["n_zone"]:
        return "absent"
    if s["n_zone"] < s["n_values"]:
        return "inconsistent"
    return "fixed" if s["zone_min"] == s["zone_max"] else "mixed"


class Inference:
    def __init__(self, layer: str, rows: list[dict[str, Any]], options: InferenceOptions):
        self.layer, self.options = layer, options.for_layer(layer)
        self.root, self.by_path = tree(rows), {r["path"]: r for r in rows}
        self.columns: list[tuple[list[str], list[str], Column]] = []  # path steps, naming steps, column

    def action(self, path: str) -> str | None:
        hits = sorted((p for p in self.options.overrides if pattern_matches(p, self.layer, path)), key=specificity)
        return self.options.overrides[hits[-1]] if hits else None

    def scalar(self, s: dict[str, Any]) -> tuple[str, dict[str, Any], str]:
        """Type, metadata and reason of a path's values."""
        o = self.options
        if o.preset == "strings" or not s["n_values"]:
            return "string", {}, "no values" if not s["n_values"] else "preset"
        if o.sampled and s["n_values"] < o.min_typed_values:
            return "string", {}, f"only {s['n_values']} sampled values"
        types = s["exact"] if o.lossless else s["lossy"]
        meta: dict[str, Any] = {}
        if types & BOOL:
            return "boolean", meta, "all true or false"
        if types & INTEGER:
            kind = "bigint"
            if o.integers == "smallest" and not o.sampled and s["int_min"] is not None:
                low, high = int(s["int_min"]), int(s["int_max"])
                kind = next(k for k, b in (("smallint", 15), ("int", 31), ("bigint", 63)) if -(1 << b) <= low and high < 1 << b)
            return kind, meta, "all integers"
        if types & DOUBLE:
            return "double", ({"gml:max_scale": int(s["max_scale"]), "gml:significant_digits": int(s["max_digits"])} if s["max_scale"] else meta), "all numbers"
        zones, shape = s["n_zone"], tz_shape(s)
        fixed = shape == "fixed"
        if shape == "inconsistent":
            return "string", meta, "some values have a time zone, some don't"
        if zones and fixed:
            minutes = s["zone_min"]
            meta["gml:tz_offset"] = f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"
        if types & DATE_:
            return ("date", meta, "all dates") if not zones or fixed else ("string", {}, "dates of several time zones")
        if types & TIMESTAMP:
            return "timestamp" if zones else "timestamp_ntz", meta, "all date-times"
        if types & TIME_:
            return ("time", meta, "all times") if not zones or fixed else ("string", {}, "times of several time zones")
        return "string", {}, "text" if types == STRING else "several types"

    def add(self, steps: list[str], naming: list[str], **of: Any) -> None:
        path = "/".join(steps)
        act = self.action(path)
        if act == "drop":
            return
        if act == "scalar":
            path = path.replace("[]", "")
        if act and act not in ("raw", "map", "list", "scalar"):
            of |= parse_type(act) | {"metadata": {}, "reason": "override"}
        c = Column("", path, **(of | {"is_list": of.get("is_list", False) or "[]" in path}))
        self.columns.append((steps, naming, c))

    def keep_attribute(self, a: Node, path: str) -> bool:
        o, name = self.options, a.name[1:]
        if name in ("nilReason", "srsName", "srsDimension", "axisLabels", "uomLabels"):
            return name == "nilReason" and o.nil_reason
        if name == "id":
            return o.gml_id
        if name == "href":
            return o.xlink != "drop"
        if name in ("title", "role", "arcrole", "type", "show", "actuate"):
            return o.xlink == "full" or name == "type" and o.attributes
        return o.attributes

    def run(self) -> list[Column]:
        for a in self.root.attributes:
            if self.keep_attribute(a, a.name):
                kind, meta, why = self.scalar(a.s)
                name = "@id" if a.name == "@fid" else a.name
                self.add([a.name], [name], type=kind, metadata=meta, reason=why)
        for c in self.root.children:
            self.element(c, [], [])
        seen = {c.name for c in self.root.children}
        for name, declared in self.options.hint.items():
            if name not in seen:  # declared, but no feature has it
                self.add([name], [name], reason="declared", **parse_type(declared))
        names = column_names([n for _, n, _ in self.columns])
        for name, (_, _, c) in zip(names, self.columns, strict=True):
            c.name = name
        return [c for _, _, c in self.columns]

    def element(self, node: Node, above: list[str], naming: list[str]) -> None:
        s, o = node.s, self.options
        act = self.action("/".join([*above, node.name]))
        if act == "drop":
            return
        anchored = (s["max_occurs"] > 1 and o.lists or act == "list") and act != "scalar"
        if anchored:  # the innermost repeated element is the anchor
            above = [x.removesuffix("[]") for x in above]
        steps = [*above, node.name + "[]" * anchored]
        named = [*naming, node.name]
        if node.name == "boundedBy":
            if o.bounded_by != "drop":
                self.add(steps, named, type="geometry", geom_kind="Box" if o.bounded_by == "box" else "Polygon", geom_dim=2, reason="envelope")
            return
        if s["n_geometry"]:
            self.geometry(node, steps, named)
            return
        if act == "raw" or node.name == "metaDataProperty" or s["mixed"] and o.mixed == "raw":
            self.add(steps, named, type="string", content="raw", reason="raw XML")
            return
        if act == "map" or s["truncated"]:
            self.add(steps, named, type="map", reason="map of a subtree")
            return
        if s["mixed"] and o.mixed == "text":
            self.add(steps, named, type="string", content="inner", reason="text without markup")
            return
        data = [a for a in node.attributes if self.keep_attribute(a, "") and a.name not in ("@nilReason", "@href")]
        wrapper = o.collapse_wrappers and node.children and not data and s["single_child"] == s["n_elements"] and all(c.name[:1].isupper() for c in node.children) and not s["mixed"]
        meta: dict[str, Any] = {}
        rest = []
        for a in node.attributes:
            if not self.keep_attribute(a, ""):
                continue
            values = a.s["values"]
            constant = o.constants_to_metadata and values is not None and len(values) == 1 and a.s["instances"] == s["instances"] and a.name not in ("@href", "@id", "@fid", "@nilReason") and not node.children
            if constant:
                meta[f"gml:attr:{a.name[1:]}"] = values[0]
            else:
                rest.append(a)
        if not node.children:
            if s["n_values"]:
                kind, more, why = self.scalar(s)
                self.add(steps, named, type=kind, metadata=meta | more, reason=why)
            elif not rest and not above and node.name in o.hint and not anchored:
                self.add(steps, named, metadata=meta, reason="declared", **parse_type(o.hint[node.name]))
            elif not rest:
                self.add(steps, named, type="string", metadata=meta, reason="no values")
        for a in rest:
            kind, more, why = self.scalar(a.s)
            # an element that only refers is named by itself
            alone = a.name == "@href" and not node.children and not s["n_values"]
            self.add([*steps, a.name], named if alone else [*named, a.name], type=kind, metadata=more, reason="reference" if alone else why)
        if wrapper:
            merged = [c for w in node.children for c in w.children]
            done: set[str] = set()
            for w in node.children:
                for a in w.attributes:
                    if self.keep_attribute(a, "") and a.name not in done:
                        done.add(a.name)
                        kind, more, why = self.scalar(a.s)
                        self.add([*steps, "*", a.name], [*named, a.name], type=kind, metadata=more, reason=why)
                if not w.children and w.s["n_values"]:
                    kind, more, why = self.scalar(w.s)
                    self.add([*steps, "*"], named, type=kind, metadata=more, reason=why)
            for c in merged:
                if c.name not in done:
                    done.add(c.name)
                    self.element(c, [*steps, "*"], named)
        else:
            for c in node.children:
                self.element(c, steps, named)

    def geometry(self, node: Node, steps: list[str], named: list[str]) -> None:
        s = node.s
        kinds = [k for k in s["kinds"] if k not in ("Unsupported", "Invalid")]
        families = {k.removeprefix("Multi") for k in kinds}
        kind = "Geometry"
        if len(families) == 1 and not s["curves"] and not self.options.sampled and len(kinds) == len(s["kinds"]):
            family = families.pop()
            kind = kinds[0] if len(kinds) == 1 else f"Multi{family}"
            kind = kind if kind != "GeometryCollection" else "Geometry"
        meta: dict[str, Any] = {}
        if s["srs"]:
            meta["gml:srs_name"] = s["srs"][0]
            meta["crs"] = projjson(s["srs"][0]) or parse_srs(s["srs"][0]).authority_code() or s["srs"][0]
        dims = list(s["dims"])
        self.add(steps, named, type="geometry", geom_kind=kind, geom_dim=(3 if 3 in dims else 2) if dims and kind != "Geometry" else None, metadata=meta, reason=f"geometries: {', '.join(s['kinds'])}")
        own = self.by_path.get("/".join(x.removesuffix("[]") for x in steps) + "/*/@id")
        if own and self.options.geometry_ids:
            kind, more, why = self.scalar(own)
            self.add([*steps, "*", "@id"], [*named, "@id"], type=kind, metadata=more, reason=why)


def infer(rows: list[dict[str, Any]], options: InferenceOptions | None = None) -> dict[str, LayerSchema]:
    """A schema for each layer of merged statistics (rows of observe())."""
    layers: dict[tuple[str, str], list] = {}
    for r in rows:
        layers.setdefault((r["layer_ns"], r["layer"]), []).append(r)
    local = [name for _, name in layers]
    out = {}
    for (ns, name), part in sorted(layers.items(), key=lambda x: min(tuple(r["first_seen"]) for r in x[1])):
        key = name if local.count(name) == 1 else f"{{{ns}}}{name}"
        out[key] = LayerSchema(key, Inference(key, part, options or InferenceOptions()).run(), ns)
    return out
