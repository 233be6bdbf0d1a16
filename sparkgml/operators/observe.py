"""What the features hold: statistics of every path, counted in tasks and merged by Spark's own aggregates."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from xml.etree.ElementTree import Element

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crs import dialect_of
from ..functions.gml_geometry import UNSUPPORTED, XLINK, Node, Scope, first_position, geometry, is_geometry, srs_of
from ..functions.geometry import GeometryError, has_curves, positions
from ..functions.lexical import ALL, DOUBLE, INTEGER, STRING, classify, digits_of, scale_of, zone_of
from ..sources.split import SplitError, SplitOptions, attribute_name, parse_element, parse_trees, split_and, tree_of

MAX_DEPTH, MAX_CHILDREN, DISTINCT = 16, 512, 64
COUNTS = ("instances", "parents", "empty", "single_child", "by_reference", "href_and_content", "nil", "n_values", "n_zone", "n_elements", "n_geometry")
FIELDS = [("layer_ns", pa.string()), ("layer", pa.string()), ("path", pa.string()), ("source", pa.string()), ("start", pa.int64()), ("place", pa.int32()), *((c, pa.int64()) for c in COUNTS), ("max_occurs", pa.int64()), ("exact", pa.int32()), ("lossy", pa.int32()), ("int_min", pa.string()), ("int_max", pa.string()), ("max_len", pa.int64()), ("max_scale", pa.int64()), ("max_digits", pa.int64()), ("zone_min", pa.int32()), ("zone_max", pa.int32()), ("values", pa.list_(pa.string())), ("mixed", pa.bool_()), ("truncated", pa.bool_()), ("kinds", pa.list_(pa.string())), ("curves", pa.bool_()), ("srs", pa.list_(pa.string())), ("dims", pa.list_(pa.int32())), ("wrappers", pa.list_(pa.string()))]
def ddl(fields: list[tuple]) -> str:
    kinds = {"int64": "bigint", "int32": "int", "bool": "boolean", "string": "string", "double": "double"}
    return ", ".join(f"{n} {kinds.get(str(t)) or ('array<int>' if 'int32' in str(t) else 'array<string>')}" for n, t in fields)


AXIS_FIELDS = [("source", pa.string()), ("srs_name", pa.string()), ("dialect", pa.string()), ("layer_ns", pa.string()), ("layer", pa.string()), ("path", pa.string()), ("a_min", pa.float64()), ("a_max", pa.float64()), ("b_min", pa.float64()), ("b_max", pa.float64()), ("n", pa.int64()), ("labels", pa.string()), *((f"e_{c}", pa.float64()) for c in ("a_min", "b_min", "a_max", "b_max"))]


class Stats:
    """Of one path within a task."""

    __slots__ = ("at", "counts", "max_occurs", "exact", "lossy", "ints", "max_len", "scale", "zones", "values", "pending", "digits", "mixed", "truncated", "kinds", "curves", "srs", "dims", "wrappers")

    def __init__(self, at: tuple):
        self.at = at
        self.counts = dict.fromkeys(COUNTS, 0)
        self.max_occurs, self.exact, self.lossy, self.max_len, self.scale = 0, ALL, ALL, 0, 0
        self.ints: list[int] = []
        self.zones: list[int] = []
        self.values: set[str] | None = set()
        self.pending: list[str] = []
        self.digits = 0
        self.mixed = self.truncated = self.curves = False
        self.kinds: set[str] = set()
        self.srs: set[str] = set()
        self.dims: set[int] = set()
        self.wrappers: set[str] = set()

    def settle(self) -> None:
        """Counts the values that have come in, each different one once."""
        if not self.pending:
            return
        counted, self.pending = Counter(self.pending), []
        self.counts["n_values"] += counted.total()
        texts = list(counted)
        if self.values is not None:
            self.values.update(texts[: DISTINCT + 1])
            if len(self.values) > DISTINCT:
                self.values = None
        self.max_len = max(self.max_len, *map(len, texts))
        if len(texts) > 16 and (kind := alike(texts)) is not None:
            self.exact &= kind
            self.lossy &= kind
            if kind & INTEGER:
                ints = pc.min_max(pa.array(texts).cast(pa.int64()))
                self.ints = [min([*self.ints, ints["min"].as_py()]), max([*self.ints, ints["max"].as_py()])]
            elif kind & DOUBLE:
                self.scale = max(self.scale, *[len(t) - t.index(".") - 1 for t in texts])
            if kind & DOUBLE:
                self.digits = max(self.digits, *map(digits_of, texts))
            return
        for text, n in counted.items():
            exact, lossy = classify(text)
            self.exact &= exact
            self.lossy &= lossy
            self.scale = max(self.scale, scale_of(text))
            self.digits = max(self.digits, digits_of(text))
            if lossy & INTEGER:
                self.ints = [min([*self.ints, int(text)]), max([*self.ints, int(text)])]
            zone = zone_of(text)
            if zone is not None:
                self.counts["n_zone"] += n
                self.zones = [min([*self.zones, zone]), max([*self.zones, zone])]


#: Texts of one look whose type sets follow from it: integers (but 0 and 1) and decimals of 15 digits at most, words.
LOOKS = ((r"^-?(?:[2-9]|[1-9][0-9]{1,14})$", STRING | INTEGER | DOUBLE), (r"^-?(?:0|[1-9][0-9]{0,7})\.[0-9]{1,6}$", STRING | DOUBLE), (r"^[^-+.0-9tTfF]", STRING))


def alike(texts: list[str]) -> int | None:
    """The type set of all texts, if they have one look."""
    column = pa.array(texts, pa.string())
    for pattern, kind in LOOKS:
        if pc.all(pc.match_substring_regex(column, pattern)).as_py():
            return kind
    return None


@lru_cache(maxsize=100_000)
def named(tag: str) -> tuple[str, bool]:
    """Local name of an element, and whether it is a geometry."""
    ns, _, name = tag.rpartition("}")
    return name, is_geometry(Node(ns[1:], name, {}, "", 0, None))


@lru_cache(maxsize=100_000)
def observed_attribute(key: str) -> str | None:
    """Name of an attribute that counts."""
    name = attribute_name(key)
    return None if name.startswith(("xsi:", "xml:")) else name.split(":")[-1].rpartition("}")[2]


def plain_shape(e: Element, inherited: int | None) -> tuple[str, int, tuple[float, float]] | None:
    """Kind, dimension and first position of points, lines and polygons of the usual form, by counting their values; None for all else."""
    kind = named(e.tag)[0]
    if kind == "Point":
        carriers, least = list(e), 1
    elif kind == "LineString":
        carriers, least = list(e), 2
    elif kind == "Polygon":
        rings = [r for b in e for r in b]
        if not rings or any(named(b.tag)[0] not in ("exterior", "interior") or len(b) != 1 for b in e) or named(e[0].tag)[0] != "exterior" or any(named(r.tag)[0] != "LinearRing" or len(r) != 1 for r in rings):
            return None
        carriers, least = [r[0] for r in rings], 4
    else:
        return None
    if not carriers or kind != "Polygon" and len(carriers) != 1:
        return None
    dims, first = set(), None
    for c in carriers:
        name = named(c.tag)[0]
        if name != ("pos" if kind == "Point" else "posList") or "count" in c.attrib or len(c):
            return None
        values = (c.text or "").split()
        own = c.get("srsDimension") or c.get("dimension") or e.get("srsDimension")
        dim = int(own) if own and own.isdigit() else inherited or (len(values) if kind == "Point" else 2)
        if dim not in (2, 3) or len(values) % dim or len(values) < least * dim or kind == "Point" and len(values) != dim:
            return None
        dims.add(dim)
        if first is None:
            try:
                first = float(values[0]), float(values[1])
            except ValueError:
                return None
    return (kind, dims.pop(), first) if len(dims) == 1 else None


XSI_NIL, XLINK_HREF = "{http://www.w3.org/2001/XMLSchema-instance}nil", f"{{{XLINK}}}href"


#: Different shapes of features that a task remembers, and marks of one shape, at most; features beyond are walked.
SHAPES, MARKS = 1000, 1024


class Unshaped(Exception):
    """A feature with something that a shape doesn't tell."""


def attribute_marks(node: Element, marks: list, values: list[str]) -> bool:
    """Adds an element's attributes to a shape; whether it is nil."""
    nil = False
    for key, value in node.attrib.items():
        if observed_attribute(key) is None:
            if key == XSI_NIL:
                nil = value in ("true", "1")
                marks.append(nil)
            continue
        marks.append(key)
        if value := value.strip():
            values.append(value)
        else:
            marks.append(None)
    return nil


def shape_marks(node: Element, marks: list, values: list[str]) -> None:
    """The shape of what is inside an element: all that counts but the values, which are given in order."""
    for c in node:
        tag = c.tag
        marks.append(tag)
        name, is_geom = named(tag)
        if is_geom or name == "boundedBy":
            raise Unshaped
        nil = attribute_marks(c, marks, values) if c.attrib else False
        text = (c.text or "").strip()
        if len(c):
            marks.append(1 if text else 2)
            shape_marks(c, marks, values)
            marks.append(3)
        elif not text:
            marks.append(4)
        elif nil:
            marks.append(5)
        else:
            marks.append(6)
            values.append(text)


def value_paths(node: Element, path: str, paths: list[str]) -> None:
    """The path of each value of shape_marks(), in the same order; the root's attributes have path ''."""
    nil = node.attrib.get(XSI_NIL) in ("true", "1")
    for key, value in node.attrib.items():
        if (name := observed_attribute(key)) is not None and value.strip():
            paths.append(f"{path}/@{name}" if path else f"@{name}")
    if not len(node) and path and not nil and (node.text or "").strip():
        paths.append(path)
    for c in node:
        name = named(c.tag)[0]
        value_paths(c, f"{path}/{name}" if path else name, paths)


class Shape:
    """Features of one shape: what each adds to the counts, and their values since the last settling."""

    __slots__ = ("added", "targets", "rows")

    def __init__(self, added: list[tuple[dict[str, int], list[tuple[str, int]]]], targets: list[Stats]):
        self.added, self.targets = added, targets
        self.rows: list[list[str]] = []

    def settle(self) -> None:
        if n := len(self.rows):
            for counts, more in self.added:
                for name, k in more:
                    counts[name] += n * k
            for s, column in zip(self.targets, zip(*self.rows, strict=True)):
                s.pending.extend(column)
            self.rows = []


class Observer:
    """Gathers the statistics of features' paths: walks the first feature of each shape, and takes but the values of others."""

    def __init__(self):
        self.paths: dict[tuple, Stats] = {}
        self.axis: dict[tuple, list] = {}
        self.shapes: dict[tuple, Shape] = {}
        self.unshaped = 0

    def feature(self, source: str, start: int, ns: str, layer: str, node: Element, bounded: dict | None = None, axis_only: bool = False) -> None:
        if not axis_only and self.unshaped < SHAPES:
            marks: list = [ns, layer]
            values: list[str] = []
            try:
                attribute_marks(node, marks, values)
                shape_marks(node, marks, values)
            except (Unshaped, RecursionError):
                marks = []
            key = tuple(marks)
            shape = self.shapes.get(key)
            if shape is None and 0 < len(key) <= MARKS and len(self.shapes) < SHAPES:
                shape = self.shapes[key] = self.shape(source, start, ns, layer, node)
            if shape is not None:
                shape.rows.append(values)
                return
            self.unshaped += 1
        self.walk(source, start, ns, layer, node, bounded, axis_only)

    def shape(self, source: str, start: int, ns: str, layer: str, node: Element) -> Shape:
        """A shape from its first feature, whose places stay those of its paths."""
        one, paths = Observer(), []
        one.walk(source, start, ns, layer, node)
        added = []
        for key, s in one.paths.items():
            mine = self.paths.get(key)
            if mine is None:
                mine = self.paths[key] = Stats(s.at)
            mine.max_occurs = max(mine.max_occurs, s.max_occurs)
            mine.mixed |= s.mixed
            mine.truncated |= s.truncated
            if len(mine.wrappers) < 8:
                mine.wrappers |= s.wrappers
            added.append((mine.counts, [(k, n) for k, n in s.counts.items() if n]))
        value_paths(node, "", paths)
        # paths that the walk cuts off take no values
        return Shape(added, [self.paths[ns, layer, p] if (ns, layer, p) in one.paths else Stats(()) for p in paths])

    def walk(self, source: str, start: int, ns: str, layer: str, node: Element, bounded: dict | None = None, axis_only: bool = False) -> None:
        self.key, self.at, self.place, self.bounded = (ns, layer), (source or "", start or 0), 0, bounded or {}
        if axis_only:
            self.sniff(node)
            return
        root = self.stats("")
        root.counts["instances"] += 1
        self.attributes(node, "")
        self.children(node, "", 0)

    def settle(self) -> None:
        for shape in self.shapes.values():
            shape.settle()
        for s in self.paths.values():
            s.settle()

    def stats(self, path: str) -> Stats:
        self.place += 1
        key = (*self.key, path)
        s = self.paths.get(key)
        if s is None:
            s = self.paths[key] = Stats((*self.at, self.place))
        return s

    def attributes(self, node: Element, path: str) -> None:
        for key, value in node.attrib.items():
            name = observed_attribute(key)
            if name is None:
                continue
            s = self.stats(f"{path}/@{name}" if path else f"@{name}")
            s.counts["instances"] += 1
            if value := value.strip():
                s.pending.append(value)

    def children(self, node: Element, path: str, depth: int) -> None:
        if not len(node):
            return
        seen: dict[str, int] = {}
        names = [named(c.tag) for c in node]
        for name, _ in names:
            seen[name] = seen.get(name, 0) + 1
        if len(seen) > MAX_CHILDREN or depth >= MAX_DEPTH:
            self.stats(path).truncated = True
            return
        for c, (name, is_geom) in zip(node, names, strict=True):
            self.element(c, name, is_geom, f"{path}/{name}" if path else name, depth + 1)
        for name, n in seen.items():
            s = self.paths[(*self.key, f"{path}/{name}" if path else name)]
            s.counts["parents"] += 1
            s.max_occurs = max(s.max_occurs, n)

    def element(self, node: Element, name: str, is_geom: bool, path: str, depth: int) -> None:
        s = self.stats(path)
        counts = s.counts
        counts["instances"] += 1
        nil, href = False, False
        if node.attrib:
            nil = node.attrib.get(XSI_NIL) in ("true", "1")
            href = XLINK_HREF in node.attrib
            counts["nil"] += nil
            self.attributes(node, path)
        text = (node.text or "").strip()
        if n := len(node):
            names = [named(c.tag) for c in node]
            if any(g for _, g in names) or is_geom and name == "Envelope":
                for c, (_, g) in zip(node, names, strict=True):
                    if g:
                        self.geometry(s, c, path)
                return
            counts["n_elements"] += 1
            if text:
                s.mixed = True
            elif n == 1:
                counts["single_child"] += 1
            if len(s.wrappers) < 8:
                s.wrappers.update(k for k, _ in names)
            if name == "boundedBy":
                return
            self.children(node, path, depth)
        elif text and not nil:
            s.pending.append(text)
        content = bool(text or n)
        counts["href_and_content"] += href and content
        counts["by_reference"] += href and not content
        counts["empty"] += not href and not content

    def geometry(self, s: Stats, element: Element, path: str) -> None:
        s.counts["n_geometry"] += 1
        srs = element.get("srsName") or self.bounded.get("srs")
        if srs and (shape := plain_shape(element, self.bounded.get("dimension"))) is not None:
            kind, dim, first = shape
            s.kinds.add(kind)
            s.dims.add(dim)
            s.srs.add(srs.strip())
            for key, own in element.attrib.items():
                if key.endswith("}id"):
                    self.identifier(path, own)
            self.evidence(srs.strip(), "gml3", first, path, element.get("axisLabels"))
            return
        try:
            node = tree_of(element)
        except SplitError:
            s.kinds.add("Invalid")
            return
        if own := node.attr("gml:id"):
            self.identifier(path, own)
        srs = srs_of(node, self.bounded.get("srs"))
        if srs:
            s.srs.add(srs)
        try:
            g = geometry(node, Scope(srs, self.bounded.get("dimension")))
        except (GeometryError, ValueError):
            s.kinds.add("Unsupported" if node.name in UNSUPPORTED else "Invalid")
            return
        s.kinds.add(g[0])
        s.dims.add(g[1])
        s.curves |= has_curves(g)
        if (first := next(positions(g), None)) and srs:
            self.evidence(srs, dialect_of(node), first, path, node.attr("axisLabels"))

    def identifier(self, path: str, own: str) -> None:
        ids = self.stats(f"{path}/*/@id")
        ids.counts["instances"] += 1
        ids.pending.append(own)

    def evidence(self, srs: str, dialect: str, first: tuple, path: str, labels: str | None) -> None:
        key = (self.at[0], srs, dialect, *self.key, path)
        box = self.axis.setdefault(key, [first[0], first[0], first[1], first[1], 0, labels, None])
        box[0], box[1], box[2], box[3] = min(box[0], first[0]), max(box[1], first[0]), min(box[2], first[1]), max(box[3], first[1])
        box[4] += 1
        if own := self.bounded.get("box"):
            box[6] = own if box[6] is None else (*map(min, own[:2], box[6][:2]), *map(max, own[2:], box[6][2:]))

    def sniff(self, node: Element, path: str = "", depth: int = 0) -> None:
        """Axis evidence alone: where geometries start, and under which name."""
        for c in node:
            name, is_geom = named(c.tag)
            if is_geom:
                srs = c.get("srsName") or self.bounded.get("srs")
                if srs and (shape := plain_shape(c, self.bounded.get("dimension"))) is not None:
                    self.evidence(srs.strip(), "gml3", shape[2], path, c.get("axisLabels"))
                    continue
                try:
                    g = tree_of(c)
                    srs, first = srs_of(g, self.bounded.get("srs")), first_position(g)
                except (SplitError, GeometryError, ValueError, IndexError):
                    continue
                if first and srs:
                    self.evidence(srs, dialect_of(g), first, path, g.attr("axisLabels"))
            elif depth < MAX_DEPTH and len(c):
                self.sniff(c, f"{path}/{name}" if path else name, depth + 1)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        out = []
        for (ns, layer, path), s in self.paths.items():
            out.append((ns, layer, path, *s.at, *s.counts.values(), s.max_occurs, s.exact, s.lossy, str(s.ints[0]) if s.ints else None, str(s.ints[1]) if s.ints else None, s.max_len, s.scale, s.digits, min(s.zones, default=None), max(s.zones, default=None), None if s.values is None else sorted(s.values), s.mixed, s.truncated, sorted(s.kinds), s.curves, sorted(s.srs), sorted(s.dims), sorted(s.wrappers)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), FIELDS, strict=True)], [n for n, _ in FIELDS])

    def axis_rows(self) -> Iterator[pa.RecordBatch]:
        out = [(*key, *v[:4], v[4], v[5], *(v[6] or (None,) * 4)) for key, v in self.axis.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), AXIS_FIELDS, strict=True)], [n for n, _ in AXIS_FIELDS])


def bounded_info(bounded: str | None) -> dict:
    """srsName and dimension that a collection's boundedBy hands down."""
    if not bounded:
        return {}
    data = json.loads(bounded)
    node = parse_element(data["xml"].encode(), data["ns"])
    env = next((c for c in node.children if is_geometry(c)), None)
    if env is None:
        return {}
    dim = env.attr("srsDimension")
    try:
        numbers = [float(x) for x in re.split(r"[\s,]+", env.all_text.strip())]
        half = len(numbers) // 2
        box = (*map(min, numbers[:2], numbers[half : half + 2]), *map(max, numbers[:2], numbers[half : half + 2])) if half >= 2 else None
    except ValueError:
        box = None
    return {"srs": env.attr("srsName").strip() if env.attr("srsName") else None, "dimension": int(dim) if dim else None, "box": box}


def observing(batches: Iterator[pa.RecordBatch], skip_bad: bool = False, axis_only: bool = False) -> Iterator[pa.RecordBatch]:
    """Statistics, axis evidence and headers of a task, told apart by `what`."""
    o, bounds, scopes, headers = Observer(), {}, {}, []
    for b in batches:
        kinds = b.column(0).to_pylist()
        headers += [(k, s, i) for k, s, i in zip(kinds, b.column(1).to_pylist(), b.column(8).to_pylist(), strict=True) if k != "feature"]
        b = b.filter(pc.equal(b.column(0), "feature"))
        columns = [b.column(i).to_pylist() for i in range(1, 8)]
        for source, start, ns, layer, _, bounded, _, node in zip(*columns, parse_trees(columns[6], columns[4], scopes), strict=True):
            if isinstance(node, SplitError):
                if skip_bad:
                    continue
                raise node
            if bounded not in bounds:
                bounds = {bounded: bounded_info(bounded)}
            o.feature(source, start, ns, layer, node, bounds[bounded], axis_only)
        o.settle()
    for what, part in (("path", o.rows()), ("axis", o.axis_rows()), ("header", header_rows(headers))):
        for found in part:
            n = found.num_rows
            given = dict(zip(found.schema.names, found.columns, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([what] * n), *(given.get(f, pa.nulls(n, t)) for f, t in ALL_FIELDS)], ["what", *(f for f, _ in ALL_FIELDS)])


def header_rows(headers: list[tuple]) -> Iterator[pa.RecordBatch]:
    if headers:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*headers, strict=True)], ["kind", "source", "info"])


ALL_FIELDS = FIELDS + [f for f in AXIS_FIELDS if f[0] not in {n for n, _ in FIELDS}] + [("kind", pa.string()), ("info", pa.string())]
INPUT = ("source", "start", "layer_ns", "layer", "ns", "bounded", "xml")


def observations(features: DataFrame, skip_bad: bool = False, axis_only: bool = False) -> DataFrame:
    """One pass over features: a few rows for each task, which observe(), axis_evidence() and headers() merge. axis_only looks at first positions alone."""
    return features.select("kind", *INPUT, "info").mapInArrow(lambda batches: observing(batches, skip_bad, axis_only), ddl([("what", pa.string()), *ALL_FIELDS]))


def observations_of(docs: DataFrame, options: SplitOptions, skip_bad: bool = False, axis_only: bool = False) -> DataFrame:
    """observations() of documents (name, content), split in the same tasks."""
    return docs.mapInArrow(split_and(options, ["kind", *INPUT, "info"], lambda batches: observing(batches, skip_bad, axis_only)), ddl([("what", pa.string()), *ALL_FIELDS]))


def observe(seen: DataFrame) -> DataFrame:
    """One row for each (layer, path) of observations()."""
    rows = seen.where("what = 'path'")
    merged = [F.sum(c).alias(c) for c in COUNTS]
    merged += [F.max(c).alias(c) for c in ("max_occurs", "max_len", "max_scale", "max_digits", "zone_max")] + [F.min("zone_min").alias("zone_min")]
    merged += [F.bit_and(c).alias(c) for c in ("exact", "lossy")] + [F.bool_or(c).alias(c) for c in ("mixed", "truncated", "curves")]
    merged += [F.min(F.col("int_min").cast("decimal(20,0)")).alias("int_min"), F.max(F.col("int_max").cast("decimal(20,0)")).alias("int_max")]
    merged += [F.min(F.struct("source", "start", "place")).alias("first_seen")]
    merged += [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("kinds", "srs", "dims", "wrappers")]
    # a task that met too many values has none: then nobody has
    merged += [F.when(F.bool_or(F.col("values").isNull()), None).otherwise(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("values")))), 1, DISTINCT + 1)).alias("values")]
    return rows.groupBy("layer_ns", "layer", "path").agg(*merged)


def axis_evidence(seen: DataFrame) -> DataFrame:
    """Ranges of first positions as written, for each source, srsName and dialect of observations()."""
    rows = seen.where("what = 'axis'").withColumn("srs", F.col("srs_name"))
    return rows.groupBy("source", "srs", "dialect").agg(F.min("a_min").alias("a_min"), F.max("a_max").alias("a_max"), F.min("b_min").alias("b_min"), F.max("b_max").alias("b_max"), F.sum("n").alias("n"), F.collect_set("labels").alias("labels"), F.min("e_a_min").alias("e_a_min"), F.min("e_b_min").alias("e_b_min"), F.max("e_a_max").alias("e_a_max"), F.max("e_b_max").alias("e_b_max"))


def srs_counts(seen: DataFrame) -> DataFrame:
    """How many geometries of each (layer, path) have which srsName."""
    return seen.where("what = 'axis'").groupBy("layer_ns", "layer", "path", "srs_name").agg(F.sum("n").alias("n"))


def headers(seen: DataFrame) -> DataFrame:
    """(kind, source, info) for each source of observations()."""
    return seen.where("what = 'header'").select("kind", "source", "info")
