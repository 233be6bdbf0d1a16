"""Features as rows of a layer's schema."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.crs import Context, decide, dialect_of
from ..functions.geometry import Geometry, GeometryError, bbox, fit_kind, mapped, with_dimension, write_wkb
from ..functions.gml_geometry import Node, Scope, envelope, geometry, is_geometry, srs_of, box_polygon
from ..functions.lexical import Misfit, read_scalar
from ..functions.project import Transform
from ..plans.schema import LOCATION, Column, LayerSchema
from ..sources.split import SplitError, SplitOptions, inner_xml, layer_matches, parse_batch, split_and
from .columns import ColumnReader, Unusual
from .observe import INPUT, bounded_info

REPORT = StructType([StructField("source", StringType()), StructField("start", LongType()), StructField("kind", StringType()), StructField("message", StringType())])


class GeometryMisfit(Misfit):
    """A geometry that can't be read or doesn't fit its column."""


@dataclass
class ReadPlan:
    """All that parsing needs, made once on the driver and sent to every task."""

    schema: LayerSchema
    on_error: str = "error"  # error, skip, null_geometry
    location: bool = False
    linear: bool = False
    target_crs: int | None = None
    empty_as_null: bool = True
    strip_hash: bool = True
    axis_mode: str = "auto"
    axis_overrides: dict[str, str] = field(default_factory=dict)
    swaps: dict[tuple[str, str, str], bool] = field(default_factory=dict)  # (source, srsName, dialect)
    contexts: dict[str, Context] = field(default_factory=dict)


class Route:
    """A step of the tree of all columns' paths."""

    def __init__(self):
        self.children: dict[str, Route] = {}
        self.attributes: dict[str, list[int]] = {}
        self.targets: list[int] = []
        self.anchor: int | None = None


def routes(columns: list[Column]) -> tuple[Route, list[int | None]]:
    """The tree, and for each column the number of its anchor."""
    root, anchors, count = Route(), [], 0
    for i, c in enumerate(columns):
        at, anchor = root, None
        for step in c.steps():
            if step.startswith("@"):
                at.attributes.setdefault(step[1:], []).append(i)
                break
            at = at.children.setdefault(step.removesuffix("[]"), Route())
            if step.endswith("[]"):
                if at.anchor is None:
                    at.anchor, count = count, count + 1
                anchor = at.anchor
        else:
            at.targets.append(i)
        anchors.append(anchor)
    return root, anchors


class RowReader:
    def __init__(self, plan: ReadPlan):
        self.plan, self.columns = plan, plan.schema.columns
        self.root, self.anchors = routes(self.columns)
        self.transforms: dict[int, Transform] = {}
        self.bounded_text, self.bounded_known = None, {}

    def read(self, source: str, node: Node, xml: bytes, bounded: dict) -> tuple[list[Any], list[str], Misfit | None]:
        """(row, warnings, first error)."""
        self.source, self.xml, self.bounded = source, xml, bounded
        self.counts: dict[int, int] = {}
        self.row: list[Any] = [None] * len(self.columns)
        self.filled = [0] * len(self.columns)
        self.warnings: list[str] = []
        self.error: Misfit | None = None
        self.geometry_failed = False
        own = next((c for c in node.children if c.name == "boundedBy"), None)
        if own is not None and (env := next((c for c in own.children if is_geometry(c)), None)) is not None:
            self.bounded = {"srs": env.attr("srsName") or bounded.get("srs"), "dimension": int(env.attr("srsDimension")) if env.attr("srsDimension") else bounded.get("dimension")}
        self.attributes(node, [self.root])
        self.inside(node, [self.root])
        for i, c in enumerate(self.columns):
            n = self.counts.get(self.anchors[i], 0) if self.anchors[i] is not None else 0
            if c.is_list and n:
                self.row[i] = (self.row[i] or []) + [None] * (n - len(self.row[i] or []))
            if self.row[i] is None and not c.nullable:
                self.fail(Misfit(f"{c.name}: no value"))
        return self.row, self.warnings, self.error

    def fail(self, e: Misfit) -> None:
        if isinstance(e, GeometryMisfit) and self.plan.on_error == "null_geometry":
            self.warnings.append(str(e))
            return
        self.error = self.error or e

    def put(self, i: int, value: Any) -> None:
        c = self.columns[i]
        if not c.is_list:
            if self.filled[i]:
                self.fail(Misfit(f"{c.name}: a second value"))
                return
            self.filled[i], self.row[i] = 1, value
            return
        at = self.counts.get(self.anchors[i], 1) if self.anchors[i] is not None else len(self.row[i] or []) + 1
        values = self.row[i] = self.row[i] or []
        if len(values) >= at:
            self.fail(Misfit(f"{c.name}: a second value in one element"))
            return
        values += [None] * (at - 1 - len(values))
        values.append(value)

    def text(self, i: int, text: str) -> None:
        c, text = self.columns[i], text.strip()
        if not text and (self.plan.empty_as_null or c.type != "string"):
            return
        try:
            self.put(i, read_scalar(c.type, text) if c.type != "time" else str(read_scalar("time", text)))
        except Misfit:
            self.fail(Misfit(f"{c.name}: {text[:60]!r} isn't {c.type}"))

    def attributes(self, node: Node, at: list[Route]) -> None:
        for r in at:
            for name, targets in r.attributes.items():
                value = next((v for k, v in node.attrs.items() if k == name or k.split(":")[-1].split("}")[-1] == name), None)
                if value is None:
                    continue
                if name == "href" and self.plan.strip_hash:
                    value = value.removeprefix("#")
                for i in targets:
                    self.text(i, value)

    def inside(self, node: Node, at: list[Route]) -> None:
        for c in node.children:
            under = [n for r in at for n in (r.children.get(c.name) or r.children.get(f"{{{c.ns}}}{c.name}"), r.children.get("*")) if n]
            if under:
                self.element(c, under)

    def element(self, node: Node, at: list[Route]) -> None:
        for r in {id(r): r for r in at}.values():
            if r.anchor is not None:
                self.counts[r.anchor] = self.counts.get(r.anchor, 0) + 1
        self.attributes(node, at)
        if node.attr("xsi:nil") in ("true", "1"):
            return
        for r in at:
            for i in r.targets:
                self.target(i, node)
        self.inside(node, at)

    def target(self, i: int, node: Node) -> None:
        c = self.columns[i]
        if c.type in ("geometry", "binary"):
            self.geometry(i, node)
        elif c.type == "map":
            values: dict[str, str] = {}
            if node.text.strip():
                values["#text"] = node.text.strip()
            subtree(node, "", values)
            self.put(i, values)
        elif c.content == "raw" or c.type == "string" and node.children and c.content != "inner":
            raw = inner_xml(self.xml, node)
            if raw or not self.plan.empty_as_null:
                self.put(i, raw)
        elif c.content == "inner":
            self.text(i, " ".join(node.all_text.split()))
        else:
            self.text(i, node.text)

    def swap(self, srs: str | None, node: Node) -> bool:
        if srs is None:
            return self.plan.axis_mode == "yx"
        key = (self.source, srs, dialect_of(node))
        if key not in self.plan.swaps:  # not seen when axes were decided
            d = decide(srs, key[2], None, self.plan.contexts.get(self.source, Context()), self.plan.axis_mode, self.plan.axis_overrides)
            self.plan.swaps[key] = d.swap
        return self.plan.swaps[key]

    def wkb_of(self, i: int, node: Node, source: str, bounded: str | None) -> bytes | None:
        """A geometry property's value; Unusual where anything is to be reported."""
        if bounded != self.bounded_text:
            self.bounded_text, self.bounded_known = bounded, bounded_info(bounded)
        self.source, self.bounded, self.warnings, self.error = source, self.bounded_known, [], None
        self.counts, self.row, self.filled = {}, [None] * len(self.columns), [0] * len(self.columns)
        if node.attr("xsi:nil") not in ("true", "1"):
            self.geometry(i, node)
        if self.error or self.warnings:
            raise Unusual
        return self.row[i]

    def geometry(self, i: int, node: Node) -> None:
        c = self.columns[i]
        inner = [n for n in node.children if is_geometry(n)]
        array = node.name.endswith(("ArrayProperty", "Members"))
        if not inner:
            return
        if len(inner) > 1 and not array:
            self.fail(Misfit(f"{c.name}: a second geometry"))
            return
        try:
            parts = [self.one(n, c) for n in inner]
            if not array or len(parts) == 1:
                g = parts[0]
            else:
                kinds = {p[0] for p in parts}
                g = (f"Multi{kinds.pop()}" if len(kinds) == 1 else "GeometryCollection", parts[0][1], parts)
            if c.geom_kind == "Box":
                box = bbox(g)
                self.put(i, None if box is None else box[:4])
                return
            if c.type == "geometry":
                g = fit_kind(g, c.geom_kind)
                if c.geom_dim:
                    g = with_dimension(g, c.geom_dim)
            self.put(i, write_wkb(g))
        except (GeometryError, ValueError) as e:
            self.fail(GeometryMisfit(f"{c.name}: {e}"))

    def one(self, node: Node, c: Column) -> Geometry:
        from ..functions.crs import crs_of, parse_srs

        srs = srs_of(node, self.bounded.get("srs"))
        code = parse_srs(srs).code if srs else None
        own = c.metadata.get("gml:srs_name")
        if own and srs and own != srs and not self.plan.target_crs and (parse_srs(own).authority_code() or own.strip().lower()) != (parse_srs(srs).authority_code() or srs.strip().lower()):
            raise GeometryError(f"srsName {srs!r} is another CRS than the column's {own!r}")
        known = crs_of(code) if code else None
        scope = Scope(srs, self.bounded.get("dimension"), None, bool(known and known.geographic), self.plan.linear, self.swap(srs, node), self.warnings)
        if node.name in ("Envelope", "Box"):
            g = box_polygon(envelope(node, scope))
            if scope.swap:
                g = mapped(g, lambda ps: [(p[1], p[0]) for p in ps])
        else:
            g = geometry(node, scope)
        if self.plan.target_crs and code and code != self.plan.target_crs:
            from ..functions.geometry import has_curves

            if has_curves(g):
                raise GeometryError("arcs can't be converted; ask for linear geometries")
            g = converted(g, self.transforms.setdefault(code, Transform(code, self.plan.target_crs)))
        return g


def converted(g: Geometry, t: Transform) -> Geometry:
    """Every position converted; ordinates stay easting first."""

    def f(ps: list) -> list:
        if not ps:
            return ps
        columns = list(zip(*ps, strict=True))
        out = t.convert(*columns)
        return list(zip(*(v.tolist() for v in out), strict=True))

    return mapped(g, f)


def converted_all(geometries: list[Geometry | None], t: Transform) -> list[Geometry | None]:
    """converted() of many geometries: all their positions at once."""
    lists: dict[int, list[list]] = {2: [], 3: []}

    def gather(ps: list) -> list:
        if ps:
            lists[len(ps[0])].append(ps)
        return ps

    for g in geometries:
        if g is not None:
            mapped(g, gather)
    done: dict[int, Iterator] = {}
    for dim, some in lists.items():
        flat = [p for ps in some for p in ps]
        columns = t.convert(*zip(*flat, strict=True)) if flat else ()
        done[dim] = iter(list(zip(*(v.tolist() for v in columns), strict=True)))

    def give(ps: list) -> list:
        return [next(done[len(p)]) for p in ps]

    return [None if g is None else mapped(g, give) for g in geometries]


def subtree(node: Node, path: str, values: dict[str, str]) -> None:
    for c in node.children:
        here = f"{path}/{c.name}" if path else c.name
        for k, v in c.attrs.items():
            if not k.startswith("xsi:"):
                values[f"{here}/@{k.split(':')[-1]}"] = v
        if c.text.strip():
            values[here] = c.text.strip()
        subtree(c, here, values)


def walk(plan: ReadPlan, batches: Iterator[pa.RecordBatch], reader: RowReader | None = None) -> Iterator[tuple]:
    """(source, start, end, row, warnings, error) of each feature of the layer."""
    reader, bounds, scopes = reader or RowReader(plan), {}, {}
    layer = plan.schema.layer
    for b in batches:
        columns = [x.to_pylist() for x in b.columns]
        for source, start, ns, name, context, bounded, xml, end, node in zip(*columns, parse_batch(columns[6], columns[4], scopes), strict=True):
            if not layer_matches(layer, ns, name, scopes[context]):
                continue
            if isinstance(node, SplitError):
                yield source, start, end, [None] * len(plan.schema.columns), [], Misfit(str(node))
                continue
            if bounded not in bounds:
                bounds = {bounded: bounded_info(bounded)}
            row, warnings, error = reader.read(source, node, xml, bounds[bounded])
            yield source, start, end, row, warnings, error


def output_type(plan: ReadPlan) -> StructType:
    out = StructType(list(plan.schema.struct().fields))
    return out.add(StructField("_location", LOCATION)) if plan.location else out


def rows_of(plan: ReadPlan, size: int = 4096):
    arrow = to_arrow_schema(output_type(plan))

    def batch(rows: list) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array([tuple_struct(v, f.type) for v in x] if pa.types.is_struct(f.type) else list(x), f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    def by_row(reader: RowReader, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for source, start, end, row, _, error in walk(plan, iter([part]), reader):
            if error is not None:
                if plan.on_error == "skip":
                    continue
                raise ValueError(f"{source} at byte {start}: {error}")
            out.append([*row, (source, start, end)] if plan.location else row)
            if len(out) == size:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def work(batches: Iterator[pa.RecordBatch]):
        reader = RowReader(plan)
        fast = ColumnReader(plan.schema.columns, reader.wkb_of, plan.strip_hash)
        wanted: dict[tuple, bool] = {}
        for b in batches:
            names = list(zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True))
            for key in set(names):
                if key not in wanted:
                    wanted[key] = layer_matches(plan.schema.layer, key[0], key[1], json.loads(key[2]))
            if not all(wanted[k] for k in names):
                b = b.filter(pa.array([wanted[k] for k in names]))
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                columns = fast.read(*(part.column(i).to_pylist() for i in (0, 6, 4, 5))) if plan.empty_as_null else None
                if columns is None:
                    yield from by_row(reader, part)
                    continue
                if plan.location:
                    columns.append(pa.StructArray.from_arrays([part.column(i).cast(t.type) for i, t in zip((0, 1, 7), arrow.field(len(columns)).type, strict=True)], fields=list(arrow.field(len(columns)).type)))
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    return work


def tuple_struct(value: tuple | None, kind: pa.StructType) -> dict | None:
    return None if value is None else dict(zip([kind.field(i).name for i in range(kind.num_fields)], value, strict=True))


def reports_of(plan: ReadPlan):
    def work(batches: Iterator[pa.RecordBatch]):
        out = []
        for source, start, _, _, warnings, error in walk(plan, batches):
            out += [(source, start, "warning", w) for w in warnings]
            if error is not None:
                out.append((source, start, "geometry" if isinstance(error, GeometryMisfit) else "value", str(error)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["source", "start", "kind", "message"])

    return work


def parse_layer(features: DataFrame, plan: ReadPlan) -> DataFrame:
    """Rows of the plan's layer; columns that the plan lacks are never built."""
    local = plan.schema.layer.rpartition("}")[2].rpartition(":")[2]
    wanted = features.where(F.col("kind") == "feature").where(F.col("layer") == local).select(*INPUT, "end")
    return wanted.mapInArrow(rows_of(plan), output_type(plan))


def parse_documents(docs: DataFrame, options: SplitOptions, plan: ReadPlan) -> DataFrame:
    """parse_layer() of documents (name, content), split in the same tasks."""
    return docs.mapInArrow(split_and(options, [*INPUT, "end"], rows_of(plan), features_only=True), output_type(plan))


def parse_report(features: DataFrame, plan: ReadPlan) -> DataFrame:
    """What parsing the same features warns of or fails on: source, start, kind, message."""
    local = plan.schema.layer.rpartition("}")[2].rpartition(":")[2]
    wanted = features.where(F.col("kind") == "feature").where(F.col("layer") == local).select(*INPUT, "end")
    return wanted.mapInArrow(reports_of(plan), REPORT)
