"""Batches of features as columns: the usual shapes of a schema without a row reader for each feature."""

from __future__ import annotations

from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.compute as pc

from ..functions.lexical import Misfit, read_scalar
from ..plans.schema import Column
from ..sources.split import parse_scope, tree_of

NIL = "{http://www.w3.org/2001/XMLSchema-instance}nil"
#: Texts that Arrow reads as the type just as the lexical rules do; a batch with others is read value by value.
PLAIN = {
    "boolean": r"^(?:true|false|1|0)$", "bigint": r"^-?[0-9]{1,18}$", "int": r"^-?[0-9]{1,9}$", "smallint": r"^-?[0-9]{1,4}$", "tinyint": r"^-?[0-9]{1,2}$",
    "double": r"^-?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$", "float": r"^-?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$",
    "date": r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}(?:Z|[+-](?:0[0-9]|1[0-4]):[0-5][0-9])?$", "timestamp_ntz": r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,6})?$",
}
ARROW = {"boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "date": pa.date32(), "timestamp_ntz": pa.timestamp("us"), "timestamp": pa.timestamp("us", "UTC"), "time": pa.string()}


class Unusual(Exception):
    """A batch that the row reader has to look at."""


def typed(kind: str, texts: list[str | None]) -> pa.Array:
    """Trimmed texts as a type; Unusual if one doesn't fit."""
    out = pa.array(texts, pa.string())
    if kind == "string":
        return out
    if kind in PLAIN and pc.all(pc.match_substring_regex(out, PLAIN[kind]), skip_nulls=True).as_py() is not False:
        if kind == "date":
            out = pc.utf8_slice_codeunits(out, 0, 10)
        try:
            return out.cast(ARROW[kind])
        except pa.ArrowInvalid:
            raise Unusual from None
    try:
        values = [None if t is None else read_scalar(kind, t) for t in texts]
    except Misfit:
        raise Unusual from None
    return pa.array([None if v is None else str(v) for v in values] if kind == "time" else values, ARROW[kind])


class Step:
    """What an element at one place of the tree of paths means."""

    __slots__ = ("children", "known", "attributes", "scalars", "lists", "geometries", "anchored")

    def __init__(self):
        self.children: dict[str, Step] = {}
        self.known: dict[str, Step | None] = {}  # by the name that the parser gives, filled as they come
        self.attributes: list[tuple[str, int]] = []
        self.scalars: list[int] = []
        self.lists: list[int] = []  # columns whose value this element is, one for each anchor
        self.geometries: list[int] = []
        self.anchored: list[int] = []  # columns of the list whose anchor this is

    def of(self, tag: str) -> Step | None:
        try:
            return self.known[tag]
        except KeyError:
            step = self.known[tag] = self.children.get(tag.rpartition("}")[2])
            return step


def steps_of(columns: list[Column]) -> Step | None:
    """The tree of all columns' paths; None if a column needs the row reader."""
    root = Step()
    for i, c in enumerate(columns):
        if c.type in ("map", "binary") or c.content != "value" or not c.nullable or c.type == "geometry" and (c.is_list or c.geom_kind == "Box"):
            return None
        at, anchors = root, 0
        steps = c.steps()
        for step in steps:
            if step.startswith(("{", "@{")) or step == "*" or step == "boundedBy":
                return None
            if step.startswith("@"):
                at.attributes.append((step[1:], i))
                break
            at = at.children.setdefault(step.removesuffix("[]"), Step())
            if step.endswith("[]"):
                at.anchored.append(i)
                anchors += 1
        else:
            (at.geometries if c.type == "geometry" else at.lists if c.is_list else at.scalars).append(i)
        if anchors != int(c.is_list):
            return None
    return root


class ColumnReader:
    """Features of a batch into one Arrow array for each column. What it can't take raises Unusual, and nothing is lost."""

    def __init__(self, columns: list[Column], geometry, strip_hash: bool):
        self.columns, self.geometry, self.strip_hash = columns, geometry, strip_hash
        self.root = steps_of(columns)
        self.scopes: dict[str, bytes] = {}

    def read(self, sources: list[str], xmls: list[bytes], contexts: list[str], bounded: list[str | None]) -> list[pa.Array] | None:
        """Arrays in the order of the columns, or None if the batch needs the row reader."""
        if self.root is None:
            return None
        columns = self.columns
        self.values: list[list[Any]] = [[] for _ in columns]
        self.offsets: list[list[int] | None] = [[0] if c.is_list else None for c in columns]
        scalars = [i for i, c in enumerate(columns) if not c.is_list]
        lists = [i for i, c in enumerate(columns) if c.is_list]
        self.validity: dict[int, list[bool]] = {i: [] for i in lists}
        at, n = 0, 0
        try:
            while at < len(xmls):
                stop = at + 1
                while stop < len(xmls) and contexts[stop] == contexts[at]:
                    stop += 1
                tree = ElementTree.fromstring(b"".join([parse_scope(contexts[at], self.scopes), *xmls[at:stop], b"</_>"]))
                if len(tree) != stop - at:
                    return None
                for k, e in enumerate(tree, at):
                    n += 1
                    self.feature = (sources[k], bounded[k])
                    starts = {i: len(self.values[i]) for i in lists}
                    self.attributes(e, self.root, n)
                    self.inside(e, self.root, n)
                    for i in scalars:
                        if len(self.values[i]) < n:
                            self.values[i].append(None)
                    for i in lists:
                        self.offsets[i].append(len(self.values[i]))
                        self.validity[i].append(len(self.values[i]) > starts[i])
                at = stop
            return [self.array(i) for i in range(len(columns))]
        except (Unusual, ElementTree.ParseError):
            return None

    def array(self, i: int) -> pa.Array:
        c = self.columns[i]
        values = pa.array(self.values[i], pa.binary()) if c.type == "geometry" else typed(c.type, self.values[i])
        if not c.is_list:
            return values
        given = self.validity[i]
        return pa.ListArray.from_arrays(pa.array(self.offsets[i], pa.int32()), values, mask=pa.array([not x for x in given], pa.bool_()))

    def put(self, i: int, n: int, value: Any) -> None:
        values = self.values[i]
        if len(values) >= n:
            raise Unusual  # a second value
        values.append(value)

    def attributes(self, e: ElementTree.Element, step: Step, n: int) -> None:
        if not step.attributes or not e.attrib:
            return
        for name, i in step.attributes:
            value = e.attrib.get(name)
            if value is None:
                value = next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)
            if value is None:
                continue
            if name == "href" and self.strip_hash:
                value = value.removeprefix("#")
            if value := value.strip():
                self.list_value(i, value) if self.columns[i].is_list else self.put(i, n, value)

    def list_value(self, i: int, value: str) -> None:
        if self.values[i][-1] is not None:
            raise Unusual
        self.values[i][-1] = value

    def inside(self, e: ElementTree.Element, step: Step, n: int) -> None:
        known = step.known
        for c in e:
            tag = c.tag
            to = known[tag] if tag in known else step.of(tag)
            if to is None:
                if tag.endswith("}boundedBy"):
                    raise Unusual  # hands its CRS down
                continue
            for i in to.anchored:
                self.values[i].append(None)
            if to.attributes:
                self.attributes(c, to, n)
            if c.attrib and c.attrib.get(NIL) in ("true", "1"):
                continue
            if to.scalars or to.lists:
                text = (c.text or "").strip()
                if len(c) and any(self.columns[i].type == "string" for i in (*to.scalars, *to.lists)):
                    raise Unusual  # raw XML
                if text:
                    for i in to.scalars:
                        self.put(i, n, text)
                    for i in to.lists:
                        self.list_value(i, text)
            for i in to.geometries:
                if (value := self.geometry(i, tree_of(c), *self.feature)) is not None:
                    self.put(i, n, value)
            if to.children:
                self.inside(c, to, n)
