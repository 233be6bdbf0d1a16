"""Documents cut at feature boundaries: one row for each feature, with what it inherits."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import quoteattr, unescape as unescape_basic

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gml_geometry import GML, GML32, XLINK, Node

WFS2 = "http://www.opengis.net/wfs/2.0"
WFS1 = "http://www.opengis.net/wfs"
#: kind: feature, header (one for each source), skipped (a source without features).
SCHEMA = "kind string, source string, seq bigint, start bigint, end bigint, layer_ns string, layer string, ns string, bounded string, xml binary, info string"
ARROW = pa.schema([("kind", pa.string()), ("source", pa.string()), ("seq", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("layer_ns", pa.string()), ("layer", pa.string()), ("ns", pa.string()), ("bounded", pa.string()), ("xml", pa.binary()), ("info", pa.string())])
TAG = re.compile(rb"<([^\s/><=\"']*+)(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>")
#: Elements within each other in a feature, at most.
MAX_DEPTH = 128
#: Bytes of XML in an Arrow batch of features.
BATCH_BYTES = 4 << 20


class SplitError(ValueError):
    """A document that isn't well formed, or that has a DTD."""


@dataclass
class SplitOptions:
    """member_rules: (namespace or None for the root's, local name, many features in one element)."""

    member_rules: list[tuple[str | None, str, bool]] = field(default_factory=lambda: [
        (GML, "featureMember", False), (GML32, "featureMember", False), (WFS2, "member", False), (None, "featureMember", False),
        (GML, "featureMembers", True), (GML32, "featureMembers", True),
    ])
    layers: list[str] | None = None
    allow_single_feature_root: bool = True
    skip_malformed: bool = False  # a source that can't be split is skipped, with the reason, instead of an error


def layer_matches(selector: str, ns: str, name: str, prefixes: dict[str, str]) -> bool:
    """{uri}local, prefix:local or local."""
    if selector.startswith("{"):
        return selector == f"{{{ns}}}{name}"
    prefix, colon, local = selector.rpartition(":")
    return name == local and (not colon or prefixes.get(prefix) == ns)


XMLNS = re.compile(rb"\sxmlns(?::([^\s=]+))?\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
ATTRIBUTE = re.compile(rb"\s([^\s=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
#: How markup that isn't a tag starts and ends.
OTHER_MARKUP = ((b"<!--", b"-->"), (b"<![CDATA[", b"]]>"), (b"<?", b"?>"))
SPACE = b" \t\r\n"


def unescape(text: str) -> str:
    """References to characters, and the five named ones."""
    text = re.sub(r"&#(?:x([0-9A-Fa-f]+)|([0-9]+));", lambda m: chr(int(m[1], 16) if m[1] else int(m[2])), text)
    return unescape_basic(text, {"&quot;": '"', "&apos;": "'"})


def unescaped(value: bytes) -> str:
    text = value.decode("utf-8")
    return unescape(text) if "&" in text else text


@dataclass
class Open:
    """An element that is open outside features."""

    raw: bytes
    role: str  # collection, member, members
    scope: dict[str, str]
    bounded: str | None = None


class Splitter:
    """Walks the markup around features; a feature is found by its end tag and handed on as a byte range, unparsed.

    Only what stands outside features has to be well formed here; a feature
    that isn't shows when it is parsed.
    """

    def __init__(self, data: bytes, options: SplitOptions):
        self.data, self.options = data, options
        self.open: list[Open] = []
        self.outside: dict[str, str] = {}
        self.root: tuple[str, str] | None = None
        self.header: dict = {}
        self.referenced = self.seq = 0
        self.members_seen = False
        self.contexts: dict[int, str] = {}
        self.wanted: dict[tuple, bool] = {}
        self.names: dict[tuple, tuple] = {}
        self.scopes: dict[tuple, dict[str, str]] = {}

    def role(self, ns: str, name: str) -> str | None:
        for want, local, many in self.options.member_rules:
            if name == local and (ns == want or want is None and self.root and ns == self.root[0]):
                return "members" if many else "member"
        return None

    def find(self, what: bytes, at: int) -> int:
        found = self.data.find(what, at)
        if found < 0:
            raise SplitError(f"not well formed: no {what.decode()} after byte {at}")
        return found

    def after_other(self, at: int) -> int:
        """The end of a comment, CDATA section or processing instruction at a byte."""
        for start, end in OTHER_MARKUP:
            if self.data.startswith(start, at):
                return self.find(end, at + len(start)) + len(end)
        if self.data.startswith(b"<!DOCTYPE", at):
            raise SplitError("a DTD is not supported")
        raise SplitError(f"not well formed: markup at byte {at}")

    def tag(self, at: int) -> tuple[bytes, int]:
        """Raw name and end of the start tag at a byte."""
        m = TAG.match(self.data, at)
        if not m or not m[1]:
            raise SplitError(f"not well formed: no tag at byte {at}")
        return m[1], m.end()

    def scope_of(self, at: int, end: int, above: dict[str, str]) -> dict[str, str]:
        if self.data.find(b"xmlns", at, end) < 0:
            return above
        key = (id(above), *XMLNS.findall(self.data, at, end))
        if key not in self.scopes:  # features that declare the same share one scope
            self.scopes[key] = above | {p.decode("utf-8"): unescaped(a or b) for p, a, b in key[1:]}
        return self.scopes[key]

    def resolve(self, raw: bytes, scope: dict[str, str]) -> tuple[str, str, str | None]:
        """Namespace, local name, and the member rule that names it; found once for each scope."""
        known = self.names.get((raw, id(scope)))
        if known is None:
            prefix, _, local = raw.decode("utf-8").rpartition(":")
            if prefix and prefix not in scope:
                raise SplitError(f"not well formed: unbound prefix {prefix}")
            ns = scope.get(prefix, "")
            known = self.names[raw, id(scope)] = (ns, local, self.role(ns, local))
        return known

    def attributes(self, at: int, end: int, scope: dict[str, str]) -> dict[tuple[str, str], str]:
        """By namespace and local name, without declarations."""
        out = {}
        for m in ATTRIBUTE.finditer(self.data, at, end):
            prefix, _, local = m[1].decode("utf-8").rpartition(":")
            if "xmlns" not in (prefix, local if not prefix else ""):
                out[scope.get(prefix, "") if prefix else "", local] = unescaped(m[2] if m[2] is not None else m[3])
        return out

    def element_end(self, raw: bytes, end: int) -> int:
        """Where the element ends whose start tag, of a raw name, ends at a byte: its end tag, past nested elements of the same name."""
        data = self.data
        if data[end - 2 : end] == b"/>":
            return end
        opening, closing, depth, at = b"<" + raw, b"</" + raw, 1, end
        while True:
            stop = self.find(closing, at)
            other = min((x for x in (data.find(b"<!", at, stop), data.find(b"<?", at, stop)) if x >= 0), default=-1)
            until = stop if other < 0 else other
            inner = data.find(opening, at, until)
            while inner >= 0:
                name, after = self.tag(inner)
                depth += name == raw and data[after - 2 : after] != b"/>"
                inner = data.find(opening, after, until)
            if other >= 0:
                at = self.after_other(other)
                continue
            at = stop + len(closing)
            if data[at : at + 1] == b">" or data[at : at + 1] in SPACE:
                depth -= 1
                at = self.find(b">", at) + 1
                if not depth:
                    return at

    def context(self, scope: dict[str, str]) -> str:
        """The scope as text, made once for each."""
        if id(scope) not in self.contexts:
            self.contexts[id(scope)] = json.dumps(scope, sort_keys=True)
        return self.contexts[id(scope)]

    def emit(self, at: int, stop: int, ns: str, name: str, scope: dict[str, str], bounded: str | None) -> Iterator[tuple]:
        key = (ns, name, id(scope))
        if key not in self.wanted:
            self.wanted[key] = self.options.layers is None or any(layer_matches(s, ns, name, scope) for s in self.options.layers)
        self.seq += 1
        if self.wanted[key]:
            yield self.seq - 1, at, stop, ns, name, self.context(scope), bounded, self.data[at:stop]

    def start(self, at: int) -> Iterator[tuple]:
        """Handles the start tag at a byte; returns where to go on."""
        raw, end = self.tag(at)
        parent = self.open[-1] if self.open else None
        scope = self.scope_of(at, end, parent.scope if parent else self.outside)
        ns, name, rule = self.resolve(raw, scope)
        empty = self.data[end - 2 : end] == b"/>"
        if parent is None:
            if self.root is not None:
                raise SplitError("not well formed: a second root")
            self.root = ns, name
            self.header = {"root": f"{{{ns}}}{name}", "namespaces": dict(scope), "attributes": {k[1]: v for k, v in self.attributes(at, end, scope).items()}}
            if empty:
                yield from self.whole_root(at, end, scope)
            else:
                self.root_at = at
                self.open.append(Open(raw, "collection", scope))
            return end
        if parent.role == "collection":
            role = rule
            if role:
                self.members_seen = True
                if role == "member" and self.data.find(b"href", at, end) >= 0 and self.attributes(at, end, scope).get((XLINK, "href")):
                    self.referenced += 1
            elif name in ("additionalObjects", "SimpleFeatureCollection", "FeatureCollection"):
                role = "collection"
            else:
                stop = self.element_end(raw, end)
                if name == "boundedBy" and ns in (GML, GML32, WFS2):
                    parent.bounded = json.dumps({"xml": self.data[at:stop].decode("utf-8"), "ns": scope})
                return stop
        elif name.endswith("FeatureCollection") and ns in (GML, GML32, WFS1, WFS2):
            role = "collection"
        else:
            stop = self.element_end(raw, end)
            yield from self.emit(at, stop, ns, name, scope, parent.bounded)
            return stop
        if not empty:
            self.open.append(Open(raw, role, scope, None if role == "collection" else parent.bounded))
        return end

    def whole_root(self, at: int, stop: int, scope: dict[str, str]) -> Iterator[tuple]:
        ns, name = self.root
        if not self.members_seen and self.options.allow_single_feature_root and not name.endswith("Collection") and ns != WFS2 and not ns.startswith(WFS1):
            yield from self.emit(at, stop, ns, name, scope, None)

    def run(self) -> Iterator[tuple]:
        """Features as tuples (seq, start, end, namespace, name, prefixes, boundedBy, xml)."""
        data, at = self.data, 0
        if data.startswith(b"\xef\xbb\xbf"):
            at = 3
        while (found := data.find(b"<", at)) >= 0:
            if not self.open and data[at:found].strip():
                raise SplitError(f"not well formed: text at byte {at}")
            mark = data[found + 1 : found + 2]
            if mark in (b"!", b"?"):
                at = self.after_other(found)
            elif mark == b"/":
                at = self.find(b">", found) + 1
                raw = data[found + 2 : at - 1].rstrip(SPACE)
                if not self.open or self.open[-1].raw != raw:
                    raise SplitError(f"not well formed: end tag {raw.decode('utf-8', 'replace')} at byte {found}")
                closed = self.open.pop()
                if not self.open:
                    yield from self.whole_root(self.root_at, at, closed.scope)
            else:
                at = yield from self.start(found)
        if self.open or self.root is None or data[at:].strip():
            raise SplitError("not well formed: the document ends early" if self.open else "not well formed: no element" if self.root is None else f"not well formed: text at byte {at}")


def split_rows(options: SplitOptions) -> Callable:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    def work(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                name, data = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                s, rows, held, n = Splitter(data, options), [], 0, 0
                failed = {}
                try:
                    for seq, at, stop, ns, local, prefixes, bounded, xml in s.run():
                        rows.append(("feature", name, seq, at, stop, ns, local, prefixes, bounded, xml, None))
                        held, n = held + len(xml), n + 1
                        if held >= BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                except (SplitError, UnicodeDecodeError) as e:
                    if not options.skip_malformed:
                        raise
                    failed = {"error": str(e)}
                info = json.dumps(s.header | {"referenced": s.referenced, "features": s.seq} | failed)
                rows.append(("header" if s.seq else "skipped", name, None, None, None, None, None, None, None, None, info))
                yield batch(rows)

    return work


def split_features(sources: DataFrame, options: SplitOptions | None = None) -> DataFrame:
    """Rows of SCHEMA for each feature of (name, content), and one for each source."""
    return sources.mapInArrow(split_rows(options or SplitOptions()), SCHEMA)


def split_and(options: SplitOptions, columns: list[str], then: Callable, features_only: bool = False) -> Callable:
    """Splits and works on the features in one Python worker, so that their XML doesn't cross into the JVM and back."""
    split = split_rows(options)

    def work(batches: Iterator[pa.RecordBatch]):
        def some() -> Iterator[pa.RecordBatch]:
            for b in split(batches):
                b = b.filter(pc.equal(b.column(0), "feature")) if features_only else b
                if b.num_rows:
                    yield b.select(columns)

        yield from then(some())

    return work


def split_by_tag(spark, paths: str | list[str], member: str = "gml:featureMember", namespaces: dict[str, str] | None = None) -> DataFrame:
    """Features of large plain UTF-8 files, each file cut by many tasks.

    Spark's text reader takes the member's end tag as the end of a line, so
    one file is read by as many tasks as it has blocks. `namespaces` are
    those of the root, the same in all files. The tag must not stand in
    comments or CDATA, and features don't inherit a boundedBy; other
    documents take split_features().
    """
    lines = spark.read.option("lineSep", f"</{member}>").text(paths).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"))
    context = json.dumps(namespaces or {}, sort_keys=True)
    opening = re.compile(rf"<{re.escape(member)}(?:\s[^>]*)?>")

    def work(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = []
            for text, source, block in zip(*(x.to_pylist() for x in b.columns), strict=True):
                m = opening.search(text)
                body = text[m.end() :].strip() if m else ""
                if not body.startswith("<"):
                    continue
                name = re.match(r"<([^\s/>]+)", body)[1]
                prefix, _, local = name.rpartition(":")
                rows.append(("feature", source, None, block, None, (namespaces or {}).get(prefix, ""), local, context, None, body.encode("utf-8"), None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    return lines.mapInArrow(work, SCHEMA)


def parse_scope(context: str, known: dict[str, bytes]) -> bytes:
    """A start tag that declares the namespaces of a context; `known` is the caller's memory."""
    if context not in known:
        declared = "".join(f' xmlns{":" + p if p else ""}={quoteattr(u)}' for p, u in json.loads(context).items() if p != "xml")
        known[context] = f"<_{declared}>".encode()
    return known[context]


def parse_elements(xmls: list[bytes], prefixes: dict[str, str]) -> list[Node]:
    """Elements cut out of a document, with the namespaces that hold there, as trees; all in one parse."""
    declared = "".join(f' xmlns{":" + p if p else ""}={quoteattr(u)}' for p, u in prefixes.items() if p != "xml").encode()
    try:
        root = ElementTree.fromstring(b"".join([b"<_", declared, b">", *xmls, b"</_>"]))
    except ElementTree.ParseError as e:
        raise SplitError(f"not well formed: {e}") from None
    return [tree_of(e) for e in root]


def parse_trees(xmls: list[bytes], contexts: list[str], known: dict[str, bytes]) -> Iterator[ElementTree.Element | SplitError]:
    """The parser's own elements of a batch's features; neighbours under the same namespaces are parsed together. `known` is the caller's memory of contexts."""
    at = 0
    for context, group in groupby(contexts):
        part = xmls[at : at + sum(1 for _ in group)]
        at += len(part)
        head = parse_scope(context, known)
        try:
            tree = ElementTree.fromstring(b"".join([head, *part, b"</_>"]))
        except ElementTree.ParseError:
            tree = ()
        if len(tree) == len(part):
            yield from tree
            continue
        for xml in part:  # which one?
            try:
                (one,) = ElementTree.fromstring(b"".join([head, xml, b"</_>"]))
                yield one
            except (ElementTree.ParseError, ValueError) as e:
                yield SplitError(f"not well formed: {e}")


def parse_batch(xmls: list[bytes], contexts: list[str], scopes: dict[str, dict[str, str]]) -> Iterator[Node | SplitError]:
    """Trees of a batch's features; neighbours under the same namespaces are parsed together. `scopes` is the caller's memory of contexts."""
    at = 0
    for context, group in groupby(contexts):
        if context not in scopes:
            scopes[context] = json.loads(context)
        part = xmls[at : at + sum(1 for _ in group)]
        at += len(part)
        try:
            yield from parse_elements(part, scopes[context])
        except SplitError:  # which one?
            for xml in part:
                try:
                    yield parse_element(xml, scopes[context])
                except SplitError as e:
                    yield e


def parse_element(xml: bytes, prefixes: dict[str, str]) -> Node:
    return parse_elements([xml], prefixes)[0]


def tree_of(element: ElementTree.Element) -> Node:
    count = 0

    def one(e: ElementTree.Element, depth: int) -> Node:
        nonlocal count
        if depth > MAX_DEPTH:
            raise SplitError("nested too deep")
        ns, _, name = e.tag.rpartition("}")
        node = Node(ns[1:], name, {attribute_name(k): v for k, v in e.items()} if e.attrib else {}, e.text or "", count, e)
        count += 1
        for c in e:
            node.children.append(one(c, depth + 1))
        return node

    return one(element, 1)


def attribute_name(key: str) -> str:
    if key[0] != "{":
        return key
    ns, _, name = key[1:].partition("}")
    return f"{XLINK_NAMES[ns]}{name}" if ns in XLINK_NAMES else key


#: How attributes of these namespaces are named.
XLINK_NAMES = {XLINK: "xlink:", GML: "gml:", GML32: "gml:", "http://www.w3.org/2001/XMLSchema-instance": "xsi:", "http://www.w3.org/XML/1998/namespace": "xml:"}


@lru_cache(maxsize=4)
def ranges(xml: bytes) -> list[list[int]]:
    """Where the content of each element starts and ends, in document order."""
    out: list[list[int]] = []
    open_: list[int] = []
    p = expat.ParserCreate("utf-8")

    def start(*_) -> None:
        open_.append(len(out))
        out.append([TAG.match(xml, p.CurrentByteIndex).end(), 0])

    def end(_: str) -> None:
        at = out[open_.pop()]
        at[1] = max(at[0], p.CurrentByteIndex)

    p.StartElementHandler, p.EndElementHandler = start, end
    p.Parse(xml, True)
    return out


def inner_xml(xml: bytes, node: Node) -> str:
    """Source text of what an element holds, trimmed."""
    start, end = ranges(xml)[node.index]
    return xml[start:end].decode("utf-8").strip()
