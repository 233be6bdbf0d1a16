"""OGC WFS 1.0, 1.1 and 2.0: capabilities, requests, paging; pages become documents for the reader."""

from __future__ import annotations

import re
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.gml_geometry import Node
from .inputs import SCHEMA, SourceError, http_get
from .split import SplitError, parse_element

#: Fixed values of the protocol: page size without other advice, longest URL before a request is posted.
PAGE, LONGEST_URL = 5000, 1800
FORMATS = ("application/gml+xml; version=3.2", "text/xml; subtype=gml/3.2", "text/xml; subtype=gml/3.1.1", "GML3", "text/xml; subtype=gml/2.1.2", "GML2")
RESERVED = {"service", "version", "request", "typename", "typenames", "outputformat", "startindex", "count", "maxfeatures", "srsname", "bbox", "filter", "sortby", "resulttype"}


class WfsError(SourceError):
    """An exception report, or an answer that can't be used."""


@dataclass
class FeatureType:
    name: str
    title: str = ""
    default_crs: str | None = None
    formats: list[str] = field(default_factory=list)


@dataclass
class Capabilities:
    """What a server offers."""

    version: str
    types: list[FeatureType]
    constraints: dict[str, str]
    formats: list[str]

    @classmethod
    def parse(cls, xml: bytes) -> Capabilities:
        root = document(xml)
        types, constraints, formats = [], {}, []
        for n in everything(root):
            if n.name == "FeatureType" and (name := text_of(n, "Name")):
                types.append(FeatureType(name, text_of(n, "Title") or "", text_of(n, "DefaultCRS") or text_of(n, "DefaultSRS") or text_of(n, "SRS"), [x.text.strip() for x in everything(n) if x.name == "Format"]))
            elif n.name == "Constraint":
                value = text_of(n, "DefaultValue") or next((x.text.strip() for x in everything(n) if x.name == "Value"), "")
                constraints[n.attr("name") or ""] = value
            elif n.name == "Parameter" and n.attr("name") == "outputFormat":
                formats += [x.text.strip() for x in everything(n) if x.name == "Value"]
        return cls(root.attr("version") or "2.0.0", types, constraints, formats)

    def preferred_format(self, name: str) -> str | None:
        """GML 3.2 before 3.1.1 before 2, of what the type or the server lists."""
        offered = next((t.formats for t in self.types if t.name == name and t.formats), self.formats)
        return next((f for f in FORMATS if f in offered), None)

    def pages(self) -> bool:
        return self.version.startswith("2.") and self.constraints.get("ImplementsResultPaging", "").upper() == "TRUE"

    def page_size(self, requested: int | None = None) -> int:
        own = self.constraints.get("CountDefault", "")
        limits = [x for x in (requested, int(own) if own.isdigit() and int(own) else None) if x]
        return min(limits) if limits else PAGE


def document(xml: bytes) -> Node:
    """The root of a response; DTDs are refused."""
    return parse_element(re.sub(rb"^\s*(\xef\xbb\xbf)?\s*<\?xml[^>]*\?>", b"", xml), {})


def everything(node: Node) -> Iterator[Node]:
    yield node
    for c in node.children:
        yield from everything(c)


def text_of(node: Node, name: str) -> str | None:
    return next((c.text.strip() for c in node.children if c.name == name), None)


def exception_of(root: Node) -> str | None:
    """The text of an exception report, also of one under HTTP 200."""
    if root.name not in ("ExceptionReport", "ServiceExceptionReport"):
        return None
    found = [f"{n.attr('exceptionCode') or n.attr('code') or ''} {n.all_text.strip()}".strip() for n in everything(root) if n.name in ("Exception", "ServiceException")]
    return "; ".join(found) or "exception"


@dataclass
class GetFeature:
    """A request in any of the versions."""

    type_name: str
    version: str = "2.0.0"
    output_format: str | None = None
    start: int | None = None
    count: int | None = None
    srs: str | None = None
    bbox: str | None = None
    filter: str | None = None
    sort_by: str | None = None
    hits: bool = False
    vendor: dict[str, str] = field(default_factory=dict)

    def sort_text(self) -> str | None:
        """`a,b desc` in the version's spelling."""
        if not self.sort_by:
            return None
        two = self.version.startswith("2.")
        out = []
        for part in self.sort_by.split(","):
            name, _, order = part.strip().partition(" ")
            down = order.strip().lower() in ("desc", "d")
            out.append(name + ((" DESC" if down else " ASC") if two else (" D" if down else " A")))
        return ",".join(out)

    def url(self, base: str) -> str:
        two = self.version.startswith("2.")
        parts = urllib.parse.urlsplit(base)
        query = [(k, v) for k, v in urllib.parse.parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in RESERVED]
        query += [("SERVICE", "WFS"), ("VERSION", self.version), ("REQUEST", "GetFeature"), ("TYPENAMES" if two else "TYPENAME", self.type_name)]
        for k, v in (("OUTPUTFORMAT", self.output_format), ("STARTINDEX", self.start), ("COUNT" if two else "MAXFEATURES", self.count), ("SRSNAME", self.srs), ("BBOX", self.bbox), ("FILTER", self.filter), ("SORTBY", self.sort_text()), ("RESULTTYPE", "hits" if self.hits else None)):
            if v is not None:
                query.append((k, str(v)))
        query += list(self.vendor.items())
        return urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode(query)))

    def xml(self) -> bytes:
        """The body of a POST request, in 1.1 and 2.0."""
        if self.bbox or self.vendor or self.version.startswith("1.0"):
            raise WfsError("bbox, vendor parameters and 1.0 aren't posted")
        two = self.version.startswith("2.")
        ns = ("http://www.opengis.net/wfs/2.0", "http://www.opengis.net/fes/2.0") if two else ("http://www.opengis.net/wfs", "http://www.opengis.net/ogc")
        attrs = {"service": "WFS", "version": self.version, "outputFormat": self.output_format, "startIndex": self.start if two else None, "count" if two else "maxFeatures": self.count, "resultType": "hits" if self.hits else None}
        head = "".join(f" {k}={quoteattr(str(v))}" for k, v in attrs.items() if v is not None)
        prefix, _, local = self.type_name.rpartition(":")
        sort = "".join(f"<f:SortProperty><f:{'ValueReference' if two else 'PropertyName'}>{escape(p.split(' ')[0])}</f:{'ValueReference' if two else 'PropertyName'}><f:SortOrder>{'DESC' if p.endswith(('D', 'DESC')) and not p.endswith(' ASC') else 'ASC'}</f:SortOrder></f:SortProperty>" for p in (self.sort_text() or "").split(",") if p)
        query = f"<w:Query {'typeNames' if two else 'typeName'}={quoteattr(self.type_name)}{f' srsName={quoteattr(self.srs)}' if self.srs else ''}>{self.filter or ''}{f'<f:SortBy>{sort}</f:SortBy>' if sort else ''}</w:Query>"
        return f'<w:GetFeature xmlns:w="{ns[0]}" xmlns:f="{ns[1]}"{head}>{query}</w:GetFeature>'.encode()


@dataclass
class Page:
    """Counts of a response."""

    matched: int | None
    returned: int | None
    next: str | None
    truncated: bool


def inspect(xml: bytes) -> Page:
    """Counts and the next link; raises WfsError for an exception report."""
    head = xml[:200_000] if b"featureMember" in xml or b"member" in xml else xml
    m = re.search(rb"<(?!\?|!)(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>", head)
    if not m:
        raise WfsError("no XML in the answer")
    tag = m[0].decode("utf-8", "replace")
    if re.match(r"<(\w+:)?(Service)?ExceptionReport\b", tag):
        raise WfsError(exception_of(document(xml)) or "exception")
    attr = lambda k: (a := re.search(rf"\b{k}\s*=\s*[\"']([^\"']*)[\"']", tag)) and a[1]
    number = lambda v: int(v) if v and v.isdigit() else None
    closing = re.match(r"<([^\s/>]+)", tag)[1]
    done = tag.endswith("/>") or xml.rstrip().endswith(f"</{closing}>".encode())
    return Page(number(attr("numberMatched")), number(attr("numberReturned") or attr("numberOfFeatures")), (attr("next") or "").replace("&amp;", "&") or None, not done)


def read_pages(base: str, request: GetFeature, *, size: int, paged: bool, first: int = 0, stop: int | None = None, timeout: float = 30, retries: int = 3, headers: dict[str, str] | None = None) -> Iterator[tuple[str, bytes]]:
    """(name, content) of page after page. By offset; a next link of a 2.0 answer is taken up.

    A truncated page is asked for again at half the size. With a known total
    short pages go on; without one a short page is the last. With `stop` the
    pages are those of features from `first` up to it: short pages are filled
    up, and it is an error if the server gives fewer or others.
    """
    start, got, total, link, tries = first, 0, None, None, 0
    while True:
        request.start, request.count = (start, size if stop is None else min(size, stop - start)) if paged else (None, None)
        url = link or request.url(base)
        body = None
        if link is None and len(url) > LONGEST_URL and not request.bbox and not request.vendor:
            url, body = base.split("?")[0], request.xml()
        xml = http_get(url, timeout=timeout, retries=retries, headers=(headers or {}) | ({"Content-Type": "text/xml"} if body else {}), body=body)
        page = inspect(xml)
        if page.truncated:
            tries += 1
            if tries > retries:
                raise WfsError(f"{url}: answer cut off")
            size = max(1, size // 2)
            continue
        yield url, xml
        n = page.returned if page.returned is not None else len(re.findall(rb"<(?:\w+:)?(?:featureMember|member)[\s>]", xml))
        total = page.matched if page.matched is not None else total
        got += n
        if stop is not None:
            start = first + got
            if not n or start > stop:
                raise WfsError(f"{url}: {got} features from {first} on, not {stop - first}")
            if start == stop:
                return
            continue
        if page.next and request.version.startswith("2."):
            link = page.next
        elif link or not paged or not n or total is not None and got >= total or total is None and n < size:
            return
        start = got


class WfsClient:
    """A server at a URL."""

    def __init__(self, base: str, version: str = "2.0.0", *, timeout: float = 30, retries: int = 3, headers: dict[str, str] | None = None):
        self.base, self.version, self.http = base, version, {"timeout": timeout, "retries": retries, "headers": headers}
        self._capabilities: Capabilities | None = None

    def capabilities(self) -> Capabilities:
        if self._capabilities is None:
            parts = urllib.parse.urlsplit(self.base)
            query = [(k, v) for k, v in urllib.parse.parse_qsl(parts.query) if k.lower() not in RESERVED] + [("SERVICE", "WFS"), ("REQUEST", "GetCapabilities"), ("VERSION", self.version)]
            xml = http_get(urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode(query))), **self.http)
            if why := exception_of(document(xml)):
                raise WfsError(why)
            self._capabilities = Capabilities.parse(xml)
        return self._capabilities

    def layers(self) -> list[str]:
        return [t.name for t in self.capabilities().types]

    def request(self, type_name: str, **more) -> GetFeature:
        caps = self.capabilities()
        return GetFeature(type_name, caps.version, caps.preferred_format(type_name), **more)

    def count(self, type_name: str) -> int | None:
        """Number of features by resultType=hits; None if the server doesn't say."""
        if self.capabilities().version.startswith("1.0"):
            return None
        page = inspect(http_get(self.request(type_name, hits=True).url(self.base), **self.http))
        return page.matched if page.matched is not None else page.returned

    def warnings(self, type_name: str, *, page_size: int | None = None, **more) -> list[str]:
        """What may go wrong with a read, before it starts."""
        caps, out = self.capabilities(), []
        if type_name not in self.layers():
            out.append(f"{type_name} isn't among the layers")
        total = self.count(type_name)
        if caps.pages() and not more.get("sort_by"):
            out.append("pages by offset without sort_by: a server may give a feature twice or not at all")
        if total is None:
            out.append("the server doesn't say how many features there are: a short page ends the read")
        elif not caps.pages() and total > caps.page_size(page_size):
            out.append(f"the server doesn't page: {total} features are asked for at once")
        return out

    def sources(self, spark: SparkSession, type_name: str, *, page_size: int | None = None, **more) -> DataFrame:
        """(name, content) of all pages. Pages are tasks of their own where the total is known, the server pages and `sort_by` fixes the order; else one task reads on and on."""
        caps, http, base = self.capabilities(), self.http, self.base
        size, request = caps.page_size(page_size), self.request(type_name, **more)
        total = self.count(type_name) if caps.pages() and request.sort_by else None
        starts = list(range(0, total, size)) if total else [-1]

        def work(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                for start in b.column(0).to_pylist():
                    stop = None if start < 0 else min(start + size, total)
                    for name, xml in read_pages(base, request, size=size, paged=caps.pages(), first=max(start, 0), stop=stop, **http):
                        yield pa.record_batch([pa.array([name]), pa.array([xml], pa.binary())], ["name", "content"])

        return spark.createDataFrame([(s,) for s in starts], "start int").repartition(len(starts)).mapInArrow(work, SCHEMA)


#: What declared types become; dateTime stays text, as a declaration doesn't say whether it has a time zone.
DECLARED = {k: v for names, v in (("boolean", "boolean"), ("integer long int short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedInt unsignedShort unsignedByte", "bigint"), ("double float decimal", "double"), ("date", "date"), ("time", "time"), ("string dateTime anyURI token Name NCName normalizedString language duration gYear unsignedLong", "text")) for k in names.split()}
GEOMETRY_TYPE = re.compile(r"(Geometry|GeometricPrimitive|Point|MultiPoint|LineString|MultiLineString|Curve|MultiCurve|Surface|MultiSurface|Polygon|MultiPolygon|MultiGeometry|GeometricComplex|CompositeCurve|CompositeSurface)PropertyType")


def hint_of(xml: bytes, name: str) -> dict[str, str]:
    """For InferenceOptions.hint: properties that a schema declares with a simple type or as geometries."""
    out = {k: DECLARED.get(t) or ("geometry" if GEOMETRY_TYPE.fullmatch(t) else None) for k, t in describe(xml, name).items()}
    return {k: t for k, t in out.items() if t}


def describe(xml: bytes, name: str) -> dict[str, str]:
    """DescribeFeatureType: direct properties of a type and their XSD types, as a hint."""
    root = document(xml)
    if why := exception_of(root):
        raise WfsError(why)
    local = name.rpartition(":")[2]
    element = next((n for n in root.children if n.name == "element" and n.attr("name") == local), None)
    wanted = (element.attr("type") or "").rpartition(":")[2] if element else f"{local}Type"
    kind = next((n for n in root.children if n.name == "complexType" and n.attr("name") == wanted), element)
    if kind is None:
        raise SplitError(f"no type {name}")
    return {n.attr("name"): (n.attr("type") or "").rpartition(":")[2] for n in everything(kind) if n.name == "element" and n.attr("name") and n is not element}
