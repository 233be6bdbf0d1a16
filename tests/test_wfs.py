import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from sparkgml.api import read
from sparkgml.sources.wfs import Capabilities, GetFeature, WfsClient, WfsError, describe, inspect

N = 25
CAPS = b"""<?xml version="1.0"?><w:WFS_Capabilities version="2.0.0" xmlns:w="http://www.opengis.net/wfs/2.0" xmlns:o="http://www.opengis.net/ows/1.1">
<o:OperationsMetadata><o:Constraint name="ImplementsResultPaging"><o:NoValues/><o:DefaultValue>TRUE</o:DefaultValue></o:Constraint><o:Constraint name="CountDefault"><o:DefaultValue>10</o:DefaultValue></o:Constraint></o:OperationsMetadata>
<w:FeatureTypeList><w:FeatureType><w:Name>t:A</w:Name><w:Title>As</w:Title><w:DefaultCRS>urn:ogc:def:crs:EPSG::4326</w:DefaultCRS><w:OutputFormats><w:Format>application/gml+xml; version=3.2</w:Format></w:OutputFormats></w:FeatureType></w:FeatureTypeList></w:WFS_Capabilities>"""


class Handler(BaseHTTPRequestHandler):
    failures, cap, cut, missing = 1, N, 0, 0

    def log_message(self, *_):
        pass

    def do_GET(self):
        q = {k.lower(): v for k, v in urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query)}
        if q["request"] == "GetCapabilities":
            body = CAPS
        elif q.get("resulttype") == "hits":
            body = f'<w:FeatureCollection xmlns:w="http://www.opengis.net/wfs/2.0" numberMatched="{N}" numberReturned="0"/>'.encode()
        elif Handler.failures:
            Handler.failures -= 1
            self.send_error(503)
            return
        else:
            start, count, there = int(q.get("startindex", 0)), min(int(q.get("count", N)), Handler.cap), N - Handler.missing
            rows = "".join(f'<w:member><A xmlns="urn:t"><n>{i}</n></A></w:member>' for i in range(start, min(there, start + count)))
            body = f'<w:FeatureCollection xmlns:w="http://www.opengis.net/wfs/2.0" numberMatched="{N}" numberReturned="{max(0, min(count, there - start))}">{rows}</w:FeatureCollection>'.encode()
            if Handler.cut:
                Handler.cut -= 1
                body = body[: len(body) // 2]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)


@pytest.fixture(scope="module")
def server():
    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/wfs?map=x"
    s.shutdown()


@pytest.mark.parametrize("sort_by", [None, "n"])
def test_paging(spark, server, sort_by):
    client = WfsClient(server)
    assert client.layers() == ["t:A"] and client.count("t:A") == N
    df = read(spark, client.sources(spark, "t:A", sort_by=sort_by), "A", {"n": "bigint"})
    assert sorted(r.n for r in df.collect()) == list(range(N))


@pytest.mark.parametrize("sort_by", [None, "n"])
@pytest.mark.parametrize("cap, cut", [(4, 0), (10, 2), (3, 1)])
def test_short_and_cut_pages(spark, server, monkeypatch, sort_by, cap, cut):
    """A server may give less than it is asked for; nothing is lost."""
    monkeypatch.setattr(Handler, "cap", cap)
    monkeypatch.setattr(Handler, "cut", cut)
    df = read(spark, WfsClient(server).sources(spark, "t:A", sort_by=sort_by), "A", {"n": "bigint"})
    assert sorted(r.n for r in df.collect()) == list(range(N))


def test_missing_features(spark, server, monkeypatch):
    monkeypatch.setattr(Handler, "missing", 2)
    with pytest.raises(Exception, match="features from 20 on, not 5"):
        read(spark, WfsClient(server).sources(spark, "t:A", sort_by="n"), "A", {"n": "bigint"}).collect()


def test_requests():
    r = GetFeature("t:A", "1.1.0", start=5, count=10, sort_by="a desc, b")
    assert "MAXFEATURES=10" in r.url("http://x/wfs?request=foo&map=1") and "map=1" in r.url("http://x/wfs?map=1") and "SORTBY=a+D%2Cb+A" in r.url("http://x")
    assert "foo" not in r.url("http://x/wfs?request=foo")
    assert b'maxFeatures="10"' in r.xml() and b"SortBy" in r.xml()
    with pytest.raises(WfsError):
        GetFeature("t:A", bbox="0,0,1,1").xml()


def test_answers():
    caps = Capabilities.parse(CAPS)
    assert caps.pages() and caps.page_size() == 10 and caps.page_size(3) == 3 and caps.preferred_format("t:A") == "application/gml+xml; version=3.2"
    page = inspect(b'<w:FeatureCollection xmlns:w="x" numberMatched="7" numberReturned="2" next="http://n?a=1&amp;b=2"></w:FeatureCollection>')
    assert (page.matched, page.returned, page.next, page.truncated) == (7, 2, "http://n?a=1&b=2", False)
    assert inspect(b"<w:FeatureCollection xmlns:w='x'><w:member>").truncated
    with pytest.raises(WfsError, match="Bad"):
        inspect(b'<ows:ExceptionReport xmlns:ows="o"><ows:Exception exceptionCode="Bad"/></ows:ExceptionReport>')
    xsd = b'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="A" type="t:AType"/><xs:complexType name="AType"><xs:sequence><xs:element name="n" type="xs:int"/></xs:sequence></xs:complexType></xs:schema>'
    assert describe(xsd, "t:A") == {"n": "int"}
