"""Which version of GML a document is written in."""

from __future__ import annotations

import re

from .gml_geometry import GML32

#: Namespaces of GML 3.3 start so; versions that texts name, the most exact first.
GML33 = "http://www.opengis.net/gml/3.3"
NAMED = (("3.3", "3.3"), ("3.2", "3.2"), ("3.1", "3.1"), ("3.0", "3.0"), ("3", "3.1"), ("2", "2"))
OF_WFS = (("1.0", "2"), ("1.1", "3.1"), ("2.", "3.2"))


def named(text: str) -> str | None:
    """The version that a text starts with."""
    return next((v for start, v in NAMED if text.strip("\"' ").startswith(start)), None)


def stated(schema_location: str = "", output_format: str = "") -> str | None:
    """The highest version of the schema locations, else the one of the format."""
    found = [v for url in schema_location.split() if "/gml/" in url and (v := named(url.split("/gml/", 1)[1]))]
    if found:
        return max(found)
    for m in re.finditer(r"gml/|version=|gml", output_format.lower()):
        if v := named(output_format.lower()[m.end() :]):
            return v
    return None


def detect_version(namespaces: set[str] | frozenset[str] = frozenset(), schema_location: str = "", output_format: str = "", wfs_version: str = "", dialects: set[str] | frozenset[str] = frozenset(), poslist_dimension: bool = False) -> str | None:
    """By strength: a 3.3 namespace, the 3.2 namespace, what is stated, the service's version, the elements seen."""
    if any(ns.startswith(GML33) for ns in namespaces):
        return "3.3"
    said = stated(schema_location, output_format)
    if GML32 in namespaces:
        return "3.3" if said == "3.3" else "3.2"
    if said:
        return said
    if served := next((v for start, v in OF_WFS if wfs_version.strip().startswith(start)), None):
        return served
    if "gml3" in dialects:
        return "3.0" if poslist_dimension else "3.1"
    return "2" if "gml2" in dialects else None
