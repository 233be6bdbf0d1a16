"""Command line: gml scan, gml convert, wfs layers, wfs count, wfs convert."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .api import ReadOptions, read_layer, scan
from .operators.sinks import write_geoparquet, write_ipc
from .plans.schema import settings_json
from .sources.wfs import WfsClient


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkgml", description=__doc__)
    kinds = p.add_subparsers(dest="kind", required=True)
    gml = kinds.add_parser("gml").add_subparsers(dest="command", required=True)
    wfs = kinds.add_parser("wfs").add_subparsers(dest="command", required=True)
    for name, sub in (("scan", gml), ("convert", gml)):
        c = sub.add_parser(name)
        c.add_argument("inputs", nargs="+")
        c.add_argument("-o", "--option", action="append", default=[], metavar="KEY=VALUE")
        c.add_argument("--settings", help="settings file to write (scan) or to read by (convert)")
        if name == "convert":
            c.add_argument("--layer")
            c.add_argument("--out", required=True)
            c.add_argument("--format", choices=("geoparquet", "ipc"), default="geoparquet")
            c.add_argument("--bbox", choices=("auto", "always", "never"), default="auto")
    for name in ("layers", "count", "convert"):
        c = wfs.add_parser(name)
        c.add_argument("url")
        if name != "layers":
            c.add_argument("type_name")
        if name == "convert":
            c.add_argument("--out", required=True)
            c.add_argument("--sort-by")
            c.add_argument("--bbox")
            c.add_argument("-o", "--option", action="append", default=[])
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sparkgml").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    options = ReadOptions.parse(dict(x.split("=", 1) for x in getattr(a, "option", [])))
    if a.kind == "wfs":
        client = WfsClient(a.url)
        if a.command == "layers":
            print("\n".join(client.layers()))
        elif a.command == "count":
            print(client.count(a.type_name))
        else:
            pages = client.sources(spark, a.type_name, sort_by=a.sort_by, bbox=a.bbox)
            layer = read_layer(spark, pages, a.type_name, options=options)
            write_geoparquet(layer.df, a.out, settings=settings_json([layer.schema])).show(truncate=False)
        return 0
    if a.command == "scan":
        found = scan(spark, a.inputs, options)
        print(found.explain())
        for name in found.skipped_sources:
            print(f"skipped: {name}", file=sys.stderr)
        if a.settings:
            with open(a.settings, "w", encoding="utf-8") as f:
                f.write(found.save())
        return 0
    schema = None
    if a.settings:
        with open(a.settings, encoding="utf-8") as f:
            schema = f.read()
    layer = read_layer(spark, a.inputs, a.layer, schema, options)
    settings = settings_json([layer.schema])
    done = write_geoparquet(layer.df, a.out, box=a.bbox, settings=settings) if a.format == "geoparquet" else write_ipc(layer.df, a.out, settings=settings)
    done.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
