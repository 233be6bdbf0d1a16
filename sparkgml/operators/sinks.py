"""GeoParquet and Arrow IPC files, written by tasks into a folder that all executors share."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import wkb_bbox
from ..functions.crs import parse_srs
from ..functions.geometry import CODES, CURVES, bbox, read_wkb

ROW_GROUP = 128_000


class SinkError(ValueError):
    """A geometry that the format can't hold."""


def geometry_columns(schema: T.StructType) -> list[T.StructField]:
    return [f for f in schema.fields if isinstance(f.dataType, T.BinaryType) and f.metadata.get("ARROW:extension:name") == "geoarrow.wkb"]


def with_bbox(df: DataFrame, mode: str = "auto") -> tuple[DataFrame, dict[str, str]]:
    """A box column after each geometry column: always, never, or (auto) where not all are points."""
    names, out, covers = set(df.columns), [], {}
    geometries = {f.name: f for f in geometry_columns(df.schema)}
    for c in df.columns:
        out.append(F.col(f"`{c}`"))
        f = geometries.get(c)
        if f and (mode == "always" or mode == "auto" and f.metadata.get("geom_kind") != "Point"):
            name, n = f"{c}_bbox", 2
            while name in names:
                name, n = f"{c}_bbox_{n}", n + 1
            names.add(name)
            covers[c] = name
            out.append(wkb_bbox(F.col(f"`{c}`")).alias(name))
    return df.select(*out), covers


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Seen:
    """Kinds and extent of a geometry column's values in one file."""

    def __init__(self):
        self.kinds: set[str] = set()
        self.box: list[float] | None = None

    def add(self, values: list[bytes | None]) -> None:
        for v in values:
            if v is None:
                continue
            g = read_wkb(v)
            if g[0] in CURVES:
                raise SinkError(f"{g[0]}: GeoParquet holds no curves; linearize first")
            self.kinds.add(g[0] + (" Z" if g[1] == 3 else ""))
            if b := bbox(g):
                b = list(b[:4])
                self.box = b if self.box is None else [min(self.box[0], b[0]), min(self.box[1], b[1]), max(self.box[2], b[2]), max(self.box[3], b[3])]


def geo_metadata(fields: list[dict[str, Any]], covers: dict[str, str], seen: dict[str, Seen]) -> dict[str, Any]:
    columns = {}
    for f in fields:
        crs = f["metadata"].get("crs")
        entry: dict[str, Any] = {"encoding": "WKB", "geometry_types": sorted(seen[f["name"]].kinds, key=lambda k: (CODES[k.removesuffix(" Z")], k)), "crs": json.loads(crs) if crs and crs.startswith("{") else None}
        if seen[f["name"]].box:
            entry["bbox"] = seen[f["name"]].box
        if f["name"] in covers:
            entry["covering"] = {"bbox": {k: [covers[f["name"]], k] for k in ("xmin", "ymin", "xmax", "ymax")}}
        columns[f["name"]] = entry
    return {"version": "1.1.0", "primary_column": fields[0]["name"], "columns": columns}


def committed(path: str, staging: str, files: list[str]) -> None:
    """Move the files that count into their folder and drop what else was written."""
    fs, root = filesystem(path)
    fs.create_dir(f"{root}/{staging}", recursive=True)
    for name in files:
        fs.move(f"{root}/{staging}/{name}", f"{root}/{name}")
    fs.delete_dir(f"{root}/{staging}")
    if not fs.get_file_info(pafs.FileSelector(f"{root}/_temporary", allow_not_found=True)):
        fs.delete_dir(f"{root}/_temporary")


def write_geoparquet(df: DataFrame, path: str, *, box: str = "auto", settings: str | None = None, compression: str = "zstd") -> DataFrame:
    """Write one GeoParquet file for each partition into the folder `path`; returns (file, rows), which are the written files.

    `path` is a folder or URI that pyarrow reaches from every executor. Tasks
    write below `_temporary`; once all have succeeded, the files of those that
    count are moved into the folder, so retried and speculative tasks leave
    nothing. The files are also listed in `_files.json`.
    """
    df, covers = with_bbox(df, box)
    fields = [{"name": f.name, "metadata": dict(f.metadata)} for f in geometry_columns(df.schema)]

    staging = f"_temporary/{uuid.uuid4().hex}"

    def work(batches: Iterator[pa.RecordBatch]):
        fs, root = filesystem(path)
        root = f"{root}/{staging}"
        fs.create_dir(root, recursive=True)
        name, writer, n, seen = f"part-{uuid.uuid4().hex}.parquet", None, 0, {f["name"]: Seen() for f in fields}
        try:
            for b in batches:
                for f in fields:
                    seen[f["name"]].add(b.column(b.schema.get_field_index(f["name"])).to_pylist())
                if writer is None:
                    sink = fs.open_output_stream(f"{root}/{name}")
                    writer = pq.ParquetWriter(sink, b.schema, compression=compression)
                writer.write_table(pa.Table.from_batches([b]), row_group_size=ROW_GROUP)
                n += b.num_rows
            if writer:
                extra = {"geo": json.dumps(geo_metadata(fields, covers, seen))} if fields else {}
                writer.add_key_value_metadata(extra | ({"gml:settings": settings} if settings else {}))
        finally:
            if writer:
                writer.close()
                sink.close()
        if n:
            yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], ["file", "rows"])

    done = df.mapInArrow(work, "file string, rows bigint").collect()  # a row for each partition
    committed(path, staging, [r.file for r in done])
    fs, root = filesystem(path)
    with fs.open_output_stream(f"{root}/_files.json") as out:
        out.write(json.dumps({r.file: r.rows for r in done}).encode())
    return df.sparkSession.createDataFrame([(r.file, r.rows) for r in done], "file string, rows bigint")


def write_ipc(df: DataFrame, path: str, *, settings: str | None = None) -> DataFrame:
    """Write one Arrow IPC file for each partition, moved into the folder once all are there; curves and types stay as they are."""
    staging = f"_temporary/{uuid.uuid4().hex}"

    def work(batches: Iterator[pa.RecordBatch]):
        fs, root = filesystem(path)
        root = f"{root}/{staging}"
        fs.create_dir(root, recursive=True)
        name, writer, n = f"part-{uuid.uuid4().hex}.arrow", None, 0
        for b in batches:
            if writer is None:
                sink = fs.open_output_stream(f"{root}/{name}")
                schema = b.schema.with_metadata({"gml:settings": settings} if settings else None)
                writer = pa.ipc.new_file(sink, schema)
            writer.write_batch(b.replace_schema_metadata(schema.metadata))
            n += b.num_rows
        if writer:
            writer.close()
            sink.close()
            yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], ["file", "rows"])

    done = df.mapInArrow(work, "file string, rows bigint").collect()  # a row for each partition
    committed(path, staging, [r.file for r in done])
    return df.sparkSession.createDataFrame([(r.file, r.rows) for r in done], "file string, rows bigint")


def column_crs(field: T.StructField) -> str | None:
    """EPSG:code of a geometry column, if its srsName is known."""
    name = field.metadata.get("gml:srs_name")
    return parse_srs(name).authority_code() if name else None
