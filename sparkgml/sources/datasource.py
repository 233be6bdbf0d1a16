"""spark.read.format("gml"): the reader as a Spark data source."""

from __future__ import annotations

import glob
import os
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.observe import INPUT
from ..operators.parse import ReadPlan, rows_of
from ..plans.schema import LayerSchema, SchemaError, load_settings
from .inputs import BARRIER, SUFFIXES, SourceError, as_utf8, filesystem_read, member_names, members, unpacked
from .split import SplitOptions, split_and


class FilePart(InputPartition):
    """One file, or one member of an archive."""

    def __init__(self, path: str, member: str | None):
        self.path, self.member = path, member


def expand(path: str) -> list[FilePart]:
    """Files of a path, folder or glob, sorted; archives by member, so that each is a task."""
    path = path.removeprefix("file://").removeprefix("file:")
    name, found, member = path.partition(BARRIER)
    if os.path.isdir(name):
        files = sorted(os.path.join(d, f) for d, _, names in os.walk(name) for f in names if f.lower().endswith(SUFFIXES))
    else:
        files = sorted(glob.glob(name)) or [name]
    out = []
    for f in files:
        if f.lower().endswith(".zip"):
            out += [FilePart(f, m) for m in member_names(f, f, member if found else None)]
        else:
            out.append(FilePart(f, None))
    if not out:
        raise SourceError(f"nothing at {path}")
    return out


def named_batches(docs: Iterable[tuple[str, bytes]], layer: str, plan: ReadPlan) -> Iterator[pa.RecordBatch]:
    """A layer's rows of documents, a batch at a time; features of other layers aren't parsed."""
    work = split_and(SplitOptions(layers=[layer]), [*INPUT, "end"], rows_of(plan), features_only=True)
    return work(pa.record_batch([pa.array([name]), pa.array([data], pa.binary())], ["name", "content"]) for name, data in docs)


class FileGroup(InputPartition):
    """Files and members that one task reads."""

    def __init__(self, parts: list[FilePart]):
        self.parts = parts


#: Bytes of files in a task, at most, but for a larger file; and how many tasks there should be before they get that large.
GROUP_BYTES, GROUPS = 16 << 20, 64


def grouped(parts: list[FilePart]) -> list[FileGroup]:
    """Neighbouring small files together, so that tasks don't become as many as files."""
    members_of = Counter(p.path for p in parts)
    sizes = [os.path.getsize(p.path) // members_of[p.path] if os.path.exists(p.path) else 0 for p in parts]
    most = min(GROUP_BYTES, sum(sizes) // GROUPS)
    out, held = [], 0
    for p, n in zip(parts, sizes, strict=True):
        if not out or held + n > most:
            out.append(FileGroup([]))
            held = 0
        out[-1].parts.append(p)
        held += n
    return out


class GmlReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.options = dict(options)
        self.schema = schema
        self.wanted: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """An equality on the column _layer skips features of other layers unparsed; the rest is Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("_layer",):
                self.wanted = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return grouped(expand(self.options["path"]))

    def documents(self, parts: list[FilePart]) -> Iterator[tuple[str, bytes]]:
        for p in parts:
            data = filesystem_read(p.path)
            name, data = next(iter(members(p.path, data, p.member))) if p.member else (p.path, data)
            yield name, as_utf8(unpacked(data))

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        layer = self.options["layer"]
        has_layer = "_layer" in self.schema.names
        fields = StructType([f for f in self.schema.fields if f.name != "_layer"])
        saved = load_settings(self.options["settings"])[1] if "settings" in self.options else {}
        plan = ReadPlan(LayerSchema.of_struct(layer, fields), axis_overrides=saved.get("axis_overrides", {}), on_error=self.options.get("on_feature_error", "error"), linear=self.options.get("linear") == "true", target_crs=int(self.options["target_crs"].upper().removeprefix("EPSG:")) if "target_crs" in self.options else None, axis_mode=self.options.get("axis_order") or saved.get("axis_order", "auto"))
        if self.wanted not in (None, layer.rpartition("}")[2].rpartition(":")[2]):
            return
        for b in named_batches(self.documents(partition.parts), layer, plan):
            yield b.append_column("_layer", pa.array([layer.rpartition("}")[2].rpartition(":")[2]] * b.num_rows, pa.string())) if has_layer else b


class GmlDataSource(DataSource):
    """Options: path, layer, settings (a settings file's text), on_feature_error, axis_order, target_crs, linear.

    The schema is a user's, or that of the settings; paths are local to the
    executors (other stores go through sparkgml.api, which lets Spark read
    the bytes). Files and members of archives are dealt to partitions by
    their sizes.
    """

    @classmethod
    def name(cls) -> str:
        return "gml"

    def schema(self) -> StructType:
        if "settings" not in self.options:
            raise SchemaError("give a schema, or settings from a scan")
        layers, _ = load_settings(self.options["settings"])
        out = layers[self.options["layer"]].struct()
        return out.add(StructField("_layer", StringType())) if self.options.get("with_layer") == "true" else out

    def reader(self, schema: StructType) -> DataSourceReader:
        if "settings" in self.options:  # paths and kinds don't survive in the schema that Spark hands back
            layers, _ = load_settings(self.options["settings"])
            known = {f.name: f for f in layers[self.options["layer"]].struct().fields}
            schema = StructType([known.get(f.name, f) for f in schema.fields])
        return GmlReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it push filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GmlDataSource)
