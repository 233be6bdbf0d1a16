"""Inputs as rows (name, content): files, folders, globs, archives and their members, URLs, bytes; unpacked, as UTF-8."""

from __future__ import annotations

import codecs
import fnmatch
import gzip
import io
import re
import sys
import time
import urllib.error
import urllib.request
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, content binary"
#: What folders and archives are searched for.
SUFFIXES = (".gml", ".xml", ".gml.gz", ".xml.gz", ".gml.zst", ".xml.zst", ".zip")
MEMBER_SUFFIXES = (".gml", ".xml", ".gml.gz", ".xml.gz")
BARRIER = "!/"


class SourceError(ValueError):
    """An input that can't be opened or decoded."""


def unpacked(data: bytes) -> bytes:
    """gzip (of any number of members) and zstd are told by their first bytes."""
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return pa.CompressedInputStream(pa.BufferReader(data), "zstd").read()
    return data


def encoding_of(data: bytes) -> str:
    """Byte order mark, then the look of UTF-16, then the declaration, then UTF-8."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return name
    if data[:2] == b"<\0":
        return "utf-16-le"
    if data[:2] == b"\0<":
        return "utf-16-be"
    m = re.match(rb"\s*<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._-]+)[\"']", data[:200])
    label = m[1].decode().lower() if m else "utf-8"
    if label.startswith(("utf-16", "ucs-2", "iso-10646-ucs-2")):
        return "utf-8"  # a declaration that can be read byte by byte isn't UTF-16
    try:
        return codecs.lookup(label).name
    except LookupError:
        raise SourceError(f"unknown encoding {label}") from None


def as_utf8(data: bytes) -> bytes:
    name = encoding_of(data)
    if name in ("utf-8", "ascii"):
        return data
    try:
        return data.decode(name).encode("utf-8")
    except UnicodeDecodeError as e:
        raise SourceError(f"not {name}: {e.reason} at byte {e.start}") from None


def glob_matches(name: str, pattern: str) -> bool:
    """* and ? stay within a path step."""
    steps, wanted = name.split("/"), pattern.split("/")
    return len(steps) == len(wanted) and all(fnmatch.fnmatchcase(s, w) for s, w in zip(steps, wanted, strict=True))


def filesystem_read(path: str) -> bytes:
    """A whole file, of any store that pyarrow knows by its URI."""
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    with fs.open_input_file(name) as f:
        return f.read()


def member_names(name: str, file, pattern: str | None) -> list[str]:
    """What members() would give, by the archive's directory alone."""
    with zipfile.ZipFile(file) as z:
        return [i.filename for i in chosen_members(name, z, pattern)]


def chosen_members(name: str, z: zipfile.ZipFile, pattern: str | None) -> list[zipfile.ZipInfo]:
    infos = sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.filename)
    if pattern is not None and not re.search(r"[*?\[]", pattern):
        infos = [i for i in infos if i.filename == pattern]
        if not infos:
            raise SourceError(f"{name} has no member {pattern}")
    else:
        infos = [i for i in infos if i.filename.lower().endswith(MEMBER_SUFFIXES) and (pattern is None or glob_matches(i.filename, pattern))]
    for i in infos:
        if i.flag_bits & 1:
            raise SourceError(f"{name}{BARRIER}{i.filename} is encrypted")
        if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise SourceError(f"{name}{BARRIER}{i.filename}: compression method {i.compress_type}")
    return infos


def members(name: str, data: bytes, pattern: str | None) -> Iterator[tuple[str, bytes]]:
    """Members of a zip: those with a known suffix, or matching a glob, or the one named."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i in chosen_members(name, z, pattern):
            yield f"{name}{BARRIER}{i.filename}", z.read(i)


def opened(patterns: dict[str, str | None]):
    """Archives become their members; all is unpacked and transcoded."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts: Iterable[tuple[str, bytes]] = [(name, data)]
                if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
                    pattern = next((p for k, p in patterns.items() if name.endswith(k)), None)
                    parts = members(name, data, pattern)
                for part, content in parts:
                    yield pa.record_batch([pa.array([part]), pa.array([as_utf8(unpacked(content))], pa.binary())], ["name", "content"])

    return work


def sources(spark: SparkSession, inputs: str | list[str], *, timeout: float = 30, retries: int = 3, headers: dict[str, str] | None = None) -> DataFrame:
    """Rows (name, content) of all inputs, sorted by the reader by name.

    An input is a file, a folder (searched below for known suffixes), a glob,
    an archive, `archive!/member` or `archive!/glob`, of any file system that
    Spark reads, an http(s) URL, or `-` for standard input. Files are read
    by executors, one row each.
    """
    inputs = [inputs] if isinstance(inputs, str) else list(inputs)
    if not inputs:
        raise SourceError("no inputs")
    urls = [x for x in inputs if re.match("https?://", x)]
    given = [("stdin", sys.stdin.buffer.read())] if "-" in inputs else []
    if remote := [x for x in urls if BARRIER in x.partition("://")[2] or x.partition("?")[0].lower().endswith(".zip")]:
        raise SourceError(f"archives can't be read over http: {remote[0]}")
    paths = [x for x in inputs if x not in urls and x != "-"]
    patterns: dict[str, str | None] = {}
    plain: list[str] = []
    for p in paths:
        path, found, member = p.partition(BARRIER)
        if found:
            patterns[path] = member
        plain.append(path)
    frames = []
    if plain:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(plain)
        folders = [p.rstrip("/") for p in plain if is_folder(spark, p)]
        if folders:  # of folders only what looks like a document
            own = F.lit(False)
            for p in folders:
                own |= F.col("path").contains(re.sub(r"^\w+:/*", "/", p) + "/")
            files = files.where(~own | F.lower("path").rlike("(" + "|".join(map(re.escape, SUFFIXES)) + ")$"))
        frames.append(files.select(F.col("path").alias("name"), "content"))
    if urls:
        frames.append(spark.createDataFrame([(u,) for u in urls], "name string").repartition(len(urls)).mapInArrow(fetched(timeout, retries, headers or {}), SCHEMA))
    if given:
        frames.append(of_bytes(spark, given))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.mapInArrow(opened(patterns), SCHEMA)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path, of any file system that Spark reads, is a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return not re.search(r"[*?\[{]", path) and fs.exists(where) and fs.getFileStatus(where).isDirectory()


def of_bytes(spark: SparkSession, parts: list[tuple[str, bytes]]) -> DataFrame:
    """Documents that the driver has in memory."""
    return spark.createDataFrame(parts, SCHEMA)


def fetched(timeout: float, retries: int, headers: dict[str, str]):
    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for url in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array([url]), pa.array([http_get(url, timeout=timeout, retries=retries, headers=headers)], pa.binary())], ["name", "content"])

    return work


def http_get(url: str, *, timeout: float = 30, retries: int = 3, headers: dict[str, str] | None = None, body: bytes | None = None) -> bytes:
    """One request; 5xx, 429 and network failures are tried again, after Retry-After if it is given."""
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers or {}), timeout=timeout) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if attempt == retries or e.code != 429 and e.code < 500:
                raise SourceError(f"{url}: HTTP {e.code}") from None
            wait = e.headers.get("Retry-After") or ""
            time.sleep(min(60.0, float(wait)) if wait.isdigit() else 0.2 * 2**attempt)
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if attempt == retries:
                raise SourceError(f"{url}: {e}") from None
            time.sleep(0.2 * 2**attempt)
    raise AssertionError
