"""Table functions for SQL: read_gml('path', 'Layer', 'key=value', ...) and, for many files, read_gml_files(TABLE(...), 'Layer', settings)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.crs import Context, Evidence, decide
from ..operators.observe import Observer, bounded_info
from ..operators.parse import ReadPlan
from ..plans.schema import LayerSchema, SchemaError, load_settings
from .datasource import named_batches
from .inputs import as_utf8, members, unpacked
from .split import SplitOptions, Splitter, parse_trees

OPTIONS = ("settings", "preset", "axis_order", "target_crs", "on_feature_error", "linear")


def options_of(pairs: list[str]) -> dict[str, str]:
    """From key=value texts; the first may be a settings file's name alone."""
    out = {}
    for i, text in enumerate(pairs):
        key, found, value = text.partition("=")
        if not found and not i:
            key, value = "settings", text
        if key.strip() not in OPTIONS:
            raise SchemaError(f"read_gml: option {text!r}")
        out[key.strip()] = value.strip()
    return out


def evidence_of(docs: Iterator[tuple[str, bytes]], layer: str) -> Observer:
    """Axis evidence of a layer's features, in one process; other statistics aren't kept."""
    o, known = Observer(), {}
    for name, data in docs:
        for _, start, _, ns, local, context, bounded, xml in Splitter(data, SplitOptions(layers=[layer])).run():
            (tree,) = parse_trees([xml], [context], known)
            if isinstance(tree, Exception):
                raise tree
            o.feature(name, start, ns, local, tree, bounded_info(bounded), axis_only=True)
    return o


def rows_of(docs: Iterator[tuple[str, bytes]], schema: LayerSchema, layer: str, options: dict[str, str]) -> Iterator[tuple]:
    target = options.get("target_crs")
    plan = ReadPlan(schema, options.get("on_feature_error", "error"), linear=options.get("linear") == "true", target_crs=int(target.upper().removeprefix("EPSG:")) if target else None, axis_mode=options.get("axis_order", "auto"))
    docs = list(docs) if plan.axis_mode == "auto" and any(c.type == "geometry" for c in schema.columns) else docs
    if isinstance(docs, list):  # axes go by evidence
        for b in evidence_of(iter(docs), layer).axis_rows():
            for r in b.to_pylist():
                e = Evidence((r["a_min"], r["a_max"]), (r["b_min"], r["b_max"]), [r["labels"]] if r["labels"] else [])
                plan.swaps[r["source"], r["srs_name"], r["dialect"]] = decide(r["srs_name"], r["dialect"], e, Context()).swap
    for b in named_batches(docs, layer, plan):
        yield from zip(*(x.to_pylist() for x in b.columns), strict=True)


def constant(a: AnalyzeArgument, what: str) -> str:
    if a.value is None or not isinstance(a.value, str):
        raise SchemaError(f"read_gml: {what} has to be a text")
    return a.value


def layer_of(spark: SparkSession, path: str, layer: str, *pairs: str) -> DataFrame:
    """read_gml()'s rows: without settings the layer's schema is inferred from all its features, in a scan by tasks."""
    from ..api import NoFeatures, ReadOptions, read

    chosen = options_of(list(pairs))
    settings, schema = chosen.pop("settings", None), None
    if settings is not None:
        layers, _ = load_settings(bytes_of(spark, settings).decode("utf-8"))
        schema = layers.get(layer)
    options = ReadOptions.parse(chosen)
    options.split = SplitOptions(layers=[layer])
    try:
        return read(spark, path, layer, schema, options)
    except NoFeatures:
        raise SchemaError(f"read_gml: no layer {layer} in {path}") from None


def bytes_of(spark: SparkSession, path: str) -> bytes:
    """A small file, of any file system that Spark reads."""
    return bytes(spark.read.format("binaryFile").load(path).first().content)


class ReadGml:
    """Spark's builder of a table function: constant arguments to the plan that reads the files, so that its tasks share the work."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def apply(self, arguments):
        texts = []
        for i in range(arguments.length()):
            a = arguments.apply(i)
            value = a.eval(None) if a.foldable() else None
            if value is None or a.dataType().typeName() != "string":
                raise SchemaError(f"read_gml: {('path', 'layer', 'option')[min(i, 2)]} has to be a text")
            texts.append(value.toString())
        if len(texts) < 2:
            raise SchemaError("read_gml: give a path and a layer")
        return layer_of(self.spark, *texts)._jdf.queryExecution().analyzed()

    class Java:
        implements = ["scala.Function1"]


class ReadGmlFiles:
    """Rows (path, content) of binary files, so that Spark deals the files to its tasks; settings is a settings file's text."""

    @staticmethod
    def analyze(files: AnalyzeArgument, layer: AnalyzeArgument, settings: AnalyzeArgument) -> AnalyzeResult:
        layers, _ = load_settings(constant(settings, "settings"))
        return AnalyzeResult(schema=T.StructType(list(layers[constant(layer, "layer")].struct().fields)))

    def eval(self, row: T.Row, layer: str, settings: str):
        layers, options = load_settings(settings)
        docs = [(row["path"], row["content"])]
        if bytes(row["content"][:4]) == b"PK\x03\x04":
            docs = list(members(row["path"], bytes(row["content"]), None))
        yield from rows_of(((n, as_utf8(unpacked(bytes(d)))) for n, d in docs), layers[layer], layer, {k: str(v) for k, v in options.items() if k in OPTIONS})


def register(spark: SparkSession) -> None:
    """Make read_gml and read_gml_files known to SQL."""
    from pyspark.java_gateway import ensure_callback_server_started
    from pyspark.sql.functions import udtf

    ensure_callback_server_started(spark.sparkContext._gateway)
    spark._jsparkSession.sessionState().tableFunctionRegistry().createOrReplaceTempFunction("read_gml", ReadGml(spark), "built-in")
    spark.udtf.register("read_gml_files", udtf(ReadGmlFiles))
