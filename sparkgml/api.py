"""scan() and read(): layers of GML documents as DataFrames."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions.crs import Context, Decision, Evidence, crs_of, decide, parse_srs
from .functions.version import detect_version
from .operators.observe import axis_evidence, headers, observations, observations_of, observe, srs_counts
from .operators.parse import ReadPlan, parse_documents, parse_layer, parse_report
from .plans.infer import InferenceOptions, infer
from .plans.schema import LayerSchema, SchemaError, load_settings, prefixes_for, settings_json
from .sources.inputs import of_bytes, sources
from .sources.split import SplitOptions, split_features


class NoFeatures(ValueError):
    """No input holds a feature."""


@dataclass
class ReadOptions:
    """Options of scan() and read()."""

    inference: InferenceOptions = field(default_factory=InferenceOptions)
    split: SplitOptions = field(default_factory=SplitOptions)
    axis_order: str = "auto"
    axis_overrides: dict[str, str] = field(default_factory=dict)
    target_crs: int | None = None
    linear: bool = False
    on_feature_error: str = "error"
    location_column: bool = False
    columns: list[str] | None = None
    preserve_order: bool = False
    sample_features: int | None = None  # the first of each source
    sample_total: int | None = None  # the first of all, in order of source
    spread: bool = False  # deal features anew after splitting: for documents that are few and large

    @classmethod
    def from_json(cls, text: str) -> ReadOptions:
        """All options as JSON: {"axis_order": ..., "inference": {...}, "split": {...}}; unknown names are errors."""

        def made(kind: type, given: dict[str, Any]) -> Any:
            known = {f.name for f in fields(kind)}
            if unknown := sorted(set(given) - known):
                raise SchemaError(f"option {', '.join(unknown)}")
            return kind(**given)

        data = json.loads(text)
        for k, kind in (("inference", InferenceOptions), ("split", SplitOptions)):
            if k in data:
                data[k] = made(kind, data[k])
        if isinstance(data.get("inference"), InferenceOptions):
            data["inference"].per_layer = [tuple(x) for x in data["inference"].per_layer]
        if isinstance(data.get("split"), SplitOptions):
            data["split"].member_rules = [tuple(x) for x in data["split"].member_rules]
        return made(cls, data)

    @classmethod
    def parse(cls, pairs: dict[str, str]) -> ReadOptions:
        """From key=value options."""
        out = cls()
        for k, v in pairs.items():
            if k == "preset":
                out.inference = replace(out.inference, preset=v)
            elif k == "axis_order":
                out.axis_order = v
            elif k in ("target_crs", "crs"):
                out.target_crs = int(str(v).upper().removeprefix("EPSG:"))
            elif k in ("sample_features", "sample_total"):
                setattr(out, k, int(v))
            elif k == "preserve_order":
                out.preserve_order = str(v).lower() == "true"
            elif k == "on_feature_error":
                out.on_feature_error = v
            elif k == "linear":
                out.linear = str(v).lower() == "true"
            elif k == "spread":
                out.spread = str(v).lower() == "true"
            elif k == "location":
                out.location_column = str(v).lower() == "true"
            elif k == "columns":
                out.columns = [c.strip() for c in v.split(",")]
            else:
                raise SchemaError(f"option {k}" + (": Spark's own settings and partitions govern this" if k in ("batch_size", "threads") else ": no grid files are used" if k in ("no_grids", "grid_dir") else ""))
        return out


def documents_of(spark: SparkSession, inputs: Any) -> DataFrame:
    """`inputs`: paths, a DataFrame (name, content), or {name: bytes}."""
    if isinstance(inputs, dict):
        return of_bytes(spark, list(inputs.items()))
    return inputs if isinstance(inputs, DataFrame) else sources(spark, inputs)


def features_of(spark: SparkSession, inputs: Any, options: ReadOptions) -> DataFrame:
    """The features of documents_of(), one row each."""
    features = split_features(documents_of(spark, inputs), options.split)
    return features.repartition(spark.sparkContext.defaultParallelism * 4) if options.spread else features


@dataclass
class Scan:
    """What a scan found: layers with counts, their schemas, axis decisions, skipped sources."""

    counts: dict[str, int]
    schemas: dict[str, LayerSchema]
    decisions: dict[tuple[str, str, str], Decision]
    skipped_sources: list[str]
    headers: list[dict[str, Any]]
    is_complete: bool
    extent: dict[str, tuple[float, float, float, float]]
    rows: list[dict[str, Any]]

    @property
    def layers(self) -> list[str]:
        return list(self.schemas)

    def schema(self, layer: str) -> LayerSchema:
        return self.schemas[pick(layer, self.layers)]

    def schema_with(self, layer: str, options: InferenceOptions) -> LayerSchema:
        """The schema that other options give on the same observation."""
        return infer(self.rows, options)[pick(layer, self.layers)]

    def explain(self) -> str:
        return "\n\n".join(f"{k} ({self.counts[k]} features)\n{s.explain()}" for k, s in self.schemas.items())

    def save(self) -> str:
        """A settings file: schemas, and the order of axes that was decided."""
        mode, overrides = self.plain_axis()
        return settings_json(list(self.schemas.values()), {"axis_order": mode, "axis_overrides": overrides} if self.decisions else None, self.prefixes())

    def warnings(self) -> list[tuple[str, str]]:
        """(kind, message) of what was found that a reader should know."""
        out = [("skipped source", s) for s in self.skipped_sources]
        for h in self.headers:
            if h.get("referenced"):
                out.append(("referenced member", f"{h['source']}: {h['referenced']} members that only refer"))
        for srs in sorted({k[1] for k in self.decisions}):
            name = parse_srs(srs)
            if name.code is None:
                out.append(("unknown srsName", srs))
            elif crs_of(name.code) is None:
                out.append(("unknown CRS", srs))
        return out + sorted({("axis conflict", f"{srs}: {c}") for (_, srs, _), d in self.decisions.items() for c in d.conflicts})

    def plain_axis(self) -> tuple[str, dict[str, str]]:
        """The decisions as one order and the srsNames that have the other: what most sources have, for each name and for all."""
        votes: dict[str, int] = {}
        for (_, srs, _), d in self.decisions.items():
            votes[srs] = votes.get(srs, 0) + (1 if d.swap else -1)
        names = {srs: "yx" if n > 0 else "xy" for srs, n in sorted(votes.items())}
        mode = "yx" if sum(1 if m == "yx" else -1 for m in names.values()) > 0 else "xy"
        return mode, {srs: m for srs, m in names.items() if m != mode}

    def prefixes(self) -> dict[str, str]:
        declared: dict[str, str] = {}
        for h in self.headers:
            for p, uri in h.get("namespaces", {}).items():
                declared.setdefault(p, uri)
        return {p: ns for ns, p in prefixes_for(sorted({s.namespace for s in self.schemas.values() if s.namespace}), declared).items()}


def pick(layer: str, layers: list[str]) -> str:
    """A layer by its key, {uri}local or local name; ambiguous and unknown names are errors."""
    if layer in layers:
        return layer
    hits = [x for x in layers if x.rpartition("}")[2] == layer.rpartition("}")[2].rpartition(":")[2]]
    if len(hits) != 1:
        raise SchemaError(f"layer {layer}: {'ambiguous' if hits else 'unknown'}; there are {', '.join(layers)}")
    return hits[0]


def contexts_of(headers: list[dict[str, Any]]) -> dict[str, Context]:
    out = {}
    for h in headers:
        a = h.get("attributes", {})
        located = a.get("schemaLocation", "")
        version = next((v for v in ("2.0", "1.1", "1.0") if f"wfs/{v}" in located or f"version={v}" in located.lower()), "")
        if not version and "wfs/2.0" in json.dumps(h.get("namespaces", {})):
            version = "2.0"
        text = json.dumps([h.get("namespaces", {}), located])
        who = "fme" if "safe.com" in text or "FME" in located else next((x for x in ("mapserver.gis.umn.edu", "/wfsserver") if x in text.lower()), "")
        if who or version:
            out[h["source"]] = Context(who, version)
    return out


def headers_of(seen: DataFrame) -> list[dict[str, Any]]:
    """One for each source; not for each feature."""
    return [json.loads(r.info) | {"source": r.source, "kind": r.kind} for r in headers(seen).coalesce(8).toLocalIterator()]


def decisions_of(seen: DataFrame, found: list[dict[str, Any]], options: ReadOptions) -> dict[tuple[str, str, str], Decision]:
    """By source, srsName and dialect; only the automatic mode looks at coordinates."""
    contexts, out = contexts_of(found), {}
    if options.axis_order == "auto":
        for r in axis_evidence(seen).coalesce(8).toLocalIterator():
            box = (r.e_a_min, r.e_b_min, r.e_a_max, r.e_b_max)
            e = Evidence((r.a_min, r.a_max), (r.b_min, r.b_max), [x for x in r.labels if x], None if None in box else box)
            out[r.source, r.srs, r.dialect] = decide(r.srs, r.dialect, e, contexts.get(r.source, Context()), "auto", options.axis_overrides)
    return out


def sampled(features: DataFrame, n: int) -> DataFrame:
    """The first n features of each source; of one cut by many tasks, of each block."""
    return features.where((F.col("kind") != "feature") | (F.coalesce("seq", F.lit(0)) < n))


def scan(spark: SparkSession, inputs: Any, options: ReadOptions | None = None) -> Scan:
    """Discover layers and infer their schemas from all features, or the first of each source."""
    options = options or ReadOptions()
    inference, skip_bad = options.inference, options.on_feature_error != "error"
    if options.spread or options.sample_features or options.sample_total:
        features = features_of(spark, inputs, options)
    else:
        features = None
    if options.sample_features:
        features, inference = sampled(features, options.sample_features), replace(inference, sampled=True)
    if options.sample_total:
        some = features.where("kind = 'feature'").orderBy("source", "seq", "start").limit(options.sample_total)
        features, inference = features.where("kind <> 'feature'").unionByName(some), replace(inference, sampled=True)
    seen = observations(features, skip_bad) if features is not None else observations_of(documents_of(spark, inputs), options.split, skip_bad)
    seen = seen.persist()  # a few rows for each task: one pass serves all that follows
    try:
        rows = [r.asDict(recursive=True) | {"first_seen": tuple(r.first_seen)} for r in observe(seen).collect()]  # as many as the layers have paths
        found = headers_of(seen)  # after all tasks have run at once, as it takes them one by one
        if not rows:
            raise NoFeatures("no features in the input")
        counted: dict[tuple, list] = {}
        for r in srs_counts(seen).collect():  # as many as paths have srsNames
            counted.setdefault((r.layer_ns, r.layer, r.path), []).append((-r.n, r.srs_name))
        for r in rows:  # the most frequent first
            first = [name for _, name in sorted(counted.get((r["layer_ns"], r["layer"], r["path"]), []))]
            r["srs"] = first + [x for x in r["srs"] if x not in first]
        decisions = decisions_of(seen, found, options)
        extent = {r.srs: (r.a_min, r.b_min, r.a_max, r.b_max) for r in axis_evidence(seen).groupBy("srs").agg(F.min("a_min").alias("a_min"), F.min("b_min").alias("b_min"), F.max("a_max").alias("a_max"), F.max("b_max").alias("b_max")).collect()}
    finally:
        seen.unpersist()
    schemas = infer(rows, inference)
    dialects = {k[2] for k in decisions}
    versions = {v for h in found if (v := detect_version(set(h.get("namespaces", {}).values()), h.get("attributes", {}).get("schemaLocation", ""), "", contexts_of([h]).get(h["source"], Context()).wfs_version, dialects))}
    for s in schemas.values():
        s.versions = ",".join(sorted(versions))
    local = {(r["layer_ns"], r["layer"]): r["instances"] for r in rows if r["path"] == ""}
    counts = {k: next(n for (ns, name), n in local.items() if k in (name, f"{{{ns}}}{name}") and s.namespace == ns) for k, s in schemas.items()}
    return Scan(counts, schemas, decisions, [h["source"] for h in found if h["kind"] == "skipped"], found, not inference.sampled, extent, rows)


@dataclass
class Layer:
    """A layer read: its rows, its schema, and (lazily) what reading it warns of."""

    df: DataFrame
    schema: LayerSchema
    plan: ReadPlan
    features: DataFrame

    def report(self) -> DataFrame:
        return parse_report(self.features, self.plan)


def only(options: ReadOptions, layer: str) -> ReadOptions:
    """Options whose splitter hands on a layer's features alone."""
    return replace(options, split=replace(options.split, layers=[layer])) if options.split.layers is None and layer else options


def read_layer(spark: SparkSession, inputs: Any, layer: str | None = None, schema: LayerSchema | StructType | dict | str | None = None, options: ReadOptions | None = None) -> Layer:
    """One layer as rows, with its schema and report.

    `schema` is a LayerSchema, a Spark schema, {column: type}, or a settings
    file's text; it is used as it is and is the projection. Without one the
    schema is inferred in a scan.
    """
    options = options or ReadOptions()
    if isinstance(schema, str):
        known, saved = load_settings(schema)
        if options.axis_order == "auto" and saved.get("axis_order"):
            options = replace(options, axis_order=saved["axis_order"], axis_overrides=saved.get("axis_overrides", {}) | options.axis_overrides)
        schema = known[pick(layer or next(iter(known)), list(known))]
    elif isinstance(schema, StructType):
        schema = LayerSchema.of_struct(layer or "", schema)
    elif isinstance(schema, dict):
        schema = LayerSchema.given(layer or "", schema)
    if schema is None:
        found = scan(spark, inputs, options)
        if layer is None and len(found.layers) > 1:
            raise SchemaError(f"which layer: {', '.join(found.layers)}?")
        schema, decisions, contexts = found.schema(layer or found.layers[0]), found.decisions, contexts_of(found.headers)
    elif any(c.type in ("geometry", "binary") for c in schema.columns) and options.axis_order == "auto":
        seen = observations_of(documents_of(spark, inputs), only(options, schema.layer).split, options.on_feature_error != "error", axis_only=True).persist()
        seen.count()  # all tasks at once; what follows takes them one by one
        heads = headers_of(seen)
        decisions, contexts = decisions_of(seen, heads, options), contexts_of(heads)
        seen.unpersist()
    else:
        decisions, contexts = {}, {}
    if options.columns:
        schema = schema.select(options.columns)
    features = features_of(spark, inputs, only(options, schema.layer))
    # tasks decide by the name alone where nothing else was decided: only other decisions are sent
    swaps = {k: d.swap for k, d in decisions.items() if d.swap != decide(k[1], k[2], None, contexts.get(k[0], Context()), options.axis_order, options.axis_overrides).swap}
    plan = ReadPlan(schema, options.on_feature_error, options.location_column or options.preserve_order, options.linear, options.target_crs, axis_mode=options.axis_order, axis_overrides=options.axis_overrides, swaps=swaps, contexts=contexts)
    df = parse_layer(features, plan) if options.spread else parse_documents(documents_of(spark, inputs), only(options, schema.layer).split, plan)
    if options.preserve_order:
        df = df.orderBy("_location.source", "_location.start")
        if not options.location_column:
            df = df.drop("_location")
    return Layer(df, schema, plan, features)


def read(spark: SparkSession, inputs: Any, layer: str | None = None, schema: Any = None, options: ReadOptions | None = None) -> DataFrame:
    """One layer as a DataFrame; see read_layer()."""
    return read_layer(spark, inputs, layer, schema, options).df
