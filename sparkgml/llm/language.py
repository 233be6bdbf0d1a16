"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, slices

#: Marks the ends of a word; no letter has this code.
EDGE = 1
#: Bits of a letter's code point within a packed n-gram of up to three.
BITS = 21


@cache
def letters() -> np.ndarray:
    """For every code point: itself if it is a letter, else the edge of a word."""
    return np.array([c if chr(c).isalpha() else EDGE for c in range(0x110000)], dtype=np.uint32)


def ngrams(text: str) -> np.ndarray:
    """All letter n-grams of 1 to 3, packed, with an edge at each end of a word; sorted."""
    codes = letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    edge = codes == EDGE
    codes = codes[np.concatenate([[True], ~(edge[1:] & edge[:-1])])]  # one edge between words
    c = codes.astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.uint64)
    one = c[c != EDGE]
    two = c[:-1] << np.uint64(BITS) | c[1:]
    three = two[:-1] << np.uint64(BITS) | c[2:]
    three = three[c[1:-1] != EDGE]
    out = np.concatenate([one, two, three])
    out.sort()
    return out


def tally(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and their counts."""
    at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[at], np.diff(np.append(at, len(grams)))


def ranked(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The `top` most frequent n-grams; ties by code."""
    if len(grams) > 4 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))[:top]]


def counted(batches: Iterator[pa.RecordBatch]):
    """N-gram counts of each language, for one task; emitted when they grow large."""

    def flush(table: dict):
        for lang, parts in table.items():
            grams, counts = merge_counts(parts)
            yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    table: dict[str, list] = {}
    held = 0
    for batch in slices(batches, "text"):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = tally(ngrams(text or ""))
            table.setdefault(lang, []).append(part)
            held += len(part[0])
        if held > 1 << 20:
            yield from flush(table)
            table, held = {}, 0
    yield from flush(table)


def merge_counts(parts: list) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    grams, where = np.unique(grams, return_inverse=True)
    return grams, np.bincount(where, counts, len(grams)).astype(np.int64)


def fit_profiles(docs: DataFrame, *, top: int = 600, sample: int = 5000) -> dict[str, np.ndarray]:
    """The `top` most frequent n-grams of each value of lang, in order of rank.

    `docs` has doc_id, text and lang; rows without lang or text are left out,
    and without any there are no profiles. Repeated rows count as often.
    About `sample` rows of a language at most are used, chosen by a hash of
    doc_id; all of a language that has fewer. Each value of lang costs some
    `top` rows on the driver.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 20, int(sample / n * (1 << 20)) + 1))])
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")])
    counts = chosen.select("lang", "text").mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # each task keeps the best of its rows, so that no language is sorted in one task
    best = counts.mapInArrow(lambda it: best_of(it, top), "lang string, gram long, n long").toArrow()
    pairs = {}
    for lang in sorted(sizes):
        own = best.filter(pc.equal(best["lang"], lang))
        pairs[lang] = ranked(own["gram"].to_numpy().view(np.uint64), own["n"].to_numpy(), top)
    return pairs


def best_of(batches: Iterator[pa.RecordBatch], top: int):
    """The `top` most frequent n-grams of each language among a task's rows; those after them are cut off now and then."""
    held: dict[str, list] = {}
    rows = 0

    def cut():
        for lang, parts in held.items():
            grams, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            at = np.lexsort((grams, -n))[:top]
            held[lang] = [(grams[at], n[at])]

    for batch in batches:
        langs, grams, n = batch.column(0), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
        for lang in pc.unique(langs).to_pylist():
            mine = np.flatnonzero(pc.equal(langs, lang).to_numpy(zero_copy_only=False))
            held.setdefault(lang, []).append((grams[mine], n[mine]))
        rows += batch.num_rows
        if rows > 1 << 18:
            cut()
            rows = 0
    cut()
    for lang, [(grams, n)] in held.items():
        yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


class Ranker:
    """Out-of-place distances between a text and every profile."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int):
        self.langs, self.top = sorted(profiles), top
        self.grams = np.unique(np.concatenate([profiles[x] for x in self.langs])) if self.langs else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); `und` and 0 without letters. The nearest profile wins, the first by name among equals."""
        if not text or not self.langs:
            return "und", 0.0
        grams = ngrams(text)
        if not len(grams):
            return "und", 0.0
        mine = ranked(*tally(grams), self.top)
        at = np.searchsorted(self.grams, mine)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == mine, at, len(self.grams))
        ranks = self.ranks[:, at]
        far = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(mine)))).sum(axis=1)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.top * len(mine)))


def language_id(docs: DataFrame, profiles: dict[str, np.ndarray], *, top: int = 600) -> DataFrame:
    """The rows of `docs` (doc_id, text): doc_id, lang_pred, score.

    A text's `top` most frequent letter n-grams (1 to 3 letters, word ends
    marked) are compared with each profile: an n-gram costs the difference of
    its two ranks, or `top` if the profile lacks it. The profile with the
    least sum wins; score is 1 less that sum over the greatest possible one.
    Texts that are null or have no letter give `und` and 0. Other columns are
    ignored, repeated rows have equal results; an empty table gives an empty
    result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def work(batches: Iterator[pa.RecordBatch]):
        ranker = Ranker(shared.value, top)
        for batch in slices(batches, "text"):
            found = [ranker.predict(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    frugal(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame, profiles: dict[str, np.ndarray], *, top: int = 600, min_score: float = 0.0) -> DataFrame:
    """The rows of `docs` whose text has a language, with all their columns; a null lang becomes the prediction.

    Texts that are null or have no letter go, and those whose nearest profile
    is full (`top` n-grams, so that it can tell) and gives a score below
    `min_score`. Without any profile letters alone decide. Repeated rows have
    equal results; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    schema = docs.schema
    fills = "lang" in schema.names and schema["lang"].dataType.simpleString() == "string"
    frugal(docs)

    def work(batches: Iterator[pa.RecordBatch]):
        ranker = Ranker(shared.value, top)
        full = {k for k, v in shared.value.items() if len(v) >= top}
        for batch in slices(batches, "text"):
            column = batch.column(batch.schema.get_field_index("text")).to_pylist()
            if not ranker.langs:
                yield batch.filter(pa.array([bool(x) and len(ngrams(x)) > 0 for x in column], pa.bool_()))
                continue
            found = [ranker.predict(x) for x in column]
            keep = pa.array([k != "und" and (score >= min_score or k not in full) for k, score in found], pa.bool_())
            if fills:
                at = batch.schema.get_field_index("lang")
                lang = batch.column(at)
                batch = batch.set_column(at, batch.schema.field(at), pa.array([k if old is None else old for (k, _), old in zip(found, lang.to_pylist(), strict=True)], lang.type))
            yield batch.filter(keep)

    return docs.mapInArrow(work, schema)
