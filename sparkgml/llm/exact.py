"""Exact deduplication through a log-structured merge index of digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, frugal, numbered, pin, restored, slices, texts

#: Filters of compacted runs: bits for each digest, bits set for it, and bits of all filters together at most.
BITS_PER_HIT, PROBES, FILTER_BITS = 12, 4, 1 << 30
#: Digests of several rows in a compacted run, about.
RUN_HITS = 1 << 16


def normal(text: bytes) -> bytes:
    return text.translate(None, WS)


def code_points(text: bytes) -> int:
    return len(text.decode("utf-8", "replace"))


def runs(size: int, entries: int):
    """Fill memtables and flush each as a sorted run: for a digest the first keeper and the count."""

    def flush(table: dict) -> pa.RecordBatch:
        keys = sorted(table)
        best = [table[k] for k in keys]
        return pa.record_batch([pa.array(keys, pa.binary()), *(pa.array([x[c] for x in best], pa.int64()) for c in range(3))], ["digest", "shorter", "id", "n"])

    def work(batches: Iterator[pa.RecordBatch]):
        table: dict[bytes, tuple] = {}
        for batch in slices(batches, "text"):
            for i, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                key, mine = hashlib.sha256(normal(text)).digest()[:size], (-code_points(text), i)
                if old := table.get(key):
                    table[key] = (*min(old[:2], mine), old[2] + 1)
                else:
                    table[key] = (*mine, 1)
            if len(table) >= entries:
                yield flush(table)
                table = {}
        if table:
            yield flush(table)

    return work


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two words of each digest; short digests are filled up."""
    both = np.frombuffer(b"".join(x[:8].ljust(8, b"\0") + x[8:16].ljust(8, b"\1") for x in digests), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1] | np.uint64(1)


class RunFilter:
    """A Bloom filter over the digests of a compacted run."""

    def __init__(self, digests: list[bytes], bits: int):
        self.words = np.zeros(max(1, bits >> 6), np.uint64)
        at = self.places(*halves(digests)).ravel()
        np.bitwise_or.at(self.words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.array([((a + np.uint64(i) * b) % np.uint64(len(self.words) << 6)).astype(np.int64) for i in range(PROBES)])

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.places(a, b)
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool).all(axis=0)

    @classmethod
    def of(cls, words: bytes) -> RunFilter:
        out = cls.__new__(cls)
        out.words = np.frombuffer(words, np.uint64)
        return out


def run_of(a: np.ndarray, count: int) -> np.ndarray:
    """The compacted run that digests belong to, by their first word."""
    return ((a >> np.uint64(16)) % np.uint64(count)).astype(np.int64)


def filters(count: int, bits: int):
    """Rows (run, digest) sorted by run: a filter for each run."""

    def work(batches: Iterator[pa.RecordBatch]):
        run, held = None, []
        for batch in batches:
            for r, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != run and held:
                    yield pa.record_batch([pa.array([run], pa.int64()), pa.array([RunFilter(held, bits).words.tobytes()], pa.binary())], ["run", "words"])
                    held = []
                run = r
                held.append(key)
        if held:
            yield pa.record_batch([pa.array([run], pa.int64()), pa.array([RunFilter(held, bits).words.tobytes()], pa.binary())], ["run", "words"])

    return work


def in_runs(count: int):
    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            if keys:
                yield pa.record_batch([pa.array(run_of(halves(keys)[0], count)), batch.column(0)], ["run", "digest"])

    return work


def suspects(size: int, count: int, found: list[tuple[int, bytes]], held: int):
    """Texts whose digest a run's filter has; each task compares its own and passes one of each digest on."""

    def work(batches: Iterator[pa.RecordBatch]):
        known = {r: RunFilter.of(w) for r, w in found}
        table, kept = {}, 0
        for batch in slices(batches, "text"):
            bodies = [normal(t) for t in texts(batch.column(1))]
            keys = [hashlib.sha256(x).digest()[:size] for x in bodies]
            a, b = halves(keys)
            run, hit = run_of(a, count), np.zeros(len(keys), bool)
            for r in np.unique(run).tolist():
                if r in known:
                    at = np.flatnonzero(run == r)
                    hit[at] = known[r].has(a[at], b[at])
            out: list[tuple] = []
            for i in np.flatnonzero(hit).tolist():
                key, body = keys[i], bodies[i]
                if (old := table.get(key)) is None:
                    table[key], kept = body, kept + len(body) + 100
                    out.append((key, body))
                elif old != body:
                    out.append((key, body))
            if out:
                yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["digest", "body"])
            if kept > held:
                table, kept = {}, 0

    return work


def differing(batches: Iterator[pa.RecordBatch]):
    """Over rows sorted by digest: the digests that stand for more than one text."""
    last, body, told = None, None, False
    for batch in batches:
        out = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != last:
                last, body, told = key, text, False
            elif text != body and not told:
                told = True
                out.append(key)
        yield pa.record_batch([pa.array(out, pa.binary())], ["digest"])


def digests(size: int):
    def work(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text"):
            raw = texts(batch.column(1))
            full = [hashlib.sha256(normal(t)) for t in raw]
            yield pa.record_batch([batch.column(0), pa.array([-code_points(t) for t in raw], pa.int64()), pa.array([x.digest()[:size] for x in full], pa.binary()), pa.array([x.hexdigest() for x in full], pa.string())], ["id", "shorter", "digest", "text_sha256"])

    return work


def exact_dedup(docs: DataFrame, *, digest_bytes: int = 32, memtable_entries: int = 200_000, memtable_bytes: int = 32 << 20, run_hits: int = RUN_HITS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after all characters of [\\x20\\x09-\\x0D]
    are deleted; null counts as empty. The row with the most code points,
    then the smallest doc_id, stays: one row of each group. Null and repeated
    doc_ids are rows of their own; a null doc_id sorts before all others.
    Other columns of `docs` are ignored; an empty table gives an empty result.

    Memtables of each task flush sorted runs of (digest, first keeper,
    count), so copies inside a task shrink to one entry before anything is
    shuffled. Compaction merges the runs by digest; what it keeps, digests of
    several rows with their smallest identifier, is dealt by digest into runs
    of about `run_hits`, each with a filter. A second scan passes only texts
    that hit a filter, compares those of one task there and one of each
    digest and task after a sort by digest. Digests that stand for different
    texts are regrouped by the text itself. All filters together have at most
    128 MB, so beyond 89 million digests of several rows they let more and
    more texts through, at worst one of each digest and task.
    """
    frugal(docs)
    spark = docs.sparkSession
    named, new = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    rows = named.select(F.col("doc_id").alias("id"), "text")
    level0 = rows.mapInArrow(runs(digest_bytes, memtable_entries), "digest binary, shorter long, id long, n long")
    level1 = level0.groupBy("digest").agg(F.min(F.struct("shorter", "id")).alias("best"), F.sum("n").alias("n"))
    hits = pin(level1.where("n > 1").select("digest", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size")))
    n = hits.count()
    count = max(1, -(-n // run_hits))
    bits = max(64, min(BITS_PER_HIT * -(-n // count), FILTER_BITS // count))
    level2 = hits.select("digest").mapInArrow(in_runs(count), "run long, digest binary").repartition(F.col("run")).sortWithinPartitions("run")
    found = [(r.run, bytes(r.words)) for r in level2.mapInArrow(filters(count, bits), "run long, words binary").toLocalIterator()]
    shared = spark.sparkContext.broadcast(found)
    checked = rows.mapInArrow(lambda it: suspects(digest_bytes, count, shared.value, memtable_bytes)(it), "digest binary, body binary")
    clashes = pin(checked.repartition(F.col("digest")).sortWithinPartitions("digest").mapInArrow(differing, "digest binary"))

    probed = rows.mapInArrow(digests(digest_bytes), "id long, shorter long, digest binary, text_sha256 string")
    if clashes.isEmpty():
        out = decided(probed.join(hits, "digest", "left"))
    else:
        bad = clashes.distinct()
        firsts = probed.join(bad, "digest", "left_semi").groupBy("text_sha256").agg(F.min(F.struct("shorter", "id")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        firsts = firsts.select("text_sha256", F.col("best.id").alias("keep_id"), "group_size")
        out = decided(probed.join(bad, "digest", "left_anti").join(hits, "digest", "left")).unionByName(decided(probed.join(bad, "digest", "left_semi").join(firsts, "text_sha256", "left")))
    return restored(out, named, "doc_id", "keep_id") if new else out


def decided(joined: DataFrame) -> DataFrame:
    keep = F.coalesce("keep_id", "id")
    return joined.select(F.col("id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (F.col("id") == keep).alias("kept"), "text_sha256")
