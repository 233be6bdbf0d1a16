"""Removal of lines that many documents share, through a sharded minimal perfect hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, frugal, mix, numbered, pin, restored, slices, texts

#: Bits of a level for each key that is placed there, and levels at most.
GAMMA, LEVELS = 2.0, 40
#: Table rows of one shard, table bytes that are sent to every executor, and asked rows that probe one copy of a shard's table.
SHARD_KEYS, TABLE_BYTES, COPY_ROWS = 1 << 18, 32 << 20, 1 << 20


def key_hash(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def keys_of(text: bytes) -> list[bytes]:
    """The keys of a text's lines: stripped of [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    return [x.strip(WS).lower() for x in text.split(b"\n")]


class PerfectHash:
    """Maps n 64-bit keys to 0..n-1; other keys go anywhere, so the fingerprints decide.

    Each level has a bit array; a key that is alone on its bit stays there,
    the others go to the next level. A key's number is the count of bits
    before its own. Keys that no level takes, as they are equal and only
    their fingerprints differ, are kept in a list of their own after the
    others.
    """

    def __init__(self, keys: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray):
        levels, rest = [], np.arange(len(keys))
        for level in range(LEVELS):
            if not len(rest):
                break
            size = max(64, int(GAMMA * len(rest)) + 63 & ~63)
            at = mix(keys[rest], level) % np.uint64(size)
            where, n = np.unique(at, return_counts=True)
            bits = np.zeros(size, dtype=np.uint8)
            bits[where[n == 1].astype(np.int64)] = 1
            levels.append(bits)
            rest = rest[bits[at.astype(np.int64)] == 0]
        self.sizes = [len(x) for x in levels]
        self.bits = np.packbits(np.concatenate(levels), bitorder="little") if levels else np.zeros(0, np.uint8)
        self._ranks()
        placed = np.ones(len(keys), bool)
        placed[rest] = False
        slots = self.slots(keys[placed])
        self.over = keys[rest]
        self.fingerprints, self.counts = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint32)
        self.fingerprints[slots], self.counts[slots] = fingerprints[placed], counts[placed]
        last = len(keys) - len(rest)
        self.fingerprints[last:], self.counts[last:] = fingerprints[rest], counts[rest]

    def _ranks(self) -> None:
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        ones = np.bitwise_count(self.bits.view(np.uint64)).astype(np.int64) if len(self.bits) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where it is on no level."""
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        words = self.bits.view(np.uint64)
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = (mix(keys[open_], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            found = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[found]] = (self.before[at >> 6] + below)[found]
            open_ = open_[~found]
        return out

    def counts_of(self, keys: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
        """The count of each key, 0 where it is not in the table."""
        if not len(self.counts):
            return np.zeros(len(keys), np.uint32)
        slots = self.slots(keys)
        safe = np.maximum(slots, 0)
        out = np.where((slots >= 0) & (self.fingerprints[safe] == fingerprints), self.counts[safe], np.uint32(0))
        last = len(self.counts) - len(self.over)
        for i, key in enumerate(self.over, last):
            out[(keys == key) & (fingerprints == self.fingerprints[i])] = self.counts[i]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.sizes), len(self.counts), len(self.over), *self.sizes], dtype=np.int64)
        return b"".join(x.tobytes() for x in (head, self.bits, self.fingerprints, self.over, self.counts))

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        out = cls.__new__(cls)
        levels, n, over = (int(x) for x in np.frombuffer(data, np.int64, 3))
        out.sizes = np.frombuffer(data, np.int64, levels, 24).tolist()
        at = 24 + 8 * levels
        out.bits = np.frombuffer(data, np.uint8, sum(out.sizes) // 8, at)
        out.fingerprints = np.frombuffer(data, np.uint64, n, at := at + len(out.bits))
        out.over = np.frombuffer(data, np.uint64, over, at := at + 8 * n)
        out.counts = np.frombuffer(data, np.uint32, n, at + 8 * over)
        out._ranks()
        return out


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def counted(min_chars: int, entries: int):
    """How many documents of a task have each key; flushed when there are many keys."""

    def flush(table: dict) -> pa.RecordBatch:
        a, b = halves(list(table))
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(list(table.values()), pa.int64())], ["key", "fingerprint", "n"])

    def work(batches: Iterator[pa.RecordBatch]):
        table: dict[bytes, int] = {}
        for batch in slices(batches, "text"):
            for text in texts(batch.column(1)):
                for key in set(keys_of(text)):
                    if long_enough(key, min_chars):
                        h = key_hash(key)
                        table[h] = table.get(h, 0) + 1
            if len(table) >= entries:
                yield flush(table)
                table = {}
        if table:
            yield flush(table)

    return work


def long_enough(key: bytes, min_chars: int) -> bool:
    return bool(key) if min_chars <= 1 else len(key.decode("utf-8", "replace")) >= min_chars


def built(batches: Iterator[pa.RecordBatch]):
    """Rows sorted by shard become one table for each shard."""
    shard, parts = None, []

    def done():
        keys, fingerprints, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        table = PerfectHash(keys.view(np.uint64), fingerprints.view(np.uint64), np.minimum(counts, 2**32 - 1).astype(np.uint32))
        return pa.record_batch([pa.array([shard], pa.int64()), pa.array([table.dump()], pa.binary())], ["shard", "data"])

    for batch in batches:
        shards, *columns = (x.to_numpy() for x in batch.columns)
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for part, *rest in zip(np.split(shards, cuts), *(np.split(x, cuts) for x in columns), strict=True):
            if not len(part):
                continue
            if parts and part[0] != shard:
                yield done()
                parts = []
            shard = int(part[0])
            parts.append(rest)
    if parts:
        yield done()


def report(ids: pa.Array, raw: list[bytes], drop) -> pa.RecordBatch:
    """drop: for each text the numbers of its dropped lines."""
    n_lines, n_dropped, kept = [], [], []
    for text, gone in zip(raw, drop, strict=True):
        lines = text.split(b"\n")
        n_lines.append(len(lines))
        n_dropped.append(len(gone))
        if len(gone):
            gone = set(gone)
            text = b"\n".join(x for i, x in enumerate(lines) if i not in gone)
        kept.append(text)
    return pa.record_batch([ids.cast(pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])], ["doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256"])


def probe(tables: list[bytes], shards: int, min_docs: int, min_chars: int):
    def work(batches: Iterator[pa.RecordBatch]):
        index = {s: PerfectHash.load(x) for s, x in tables}
        for batch in slices(batches, "text"):
            raw = texts(batch.column(1))
            keys = [keys_of(x) for x in raw]
            owner = np.repeat(np.arange(len(raw)), [len(x) for x in keys])
            number = np.concatenate([np.arange(len(x)) for x in keys])
            flat = [k for x in keys for k in x]
            a, b = halves([key_hash(k) for k in flat])
            shard = shard_of(a, shards)
            hit = np.zeros(len(a), bool)
            for s, table in index.items():
                at = np.flatnonzero(shard == s)
                hit[at] = table.counts_of(a[at], b[at]) >= min_docs
            at = [i for i in np.flatnonzero(hit) if long_enough(flat[i], min_chars)]
            drop: list[list[int]] = [[] for _ in raw]
            for i in at:
                drop[owner[i]].append(int(number[i]))
            yield report(batch.column(0), raw, drop)

    return work


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def routed(min_chars: int, copies: np.ndarray):
    """One row for each document and distinct key: shard, the table's copy that it asks, key, fingerprint, document."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text", 1 << 20):
            ids, digests = [], []
            for i, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                mine = [key_hash(k) for k in set(keys_of(text)) if long_enough(k, min_chars)]
                ids += [i] * len(mine)
                digests += mine
            if ids:
                a, b = halves(digests)
                i, shard = np.array(ids, np.int64), shard_of(a, len(copies))
                copy = (mix(i.view(np.uint64), 3) % copies[shard].astype(np.uint64)).astype(np.int64)
                yield pa.record_batch([pa.array(shard), pa.array(copy), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(i)], ["shard", "copy", "key", "fingerprint", "id"])

    return work


def looked_up(min_docs: int):
    """Rows sorted by shard and copy, first the table and then who asks it: those whose lines are to be dropped."""

    def work(batches: Iterator[pa.RecordBatch]):
        table = None
        for batch in batches:
            data = batch.column(5)
            tables = np.flatnonzero(data.is_valid().to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip([0, *tables], [*tables, batch.num_rows], strict=True):
                if a in tables:
                    table, a = PerfectHash.load(data[a].as_py()), a + 1
                if a >= b:
                    continue
                key, fingerprint = (batch.column(i).slice(a, b - a).to_numpy().view(np.uint64) for i in (2, 3))
                keep = pa.array(table.counts_of(key, fingerprint) >= min_docs)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a).filter(keep) for i in (4, 2, 3)], ["id", "key", "fingerprint"])

    return work


def removed(batches: Iterator[pa.RecordBatch]):
    """Texts with the hashes of the keys to be dropped."""
    for batch in slices(batches, "text"):
        raw, drop = texts(batch.column(1)), []
        for text, gone in zip(raw, batch.column(2).to_pylist(), strict=True):
            gone = {x["key"] & 2**64 - 1 | (x["fingerprint"] & 2**64 - 1) << 64 for x in gone or ()}
            drop.append([n for n, k in enumerate(keys_of(text)) if int.from_bytes(key_hash(k), "little") in gone] if gone else [])
        yield report(batch.column(0), raw, drop)


def line_dedup(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, memtable_entries: int = 200_000, shard_keys: int = SHARD_KEYS, table_bytes: int = TABLE_BYTES, copy_rows: int = COPY_ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_lines, n_dropped, kept_text, kept_sha256.

    Lines end at \\n; a null or empty text is one empty line. A line's key is
    the line stripped of [\\x20\\x09-\\x0D] at both ends with A-Z lower-cased.
    Keys of at least `min_chars` code points that at least `min_docs` rows
    hold lose all their lines in every row; the others stay, joined by \\n.
    Null and repeated doc_ids are documents of their own. Other columns are
    ignored; an empty table gives an empty result.

    A key is known by 128 bits of hash. Counts are summed in each task, then
    by key. The keys that reach `min_docs` (no other can be dropped) are
    dealt into shards by their hash; each shard becomes a minimal perfect
    hash with an array of 64-bit fingerprints and one of counts. While all
    shards together have at most `table_bytes`, every task probes them in
    memory; beyond that, each document's distinct line hashes go to their
    shard, stream past its table, which is there once, and those that are to
    be dropped come back to their documents. A shard that many documents ask
    has several copies, about one for `copy_rows` of them.
    """
    frugal(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(counted(min_chars, memtable_entries), "key long, fingerprint long, n long").groupBy("key", "fingerprint").agg(F.sum("n").alias("n"))
    common = pin(counts.where(F.col("n") >= min_docs))
    n = common.count()
    shards = max(1, -(-n // shard_keys))
    # as in shard_of(): the upper half of the key, unsigned
    sharded = common.select((F.shiftrightunsigned("key", 32) % shards).alias("shard"), "key", "fingerprint", "n")
    tables = pin(sharded.repartition(F.col("shard")).sortWithinPartitions("shard").mapInArrow(built, "shard long, data binary"))
    result = "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string"
    if n * 13 <= table_bytes:
        shared = docs.sparkSession.sparkContext.broadcast([(r.shard, bytes(r.data)) for r in tables.toLocalIterator()])
        return rows.mapInArrow(lambda it: probe(shared.value, shards, min_docs, min_chars)(it), result)
    named, new = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    rows = named.select(F.col("doc_id").alias("id"), "text")
    # what a shard's common keys alone are asked; other keys are spread evenly
    asked = sharded.groupBy("shard").agg(F.sum("n").alias("n")).toArrow()
    copies = np.ones(shards, np.int64)
    copies[asked["shard"].to_numpy()] += asked["n"].to_numpy() // copy_rows
    many = docs.sparkSession.sparkContext.broadcast(copies)
    of = asked_copies(tables, copies)
    asks = rows.mapInArrow(lambda it: routed(min_chars, many.value)(it), "shard long, copy long, key long, fingerprint long, id long").withColumn("data", F.lit(None).cast("binary"))
    both = of.select("shard", "copy", *[F.lit(None).cast("long").alias(c) for c in ("key", "fingerprint", "id")], "data").unionByName(asks)
    found = both.repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("data").isNull()).mapInArrow(looked_up(min_docs), "id long, key long, fingerprint long")
    drop = found.groupBy("id").agg(F.collect_list(F.struct("key", "fingerprint")).alias("drop"))
    out = rows.join(drop, "id", "left").select("id", "text", "drop").mapInArrow(removed, result)
    return restored(out, named, "doc_id") if new else out


def asked_copies(tables: DataFrame, copies: np.ndarray) -> DataFrame:
    """Each shard's table as often as `copies` says; a shard without keys isn't there."""
    several = [(int(s), int(copies[s])) for s in np.flatnonzero(copies > 1)]
    times = tables.sparkSession.createDataFrame(several, "of long, times long")
    out = tables.join(times, F.col("shard") == F.col("of"), "left")
    return out.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("times", F.lit(1).cast("long")) - 1)).alias("copy"), "data")
