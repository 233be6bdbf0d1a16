"""Removal of repeated byte strings: anchored suffixes, sorted by hash-compared mergesort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import frugal, joined, mix, numbered, pin, release, restored, slices, texts, trim

BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
#: A random 64-bit word for each byte value, from the finaliser that everything else uses.
WORDS = mix(np.arange(256, dtype=np.uint64), 7)
#: Anchors that a task gathers before it sends them; anchors and suffixes of a shard.
HELD, SHARD_ANCHORS, SHARD_SUFFIXES = 200_000, 1_000_000, 40_000
#: Bytes of the input for each shuffle partition at most.
TASK_BYTES = 128 << 20
#: Surroundings of one gram that a task compares; those of a gram with more become rows of their own strings.
GRAM_CONTEXTS = 50_000

_powers: dict[str, np.ndarray] = {}
KEPT_POWERS = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n; kept, but for those that only very long texts need."""
    if len(_powers.get("up", ())) > n:
        return _powers["up"][: n + 1], _powers["down"][: n + 1]
    made = {}
    for name, b in (("up", BASE), ("down", INVERSE)):
        x = np.full(max(n + 1, KEPT_POWERS), b, np.uint64)
        x[0] = 1
        made[name] = np.cumprod(x)
    if n < KEPT_POWERS:
        _powers.update(made)
    return made["up"][: n + 1], made["down"][: n + 1]


def sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """`of` (minimum or maximum) over x[i : i + width], by doubling."""
    span = 1
    while span * 2 <= width:
        x = of(x[:-span], x[span:])
        span *= 2
    return of(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class Shape:
    """Lengths that follow from the length of the strings: grams, anchor positions within a string, contexts."""

    def __init__(self, length: int):
        self.length = length
        self.gram = max(1, length // 3)
        self.places = length - self.gram + 1  # an anchor's gram starts at 0..places - 1 within a string
        self.left = self.places - 1
        self.context = self.left + length


def anchors(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `data` of the grams that are least in some string of the given length, and their hashes.

    The choice depends on a string's bytes alone, so equal strings have
    anchors at equal places. Strings don't cross texts.
    """
    n, k, w = len(data), shape.gram, shape.places
    if n < shape.length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(WORDS[data] * up[:-1], out=sums[1:])
    h = mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    end = np.repeat(offsets[1:], np.diff(offsets))
    low = sliding(h, w, np.minimum)  # of the string that starts here
    inside = np.arange(len(low)) + shape.length <= end[: len(low)]
    low = np.where(inside, low, np.uint64(0))
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero((sliding(padded, w, np.maximum) == h) & (h != 0))
    return at, h[at]


def contexts(text_at: np.ndarray, text_end: np.ndarray, at: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of what surrounds anchors, up to the ends of their texts."""
    return np.maximum(text_at, at - shape.left), np.minimum(text_end, at + shape.length)


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def packed(ids: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Rows grouped by identifier, each column as bytes."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    columns = [c[order] for c in columns]
    cuts = np.append(np.flatnonzero(runs_of(ids)), len(ids))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(ids[a]), [c[a:b].tobytes() for c in columns]


def firsts(first: np.ndarray) -> np.ndarray:
    """For each row of sorted columns the row that starts its run."""
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def equal_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray, width: int, rows: int = 4_000) -> np.ndarray:
    """Whether data[start:end] and data[other:other_end], of at most `width` bytes, are the same."""
    same = end - start == other_end - other
    columns = np.arange(width)
    for a in range(0, len(start), rows):
        b = slice(a, a + rows)
        x, y = (np.minimum(s[b, None] + columns, len(data) - 1) for s in (start, other))
        same[b] &= ((data[x] == data[y]) | (columns >= (end - start)[b, None])).all(axis=1)
    return same


def gathered(shape: Shape, shards: int):
    """Anchors of a task, dealt into shards by hash. Those whose whole context came before in the task, byte for byte, need no more comparing."""

    def send(parts: list) -> Iterator[pa.RecordBatch]:
        *columns, blocks = zip(*parts, strict=True)
        base = np.cumsum([0, *map(len, blocks)])
        h, c, i, off, start, end = (np.concatenate([x + b if k > 3 else x for x, b in zip(column, base, strict=False)]) for k, column in enumerate(columns))
        order = np.lexsort((off, i, c, h))
        h, c, i, off, start, end = (x[order] for x in (h, c, i, off, start, end))
        once = runs_of(h, c, i, off)
        first = runs_of(h, c)
        again = once & ~first
        x = np.flatnonzero(again)
        y = firsts(first)[x]
        same = equal_bytes(np.concatenate(blocks), start[x], end[x], start[y], end[y], shape.context)
        again[x[~same]] = False
        first[x[~same]] = True  # hashes that stand for different bytes are compared with others' later
        rows: list[tuple[int, bytes | None, bytes | None]] = []
        for doc, (data,) in packed(i[again], off[again].astype(np.uint32)):
            rows.append((int(mix(np.array([doc], np.int64).view(np.uint64))[0] % np.uint64(shards)), None, np.int64(doc).tobytes() + data))
        h, c, i, off = h[first], c[first], i[first], off[first].astype(np.uint32)
        shard = (mix(h, 1) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.append(np.flatnonzero(runs_of(shard[order])), len(order))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            o = order[a:b]
            rows.append((int(shard[o[0]]), b"".join(x[o].tobytes() for x in (h, c, i, off)), None))
        for a in range(0, len(rows), 5000):
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows[a : a + 5000], strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "found", "again"])

    def work(batches: Iterator[pa.RecordBatch]):
        parts, held = [], 0
        for batch in slices(batches, "text", 1 << 19):
            raw = texts(batch.column(1))
            data, offsets = joined(raw)
            at, h = anchors(data, offsets, shape)
            if not len(at):
                continue
            owner = np.searchsorted(offsets, at, "right") - 1
            start, end = contexts(offsets[owner], offsets[owner + 1], at, shape)
            view, digest = data.tobytes(), xxhash.xxh3_64_intdigest
            seeds = ((at - start) << 20 | (end - at)).tolist()
            c = np.array([digest(view[a:b], s) for a, b, s in zip(start.tolist(), end.tolist(), seeds, strict=True)], np.uint64)
            parts.append((h, c, batch.column(0).to_numpy()[owner], at - offsets[owner], start, end, data))
            held += len(at)
            if held >= HELD:
                yield from send(parts)
                parts, held = [], 0
        if parts:
            yield from send(parts)

    return work


def compared(most: int):
    """Rows sorted by shard: anchors whose context came before, with where, and those to be compared as their gram has several contexts; those of grams with over `most` contexts apart, as hot."""

    def done(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], [], []]
        for blob in blobs:
            n = len(blob) // 28
            for column, kind, at in zip(columns, (np.uint64, np.uint64, np.int64, np.uint32), (0, 8 * n, 16 * n, 24 * n), strict=True):
                column.append(np.frombuffer(blob, kind, n, at))
        h, c, i, off = map(np.concatenate, columns)
        order = np.argsort(h)
        twice = np.zeros(len(h), bool)
        same = h[order][1:] == h[order][:-1]
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        h, c, i, off = h[twice], c[twice], i[twice], off[twice]
        order = np.lexsort((off, i, c, h))
        h, c, i, off = h[order], c[order], i[order], off[order]
        once, first, group = runs_of(h, c, i, off), runs_of(h, c), np.cumsum(runs_of(h)) - 1
        classes = np.bincount(group, first, int(group[-1]) + 1 if len(group) else 0)
        again, ask = once & ~first, first & (classes[group] > 1)
        x = np.flatnonzero(again)
        y = firsts(first)[x]
        refs = np.zeros(len(x), REFERENCE)
        refs["off"], refs["of"], refs["at"] = off[x], i[y], off[y]
        hot = ask & (classes[group] > most)
        ask &= ~hot
        yield from batched(((doc, None, None, None, None, data) for doc, (data,) in packed(i[x], refs)), ANCHOR_ROWS)
        yield from batched(((doc, None, a, b, None, None) for doc, (a, b) in packed(i[ask], off[ask], h[ask])), ANCHOR_ROWS)
        yield from batched(((doc, None, None, None, data, None) for doc, (data,) in packed(i[hot], off[hot])), ANCHOR_ROWS)

    def work(batches: Iterator[pa.RecordBatch]):
        shard, blobs = None, []
        for batch in batches:
            passed = []
            for s, found, again in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if again is not None:
                    passed.append((int(np.frombuffer(again, np.int64, 1)[0]), again[8:], None, None, None, None))
                    continue
                if s != shard and blobs:
                    yield from done(blobs)
                    blobs = []
                shard = s
                blobs.append(found)
            yield from batched(iter(passed), ANCHOR_ROWS)
        if blobs:
            yield from done(blobs)
        trim()

    return work


def windows(shape: Shape):
    """Texts with hot anchors: a 128-bit hash of every string through one, and where it starts."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text", 1 << 18):
            for doc, text, hots in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                data = (text or "").encode("utf-8")
                at = np.frombuffer(b"".join(hots), np.uint32).astype(np.int64)
                starts = np.unique((at[:, None] - np.arange(shape.places)).ravel())
                starts = starts[(starts >= 0) & (starts + shape.length <= len(data))]
                if len(starts):
                    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[a : a + shape.length]) for a in starts.tolist()), "<i8").reshape(-1, 2)
                    yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.full(len(starts), doc, np.int64)), pa.array(starts)], ["a", "b", "id", "start"])

    return work


def as_spans(shape: Shape):
    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, start = (x.to_numpy() for x in batch.columns)
            yield from batched(((doc, data) for doc, (data,) in packed(ids, np.stack([start, start + shape.length], 1))), SPAN_ROWS)

    return work


def hot_spans(rows: DataFrame, hot: DataFrame, shape: Shape) -> DataFrame:
    """Spans of the strings through hot anchors: one row for each string, whose first start Spark's aggregate finds."""
    wanted = hot.groupBy("id").agg(F.collect_list("hot").alias("hots"))
    found = pin(rows.join(wanted, "id").select("id", "text", "hots").mapInArrow(windows(shape), "a long, b long, id long, start long"))
    first = found.groupBy("a", "b").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = found.join(first, ["a", "b"]).where((F.col("id") != F.col("first.id")) | (F.col("start") != F.col("first.start")))
    return later.select("id", "start").mapInArrow(as_spans(shape), "id long, spans binary")


ANCHOR_ROWS = pa.schema([("id", pa.int64()), ("again", pa.binary()), ("ask", pa.binary()), ("gram", pa.binary()), ("hot", pa.binary()), ("refs", pa.binary())])
#: An anchor of a document whose context, by its hashes, is that of an anchor of another.
REFERENCE = np.dtype([("off", "<u4"), ("of", "<i8"), ("at", "<u4")])
WANTED_ROWS = pa.schema([("of", pa.int64()), ("id", pa.int64()), ("wanted", pa.binary())])
SOURCE_ROWS = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("source", pa.binary())])
SPAN_ROWS = pa.schema([("id", pa.int64()), ("spans", pa.binary())])


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def wanted(shape: Shape):
    """Rows (id, refs) become, for each document that is referred to, the spans to be compared: start, end, start there."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield from batched(rows(batch), WANTED_ROWS)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            refs = np.frombuffer(b"".join(parts), REFERENCE)
            off, at = refs["off"].astype(np.int64), refs["at"].astype(np.int64)
            order = np.lexsort((off, at - off, refs["of"]))
            off, at, of = off[order], at[order], refs["of"][order]
            start, end = np.maximum(off - np.minimum(shape.left, at), 0), off + shape.length
            new = runs_of(of, at - off)
            new[1:] |= start[1:] > end[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(off)) - 1
            spans = np.stack([start[first], end[last], start[first] + (at - off)[first]], 1)
            for source, (data,) in packed(of[first], spans):
                yield source, doc, data

    return work


def sources(batches: Iterator[pa.RecordBatch]):
    """Texts that are referred to, with who wants which spans of them: the bytes, for those who do."""
    for batch in slices(batches, "text", 1 << 18):

        def rows(batch=batch) -> Iterator[tuple]:
            for text, askers in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for a in askers:
                    for start, end, there in np.frombuffer(a["wanted"], np.int64).reshape(-1, 3).tolist():
                        yield a["id"], start, text[there : there + end - start]

        yield from batched(rows(), SOURCE_ROWS, 1000)


def fetched(shape: Shape, shards: int):
    """Texts with the anchors to be compared become suffixes with what stands before them, dealt by gram."""
    width = shape.context

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text"):
            out = []
            for doc, text, asks, grams in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                data = np.frombuffer((text or "").encode("utf-8"), np.uint8)
                at = np.frombuffer(b"".join(asks), np.uint32).astype(np.int64)
                h = np.frombuffer(b"".join(grams), np.uint64)
                start, end = contexts(np.zeros_like(at), np.full_like(at, len(data)), at, shape)
                padded = np.concatenate([np.zeros(shape.left, np.uint8), data, np.zeros(shape.length, np.uint8)])
                body = padded[at[:, None] + np.arange(width)]
                record = np.zeros(len(at), record_type(width))
                record["h"], record["id"], record["off"], record["left"], record["right"], record["body"] = h, doc, at, at - start, end - at, body
                out.append(record)
            record = np.concatenate(out)
            shard = (mix(record["h"], 2) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.append(np.flatnonzero(runs_of(shard[order])), len(order))
            for part in [cuts[k : k + 2000] for k in range(0, len(cuts) - 1, 1999)]:
                pieces = [order[a:b] for a, b in zip(part[:-1].tolist(), part[1:].tolist(), strict=True)]
                yield pa.record_batch([pa.array([int(shard[o[0]]) for o in pieces], pa.int64()), pa.array([record[o].tobytes() for o in pieces], pa.binary())], ["shard", "data"])

    return work


def record_type(width: int) -> np.dtype:
    return np.dtype([("h", "<u8"), ("id", "<i8"), ("off", "<u4"), ("left", "<u2"), ("right", "<u2"), ("body", "u1", (width,))])


class Suffixes:
    """Suffixes of bounded length under prefix polynomial hashes."""

    def __init__(self, body: np.ndarray, size: np.ndarray):
        self.body, self.size = body, size
        self.hash = np.zeros((len(body), body.shape[1] + 1), np.uint64)
        for k in range(body.shape[1]):
            self.hash[:, k + 1] = self.hash[:, k] * np.uint64(BASE) + WORDS[body[:, k]]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each pair: binary search for the longest with equal hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b]).astype(np.int64)
        for _ in range(int(self.body.shape[1]).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hash[a, middle] == self.hash[b, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Whether suffix a[i] comes before b[i]; `equal` is the answer for equal ones."""
        k = self.common(a, b)
        ends_a, ends_b = k == self.size[a], k == self.size[b]
        at = np.minimum(k, self.body.shape[1] - 1)
        return np.where(ends_a & ends_b, equal, ends_a | (~ends_b & (self.body[a, at] < self.body[b, at])))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within each group (rows of a group are together): bottom-up mergesort, all merges of a round at once."""
        n = len(group)
        order = np.arange(n)
        starts = np.flatnonzero(runs_of(group))
        start = np.repeat(starts, np.diff(np.append(starts, n)))
        stop = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        run = 1
        while n and run < (stop - start).max():
            at = np.flatnonzero(stop - start > run)
            place = at - start[at]
            mine = place // run
            other = start[at] + (mine ^ 1) * run
            low, high = np.minimum(other, stop[at]), np.minimum(other + run, stop[at])
            from_left = (mine & 1) == 0
            first = low.copy()
            for _ in range(run.bit_length()):
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                # how many of the other run come before; of equal ones the left run's
                less = self.before(order[middle], order[at[open_]], ~from_left[open_])
                low[open_] = np.where(less, middle + 1, low[open_])
                high[open_] = np.where(less, high[open_], middle)
            new = order.copy()
            new[start[at] + (mine & ~1) * run + place % run + (low - first)] = order[at]
            order = new
            run *= 2
        return order


def repeated(rec: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of records sorted by gram: identifier, start and end of what strings of an earlier record cover.

    Within a gram's records, sorted by what follows, those whose strings have
    an equal part from the anchor on stand together; a hash of what comes
    before the anchor splits them. Of each class the first record stays. The
    two outermost strings of every other record are compared byte by byte
    with the first's; where they differ, the gram is done over on bytes.
    """
    none = (np.zeros(0, np.int64),) * 3
    if not len(rec):
        return none
    right = Suffixes(rec["body"][:, shape.left :], rec["right"])
    group = np.cumsum(runs_of(rec["h"]))
    order = right.sort(group)
    rec, group = rec[order], group[order]
    common = np.zeros(len(rec), np.int64)
    common[1:] = right.common(order[1:], order[:-1])
    common[runs_of(group)] = -1
    rank = np.empty(len(rec), np.int64)
    rank[np.lexsort((rec["off"], rec["id"]))] = np.arange(len(rec))
    before = np.zeros(len(rec), np.uint64)
    low, high = np.full(len(rec), -1), np.full(len(rec), -1)
    low_of, high_of = np.zeros(len(rec), np.int64), np.zeros(len(rec), np.int64)
    for r in range(shape.places):
        if r:
            before = before * np.uint64(BASE) + WORDS[rec["body"][:, shape.left - r]]
        run = np.cumsum(common < shape.length - r)
        at = np.flatnonzero((rec["left"] >= r) & (rec["right"] >= shape.length - r))
        if not len(at):
            continue
        key = mix(run[at].astype(np.uint64), 3) ^ mix(before[at], 4)
        o = np.argsort(key, kind="stable")
        at, key = at[o], key[o]
        starts = np.flatnonzero(runs_of(key))
        least = np.minimum.reduceat(rank[at], starts)
        sizes = np.diff(np.append(starts, len(at)))
        if (sizes == 1).all():
            continue
        leasts = np.repeat(least, sizes)
        hit = rank[at] > leasts
        x = at[hit]
        if not len(x):
            continue
        holder = np.full(int(rank.max()) + 1, -1)
        holder[rank[at]] = at
        y = holder[leasts[hit]]
        fresh = low[x] < 0
        low[x[fresh]], low_of[x[fresh]] = r, y[fresh]
        high[x], high_of[x] = r, y
    x = np.flatnonzero(high >= 0)
    wrong = np.zeros(len(rec), bool)
    for r, y in ((low[x], low_of[x]), (high[x], high_of[x])):
        columns = (shape.left - r)[:, None] + np.arange(shape.length)
        wrong[x] |= (rec["body"][x[:, None], columns] != rec["body"][y[:, None], columns]).any(axis=1) | (group[x] != group[y])
    if wrong.any():
        bad = np.isin(group, group[wrong])
        again = by_bytes(rec[bad], rank[bad], group[bad], shape)
        x = x[~bad[x]]
    else:
        again = none
    off = rec["off"].astype(np.int64)
    own = rec["id"][x], off[x] - high[x], off[x] - low[x] + shape.length
    return tuple(np.concatenate(p) for p in zip(own, again, strict=True))


def by_bytes(rec: np.ndarray, rank: np.ndarray, group: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As repeated(), for groups in which a hash was not enough."""
    out = []
    bodies = [b.tobytes() for b in rec["body"]]
    for r in range(shape.places):
        first: dict[tuple[int, bytes], int] = {}
        rows = [i for i in np.argsort(rank, kind="stable").tolist() if rec["left"][i] >= r and rec["right"][i] >= shape.length - r]
        for i in rows:
            a = shape.left - r
            if rank[first.setdefault((int(group[i]), bodies[i][a : a + shape.length]), i)] < rank[i]:
                out.append((int(rec["id"][i]), int(rec["off"][i]) - r, int(rec["off"][i]) - r + shape.length))
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def resolved(shape: Shape, most: int):
    """Rows sorted by shard: spans of every document that earlier strings cover."""
    kind = record_type(shape.context)

    def done(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        rec = np.frombuffer(b"".join(blobs), kind)
        rec = rec[np.argsort(rec["h"], kind="stable")]
        cuts = np.append(np.flatnonzero(runs_of(rec["h"])), len(rec))
        a = 0
        while a < len(rec):  # whole grams, about `most` records at once
            b = int(cuts[max(np.searchsorted(cuts, a + most, "right") - 1, np.searchsorted(cuts, a, "right"))])
            ids, start, end = repeated(rec[a:b], shape)
            yield from batched(((doc, data) for doc, (data,) in packed(ids, np.stack([start, end], 1))), SPAN_ROWS)
            a = b

    def work(batches: Iterator[pa.RecordBatch]):
        shard, blobs = None, []
        for batch in batches:
            for s, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if s != shard and blobs:
                    yield from done(blobs)
                    blobs = []
                shard = s
                blobs.append(data)
        if blobs:
            yield from done(blobs)
        trim()

    return work


def removal(n: int, again: list[bytes], spans: list[bytes], checked: list[tuple[int, int]], shape: Shape) -> list[tuple[int, int]]:
    """Maximal removed runs of a text of n bytes."""
    at = np.frombuffer(b"".join(again), np.uint32).astype(np.int64)
    both = np.concatenate([np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2), np.array(checked, np.int64).reshape(-1, 2)])
    start = np.concatenate([np.maximum(at - shape.left, 0), both[:, 0]])
    end = np.minimum(np.concatenate([at + shape.length, both[:, 1]]), n)
    use = end - start >= shape.length
    start, end = start[use], end[use]
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return list(zip(start[new].tolist(), end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)].tolist(), strict=True))


def applied(shape: Shape, as_text: bool):
    """Texts without what is to be removed, as bytes or as strings; what a cut left of a character goes from a string."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text"):
            size, gone, runs, kept = [], [], [], []
            for text, again, spans, found in zip(texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                # only bytes that are the source's go
                checked = [(x["start"], x["start"] + len(x["source"])) for x in found or () if text.startswith(x["source"], x["start"])]
                cut = removal(len(text), again or [], spans or [], checked, shape)
                size.append(len(text))
                runs.append(len(cut))
                gone.append(sum(b - a for a, b in cut))
                if cut:
                    ends = [0, *(x for ab in cut for x in ab), len(text)]
                    text = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                kept.append(text)
            yield pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), batch.column(5)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text" if as_text else "kept_bytes", "row"])

    return work


def suffix_dedup(docs: DataFrame, *, length: int = 100, carry: bool = False, gram_contexts: int = GRAM_CONTEXTS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes.

    Every byte is removed that is covered by a string of `length` bytes which
    also starts earlier: in a document with a smaller doc_id, or in the same
    at an earlier byte. Strings lie within one text and are judged on the
    input. Null counts as empty. Null and repeated doc_ids are documents of
    their own: null comes first, and of equal doc_ids an order by a hash of
    the text decides which is earlier. Other columns are ignored; with `carry`
    a struct column `row` has all columns of the input but text, and
    kept_text, a string, stands for kept_bytes. An empty table gives an empty
    result. A text of n bytes takes some 60 n bytes of memory in its task.

    A gram that is the least by hash in some string is an anchor; equal
    strings have equal anchors, so only anchors (one in about `length` / 3
    bytes) are shuffled, with a 64-bit hash of the gram and one of the bytes
    around it that any string through it can reach. Of anchors with equal
    hashes all but the first are covered whole, if their bytes are equal too:
    those of one task are compared there, so that a text copied any number of
    times adds one record for each task and anchor; for those of other tasks
    the first one's bytes are fetched, neighbouring anchors as one span, and
    what differs from them stays. Where a gram has
    several surroundings, the first anchor of each is fetched with its bytes;
    the suffixes from the anchors on are sorted by a mergesort whose
    comparisons find common prefixes by binary search over prefix polynomial
    hashes, and what is found is verified on bytes. A gram with over
    `gram_contexts` surroundings isn't one task's work: every string through
    its anchors becomes a row under a 128-bit hash, and Spark's aggregate
    finds the first of each.
    """
    frugal(docs)
    spark, shape = docs.sparkSession, Shape(length)
    row = F.struct(*[docs[c] for c in docs.columns if c != "text"]) if carry else F.lit(None).cast("struct<doc_id:bigint>")
    named, new = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text"), row.alias("row")))
    rows = named.select(F.col("doc_id").alias("id"), "text", "row")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # as many shuffle partitions as the session says, or more of them where they would grow with the table
    many = [-(-total // TASK_BYTES)] if total > tasks * TASK_BYTES else []
    tasks = max([tasks, *many])
    shards = max(tasks, total // (SHARD_ANCHORS * shape.places // 2) + 1)
    found = rows.select("id", "text").where(F.octet_length("text") >= length).mapInArrow(gathered(shape, shards), "shard long, found binary, again binary")
    marks = pin(found.repartition(*many, F.col("shard")).sortWithinPartitions("shard").mapInArrow(compared(gram_contexts), "id long, again binary, ask binary, gram binary, hot binary, refs binary"))
    release(spark)
    refs = marks.where("refs is not null").groupBy("id").agg(F.collect_list("refs").alias("refs"))  # a document's own anchors
    # askers of a text are few: a task sends one reference to it for each time that it sends its anchors
    askers = refs.mapInArrow(wanted(shape), "of long, id long, wanted binary").groupBy("of").agg(F.collect_list(F.struct("id", "wanted")).alias("askers"))
    checks = pin(rows.select("id", "text").join(askers, F.col("id") == F.col("of")).select("id", "text", "askers").mapInArrow(sources, "id long, start long, source binary"))
    release(spark)
    asked = marks.where("ask is not null")
    n = asked.agg(F.sum(F.octet_length("ask"))).first()[0] or 0
    shards = max(tasks, n // 4 // SHARD_SUFFIXES + 1)
    asked = asked.groupBy("id").agg(F.collect_list("ask").alias("asks"), F.collect_list("gram").alias("grams"))
    suffixes = rows.join(asked, "id").select("id", "text", "asks", "grams").mapInArrow(fetched(shape, shards), "shard long, data binary")
    spans = pin(suffixes.repartition(*many, F.col("shard")).sortWithinPartitions("shard").mapInArrow(resolved(shape, SHARD_SUFFIXES), "id long, spans binary"))
    release(spark)
    hot = marks.where("hot is not null").select("id", "hot")
    if not hot.isEmpty():
        spans = spans.unionByName(hot_spans(rows.select("id", "text"), hot, shape))
    no, none = F.lit(None).cast("binary"), F.lit(None).cast("struct<start: bigint, source: binary>")
    cut = marks.where("again is not null").select("id", "again", no.alias("spans"), none.alias("check")).unionByName(spans.select("id", no.alias("again"), "spans", none.alias("check")))
    cut = cut.unionByName(checks.select("id", no.alias("again"), no.alias("spans"), F.struct("start", "source").alias("check")))
    cut = cut.groupBy("id").agg(F.collect_list("again").alias("again"), F.collect_list("spans").alias("spans"), F.collect_list("check").alias("checks"))
    out = StructType.fromDDL(f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, {'kept_text string' if carry else 'kept_bytes binary'}").add("row", rows.schema["row"].dataType)
    done = rows.join(cut, "id", "left").select("id", "text", "again", "spans", "checks", "row").mapInArrow(applied(shape, carry), out)
    done = restored(done, named, "doc_id") if new else done
    return done if carry else done.drop("row")
