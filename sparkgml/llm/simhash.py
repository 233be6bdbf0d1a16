"""SimHash near-duplicates through a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, numbered, pin, release, restored, slices, texts
from .graph import connected
from .near import similar_pairs, sketches_of
from .shingles import shingle_hashes, simhashes

#: Children of a node; queries that go down the index together; rows under one index, but for a larger group.
FAN, BLOCK, INDEX_ROWS = 16, 256, 1 << 17
#: The top of the index: 4 blocks of a fingerprint, one of which two fingerprints with 3 differing bits share; and 4 parts of what a block leaves.
BLOCKS, BLOCK_BITS, PART_BITS = 4, 16, 12
REST_BITS = 64 - BLOCK_BITS
#: Groups under a block and a part are numbered from here on.
PARTED = 1 << 40


def fingerprint_batch(raw: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text over its word shingles, repeats included; no words: zero."""
    return simhashes([shingle_hashes(t, shingle, seed) for t in raw])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Fingerprints in Gray order under a tree of the bits that groups share.

    A node holds the bits that all fingerprints below it share and its parent
    doesn't hold already; the differences met on the way down add up, and a
    whole group is left out once they exceed the radius, or touch one of the
    `held` leading bits, in which no difference is allowed, or when the group
    is known to be in the query's component.
    """

    def __init__(self, words: np.ndarray, held: int = 0):
        self.order = np.argsort(gray_rank(words), kind="stable")
        self.words = words[self.order]
        self.fixed = np.uint64((2**64 - 1) ^ (2 ** (64 - held) - 1))
        low, high = self.words, self.words
        levels = []
        while len(low) > 1 or not levels:
            at = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            levels.append((~(low ^ high), low))
        self.levels = []  # from the root down: the bits held there, their values
        above = None
        for mask, value in reversed(levels):
            self.levels.append((mask if above is None else mask & ~np.repeat(above, FAN)[: len(mask)], value))
            above = mask

    def components(self, radius: int) -> np.ndarray:
        """For each of the words, in the order given, the least position of its component."""
        n = len(self.words)
        label = np.arange(n)
        for start in range(0, n, BLOCK):
            ask = np.arange(start, min(n, start + BLOCK))
            label = merged(label, *self.search(ask, radius, label))
        root = np.full(n, n)
        np.minimum.at(root, label, self.order)
        out = np.empty(n, np.int64)
        out[self.order] = root[label]
        return out

    def search(self, ask: np.ndarray, radius: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of positions within the radius whose labels differ."""
        only = []  # for each level from the leaves up: the label that a whole group has, or -1
        lo = hi = label
        for _ in self.levels:
            at = np.arange(0, len(lo), FAN)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            only.append(np.where(lo == hi, lo, -1))
        q, node, far = ask, np.zeros(len(ask), np.int64), np.zeros(len(ask), np.uint8)
        for depth, (mask, value) in enumerate(self.levels):
            differing = (self.words[q] ^ value[node]) & mask[node]
            far = far + np.bitwise_count(differing)
            keep = (far <= radius) & (differing & self.fixed == 0) & (only[-1 - depth][node] != label[q])
            q, far = np.repeat(q[keep], FAN), np.repeat(far[keep], FAN)
            node = (node[keep][:, None] * FAN + np.arange(FAN)).ravel()
            inside = node < (len(self.levels[depth + 1][0]) if depth + 1 < len(self.levels) else len(self.words))
            q, node, far = q[inside], node[inside], far[inside]
        differing = self.words[q] ^ self.words[node]
        keep = (np.bitwise_count(differing) <= radius) & (differing & self.fixed == 0) & (label[q] != label[node])
        return q[keep], node[keep]


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the components of a[i] and b[i] have become one; a label is the least of its component's."""
    if not len(a):
        return label
    pairs = np.unique(np.stack([np.minimum(label[a], label[b]), np.maximum(label[a], label[b])], 1), axis=0)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for x, y in pairs.tolist():
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    to = np.arange(len(label))
    for x in list(parent):
        to[x] = find(x)
    return to[label]


def turned(x: np.ndarray, by: int, width: int) -> np.ndarray:
    """The lower `width` bits rotated to the left; the others stay."""
    if not by % width:
        return x
    low = x & np.uint64(2**width - 1)
    return (x ^ low) | ((low << np.uint64(by % width) | low >> np.uint64(width - by % width)) & np.uint64(2**width - 1))


def to_front(words: np.ndarray, block: int, part: int | None = None) -> np.ndarray:
    """Words with the bits of a block, and of a part of the rest, moved to the top."""
    words = turned(words, 64 - BLOCK_BITS * (block + 1), 64)
    return words if part is None else turned(words, REST_BITS - PART_BITS * (part + 1), REST_BITS)


def from_front(words: np.ndarray, block: int, part: int | None = None) -> np.ndarray:
    """The words that to_front() had."""
    words = words if part is None else turned(words, PART_BITS * (part + 1), REST_BITS)
    return turned(words, BLOCK_BITS * (block + 1), 64)


def order_of(group: np.ndarray) -> np.ndarray:
    """Which bits a group's words have in front: the block, or 4 + 4 * block + part."""
    return np.where(group < PARTED, group >> BLOCK_BITS, 4 + (group - PARTED >> BLOCK_BITS + PART_BITS))


def dealt(large: np.ndarray):
    """Rows (group, word) of a word under each of its blocks; under those that are large, of each part of the rest."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            words = batch.column(0).to_numpy().view(np.uint64)
            groups, fronts = [], []
            for block in range(BLOCKS):
                front = to_front(words, block)
                value = (front >> np.uint64(REST_BITS)).astype(np.int64)
                key = value + (block << BLOCK_BITS)
                small = ~large[key]
                groups.append(key[small])
                fronts.append(front[small])
                for part in range(BLOCKS) if not small.all() else ():
                    front = to_front(words[~small], block, part)
                    groups.append((front >> np.uint64(REST_BITS - PART_BITS)).astype(np.int64) + PARTED + ((block << 2 | part) << BLOCK_BITS + PART_BITS))
                    fronts.append(front)
            yield pa.record_batch([pa.array(np.concatenate(groups)), pa.array(np.concatenate(fronts).view(np.int64))], ["group", "word"])

    return work


def linked(radius: int):
    """Over rows sorted by group: stars of the components that the index finds, a word of each and each of its others."""

    def edges(group: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        orders = order_of(group)
        for k in np.unique(orders).tolist():  # words with the same bits in front are comparable
            mine = words[orders == k]
            block, part = (k, None) if k < BLOCKS else divmod(k - BLOCKS, BLOCKS)
            least = GrayIndex(mine, BLOCK_BITS + (0 if part is None else PART_BITS)).components(radius)
            other = np.flatnonzero(least != np.arange(len(mine)))
            if len(other):
                u, v = (from_front(mine[x], block, part).view(np.int64) for x in (least[other], other))
                yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    def work(batches: Iterator[pa.RecordBatch]):
        groups, words, rows, enough = [], [], 0, INDEX_ROWS
        for batch in batches:
            groups.append(batch.column(0).to_numpy())
            words.append(batch.column(1).to_numpy().view(np.uint64))
            rows += batch.num_rows
            if rows >= enough:
                group, word = np.concatenate(groups), np.concatenate(words)
                cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if cut:
                    yield from edges(group[:cut], word[:cut])
                groups, words, rows = [group[cut:]], [word[cut:]], len(group) - cut
                enough = max(INDEX_ROWS, 2 * rows)
        if rows:
            yield from edges(np.concatenate(groups), np.concatenate(words))

    return work


def fingerprint_links(words: DataFrame, radius: int, part_rows: int) -> DataFrame:
    """(u, v) of distinct fingerprints (word): stars whose components are those of all links."""
    if radius >= BLOCKS:
        raise ValueError("radius must be below the number of blocks")
    # Rows of each block value: there are 4 * 65536 values at most, whatever the input.
    key = F.explode(F.array(*[F.shiftrightunsigned("word", BLOCK_BITS * t).bitwiseAND(2**BLOCK_BITS - 1) + (t << BLOCK_BITS) for t in range(BLOCKS)]))
    sizes = words.select(key.alias("key")).groupBy("key").count().where(F.col("count") > part_rows).toArrow()
    large = np.zeros(BLOCKS << BLOCK_BITS, bool)
    large[sizes["key"].to_numpy().astype(np.int64)] = True
    shared = words.sparkSession.sparkContext.broadcast(large)
    groups = words.select("word").mapInArrow(lambda it: dealt(shared.value)(it), "group long, word long")
    return groups.repartition(F.col("group")).sortWithinPartitions("group").mapInArrow(linked(radius), "u long, v long")


def simhash_fingerprints(docs: DataFrame, *, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, word) for each row of `docs` (doc_id, text): its 64-bit SimHash as a long."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text", 1 << 20):
            words = fingerprint_batch(texts(batch.column(1)), shingle, seed)
            yield pa.record_batch([batch.column(0), pa.array(words.view(np.int64))], ["id", "word"])

    frugal(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "id long, word long")


def simhash_dedup(docs: DataFrame, *, shingle: int = 3, radius: int = 3, similarity: float | None = None, seed: int = 42, part_rows: int = 1 << 18) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, fingerprint, component_id, kept.

    Texts have A-Z lower-cased; words are [^\\x20\\x09-\\x0D]+; shingles of
    `shingle` words, repeats included, are joined by spaces (fewer words: the
    whole sequence) and hashed by XXH64. A bit of the fingerprint is 1 if it
    is set in over half the hashes; without words the fingerprint is zero.
    Fingerprints with at most `radius` differing bits are linked;
    component_id is the smallest doc_id that links reach, and `kept` says
    that the row is it: one row of each component. Null and repeated doc_ids
    are rows of their own; a null doc_id counts as the greatest, so it names a
    component only where no other row does. Null and empty texts are linked
    to each other. Other columns are ignored, an empty table gives no row.

    Equal fingerprints become one node. Two nodes with at most 3 differing
    bits share one of 4 blocks of 16 bits, so blocks are the top of the
    index, and what is dealt out; a task hangs all fingerprints of its blocks
    in Gray order under a tree of shared bits and goes down that tree with
    the sum of differences. A block of over `part_rows` nodes is dealt by the
    4 parts of its other bits as well, one of which such nodes share too.
    Only a star for each component is sent on; components join by large and
    small stars.

    With `similarity`, links are pairs whose sets of shingles have that
    Jaccard similarity, decided on the sets. Pairs that the index finds are
    looked at first; as SimHash at this radius misses most pairs of 0.8, what
    is left comes from bands of minima of the sets, see similar_pairs().
    """
    spark = docs.sparkSession
    frugal(docs)
    named, new = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text")), nulls_first=False)
    if similarity is None:
        words = pin(simhash_fingerprints(named, shingle=shingle, seed=seed))
    else:
        sketches = pin(sketches_of(named, shingle, seed))
        words = sketches.select("id", "word")
    nodes = pin(words.groupBy("word").agg(F.min("id").alias("first")))
    star = connected(fingerprint_links(nodes, radius, part_rows)).select(F.col("u").alias("root"), F.col("v").alias("word"))
    firsts = nodes.join(star, "word", "left").select("word", "first", F.coalesce("root", "word").alias("root"))
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    of = pin(words.join(firsts.join(least, "root").select("word", "component_id"), "word").select("id", "word", "component_id"))
    release(spark)
    if similarity is not None:
        seeds = of.where("id <> component_id").select(F.col("component_id").alias("u"), F.col("id").alias("v"))
        star = connected(similar_pairs(named, sketches, seeds, similarity, shingle, seed))
        names = star.select(F.col("v").alias("id"), F.col("u").alias("least"))
        of = of.drop("component_id").join(names, "id", "left").select("id", "word", F.coalesce("least", "id").alias("component_id"))
    out = of.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("word")), 16, "0").alias("fingerprint"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return restored(out, named, "doc_id", "component_id") if new else out
