"""Pairs of texts of a given Jaccard similarity of word shingles: candidates from SimHash and from bands of minima, decided on the sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pin, release, slices, texts, unpin
from .graph import connected
from .shingles import shingle_hashes, simhashes

#: Rounds in which each row is compared with one row of its buckets, before what is left is searched exactly.
STAR_ROUNDS = 2
#: Bands, and minima that are hashed together in each.
BANDS, ROWS = 24, 5


def shingle_set(hashes: list[int], seed: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text without words has one of its own kind."""
    return np.unique(np.array(hashes or [xxhash.xxh64_intdigest(b"", seed)], np.uint64))


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each set and band: a hash of `rows` minima over the set, each under a hash function of its own."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b, np.uint64)
        for r in range(rows):
            key = mix(key ^ np.minimum.reduceat(mix(every, 1 + b * rows + r), starts))
        out[:, b] = key
    return out


def sketches_of(docs: DataFrame, shingle: int, seed: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, word, n, keys) for each row of `docs` (doc_id, text): SimHash, size of the set of shingles, key of each band."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text", 1 << 19):
            hashes = [shingle_hashes(t, shingle, seed) for t in texts(batch.column(1))]
            sets = [shingle_set(h, seed) for h in hashes]
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(band_keys(sets, bands, rows).view(np.int64).ravel()))
            yield pa.record_batch([batch.column(0), pa.array(simhashes(hashes).view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), keys], ["id", "word", "n", "keys"])

    return docs.select("doc_id", "text").mapInArrow(work, "id long, word long, n long, keys array<long>")


def sets_of(shingle: int, seed: int):
    """Texts become their sets, as bytes."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text", 1 << 20):
            sets = [shingle_set(shingle_hashes(t, shingle, seed), seed).tobytes() for t in texts(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], ["id", "members"])

    return work


def measured(batches: Iterator[pa.RecordBatch]):
    """Rows (u, v, a, b) of two sets: their Jaccard similarity, and how many members they share."""
    for batch in batches:
        j, n = [], []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            j.append(both / (len(x) + len(y) - both))
            n.append(both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(j, pa.float64()), pa.array(n, pa.int64())], ["u", "v", "j", "both"])


def similar_pairs(docs: DataFrame, sketches: DataFrame, seeds: DataFrame, similarity: float, shingle: int, seed: int) -> DataFrame:
    """(u, v) of rows of `docs` (doc_id, text), ids unique, whose components are those of all pairs that bands or `seeds` (u, v) have and that are similar.

    A pair of similarity s is a candidate unless all bands differ, with
    probability (1 - s ** ROWS) ** BANDS: 7e-5 at 0.8. Every candidate is
    decided on its sets. Buckets are texts with equal key of a band. At first
    every row is compared with the one of its buckets that stands in the
    largest buckets, as the original of many copies does, and `seeds` are
    looked at. Then each row is compared with one row of its buckets a round,
    a different one in each, unless they are in one component already. What
    is left, rows whose buckets are in different components, goes by the
    first row p that it was compared with. Two sets that were compared with
    the same p share at most min(|a & p|, |b & p|) members of p: either that is
    enough for the similarity, or they share a member that p lacks, and such
    members, unlike p's, are rare in a group of copies of p. Rows of different
    p are compared if they share a bucket. So large groups of copies cost a
    few comparisons a row, also of copies that are just too different. Only
    texts that share a bucket or a seed are fetched, once, as sets.
    """
    spark = docs.sparkSession
    keys = sketches.select("id", "n", F.explode("keys").alias("key"))
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = pin(keys.join(several, "key").select("key", "id", "n", "c"))
    weights = shared.groupBy("id").agg(F.sum("c").alias("weight"))
    buckets = pin(shared.join(weights, "id").select("key", "id", "n", "weight", F.col("id").alias("label")))
    unpin(shared)
    some = pin(buckets.select("id").unionByName(seeds.select(F.col("u").alias("id"))).unionByName(seeds.select(F.col("v").alias("id"))).distinct())
    members = pin(docs.select(F.col("doc_id").alias("id"), "text").join(some, "id", "left_semi").mapInArrow(sets_of(shingle, seed), "id long, members binary"))
    release(spark)

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = pin(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        a = members.select(F.col("id").alias("u"), F.col("members").alias("a"))
        b = members.select(F.col("id").alias("v"), F.col("members").alias("b"))
        return pin(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(measured, "u long, v long, j double, both long"))

    def near(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.col("j") >= similarity - 1e-9).select("u", "v")

    def with_one(rank) -> DataFrame:
        """Each row that has a bucket of several labels, with the one of its buckets' rows that ranks highest."""
        ones = buckets.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct(rank.alias("rank"), (-F.col("id")).alias("least"), "label")).alias("one")).where("lo <> hi")
        rows = buckets.join(ones.select("key", "one"), "key").where("label <> one.label")
        return rows.groupBy("id").agg(F.max("one").alias("one")).select(F.col("id").alias("u"), (-F.col("one.least")).alias("v"))

    first = pin(with_one(F.col("weight")))
    found = compared(first.unionByName(seeds))
    ends = first.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), F.col("u").alias("id"), F.col("v").alias("p"))
    pivots = pin(ends.join(found, (F.col("lo") == F.col("u")) & (F.col("hi") == F.col("v"))).select("id", "p", "both"))
    edges = pin(near(found))
    for turn in range(1, STAR_ROUNDS + 1):
        star = connected(edges)
        names = star.select(F.col("v").alias("id"), F.col("u").alias("root"))
        old = buckets
        buckets = pin(old.drop("label").join(names, "id", "left").select("key", "id", "n", "weight", F.coalesce("root", "id").alias("label")))
        unpin(old)
        if turn < STAR_ROUNDS:
            pairs = with_one(F.xxhash64("id", F.lit(turn)))
        else:
            mixed = buckets.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
            # a row that ranks highest in all its buckets was compared with none: it is its own p
            left = buckets.join(mixed, "key").join(pivots, "id", "left")
            left = pin(left.select("key", "id", "n", "label", F.coalesce("p", "id").alias("p"), F.coalesce("both", "n").alias("both")))
            pairs = left_pairs(left, members, similarity)
        edges = pin(star.select("u", "v").unionByName(near(compared(pairs))))
    return edges


def own_members(batches: Iterator[pa.RecordBatch]):
    """Rows (id, n, label, p, members, of_p) become one for each member that p lacks."""
    for batch in batches:
        own = [np.setdiff1d(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), assume_unique=True) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        sizes = [len(x) for x in own]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(batch.column(i).to_numpy(), sizes)) for i in range(4)), pa.array(np.concatenate(own))], ["id", "n", "label", "p", "t"])


def left_pairs(left: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of rows (key, id, n, label, p, both) of different labels that may be similar; see similar_pairs()."""

    def of_two(rows: DataFrame, on: list[str], more) -> DataFrame:
        """Pairs of rows that are equal in `on`, differ in label, and may be similar by size."""
        other = rows.select(*on, *[F.col(c).alias(f"{c}2") for c in rows.columns if c not in on])
        sizes = F.least("n", "n2") >= similarity * F.greatest("n", "n2") - 1e-9
        pairs = rows.join(other, on).where((F.col("id") < F.col("id2")) & (F.col("label") != F.col("label2")) & sizes & more)
        return pairs.select(F.col("id").alias("u"), F.col("id2").alias("v"))

    rows = left.select("id", "n", "label", "p", "both").distinct()
    sets = rows.join(members, "id").join(members.select(F.col("id").alias("p"), F.col("members").alias("of_p")), "p")
    own = pin(sets.select("id", "n", "label", "p", "members", "of_p").mapInArrow(own_members, "id long, n long, label long, p long, t long"))
    shared = of_two(own, ["p", "t"], F.lit(True))
    # without a member of their own in common, two sets share what both have of p at most
    least = F.least("both", "both2")
    full = of_two(rows.where(F.col("both") >= similarity * F.col("n") - 1e-9), ["p"], least >= similarity * (F.col("n") + F.col("n2") - least) - 1e-9)
    apart = of_two(left.drop("both"), ["key"], F.col("p") != F.col("p2"))
    return shared.unionByName(full).unionByName(apart)
