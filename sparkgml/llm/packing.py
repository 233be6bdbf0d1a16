"""Packing into length buckets whose bounds make padding least."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, numbered, pin, restored, slices, texts
from .tokens import encode, encoding


def optimal_bounds(upper: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets over bins in order of length, with the least padding.

    `upper` is the greatest length in a bin, `count` its rows, `total` their
    lengths' sum. Dynamic programming over (buckets used, bins covered): the
    start of the last bucket never moves back when a bin is added, so all
    middles of halves are solved together within their neighbours' starts.
    Among equals the one with fewer buckets, then the longer last bucket, wins.
    """
    n = len(upper)
    rows = np.concatenate([[0], np.cumsum(count)]).astype(float)
    tokens = np.concatenate([[0], np.cumsum(total)]).astype(float)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    cuts, ends = [], []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        first, last = np.array([1]), np.array([n])  # bins to solve, and where their starts lie
        low, high = np.array([0]), np.array([n - 1])
        while len(first):
            j = (first + last) // 2
            sizes = np.minimum(high, j - 1) - low + 1
            at = np.cumsum(sizes) - sizes
            i = np.arange(sizes.sum()) - np.repeat(at - low, sizes)
            of = np.repeat(j, sizes)
            cost = best[i] + upper[of - 1] * (rows[of] - rows[i]) - (tokens[of] - tokens[i])
            new[j] = np.minimum.reduceat(cost, at)
            cut[j] = np.minimum.reduceat(np.where(cost == np.repeat(new[j], sizes), i, n), at)
            first, last = np.concatenate([first, j + 1]), np.concatenate([j - 1, last])
            low, high = np.concatenate([low, cut[j]]), np.concatenate([cut[j], high])
            some = first <= last
            first, last, low, high = first[some], last[some], low[some], high[some]
        cuts.append(cut)
        ends.append(new[n])
        best = new
    if not ends:
        return []
    k, j, out = int(np.argmin(ends)), n, []
    for cut in cuts[k::-1]:
        out.append(int(upper[j - 1]))
        j = int(cut[j])
        if not j:
            break
    return out[::-1]


def token_lengths(docs: DataFrame, path: str) -> DataFrame:
    """(id, n_tokens) for each row of `docs` (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]):
        enc = encoding(path)
        for batch in slices(batches, "text"):
            n = [len(encode(enc, x.decode("utf-8", "replace"))) for x in texts(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    frugal(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "id long, n_tokens long")


def pack(docs: DataFrame, path: str, *, buckets: int = 16, token_budget: int = 65_536, shard_rows: int = 50_000) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_tokens, bucket, bucket_tokens, shard, batch, position.

    Lengths are tokens of the rank file at `path`, which every executor must
    have. The global histogram has a bin for each distinct length, at most the
    root of twice the table's tokens; dynamic programming over it chooses the
    upper bounds of at most `buckets` buckets that make padding least. A
    batch has as many rows of a bucket as fit into `token_budget` when padded
    to `bucket_tokens`, one at least: a text longer than the budget is a
    batch by itself and stays whole. A bucket's rows are dealt by hash into
    shards of about `shard_rows` rows, whatever share of the table the bucket
    has, and batches form inside a shard in order of doc_id (null first).
    Null and repeated doc_ids and repeated rows are rows of their own. Null
    and empty texts have length 0 and are packed too. Other columns are
    ignored; an empty table gives an empty result.
    """
    named, new = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    lengths = pin(token_lengths(named, path))
    hist = lengths.groupBy(F.col("n_tokens").alias("upper")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("total"))
    table = hist.toArrow().sort_by("upper")
    upper, count, total = (table[c].to_numpy() for c in ("upper", "n", "total"))
    bounds = optimal_bounds(upper, count, total, buckets)
    where = np.searchsorted(bounds, upper)
    sizes = np.bincount(where, count, len(bounds)).astype(np.int64) if bounds else []

    def chosen(values: list[int]):
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]) if values else F.array(F.lit(0)), F.col("bucket") + 1).cast("long")

    bucket = F.size(F.filter(F.array(*[F.lit(int(b)).cast("long") for b in bounds]), lambda b: b < F.col("n_tokens"))) if bounds else F.lit(0)
    rows = lengths.withColumn("bucket", bucket.cast("int")).withColumn("bucket_tokens", chosen(bounds))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), chosen([-(-int(n) // shard_rows) or 1 for n in sizes])))
    rows = rows.withColumn("fits", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest("bucket_tokens", F.lit(1).cast("long")))))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("id")) - 1
    rows = rows.withColumn("place", place.cast("long"))
    out = rows.select(F.col("id").alias("doc_id"), "n_tokens", "bucket", "bucket_tokens", "shard", F.floor(F.col("place") / F.col("fits")).alias("batch"), (F.col("place") % F.col("fits")).alias("position"))
    return restored(out, named, "doc_id") if new else out
