"""Quality rules: counted base rules, then a calibrated regression over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, frugal, joined, mix, slices, texts
from .labelled import fit_dense, sample_labelled, sigmoid

#: Hash buckets of each family; the families are n-grams of code points and of words.
BUCKETS = 1 << 15
CHAR_SIZES, WORD_SIZES = (1, 3, 5), (1, 2)
#: Base of the hash of several code points.
CHAR_BASE = np.uint64(0x9E3779B97F4A7C15)
FAMILIES = len(CHAR_SIZES) + len(WORD_SIZES)
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


def table_of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


IS_WS, IS_SYMBOL = table_of(WS), table_of(SYMBOLS)


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; the ends of texts end words too."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~IS_WS[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[1 + cuts]
    last[cuts - 1] |= inside[cuts]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def code_points(data: np.ndarray) -> np.ndarray:
    """The code points of well-formed UTF-8, one for each byte that starts one."""
    if not (data & 0x80).any():
        return data.astype(np.uint64)
    starts = np.flatnonzero(data & 0xC0 != 0x80)
    lead = data[starts].astype(np.uint64)
    size = np.diff(np.append(starts, len(data)))
    out = np.where(size > 1, lead & (np.uint64(0x7F) >> size.astype(np.uint64)), lead)
    for i in range(1, 4):
        more = size > i
        out[more] = out[more] << np.uint64(6) | (data[starts[more] + i] & 0x3F).astype(np.uint64)
    return out


def hashed_families(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family: the texts that its n-grams belong to, ascending, and their buckets."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    x = data.astype(np.uint64)
    points, of = code_points(data), owner[data & 0xC0 != 0x80]
    for f, n in enumerate(CHAR_SIZES):
        if len(points) < n:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        code = points[: len(points) - n + 1].copy()
        for i in range(1, n):
            code = code * CHAR_BASE + points[i : len(points) - n + 1 + i]
        same = of[n - 1 :] == of[: len(code)]
        yield of[: len(same)][same], (mix(code[same], f) % np.uint64(BUCKETS)).astype(np.int64)
    starts, ends = word_starts(data, offsets)
    power = np.cumprod(np.full(len(data) + 1, 0x9E3779B97F4A7C15, np.uint64))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((x + np.uint64(1)) * power[:-1], out=sums[1:])
    inverse = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    back = np.cumprod(np.full(len(data) + 1, inverse, np.uint64))
    word = mix((sums[ends] - sums[starts]) * back[starts])
    mine = owner[starts] if len(data) else np.zeros(0, np.int64)
    for f, n in enumerate(WORD_SIZES):
        code = word[: max(0, len(word) - n + 1)].copy()
        for i in range(1, n):
            code = mix(code, i) ^ word[i : len(word) - n + 1 + i]
        same = mine[n - 1 :] == mine[: len(code)]
        yield mine[: len(code)][same], (mix(code[same], 10 + f) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class QualityModel:
    """Weights of every bucket of every family, intercept, and the calibration's slope and shift."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, raw: list[bytes]) -> np.ndarray:
        """For each text the sum over families of the mean weight of its n-grams."""
        data, offsets = joined(raw)
        out = np.full(len(raw), self.intercept)
        for f, (owner, bucket) in enumerate(hashed_families(data, offsets)):
            n = np.bincount(owner, minlength=len(raw))
            out += np.bincount(owner, self.weights[f][bucket], len(raw)) / np.maximum(n, 1)
        return out

    def probability(self, raw: list[bytes]) -> np.ndarray:
        return sigmoid(self.slope * self.margins(raw) + self.shift)


def fit_quality(docs: DataFrame, labels: DataFrame, *, per_class: int = 1000, max_bytes: int = 32 << 20, rounds: int = 80, penalty: float = 1e-5) -> QualityModel:
    """Fit on about `per_class` labelled rows at most of each class, of about `max_bytes` together; every fifth of them calibrates. Without rows of both classes every text gets one half; rows without label, doc_id or text aren't used."""
    rows = sample_labelled(docs, labels, "quality", per_class, max_bytes)
    model = QualityModel(np.zeros((FAMILIES, BUCKETS), np.float32), 0.0)
    y = np.array([r[2] for r in rows])
    if len(set(y.tolist())) < 2:
        return model  # nothing to tell apart: every text gets one half
    apart = np.arange(len(rows)) % 5 == 4
    columns, owners, values = [], [], []
    step = 200
    for a in range(0, len(rows), step):
        data, offsets = joined([r[1].encode("utf-8", "replace") for r in rows[a : a + step]])
        for f, (owner, bucket) in enumerate(hashed_families(data, offsets)):
            key, n = np.unique(owner << 20 | bucket, return_counts=True)
            own = key >> 20
            total = np.bincount(own, n, len(offsets) - 1)
            owners.append((own + a).astype(np.int32))
            columns.append(((key & (1 << 20) - 1) + f * BUCKETS).astype(np.int32))
            values.append((n / total[own]).astype(np.float32))
    owner, column, value = map(np.concatenate, (owners, columns, values))
    use = ~apart[owner]
    owner, column, value = owner[use], column[use], value[use]
    # columns on one scale, so that rare n-grams can count
    scale = 1 / np.sqrt(np.bincount(column, value * value, FAMILIES * BUCKETS) / (~apart).sum() + 1e-6)
    value = (value * scale[column]).astype(np.float32) / np.sqrt(np.bincount(owner, minlength=len(rows)).mean()).astype(np.float32)
    balance = np.where(y == 1, 0.5 / y[~apart].mean(), 0.5 / (1 - y[~apart].mean())) * ~apart
    w, b, m, v = np.zeros(FAMILIES * BUCKETS), 0.0, np.zeros(FAMILIES * BUCKETS), np.zeros(FAMILIES * BUCKETS)
    bm = bv = 0.0
    for t in range(1, rounds + 1):
        error = balance * (sigmoid(np.bincount(owner, w[column] * value, len(rows)) + b) - y) / (~apart).sum()
        g, gb = np.bincount(column, error[owner] * value, len(w)) + penalty * w, error.sum()
        m, v, bm, bv = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * bm + 0.1 * gb, 0.99 * bv + 0.01 * gb * gb
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 0.05 * (bm / (1 - 0.9**t)) / (np.sqrt(bv / (1 - 0.99**t)) + 1e-8)
    norm = np.sqrt(np.bincount(owner, minlength=len(rows)).mean())
    model.weights, model.intercept = (w * scale / norm).reshape(FAMILIES, BUCKETS).astype(np.float32), b
    at = np.flatnonzero(apart)
    if len(set(y[at].tolist())) == 2:
        margins = model.margins([rows[i][1].encode("utf-8", "replace") for i in at])
        # margins on a scale of one, and targets that leave room for errors not seen in the sample
        middle, spread = margins.mean(), margins.std() + 1e-9
        up, down = (y[at] == 1).sum(), (y[at] == 0).sum()
        target = np.where(y[at] == 1, (up + 1) / (up + 2), 1 / (down + 2))
        slope, shift = fit_dense(((margins - middle) / spread)[:, None], target, np.array([1.0, 0.0]), 0.1)
        model.slope, model.shift = slope / spread, shift - slope * middle / spread
    return model


def base_counts(raw: list[bytes]) -> dict[str, np.ndarray]:
    """The counts that the base rules look at, for each text."""
    data, offsets = joined(raw)
    n = len(raw)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = {
        "word_chars": np.bincount(owner[~IS_WS[data] & (data & 0xC0 != 0x80)], minlength=n),
        "n_symbols": np.bincount(owner[IS_SYMBOL[data]], minlength=n),
    }
    split = [t.split() for t in raw]
    counts["n_words"] = sizes = np.array([len(s) for s in split], np.int64)
    again = np.zeros(n, np.int64)
    for i, text in enumerate(raw):
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x.strip(WS)]
            again[i] = len(lines) - len(set(lines))
    counts["n_dup_lines"] = again
    word = np.fromiter((hash(w) for s in split for w in s), np.int64, int(sizes.sum())).view(np.uint64)
    mine = np.repeat(np.arange(n), sizes)
    covered = np.zeros(len(word) + 1, np.int64)
    if len(word) >= WINDOW:
        last = len(word) - WINDOW + 1
        code = mine[:last].astype(np.uint64)
        for i in range(WINDOW):
            code = mix(code, i) ^ word[i : last + i]
        at = np.flatnonzero(mine[WINDOW - 1 :] == mine[:last])
        code = code[at]
        ordered = np.sort(code)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            where = np.minimum(np.searchsorted(twice, code), len(twice) - 1)
            hit = at[twice[where] == code]
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + WINDOW, -1)
    counts["n_repeat_words"] = np.bincount(mine[np.cumsum(covered[:-1]) > 0], minlength=n)
    return counts


def quality_rules(docs: DataFrame, model: QualityModel, *, min_words: int = 10, repeat_percent: int = 20, min_quality: float = 0.5) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality.

    Words are [^\\x20\\x09-\\x0D]+; a null text has none. n_symbols counts
    [#*$%&|<>], n_dup_lines the lines with a word that equal an earlier line,
    n_repeat_words the words in windows of five words that occur twice or
    more, the first time included. base_failed: under `min_words` words, or
    more than `repeat_percent` of them repeated. `quality` is the model's
    calibrated probability; a row is kept if it did not fail and has
    `min_quality` at least. Other columns are ignored, repeated rows have
    equal results; an empty table gives an empty result. A text of n bytes
    takes some 100 n bytes of memory in its task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def work(batches: Iterator[pa.RecordBatch]):
        model = shared.value
        for batch in slices(batches, "text", 1 << 20):
            raw = texts(batch.column(1))
            counts = base_counts(raw)
            failed = (counts["n_words"] < min_words) | (100 * counts["n_repeat_words"] > repeat_percent * counts["n_words"])
            quality = model.probability(raw)
            yield pa.record_batch([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in longs), pa.array(failed), pa.array(~failed & (quality >= min_quality)), pa.array(quality)], ["doc_id", *longs, "base_failed", "kept", "quality"])

    frugal(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, f"doc_id long, {', '.join(f'{k} long' for k in longs)}, base_failed boolean, kept boolean, quality double")
