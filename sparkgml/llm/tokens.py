"""Token counts of sections by offsets of the tokens of whole documents."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, slices, texts

#: Fixed value: how the rank files' tokenizers split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "most")
#: White space of which the pattern makes one piece, in runs that would be too long for the pattern's matcher.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


@cache
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a rank file; read once in each worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The tokens of a text; long runs of white space, all but a last character before other text, are pieces cut here."""
    out, at = [], 0
    for m in LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._encode_single_piece(text[m.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


@cache
def token_sizes(path: str) -> np.ndarray:
    """Bytes of each token."""
    enc = encoding(path)
    sizes = np.zeros(enc.max_token_value + 1, np.int64)
    for t in range(enc.max_token_value + 1):
        try:
            sizes[t] = len(enc.decode_single_token_bytes(t))
        except KeyError:
            pass
    return sizes


def token_ends(text: bytes, path: str) -> np.ndarray:
    """The byte at which each token of the whole text ends."""
    return np.cumsum(token_sizes(path)[encode(encoding(path), text.decode("utf-8", "replace"))])


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross its bounds.

    Section i is bytes bounds[i] to bounds[i + 1]. A token that crosses a
    bound belongs to the section of its first byte, of its last, or to that
    with most of its bytes (the earlier among equals).
    """
    n = len(bounds) - 1
    starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
    first = np.clip(np.searchsorted(bounds, starts, "right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(bounds, ends - 1, "right") - 1, 0, n - 1)
    # a section without bytes has no token: searchsorted gives the last of equal bounds
    owner = first if rule == "first" else last.copy()
    crosses = first != last
    if rule == "most":
        owner = first.copy()
        for i in np.flatnonzero(crosses):
            parts = range(first[i], last[i] + 1)
            owner[i] = max(parts, key=lambda s: (min(ends[i], bounds[s + 1]) - max(starts[i], bounds[s]), -s))
    return np.bincount(owner, minlength=n), np.bincount(owner[crosses], minlength=n)


def sections_of(text: bytes, separator: bytes = b"\n") -> np.ndarray:
    """Bounds of the sections that end after each separator; a text without any is one section."""
    cuts = [m.end() for m in re.finditer(re.escape(separator), text)]
    if cuts and cuts[-1] == len(text):
        cuts.pop()
    return np.array([0, *cuts, len(text)], dtype=np.int64)


def token_counts(docs: DataFrame, path: str, *, rule: str = "first", separator: str = "\n") -> DataFrame:
    """One row for each section of each row of `docs` (doc_id, text): doc_id, section, start, n_chars, n_tokens, n_crossing.

    A section ends after each `separator`; `start` and `n_chars` are in code
    points. The whole text is encoded once by the rank file at `path`, which
    every executor must have; the tokens' spans are joined to the sections by
    their sorted bounds, and a token that crosses bounds is given to one
    section by `rule`: that of its first byte, of its last, or of most bytes
    (the earlier among equals). So the sections' n_tokens add up to the
    document's. n_crossing counts those given to a section that other
    sections share. A null or empty text is one section without tokens.
    Other columns are ignored, repeated rows have equal results.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def work(batches: Iterator[pa.RecordBatch]):
        mark = separator.encode()
        for batch in slices(batches, "text", 1 << 20):
            ids, out = [], []
            for i, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                bounds = sections_of(text, mark)
                n, crossing = attribute(token_ends(text, path), bounds, rule)
                points = np.concatenate([[0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)])[bounds]
                ids += [i] * len(n)
                out.append((np.arange(len(n)), points[:-1], np.diff(points), n, crossing))
            yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True))], ["doc_id", "section", "start", "n_chars", "n_tokens", "n_crossing"])

    frugal(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, section long, start long, n_chars long, n_tokens long, n_crossing long")
