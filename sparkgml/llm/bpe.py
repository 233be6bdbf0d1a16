"""BPE by speculation: greedy longest match, a check of adjacent tokens, exact merging where it fails."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, slices

END = "</w>"
#: No merge, or a token that nothing absorbs.
NEVER = 1 << 40
#: Characters of the longest words that are kept.
LONG_WORD = 1000
#: What the tokenizer's file format calls white space, and its pattern for pieces of text.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_alphabet() -> list[str]:
    """For each byte the character that stands for it in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class SpeculativeBpe:
    """A word-end BPE tokenizer read from a file of the tokenizers library; lower-casing, NFC, no truncation or padding."""

    def __init__(self, path: str, cache_words: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not a lower-casing BPE with word ends")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.bytes = byte_alphabet()
        self.longest = max(map(len, self.vocab))
        self.reach: dict[str, int] = {}  # the longest token that starts with these two characters
        for t in self.vocab:
            if not t.endswith(END) or len(t) == len(END):
                self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        size = max(self.names) + 1
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)  # base symbols: -1
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merge[x, y] = (r, z)
            self.left[z], self.right[z], self.rank[z] = x, y, r
        keys = np.array([x << 20 | y for x, y in self.merge], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merge.values()], dtype=np.int64)[order]
        made = np.flatnonzero(self.rank >= 0)
        self.whole = np.ones(size, bool)  # tokens whose own text merges into them
        self.whole[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            self.whole[t] &= self.whole[self.left[t]] & self.whole[self.right[t]]
        self.cache: dict[str, tuple[int, bytes, str]] = {}
        self.old: dict[str, tuple[int, bytes, str]] = {}
        self.cache_words = cache_words
        self.failed = self.guessed = 0

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether merging the text of a[i] followed by that of b[i] leaves these two tokens, up to rank `until`.

        Going back in time from (a, b), the tokens that meet at the border are
        found by undoing the later of the two last merges. A pair of them that
        has a merge of its own, earlier than what absorbs either, would have
        crossed the border. Of equal merges, the left one comes first.
        """
        x, y = a.copy(), b.copy()
        x_end, y_end = (np.broadcast_to(until, a.shape).astype(np.int64) for _ in range(2))
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            p, q = x[live], y[live]
            key = p << 20 | q
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            m = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
            crossed = (m < x_end[live]) & (m <= y_end[live])
            if until is not NEVER:
                crossed &= m < until[live]
            ok[live[crossed]] = False
            rp, rq = self.rank[p], self.rank[q]
            on = ~crossed & (np.maximum(rp, rq) >= 0)
            left_later = on & (rp > rq)
            right_later = on & ~left_later
            i, j = live[left_later], live[right_later]
            x_end[i], x[i] = rp[left_later], self.right[p[left_later]]
            y_end[j], y[j] = rq[right_later], self.left[q[right_later]]
            live = live[on]
        return ok

    def symbols(self, word: str) -> str:
        return "".join(map(self.bytes.__getitem__, word.encode("utf-8")))

    def guess(self, text: str) -> list[int]:
        """Greedy longest match from the left; `text` without the word end."""
        out, i, n, vocab, longest, reach = [], 0, len(text), self.vocab, self.longest, self.reach
        while i < n:
            if n - i + len(END) <= longest and (t := vocab.get(text[i:] + END)) is not None:
                out.append(t)
                break
            for j in range(min(n - 1, i + reach.get(text[i : i + 2], 1)), i, -1):
                if (t := vocab.get(text[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def exact(self, text: str) -> list[int]:
        """All merges in order of rank, the leftmost first among equals."""
        ids = [self.vocab[c] for c in text[:-1]] + [self.vocab[text[-1] + END]]
        if len(ids) <= 40:
            merge, none = self.merge.get, (NEVER, 0)
            ranks = [merge(p, none) for p in zip(ids, ids[1:])]
            while ranks:
                best = min(ranks)
                if best is none:
                    break
                i = ranks.index(best)
                ids[i : i + 2] = [best[1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = merge((ids[i - 1], ids[i]), none)
                if i < len(ranks):
                    ranks[i] = merge((ids[i], ids[i + 1]), none)
            return ids
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = self.merge[x, y][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (m := self.merge.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (m[0], a, ids[a], ids[b]))
        return [t for t in ids if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Encode words that the cache doesn't have."""
        texts = [self.symbols(w) for w in words]
        guesses = [self.guess(t) for t in texts]
        sizes = np.array([len(g) for g in guesses])
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        bad = np.zeros(len(words), bool)
        bad[owner[~self.whole[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, where = np.unique(flat[inner] << 20 | flat[inner + 1], return_inverse=True)
        ok = self.compatible(pairs >> 20, pairs & (2**20 - 1))
        bad[owner[inner[~ok[where]]]] = True
        self.guessed += len(words)
        self.failed += int(bad.sum())
        names = self.names
        for i, word in enumerate(words):
            ids = self.exact(texts[i]) if bad[i] else guesses[i]
            self.cache[word] = (len(ids), np.array(ids, dtype="<u4").tobytes(), " ".join([names[t] for t in ids]))

    def pieces(self, text: str) -> list[str]:
        """Normalised words; a special token stands as a piece of its own."""
        if self.special_at and self.special_at.search(text):
            out, at = [], 0
            for m in self.special_at.finditer(text):
                out += self.words(text[at : m.start()])
                out.append((m[0],))
                at = m.end()
            return out + self.words(text[at:])
        return self.words(text)

    @staticmethod
    def words(text: str) -> list[str]:
        if text.isascii():
            return ASCII_PIECES.findall(text.lower())
        # a final sigma is lower-cased like any other
        return PIECES.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, texts: list[str]) -> Iterator[tuple[int, bytes, str]]:
        """For each text: number of tokens, ids as little-endian 32-bit integers, decoded text (tokens joined by spaces)."""
        pieces = [self.pieces(t) for t in texts]
        if len(self.cache) > self.cache_words // 2:
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        for name, i in self.special.items():
            cache[(name,)] = (1, np.array([i], "<u4").tobytes(), name)
        new = {w for p in pieces for w in p if w not in cache}
        for w in new:
            if w in old:
                cache[w] = old[w]
        if unknown := [w for w in new if w not in cache]:
            self.learn(unknown)
        for p in pieces:
            got = [cache[w] for w in p]
            yield sum([x[0] for x in got]), b"".join([x[1] for x in got]), " ".join([x[2] for x in got])
        for w in new:  # words of this length hardly come again
            if len(w) > LONG_WORD:
                del cache[w]


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    `path` is the tokenizer's file, which every executor must have; it is
    read there once for each task. Null counts as empty: no tokens. Strings
    of special tokens within a text become those tokens. The file names no
    decoder, so decoding joins the tokens by spaces. Other columns are
    ignored, repeated rows have equal results.

    Words are encoded once and kept in a table of bounded size, but for very long ones. A new word is
    cut by greedy longest match; if each adjacent pair of tokens is one that
    merging leaves alone, the cut is the word's encoding, else the word is
    merged step by step.
    """

    def work(batches: Iterator[pa.RecordBatch]):
        bpe = SpeculativeBpe(path)
        for batch in slices(batches, "text", 1 << 20):
            n, ids, text = [], [], []
            for k, i, t in bpe.encode([x or "" for x in batch.column(1).to_pylist()]):
                n.append(k)
                ids.append(hashlib.sha256(i).hexdigest())
                text.append(hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    frugal(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
