"""Word shingles of texts as hashes, and the SimHash of such hashes."""

from __future__ import annotations

import numpy as np
import xxhash


def shingle_hashes(text: bytes, shingle: int, seed: int) -> list[int]:
    """XXH64 of each word shingle, repeats included; fewer words: of the whole sequence; no word: none.

    A-Z is lower-cased; words are [^\\x20\\x09-\\x0D]+, joined by spaces.
    """
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(b" ".join(words), seed)] if words else []
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stops = np.cumsum(sizes)
    starts = (stops - sizes)[: len(words) - shingle + 1].tolist()
    return [digest(line[a:b], seed) for a, b in zip(starts, (stops[shingle - 1 :] - 1).tolist(), strict=True)]


def simhashes(hashes: list[list[int]]) -> np.ndarray:
    """For each list of hashes the bits that are set in over half of them; zero for none."""
    out = np.zeros(len(hashes), np.uint64)
    stops = np.cumsum([len(h) for h in hashes], dtype=np.int64)
    starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    some = np.flatnonzero(stops > starts)
    if len(some):
        bits = np.unpackbits(np.array([x for h in hashes for x in h], dtype="<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        ones = np.add.reduceat(bits, starts[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > (stops - starts)[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out
