"""Deduplication operators against brute force, with nulls, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkgml.llm import suffix
from sparkgml.llm.common import mix
from sparkgml.llm.exact import exact_dedup
from sparkgml.llm.lines import PerfectHash, line_dedup
from sparkgml.llm.exact import RunFilter, halves
from sparkgml.llm import simhash
from sparkgml.llm.simhash import GrayIndex, fingerprint_batch, from_front, gray_rank, simhash_dedup, to_front
from sparkgml.llm.suffix import suffix_dedup

SCHEMA = "doc_id long, text string, kept string, keep_id string, fingerprint int, id int, group int"


def frame(spark, docs, parts=3):
    """Extra columns have names that the operators use too."""
    return spark.createDataFrame([(i, t, "x", None, 1, 2, 3) for i, t in docs], SCHEMA).repartition(parts)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


def ordered(expected):
    return sorted(expected, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


DOCS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, ""), (5, None), (6, " \n"), (7, "c"), (7, "c"), (None, "zz"), (8, "z z"), (9, "é "), (10, "é"), (11, "x" * 200_000), (12, "x" * 200_000 + " ")]


def brute_exact(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault((t or "").encode().translate(None, b" \t\n\x0b\x0c\r"), []).append((-len(t or ""), i is not None, i or 0, i))
    out = []
    for key, g in groups.items():
        first, *others = sorted(g)
        out += [(x[3], first[3], len(g), x is first, hashlib.sha256(key).hexdigest()) for x in (first, *others)]
    return ordered(out)


@pytest.mark.parametrize("digest_bytes, entries, held", [(32, 200_000, 1 << 25), (1, 2, 50), (0, 3, 1)])
def test_exact(spark, digest_bytes, entries, held):
    """A digest of one byte, or of none, makes different texts meet: bytes decide."""
    docs = DOCS + [(100 + i, f"t{i % 40}") for i in range(120)]
    df = exact_dedup(frame(spark, docs), digest_bytes=digest_bytes, memtable_entries=entries, memtable_bytes=held, run_hits=held)
    assert rows(df, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(docs)


def brute_lines(docs, min_docs, min_chars=1):
    counts = {}
    split = [(t or "").encode().split(b"\n") for _, t in docs]
    key = lambda x: x.strip(b" \t\n\x0b\x0c\r").lower()
    for lines in split:
        for k in {key(x) for x in lines}:
            counts[k] = counts.get(k, 0) + 1
    out = []
    for (i, _), lines in zip(docs, split, strict=True):
        kept = [x for x in lines if len(key(x).decode()) < min_chars or counts[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("table_bytes, shard_keys", [(1 << 25, 1 << 18), (0, 2)])
def test_lines(spark, table_bytes, shard_keys):
    """With the table in every task, and with lines sent to their shards."""
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choice(["Same line ", "\tsame LINE", "É", "é", "", "  ", f"own {i}", f"few {i % 9}", "x" * 5000]) for _ in range(rng.randint(0, 8)))) for i in range(60)] + DOCS
    df = line_dedup(frame(spark, docs), table_bytes=table_bytes, shard_keys=shard_keys)
    assert rows(df, "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(docs, 10)


def test_lines_copies(spark):
    """A shard that all documents ask has several copies of its table."""
    docs = [(i % 40, f"hot\n{i % 7}\nown {i}\nhot") for i in range(90)] + [(None, "hot"), (None, "own")]
    df = line_dedup(frame(spark, docs), table_bytes=0, shard_keys=3, copy_rows=10)
    assert rows(df, "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(docs, 10)


def test_lines_min_chars(spark):
    docs = [(i, "é\néé") for i in range(12)]
    assert rows(line_dedup(frame(spark, docs), min_chars=2), "n_dropped") == [(1,)] * 12


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        keys, prints = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)), None
        prints = mix(keys, 5)
        counts = rng.integers(1, 100, len(keys)).astype(np.uint32)
        table = PerfectHash.load(PerfectHash(keys, prints, counts).dump())
        assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
        assert (table.counts_of(keys, prints) == counts).all()
        assert not table.counts_of(mix(keys, 9), mix(keys, 6)).any()


def test_perfect_hash_with_equal_keys():
    """Keys whose first 64 bits are equal are told apart by their fingerprints."""
    keys = np.array([5, 9, 5, 7, 5, 2**63], np.uint64)
    prints, counts = np.array([1, 2, 3, 4, 5, 6], np.uint64), np.array([10, 20, 30, 40, 50, 60], np.uint32)
    table = PerfectHash.load(PerfectHash(keys, prints, counts).dump())
    assert table.counts_of(keys, prints).tolist() == counts.tolist() and len(table.over) == 3
    assert table.counts_of(keys, prints + np.uint64(100)).tolist() == [0] * 6


def brute_components(words, radius):
    label = np.arange(len(words))
    for i in range(len(words)):
        for j in np.flatnonzero(np.bitwise_count(words ^ words[i]) <= radius):
            a, b = label[i], label[j]
            if a != b:
                label[label == max(a, b)] = min(a, b)
    return label


@pytest.mark.parametrize("n", [1, 2, 17, 300, 1500])
def test_gray_index(n):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**63, max(1, n // 20), dtype=np.uint64)
    words = centres[rng.integers(0, len(centres), n)]
    for _ in range(3):
        words = words ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    words = np.unique(words)
    rng.shuffle(words)
    assert (GrayIndex(words).components(3) == brute_components(words, 3)).all()


def test_words_turned():
    words = np.random.default_rng(1).integers(0, 2**63, 50, dtype=np.uint64) * np.uint64(2)
    for block in range(4):
        front = to_front(words, block)
        assert (front >> np.uint64(48) == words >> np.uint64(16 * block) & np.uint64(0xFFFF)).all() and (from_front(front, block) == words).all()
        for part in range(4):
            front = to_front(words, block, part)
            assert (from_front(front, block, part) == words).all()
            assert (front >> np.uint64(36) & np.uint64(0xFFF) == to_front(words, block) >> np.uint64(12 * part) & np.uint64(0xFFF)).all()


@pytest.mark.parametrize("large", [False, True])
def test_index_finds_the_links(monkeypatch, large):
    """Rows dealt by block, or by block and part, reach the index whatever the size of their groups; components are those of all links."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, 40, dtype=np.uint64)[rng.integers(0, 40, 900)]
    for _ in range(3):
        words = words ^ np.where(rng.random(900) < 0.5, np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64), np.uint64(0))
    words = np.unique(words)
    asked, search = [], GrayIndex.search
    monkeypatch.setattr(GrayIndex, "search", lambda self, ask, *a: asked.append(len(ask)) or search(self, ask, *a))
    batch = simhash.pa.record_batch([simhash.pa.array(words.view(np.int64))], ["word"])
    (dealt,) = simhash.dealt(np.full(1 << 18, large))(iter([batch]))
    dealt = dealt.sort_by("group")
    label = {w: i for i, w in enumerate(words.tolist())}
    for out in simhash.linked(3)(iter([dealt.slice(0, 700), dealt.slice(700)])):
        for u, v in zip(out.column(0).to_numpy().view(np.uint64).tolist(), out.column(1).to_numpy().view(np.uint64).tolist(), strict=True):
            a, b = sorted((label[u], label[v]))
            label = {w: a if x == b else x for w, x in label.items()}
    assert [label[w] for w in words.tolist()] == brute_components(words, 3).tolist()
    assert sum(asked) == dealt.num_rows == len(words) * (16 if large else 4)


def test_run_filter():
    rng = random.Random(4)
    keys = [rng.randbytes(32) for _ in range(2000)]
    f = RunFilter.of(RunFilter(keys[:1000], 12_000).words.tobytes())
    assert f.has(*halves(keys[:1000])).all() and f.has(*halves(keys[1000:])).mean() < 0.03
    assert RunFilter([b"", b"a"], 64).has(*halves([b"", b"a"])).all()


def test_gray_rank():
    codes = np.array([i ^ (i >> 1) for i in range(500)], dtype=np.uint64)
    assert (gray_rank(codes) == np.arange(500)).all()


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("part_rows", [1 << 18, 6])
def test_simhash(spark, part_rows):
    """Also with blocks cut into parts, where each pair of parts is a task."""
    rng = random.Random(7)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta É ü".split()) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 150))) for _ in range(12)]
    docs = [(None, ""), (3, None), (4, "one"), (5, "ONE"), (6, "one two"), (7, "x" * 100_000), (7, "x" * 100_000), (None, "own words here too")]
    for i in range(150):
        words = rng.choice(base).split()
        if words and rng.random() < 0.8:
            words[rng.randrange(len(words))] = "changed"
        docs.append((1000 - i, " ".join(words)))
    words = np.array([brute_fingerprint(t) for _, t in docs], dtype=np.uint64)
    assert (fingerprint_batch([(t or "").encode() for _, t in docs]) == words).all()
    label = brute_components(words, 3)
    least = {}
    for (i, _), x in zip(docs, label, strict=True):
        least[x] = min([v for v in (least.get(x), i) if v is not None], default=None)
    expected = ordered([(i, f"{w:016x}", least[x]) for (i, _), w, x in zip(docs, words, label, strict=True)])
    got = simhash_dedup(frame(spark, docs), part_rows=part_rows)
    assert rows(got, "doc_id", "fingerprint", "component_id") == expected
    assert got.where("kept").count() == len(set(label.tolist()))


def brute_suffix(docs, length):
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        t = (text or "").encode()
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if t[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(t[p : p + length])
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return ordered(out)


def passages(seed, n, length, alphabet):
    rng = random.Random(seed)
    shared = ["".join(rng.choice(alphabet) for _ in range(rng.randint(length // 2, 3 * length))) for _ in range(8)]
    docs = [(i, "".join(rng.choice([rng.choice(shared), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, length)))]) for _ in range(rng.randint(0, 6)))) for i in range(n)]
    docs += [(n + i, docs[rng.randrange(n)][1]) for i in range(n // 4)]
    docs += [(10 * n, "ab" * 400), (10 * n + 1, "a" * 700), (10 * n + 2, "xyz" * 300 + "é" * 300), (10 * n + 3, "é" * 200 + "ab" * 300), (10 * n + 4, ""), (10 * n + 5, None), (None, "ab" * 100)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("length, alphabet, n, contexts", [(100, "abcdefgh é", 50, 50_000), (20, "ab", 40, 50_000), (7, "abc", 30, 50_000), (100, "abcdefgh é", 50, 1), (20, "ab", 40, 3)])
def test_suffix(spark, length, alphabet, n, contexts):
    """Also with grams of more than 1 and 3 surroundings treated as hot."""
    docs = passages(length, n, length, alphabet)
    assert rows(suffix_dedup(frame(spark, docs), length=length, gram_contexts=contexts), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_suffix(docs, length)


def test_suffix_repeated_rows(spark):
    """Rows of one doc_id, or of none, are documents of their own: copies lose their text, others nothing."""
    rng = random.Random(1)
    text, other, third = ("".join(rng.choice("abcdef ") for _ in range(500)) for _ in range(3))
    got = rows(suffix_dedup(frame(spark, [(1, text), (1, text), (2, text), (2, other), (None, third), (None, third), (None, "")])), "doc_id", "n_bytes", "n_removed")
    assert got == [(None, 0, 0), (None, 500, 0), (None, 500, 500), (1, 500, 0), (1, 500, 500), (2, 500, 0), (2, 500, 500)]


def test_suffix_collisions(monkeypatch):
    """With a hash that tells nothing before the anchor apart, bytes decide."""
    shape = suffix.Shape(20)
    rng = random.Random(2)
    shared = ["".join(rng.choice("ab") for _ in range(30)) for _ in range(4)]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 15))) + rng.choice(shared) + "".join(rng.choice("ab") for _ in range(rng.randint(0, 15))) for _ in range(30)]
    kind = suffix.record_type(shape.context)

    def records():
        out = []
        for i, t in enumerate(texts):
            data, offsets = np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])
            at, h = suffix.anchors(data, offsets, shape)
            padded = np.concatenate([np.zeros(shape.left, np.uint8), data, np.zeros(shape.length, np.uint8)])
            for a, g in zip(at.tolist(), h, strict=True):
                start, end = max(0, a - shape.left), min(len(t), a + shape.length)
                out.append((g, i, a, a - start, end - a, padded[a : a + shape.context]))
        rec = np.array(out, kind)
        return rec[np.argsort(rec["h"], kind="stable")]

    def covered():
        ids, start, end = suffix.repeated(records(), shape)
        gone = {i: set() for i in range(len(texts))}
        for i, a, b in zip(ids.tolist(), start.tolist(), end.tolist(), strict=True):
            gone[i] |= set(range(a, b))
        return gone

    want = covered()
    real = suffix.mix
    monkeypatch.setattr(suffix, "mix", lambda x, seed=0: np.zeros_like(x) if seed == 4 else real(x, seed))
    assert covered() == want and any(want.values())


def test_suffix_sort():
    rng = np.random.default_rng(4)
    body = rng.integers(0, 2, (300, 12)).astype(np.uint8)
    size = rng.integers(0, 13, 300)
    for i, n in enumerate(size):
        body[i, n:] = 0
    group = np.sort(rng.integers(0, 6, 300))
    order = suffix.Suffixes(body, size).sort(group)
    keys = [(group[i], bytes(body[i, : size[i]])) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(300))


@pytest.mark.parametrize("operator", [exact_dedup, line_dedup, simhash_dedup, suffix_dedup])
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).count() == 0


def test_everything_null(spark):
    df = frame(spark, [(None, None)] * 3)
    assert rows(exact_dedup(df), "doc_id", "keep_id", "group_size", "kept") == [(None, None, 3, False)] * 2 + [(None, None, 3, True)]
    assert rows(simhash_dedup(df), "fingerprint", "component_id") == [("0" * 16, None)] * 3
    assert rows(suffix_dedup(df), "doc_id", "n_bytes") == [(None, 0)] * 3
    assert line_dedup(df.withColumn("more", F.lit(1))).count() == 3


@pytest.mark.parametrize("parts", [1, 7])
def test_suffix_hashes_that_meet(spark, monkeypatch, parts):
    """With a context hash that tells nothing apart, in one task and across tasks, no byte goes that isn't a copy's."""
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdef") for _ in range(60))  # a common gram, but no common string of the length
    docs = [(i, "".join(rng.choice("abcdef") for _ in range(90)) + shared + "".join(rng.choice("abcdef") for _ in range(90))) for i in range(12)]
    docs += [(20 + i, docs[i][1]) for i in range(3)]
    truth = {(r[0], r[2]) for r in brute_suffix(docs, 100)}
    rows_of, real = suffix.gathered, suffix.xxhash.xxh3_64_intdigest

    def blind(shape, shards):
        work = rows_of(shape, shards)

        def run(batches):
            suffix.xxhash.xxh3_64_intdigest = lambda data, seed=0: 7
            try:
                yield from work(batches)
            finally:
                suffix.xxhash.xxh3_64_intdigest = real

        return run

    monkeypatch.setattr(suffix, "gathered", blind)
    got = {(r.doc_id, r.n_removed) for r in suffix_dedup(frame(spark, docs, parts)).collect()}
    assert {i: n for i, n in got if i < 20} == dict.fromkeys(range(12), 0) and all(n <= dict(truth)[i] for i, n in got) and truth


def test_equal_bytes():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 2, 400).astype(np.uint8)
    start, other, n = rng.integers(0, 380, 3000), rng.integers(0, 380, 3000), rng.integers(0, 12, 3000)
    end, other_end = np.minimum(start + n, 400), np.minimum(other + n, 400)
    want = [data[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(start, end, other, other_end, strict=True)]
    assert suffix.equal_bytes(data, start, end, other, other_end, 12, rows=700).tolist() == want and any(want)
