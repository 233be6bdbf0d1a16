"""Near copies against brute force over all pairs."""

import random

import pytest

import corpus_pipeline as P
from sparkgml.llm.common import pin
from sparkgml.llm.simhash import simhash_dedup


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def brute(docs, similarity=0.8):
    sets = [shingles(t) for _, t in docs]
    label = [i for i, _ in docs]
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9 and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    return {i: x for (i, _), x in zip(docs, label, strict=True)}


def copies(seed, n):
    """Texts with 1 to 8 changed words, around and below similarity 0.8; a large group; short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(rng.randint(40, 300))] for _ in range(25)]
    docs = []
    for i in range(n):
        words = list(base[0] if i % 3 == 0 else rng.choice(base))
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = word()
        docs.append((i, " ".join(words)))
    return [*docs, (n, "one two"), (n + 1, "ONE  two"), (n + 2, "one two three"), (n + 3, "")]


def crowd(seed, n):
    """Copies of one text and of a shortened one, most of them just too different from each other."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(90)]
    docs = []
    for i in range(n):
        words = list(base if i % 4 else base[: rng.randint(68, 80)])
        for _ in range(rng.randint(2, 6)):
            words[rng.randrange(len(words))] = rng.choice(["x1", "x2", f"y{rng.randint(0, 900)}"])
        docs.append((i, " ".join(words)))
    return docs


@pytest.mark.parametrize("docs", [copies(5, 300), crowd(6, 260)], ids=["copies", "crowd"])
def test_against_brute_force(spark, docs):
    got = {r.doc_id: (r.component_id, r.kept) for r in simhash_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shingle=5, similarity=0.8).collect()}
    want = brute(docs)
    assert got == {i: (x, i == x) for i, x in want.items()} and len(set(want.values())) > 30


def test_stage_drops_copies_of_similarity_080(spark):
    """Nine shingles of a hundred differ in each: similarity 0.83, and 0.74 for the last."""
    words = [f"w{i}" for i in range(104)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:50], "x", "y", *words[52:]])), (3, " ".join([*words[:20], "x", *words[21:80], "y", "z", "u", "v", "w", "q", "r", *words[87:]]))]
    rows = pin(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(r.doc_id for r in dict(P.STAGES)["near_dedup"](spark, rows, "").collect()) == [1, 3]
