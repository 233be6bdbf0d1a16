"""The pipeline's stages against brute force, on a small fixture and on the smallest tables."""

import os
import random

import pytest

import corpus_pipeline as P
from sparkgml.llm.common import pin, pinned

from .test_dedup import brute_exact, brute_suffix
from .test_near import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(rng.randint(30, 120))) for _ in range(30)]
    passage = " ".join(word() for _ in range(60))
    docs = []
    for i in range(120):
        words = rng.choice(base).split()
        kind = rng.random()
        if kind < 0.3:
            words[rng.randrange(len(words))] = word()
        elif kind < 0.6:
            words = [*(word() for _ in range(40)), passage, *(word() for _ in range(40))]
        docs.append((i, " ".join(words), "en", "s", 0))
    docs += [(200, None, "en", "s", 0), (201, "", "en", "s", 0), (202, "123 !!", None, "s", 0), (203, "é" * 300, "fr", "s", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s, _ in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(P.STAGES)
    assert [k for k, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    a = pin(stages["language_id"](spark, docs, sf))
    assert a.columns == COLUMNS and pairs(a) == sorted((r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    b = pin(stages["exact_dedup"](spark, a, sf))
    kept = {x[0] for x in brute_exact(pairs(a)) if x[3]}
    assert b.columns == COLUMNS and pairs(b) == [x for x in pairs(a) if x[0] in kept]
    c = pin(stages["near_dedup"](spark, b, sf))
    label = brute(pairs(b))
    assert pairs(c) == [x for x in pairs(b) if label[x[0]] == x[0]]
    d = pin(stages["suffix_dedup"](spark, c, sf))
    left = {x[0]: x[1] - x[2] for x in brute_suffix(pairs(c), 100)}
    assert d.columns == COLUMNS and {i: len(t.encode()) for i, t in pairs(d)} == left and any(len(t) != n for (_, t), n in zip(pairs(c), left.values(), strict=True))
    assert all(r.n_chars == len(r.text) for r in d.collect())
    e = stages["packing"](spark, d, sf)
    assert sorted(r.doc_id for r in e.collect()) == [i for i, _ in pairs(d)]
    assert sorted(r.doc_id for r in P.run(spark, sf).collect()) == [i for i, _ in pairs(d)] and P.ORACLE_SQL is None


def test_run_leaves_its_last_tables_alone(spark, sf):
    """What a stage's result was made from is deleted; results and what others have pinned stay."""
    mine = pin(spark.range(3).toDF("doc_id"))
    before = set(pinned())
    result = P.run(spark, sf)
    left = [p for p in pinned() if p not in before]
    assert result.count() == result.count() > 0 and mine.count() == 3 and len(left) <= 3


def test_empty_and_extra_columns(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, id long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    some = spark.createDataFrame([(1, "some text here", "en", "s", 1, "r", "k", 5), (None, "other words", None, None, None, None, None, None)], docs.schema)
    for _, stage in P.STAGES[:-1]:
        some = pin(stage(spark, some, str(tmp_path)))
        assert some.columns == docs.columns
    assert sorted(str(r.row) for r in some.collect()) == ["None", "r"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_smallest_tables(spark):
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert 0 < P.run(spark, "/root/testdata/sf0.001").count() <= n
