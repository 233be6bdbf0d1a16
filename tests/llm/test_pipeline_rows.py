"""Rows of the pipeline with null and repeated doc_ids."""

import corpus_pipeline as P
from sparkgml.llm.common import pin

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def left(spark, stage, rows):
    docs = pin(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3))
    out = dict(P.STAGES)[stage](spark, docs, "")
    assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_exact_by_row(spark):
    rows = [(None, "z z"), (None, "zz"), (None, "another clean text"), (5, "one"), (5, "o ne"), (5, "two"), (6, "same"), (6, "same")]
    assert left(spark, "exact_dedup", rows) == [(None, "another clean text"), (None, "z z"), (5, "o ne"), (5, "two"), (6, "same")]


def test_near_by_row(spark):
    text, other = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    rows = [(None, text.upper()), (1, text), (None, other), (7, other.upper()), (7, "a third text"), (None, "a fourth text")]
    assert left(spark, "near_dedup", rows) == [(None, "a fourth text"), (1, text), (7, other.upper()), (7, "a third text")]


def test_passages_by_row(spark):
    """What one text loses isn't cut from another of the same doc_id."""
    passage, unique = "".join(f"{i * i:04d}" for i in range(40)), "".join(f"{i:03d}" for i in range(120))
    for i in (9, None):
        rows = [(-5, passage + "a"), (i, passage + "b"), (i, unique)]
        assert sorted(t for _, t in left(spark, "suffix_dedup", rows)) == sorted([passage + "a", "b", unique] if i else ["a", passage + "b", unique])


def test_language_without_profiles(spark):
    docs = spark.createDataFrame([(1, "clean text", None, "s", 10), (2, "123 !!", None, "s", 6), (3, None, None, "s", 0), (4, "é", None, "s", 1)], SCHEMA)
    assert sorted(r.doc_id for r in dict(P.STAGES)["language_id"](spark, docs, "").collect()) == [1, 4]
