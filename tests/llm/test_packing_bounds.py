"""Bucket bounds at every distinct length."""

import public_tokenizers

from sparkgml.llm.packing import pack


def test_close_lengths_need_no_padding(spark):
    docs = spark.createDataFrame([(i, " the" * n) for i, n in enumerate([1000, 1001, 1002, 1003, 5000, 5001])], "doc_id long, text string")
    rows = pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert len({r.n_tokens for r in rows}) == 6 and all(r.n_tokens == r.bucket_tokens for r in rows)
