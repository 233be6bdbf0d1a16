"""Bounded samples of labelled documents, and logistic regression for small dense or sparse inputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINE = 1 << 20


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int = 32 << 20) -> list[tuple[int, str, int]]:
    """About `per_class` rows (doc_id, text, label) at most of each class, of about `max_bytes` of text together, chosen by a hash of doc_id.

    Rows without label, doc_id or text are left out. The chosen identifiers
    are few by construction and so may be broadcast.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).dropna()
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if not sizes:
        return []
    place = F.pmod(F.xxhash64("id"), F.lit(FINE))
    share = {k: min(FINE, int(per_class / n * FINE) + 1) for k, n in sizes.items()}
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).dropna()

    def chosen(share: dict[int, int]) -> DataFrame:
        part = marked.where(place < F.create_map(*[F.lit(x) for kn in share.items() for x in kn])[F.col("label")])
        return texts.join(F.broadcast(part), "id").select("id", "text", "label")

    size = chosen(share).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_bytes:
        share = {k: max(1, int(n * max_bytes / size)) for k, n in share.items()}
    rows = chosen(share).toArrow()
    return sorted(zip(*(rows[c].to_pylist() for c in ("id", "text", "label")), strict=True))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_dense(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float, rounds: int = 30) -> np.ndarray:
    """Newton's method for logistic regression whose weights are drawn to `prior`; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = prior.astype(float).copy()
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + strength * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w
