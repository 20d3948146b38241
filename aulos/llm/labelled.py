"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulos.llm import textbytes as tb

#: Labelled documents that a classifier is fitted on, at most: the smallest by a hash of doc_id.
FIT_ROWS = 6000
COPY_SEEDS = (0x51ED, 0xC0FFEE, 0x9E37)


def fold(column, folds: int):
    """crc32 of doc_id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % folds


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int = FIT_ROWS):
    """(texts, labels) of at most ``rows`` labelled documents outside the held-out fold, sorted by doc_id."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(fold(F.col("doc_id"), folds) != held)
    picked = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")).orderBy(F.xxhash64("doc_id")).limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").toPandas().sort_values("doc_id", kind="stable")
    found = found.drop_duplicates("doc_id")
    pa.default_memory_pool().release_unused()
    return found["text"].fillna("").tolist(), found["_label"].to_numpy()


def without_copies(texts: list[str], labels: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The sample without exact and near copies, which would make their words look telling.

    A text goes if one of the smallest shingle hashes (under ``COPY_SEEDS``) has been seen before.
    """
    seen, keep, done = [set() for _ in COPY_SEEDS], np.ones(len(texts), bool), 0
    for rows, data, offsets in tb.pieces(pa.record_batch({"text": pa.array(texts, pa.string())})):
        starts, ends = tb.words(data, ~tb.SPACE)
        made, at = tb.shingles(tb.span_hashes(tb.LOWER[data], starts, ends), tb.doc_of(starts, offsets), len(rows))
        first = np.searchsorted(at, np.arange(len(rows) + 1))
        for i in range(len(rows)):
            own = made[first[i] : first[i + 1]]
            keys = [int(tb.mix64(own ^ np.uint64(s)).min()) for s in COPY_SEEDS] if len(own) else []
            keep[done + i] = bool(keys) and not any(k in s for k, s in zip(keys, seen, strict=True))
            for k, s in zip(keys, seen, strict=False):
                s.add(k)
        done += len(rows)
    return [t for t, k in zip(texts, keep, strict=True) if k], np.asarray(labels)[keep]
