"""Quality by Bradley-Terry pairwise ranking.

Preference pairs join good and bad labelled documents, of which all outside the held-out fold take
part; a linear score is learned by logistic loss on the difference of the pair's features. The raw
score is then cut at the quantile that the labels' share of bad documents gives, and scaled by a logistic curve
so that the cut sits at ``THRESHOLD``. Features are shares of byte classes and of words over the
whole text, from one vectorised pass.

Null and empty texts have all features zero and get the score of that point. Without labels of
both kinds every score is 0.5. Repeated rows are scored one by one; empty tables give empty
results; other columns are ignored. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulos.llm import textbytes as tb
from aulos.llm.labelled import fold
from aulos.llm.shared import materialize, release

FOLDS, HELD, THRESHOLD = 5, 0, 0.3
STEPS, RIDGE = 60, 1e-3
#: Pairs of each row, rows of the rarer kind in a block (about), and scores among which the cut is looked up one by one.
ROUNDS, LEAST_OF_KIND, FEW = 8, 64, 20_000
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]


def _word_marks() -> np.ndarray:
    table = np.zeros((256, len(_MARKS) + 5), np.float32)
    for i, b in enumerate(_MARKS):
        table[b, i] = 1
    table[65:91, -5], table[97:123, -4], table[48:58, -3], table[128:, -2], table[10, -1] = 1, 1, 1, 1, 1
    return table


_CLASS = np.full(256, -1)
for _i, _row in enumerate(_word_marks()):
    if _row.any():
        _CLASS[_i] = _row.argmax()
_N = len(_MARKS) + 5


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text: see the module's text."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    kind = _CLASS[data]
    kept = kind >= 0
    shares = np.bincount(doc[kept] * _N + kind[kept], minlength=n * _N).reshape(n, _N).astype(float)
    shares[:, -1] -= 1  # the line feed that ends each text
    size = np.maximum(np.diff(offsets) - 1, 1)[:, None]
    starts, ends = tb.words(data, ~tb.SPACE)
    at = tb.doc_of(starts, offsets)
    count = np.bincount(at, minlength=n).astype(float)
    of = np.maximum(count, 1)
    hashes = tb.span_hashes(tb.LOWER[data], starts, ends)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1])
    order = np.lexsort((hashes, at))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (at[order][1:] != at[order][:-1])
    plain = tb.ALNUM[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    alone = (ends - starts == 1) & ~plain
    by = lambda x: np.bincount(at, weights=x.astype(float), minlength=n) / of
    distinct = np.bincount(at[order][new], minlength=n)
    some = np.stack([by(same), distinct / of, by(plain), by(alone), by(np.minimum(ends - starts, 40)) / 10,
                     np.log1p(count) / 10, (distinct / np.sqrt(of)) / 20], 1)
    return np.hstack([np.sqrt(np.maximum(shares, 0) / size), some])


class Ranker:
    """Weights, and the cut and slope that turn a raw score into a probability."""

    def __init__(self, mean, scale, weights, cut, slope):
        self.mean, self.scale, self.weights, self.cut, self.slope = mean, scale, weights, cut, slope

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.log(THRESHOLD / (1 - THRESHOLD)) + self.slope * (self.raw(x) - self.cut)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _total(df: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """``fn`` of every batch, summed: one row of ``size`` numbers a partition comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += fn(batch)
        yield pa.record_batch({"s": pa.array([total.tolist()], pa.list_(pa.float64()))})

    return np.sum([np.zeros(size), *(r.s for r in df.mapInArrow(run, "s array<double>").collect())], axis=0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.astype(np.float32).ravel())


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """_label, _key, x of every labelled row outside the held-out fold; texts stay where they are, features are joined."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") == 1).cast("int").alias("_label"))
    rows = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tb.pieces(batch):
                yield pa.record_batch({"doc_id": part.column(0), "x": _lists(features(data, offsets))})

    made = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<float>")
    return made.join(usable, "doc_id").select("_label", F.xxhash64("doc_id").alias("_key"), "x")


def _paired(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Differences of ``ROUNDS`` pairs at least for each row of either kind."""
    j = np.arange(max(len(good), len(bad)))
    return np.vstack([good[j % len(good)] - bad[(j + r) % len(bad)] for r in range(ROUNDS)])


def _cut(raw: DataFrame, n: int, k: int) -> float:
    """The middle between the ``k``-th smallest raw score and the next, exactly: bins around both are cut again until few are in them."""
    first, last = min(max(k - 1, 0), n - 1), min(k, n - 1)
    low, high = raw.agg(F.min("raw"), F.max("raw")).first()
    below, inside = 0, n
    while inside > FEW and high > low:
        edges = np.unique(np.append(np.linspace(low, high, 4096), high))
        own = raw.filter(F.col("raw").between(float(low), float(high)))
        counts = _total(own, lambda b: np.bincount(np.searchsorted(edges, b.column(0).to_numpy(), "right") - 1, minlength=len(edges)).astype(float), len(edges))
        ends = below + np.cumsum(counts)
        i, j = int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, last, "right"))
        held = counts[i : j + 1].sum() + (counts[j + 1] if j + 1 < len(edges) else 0)
        if held >= inside:  # nothing left to cut but equal scores
            break
        below, inside, low, high = int(ends[i] - counts[i]), held, edges[i], edges[min(j + 1, len(edges) - 1)]
    at, found = below, []
    for r in raw.filter(F.col("raw").between(float(low), float(high))).groupBy("raw").count().orderBy("raw").collect():
        found += [r["raw"] for want in (first, last) if at <= want < at + r["count"]]
        at += r["count"]
    return sum(found) / 2


def fit(docs: DataFrame, labels: DataFrame) -> Ranker | None:
    """A ranker of all labelled rows outside the held-out fold.

    Blocks of rows, by a hash of doc_id and so many that each has both kinds, are packed once; every step of a fit is one
    pass over them that brings sums to the driver. Each row takes part in pairs, and in the cut and the slope.
    """
    found = materialize(labelled_features(docs, labels), "quality-features")
    width = _N + 7
    sums = _total(found, lambda b: np.concatenate([[b.num_rows, pc.sum(b.column(0)).as_py() or 0], (x := _matrix(b.column(2), width)).sum(0), (x**2).sum(0)]), 2 + 2 * width)
    n, goods = int(sums[0]), int(sums[1])
    if not 0 < goods < n:
        release(found)
        return None
    mean = sums[2 : 2 + width] / n
    scale = np.sqrt(np.maximum(sums[2 + width :] / n - mean**2, 0)) + 1e-3

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_key").combine_chunks()
        z = np.clip((_matrix(rows.column("x").combine_chunks(), width) - mean) / scale, -8, 8).astype(np.float32)
        good = rows.column("_label").to_numpy() == 1
        return pa.table({"good": pa.array([z[good].tobytes()], pa.binary()), "bad": pa.array([z[~good].tobytes()], pa.binary())})

    blocks = materialize(found.groupBy(F.pmod("_key", F.lit(max(1, min(goods, n - goods) // LEAST_OF_KIND)))).applyInArrow(pack, "good binary, bad binary"), "quality-blocks")
    release(found)

    def sides(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield [np.frombuffer(x, np.float32).reshape(-1, width).astype(float) for x in row]

    w = np.zeros(width)

    def newton(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(1 + width + width * width)
        for good, bad in sides(batch):
            if len(good) and len(bad):
                diff = _paired(good, bad)
                p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
                out += np.concatenate([[len(diff)], diff.T @ p, ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()])
        return out

    for _ in range(STEPS):  # Newton steps on the ridge-penalised logistic loss
        got = _total(blocks, newton, 1 + width + width * width)
        pairs = max(got[0], 1)
        step = np.linalg.solve(got[1 + width :].reshape(width, width) / pairs + RIDGE * np.eye(width), got[1 : 1 + width] / pairs - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for good, bad in sides(batch):
                yield pa.record_batch({"raw": np.concatenate([good @ w, bad @ w]), "label": np.repeat([1.0, 0.0], [len(good), len(bad)])})

    raw = materialize(blocks.mapInArrow(score, "raw double, label double"), "quality-raw")
    release(blocks)
    cut = _cut(raw, n, n - goods)
    slope = 1.0
    base = np.log(THRESHOLD / (1 - THRESHOLD))

    def logistic(batch: pa.RecordBatch) -> np.ndarray:
        far, label = batch.column(0).to_numpy() - cut, batch.column(1).to_numpy()
        p = 1 / (1 + np.exp(-np.clip(base + slope * far, -30, 30)))
        return np.array([((label - p) * far).sum(), (p * (1 - p) * far**2).sum()])

    for _ in range(50):  # one-parameter logistic fit of the slope
        grad, bend = _total(raw, logistic, 2)
        step = np.clip((grad - 0.1 * slope) / (bend + 0.1), -0.5, 0.5)
        slope += step
        if abs(step) < 1e-6:
            break
    release(raw)
    return Ranker(mean, scale, w, cut, max(slope, 0.05))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, data, offsets in tb.pieces(batch):
                score = model.score(features(data, offsets)) if model else np.full(len(rows_), 0.5)
                ids = rows_.column(0)
                held = [zlib.crc32(("" if i is None else str(i)).encode()) % FOLDS == HELD for i in ids.to_pylist()]
                yield pa.record_batch({"doc_id": ids.cast(pa.int64()), "held_out": pa.array(held), "score": pa.array(score),
                                       "predicted": pa.array((score >= THRESHOLD).astype(np.int32))})

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def quality_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the ranker accepts, with all their columns.

    Each row is judged by its own text and passes or goes where it stands: no join, so null and repeated ids
    need no rule. Null and empty texts get the score of an empty text. Empty tables give empty results; without labels of both kinds all stay.
    """
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tb.pieces(batch):
                yield rows.filter(pa.array(model.score(features(data, offsets)) >= THRESHOLD)) if model else rows
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
