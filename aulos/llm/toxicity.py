"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Each word is read through two inputs: a word vector (hashed word table) and a character vector
(hashed five-byte grams, largest and mean of the word). Both tables hold how much more often the
entry stands in toxic documents of the fitting sample. Overlapping windows of words pass through a
forward and a backward gated recurrent layer; attention pools their states into one score. All
windows of a text are scored, and its score is that of its worst window after a logistic
calibration. Training picks, in each round, the windows of toxic documents that the network finds
worst, and windows of clean documents that it finds worst or at random; ``FIT_WINDOWS`` windows of each fitted document
(the strongest by their inputs, and one at random) bound what training holds. Scoring reads all windows.

Null and empty texts have one window of padding and get its score. Without labels of both kinds
every score is 0. Repeated rows are scored one by one; empty tables give empty results; other
columns are ignored. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from aulos.llm import textbytes as tb
from aulos.llm.labelled import FIT_ROWS, fit_sample, without_copies

FOLDS, HELD, THRESHOLD = 3, 1, 0.7
WINDOW, STRIDE, HIDDEN, GRAM = 16, 8, 8, 5
TABLE_BITS, INPUTS = 20, 8
EPOCHS, RATE = 6, 0.01
#: Windows of each fitted document that training may pick from, at most.
FIT_WINDOWS = 3


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """Word slots, documents and gram slots with their words."""
    low = tb.LOWER[data]
    starts, ends = tb.words(low, tb.ALNUM)
    sums = tb.span_hashes(low, starts, ends)
    if len(data) >= GRAM and len(starts):
        gram = np.zeros(len(data) - GRAM + 1, np.uint64)
        for i in range(GRAM):
            gram = (gram << np.uint64(8)) | low[i : len(data) - GRAM + 1 + i]
        word = np.repeat(np.arange(len(starts)), ends - starts)
        place = np.arange(len(word)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts) + np.repeat(starts, ends - starts)
        inside = place + GRAM <= np.repeat(ends, ends - starts)
        word, grams = word[inside], _slots(tb.mix64(gram[place[inside]]))
    else:
        word, grams = np.zeros(0, np.int64), np.zeros(0, np.int64)
    return sums, starts, ends, tb.doc_of(starts, offsets), word, grams


def _odds(slot: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Signed strength of each slot: documents that hold it, toxic against expected."""
    pair = np.unique(doc * (1 << TABLE_BITS) + slot)
    d, s = pair >> TABLE_BITS, pair & ((1 << TABLE_BITS) - 1)
    n = np.bincount(s, minlength=1 << TABLE_BITS).astype(float)
    t = np.bincount(s, weights=toxic[d].astype(float), minlength=1 << TABLE_BITS)
    expected = n * toxic.mean()
    return np.clip((t - expected) / np.sqrt(expected + 1), -4, 8).astype(np.float32) / 4


class Net:
    """The two tables, the network's weights and the calibration."""

    def __init__(self, word_table, gram_table, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.word_table, self.gram_table = word_table, gram_table
        glorot = lambda a, b: (rng.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = {}
        for way in "fb":
            self.w |= {f"W{way}": glorot(INPUTS, 3 * HIDDEN), f"U{way}": glorot(HIDDEN, 3 * HIDDEN) * 0.5, f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
        self.w |= {"A": glorot(2 * HIDDEN, HIDDEN), "a": np.zeros(HIDDEN, np.float32), "v": glorot(HIDDEN, 1)[:, 0],
                   "o": glorot(2 * HIDDEN, 1)[:, 0], "p": np.zeros(1, np.float32)}
        self.cal = (1.0, 0.0)

    def inputs(self, data, offsets) -> tuple[np.ndarray, np.ndarray]:
        """(rows, doc): one row of INPUTS values for each word."""
        sums, starts, ends, doc, word, grams = _tokens(data, offsets)
        x = np.zeros((len(starts), INPUTS), np.float32)
        x[:, 0] = self.word_table[_slots(sums)]
        if len(grams):
            value = self.gram_table[grams]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            x[word[first], 1] = np.maximum.reduceat(value, first)
            x[word[first], 2] = np.add.reduceat(value, first) / np.diff(np.append(first, len(value)))
        x[:, 3] = np.minimum(ends - starts, 20) / 20
        for i in range(4, INPUTS):  # a few hashed signs of the word itself
            x[:, i] = ((sums >> np.uint64(i)) & np.uint64(1)).astype(np.float32) * 0.2 - 0.1
        return x, doc

    @staticmethod
    def windows(doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(indices into the words, -1 padded; document) of all overlapping windows."""
        count = np.bincount(doc, minlength=n_docs)
        first = np.cumsum(count) - count
        per = np.maximum(1, -(-(count - (WINDOW - STRIDE)) // STRIDE))
        at = np.repeat(np.arange(n_docs), per)
        k = np.arange(len(at)) - np.repeat(np.cumsum(per) - per, per)
        index = (first[at] + k * STRIDE)[:, None] + np.arange(WINDOW)
        return np.where(index < (first + count)[at][:, None], index, -1), at

    def forward(self, x: np.ndarray, keep: bool = False):
        """Logit of each window; x is (windows, WINDOW, INPUTS)."""
        w, n, states, trace = self.w, len(x), {}, {}
        for way in "fb":
            seq = range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1)
            h = np.zeros((n, HIDDEN), np.float32)
            given = x.reshape(-1, INPUTS) @ w[f"W{way}"] + w[f"c{way}"]
            given = given.reshape(n, WINDOW, 3 * HIDDEN)
            out, steps = np.empty((n, WINDOW, HIDDEN), np.float32), []
            for t in seq:
                g, u = given[:, t], h @ w[f"U{way}"]
                zr = 0.5 + 0.5 * np.tanh(0.5 * (g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]))
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                new = h + z * (c - h)
                if keep:
                    steps.append((t, h, z, r, c, u[:, 2 * HIDDEN :]))
                h = new
                out[:, t] = h
            states[way], trace[way] = out, steps
        both = np.concatenate((states["f"], states["b"]), 2)
        e = np.tanh(both.reshape(-1, 2 * HIDDEN) @ w["A"] + w["a"])
        s = (e @ w["v"]).reshape(n, WINDOW)
        s = np.exp(s - s.max(1, keepdims=True))
        s /= s.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", s, both)
        logit = pooled @ w["o"] + w["p"][0]
        return (logit, (both, e.reshape(n, WINDOW, HIDDEN), s, pooled, trace)) if keep else logit

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.w, len(x)
        logit, (both, e, s, pooled, trace) = self.forward(x, keep=True)
        d = ((1 / (1 + np.exp(-logit)) - y) / n).astype(np.float32)
        g = {"o": pooled.T @ d, "p": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * w["o"]
        dboth = s[:, :, None] * dpool[:, None]
        ds = np.einsum("nth,nh->nt", both, dpool)
        ds = s * (ds - (s * ds).sum(1, keepdims=True))
        de = ds[:, :, None] * w["v"] * (1 - e * e)
        g["v"] = np.einsum("nt,nth->h", ds, e)
        g["A"] = both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, HIDDEN)
        g["a"] = de.sum((0, 1))
        dboth = dboth + de @ w["A"].T
        for way, part in (("f", dboth[:, :, :HIDDEN]), ("b", dboth[:, :, HIDDEN:])):
            dh = np.zeros((n, HIDDEN), np.float32)
            dU, dgiven = np.zeros_like(w[f"U{way}"]), np.zeros((n, WINDOW, 3 * HIDDEN), np.float32)
            for t, h, z, r, c, u in reversed(trace[way]):
                dh = dh + part[:, t]
                dz, dc = dh * (c - h) * z * (1 - z), dh * z * (1 - c * c)
                dr = dc * u * r * (1 - r)
                dgiven[:, t] = np.concatenate((dz, dr, dc), 1)
                du = np.concatenate((dz, dr, dc * r), 1)
                dU += h.T @ du
                dh = dh * (1 - z) + du @ w[f"U{way}"].T
            flat = dgiven.reshape(-1, 3 * HIDDEN)
            g |= {f"U{way}": dU, f"W{way}": x.reshape(-1, INPUTS).T @ flat, f"c{way}": flat.sum(0)}
        return g

    def logits(self, data, offsets) -> np.ndarray:
        """The worst window's logit of each text."""
        x, doc = self.inputs(data, offsets)
        index, at = self.windows(doc, len(offsets) - 1)
        padded = np.vstack([x, np.zeros((1, INPUTS), np.float32)])
        out = np.concatenate([self.forward(padded[index[i : i + 4096]]) for i in range(0, len(index), 4096)])
        return np.maximum.reduceat(out, np.searchsorted(at, np.arange(len(offsets) - 1)))

    def score(self, data, offsets) -> np.ndarray:
        a, b = self.cal
        return 1 / (1 + np.exp(-np.clip(a * self.logits(data, offsets).astype(float) + b, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, windows: int = FIT_WINDOWS) -> Net | None:
    texts, labels = without_copies(texts, labels)
    toxic = labels == 1
    if not len(texts) or not toxic.any() or toxic.all():
        return None
    batch, done = pa.record_batch({"text": pa.array(texts, pa.string())}), 0
    tokens = []
    for rows, data, offsets in tb.pieces(batch):
        sums, _, _, doc, word, grams = _tokens(data, offsets)
        tokens.append((doc + done, np.unique((doc + done) * (1 << TABLE_BITS) + _slots(sums)), np.unique((doc[word] + done) * (1 << TABLE_BITS) + grams)))
        done += len(rows)
    tables = [np.concatenate([t[i] for t in tokens]) for i in (1, 2)]
    net = Net(*(_odds(p & ((1 << TABLE_BITS) - 1), p >> TABLE_BITS, toxic) for p in tables))
    del tokens, tables
    # a bounded set of windows: those of each document with the strongest inputs, and one at random
    rng, xs, of, done = np.random.default_rng(11), [], [], 0
    for rows, data, offsets in tb.pieces(batch):
        x, doc = net.inputs(data, offsets)
        index, at = net.windows(doc, len(rows))
        padded = np.vstack([x, np.zeros((1, INPUTS), np.float32)])
        strong = padded[index][:, :, :2].max((1, 2))
        order = np.lexsort((-strong, at))
        first = np.searchsorted(at[order], np.arange(len(rows)))
        strongest = [order[np.minimum(first + k, len(order) - 1)] for k in range(max(1, windows - 1))]
        picked = np.concatenate([*strongest, rng.integers(0, len(index), len(rows))])
        xs.append(padded[index[picked]])
        of.append(at[picked] + done)
        done += len(rows)
    x, of = np.concatenate(xs), np.concatenate(of)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    step = 0
    for epoch in range(EPOCHS):
        logit = np.concatenate([net.forward(x[i : i + 8192]) for i in range(0, len(x), 8192)])
        strong = logit if epoch else x[:, :, :2].max((1, 2))
        best = np.full(len(labels), -np.inf)
        np.maximum.at(best, of, strong)
        use = np.flatnonzero(~toxic[of] | (strong >= best[of]))
        use = np.concatenate([use, np.repeat(use[toxic[of[use]]], 3)])  # toxic documents are few
        rng.shuffle(use)
        for i in range(0, len(use), 256):
            b, step = use[i : i + 256], step + 1
            for k, grad in net.gradients(x[b], toxic[of[b]].astype(np.float32)).items():
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                net.w[k] = (net.w[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    worst = np.concatenate([net.logits(d, o) for _, d, o in tb.pieces(batch)]).astype(float)
    a, b = 1.0, 0.0
    for _ in range(100):  # logistic calibration, lightly penalised
        p = 1 / (1 + np.exp(-np.clip(a * worst + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((toxic - p) * worst).sum() - 0.5 * (a - 1), (toxic - p).sum() - 0.5 * b])
        h = np.array([[(w * worst * worst).sum() + 0.5, (w * worst).sum()], [(w * worst).sum(), w.sum() + 0.5]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -0.5, 0.5)
    net.cal = (max(float(a), 0.05), float(b))
    return net


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(*fit_sample(docs, labels, "toxic", FOLDS, HELD, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, data, offsets in tb.pieces(batch):
                score = model.score(data, offsets) if model else np.zeros(len(rows_))
                ids = rows_.column(0)
                held = [zlib.crc32(("" if i is None else str(i)).encode()) % FOLDS == HELD for i in ids.to_pylist()]
                yield pa.record_batch({"doc_id": ids.cast(pa.int64()), "held_out": pa.array(held), "score": pa.array(score),
                                       "predicted": pa.array((score >= THRESHOLD).astype(np.int32))})

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
