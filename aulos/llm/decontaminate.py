"""Benchmark decontamination by CGK embedding, bit sampling and exact edit distance.

Texts are read as lower-cased words. A random walk (Chakraborty, Goldenberg, Koucky) embeds the
words from each position on: at step j it writes the word it stands on and moves on if a random
function of j and the word says so; an edit costs few differing steps before two walks meet again.
Each of ``REPEATS`` tables keeps a sample of the walk's steps as its key. Every window start of
every document is looked up among the keys of every window start inside the benchmark items, so any
short run without edits is enough to propose an item-sized window; the item's best alignment
within it is then found by exact edit distance over words. An item is found if at most
``EDITS`` of its words are edited.

Items of fewer than ``SHORT`` words, where a walk has too few places to start, are proposed by exact pieces
instead: with e edits allowed, one of e + 1 pieces of the item stands unedited, so none is missed. From ``SHORT``
words on, walks from all places of an item make a miss at the full number of edits a matter of a few in a hundred.

Items are held whole, ``ITEM_WORDS`` words of them at a time, so a large benchmark takes several
passes instead of a larger broadcast. Items without words match nothing. Ties between alignments go to the
first; very long texts are read whole. Null texts are empty. Repeated documents or items are reported
one by one; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulos.llm import textbytes as tb

STEPS, SAMPLE, REPEATS, EDITS, SHORT = 10, 7, 3, 0.2, 15
ITEM_WORDS, FILTER_BITS, SEED = 4_000_000, 22, 29


def _salts() -> tuple[np.ndarray, list[np.ndarray]]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, (REPEATS, STEPS), dtype=np.uint64), [np.sort(rng.choice(STEPS, SAMPLE, replace=False)) for _ in range(REPEATS)]


def walk_keys(words: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, last word read) of the walk from each position; past the end it stays on the last word."""
    salts, sampled = _salts()
    n = len(words)
    at, key, steps = np.arange(n), np.zeros(n, np.uint64), set(sampled[repeat].tolist())
    last = at
    for j in range(max(steps) + 1):
        here = words[np.minimum(at, n - 1)]
        if j in steps:
            key = (key ^ here) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            last = at
        at = at + (((here ^ salts[repeat, j]) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)).astype(np.int64)
    return key, last


def edit_distance(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the best alignment of the whole item within the window."""
    m = len(window)
    step = np.arange(m + 1)
    row, start = np.zeros(m + 1, np.int64), step.copy()
    big = m + len(item) + 2
    for w in item:
        swap = row[:-1] + (window != w)
        drop = row + 1
        new, own = drop.copy(), start.copy()
        better = swap < new[1:]
        new[1:] = np.where(better, swap, new[1:])
        own[1:] = np.where(better, start[:-1], own[1:])
        # words of the window left out: the least of new[k] + (j - k) over k <= j
        packed = (new - step) * big + step
        least = np.minimum.accumulate(packed)
        k = least % big
        row, start = new[k] + step - k, own[k]
    end = int(row.argmin())
    return int(row[end]), int(start[end]), end


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position on."""
    mixed = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        mixed = tb.mix64(mixed + words[k : len(words) - n + 1 + k])
    return mixed


class Index:
    """Walk keys of all window starts of some benchmark items."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids, self.items = [], []
        for rows, data, offsets in tb.pieces(pa.record_batch({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})):
            low = tb.LOWER[data]
            starts, ends = tb.words(low, tb.ALNUM)
            bounds = np.searchsorted(starts, offsets)
            sums = tb.span_hashes(low, starts, ends)
            self.ids += rows.column(0).to_pylist()
            self.items += [sums[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.tables = []
        for r in range(REPEATS):
            keys, owners, places = [], [], []
            for i, item in enumerate(self.items):
                if len(item) >= SHORT:
                    key, last = walk_keys(np.append(item, np.uint64(0)), r)
                    ok = np.flatnonzero(last < len(item))
                    keys.append(key[ok])
                    owners.append(np.full(len(ok), i))
                    places.append(ok)
            key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            order = np.argsort(key, kind="stable")
            table = [key[order], *((np.concatenate(x) if x else np.zeros(0, np.int64))[order] for x in (owners, places))]
            there = np.zeros(1 << FILTER_BITS, bool)
            there[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.tables.append((*table, there))
        short = defaultdict(lambda: defaultdict(list))  # words of a piece, its hash: items and the piece's place in them
        for i, item in enumerate(self.items):
            if 0 < len(item) < SHORT:
                cuts = np.linspace(0, len(item), int(EDITS * len(item)) + 2).astype(int).tolist()
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    short[b - a][int(_runs(item[a:b], b - a)[0])].append((i, a))
        self.short = {n: dict(seeds) for n, seeds in short.items()}

    def candidates(self, words: np.ndarray, bounds: np.ndarray):
        """(document, item, start) triples proposed by the tables; starts may lie outside the text."""
        doc_end = np.repeat(bounds[1:], np.diff(bounds))
        out = []
        for r, (key, owner, place, there) in enumerate(self.tables):
            if not len(key) or not len(words):
                continue
            own, last = walk_keys(words, r)
            maybe = np.flatnonzero(there[(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] & (last < doc_end))
            lo, hi = np.searchsorted(key, own[maybe], "left"), np.searchsorted(key, own[maybe], "right")
            n = hi - lo
            at = np.repeat(maybe, n)
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            out.append(np.stack([np.searchsorted(bounds, at, "right") - 1, owner[entry], at - place[entry]], 1))
        for n, seeds in self.short.items():
            if len(words) >= n:
                mixed = _runs(words, n)
                at = np.flatnonzero(np.isin(mixed, np.array(list(seeds), np.uint64)))
                doc = np.searchsorted(bounds, at, "right") - 1
                hits = [(d, i, p - place) for p, d in zip(at.tolist(), doc.tolist(), strict=True) if p + n <= bounds[d + 1] for i, place in seeds[int(mixed[p])]]
                out.append(np.array(hits, np.int64).reshape(-1, 3))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def find(self, words: np.ndarray, bounds: np.ndarray):
        """(document, item, edits, start, end) of the items found; words count from the text's start."""
        held, found = defaultdict(list), []
        for d, i, s in self.candidates(words, bounds).tolist():
            held[d, i].append(s)
        for (d, i), starts in held.items():
            item, lo, hi = self.items[i], int(bounds[d]), int(bounds[d + 1])
            most = int(EDITS * len(item))
            starts.sort()
            cut = 0
            for k in range(1, len(starts) + 1):
                if k < len(starts) and starts[k] - starts[k - 1] <= 2 * most + 1:
                    continue
                a, b = max(starts[cut] - most, lo), min(starts[k - 1] + len(item) + most, hi)
                cut = k
                window = words[a:b]
                if np.isin(item, window).sum() < len(item) - most:
                    continue
                edits, s, e = edit_distance(item, window)
                if edits <= most:
                    found.append((d, i, edits, a + s - lo, a + e - lo))
        return found


SCHEMA = "doc_id long, item_id long, edits int, first_word long, end_word long, item_words int"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per place where a document holds an item: doc_id, item_id, edits, first_word, end_word, item_words."""
    parts = [docs.select("doc_id", "text").mapInArrow(_finder(index), SCHEMA) for index in _indexes(docs.sparkSession, benchmark)]
    return reduce(DataFrame.unionByName, parts)


def _indexes(spark, benchmark: DataFrame):
    """Broadcast indexes of the benchmark, each of bounded size."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-total // (6 * ITEM_WORDS)))
    for p in range(passes):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).toPandas()
        yield spark.sparkContext.broadcast(Index(own["item_id"].astype(object).where(own["item_id"].notna(), None).tolist(), own["text"].tolist()))


def _finder(index):
    def run(batches):
        ix = index.value
        for batch in batches:
            for rows, data, offsets in tb.pieces(batch):
                low = tb.LOWER[data]
                starts, ends = tb.words(low, tb.ALNUM)
                found = ix.find(tb.span_hashes(low, starts, ends), np.searchsorted(starts, offsets))
                d = [f[0] for f in found]
                yield pa.record_batch({
                    "doc_id": rows.column(0).cast(pa.int64()).take(pa.array(d, pa.int64())), "item_id": pa.array([ix.ids[f[1]] for f in found], pa.int64()),
                    "edits": pa.array([f[2] for f in found], pa.int32()), "first_word": pa.array([f[3] for f in found], pa.int64()),
                    "end_word": pa.array([f[4] for f in found], pa.int64()), "item_words": pa.array([len(ix.items[f[1]]) for f in found], pa.int32())})

    return run


def decontaminate_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns.

    Each row is judged by its own text and passes or goes where it stands: no join, so null and repeated ids
    need no rule. Null and empty texts hold nothing and stay. Empty tables give empty results.
    """
    def clean(index):
        def run(batches):
            ix = index.value
            for batch in batches:
                for rows, data, offsets in tb.pieces(batch):
                    low = tb.LOWER[data]
                    starts, ends = tb.words(low, tb.ALNUM)
                    found = ix.find(tb.span_hashes(low, starts, ends), np.searchsorted(starts, offsets))
                    keep = np.ones(len(rows), bool)
                    keep[[f[0] for f in found]] = False
                    yield rows.filter(pa.array(keep))
                pa.default_memory_pool().release_unused()

        return run

    for index in _indexes(docs.sparkSession, benchmark):
        docs = docs.mapInArrow(clean(index), docs.schema)
    return docs
