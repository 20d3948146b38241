"""Repeated 400-byte strings by suffix arrays, per shard and across shards.

1. Byte-equal texts are one text (of at least 400 bytes, all of them goes if it occurs twice).
2. Each 400-byte window has one anchor, the GRAM bytes in it with the least hash (then leftmost),
   so equal windows have equal anchors. Windows whose anchor stands nowhere else are unique; the
   rest are shipped as contexts (the bytes of a run of windows with one anchor) to the shard that
   owns the anchor. A window also holds SIDE bytes before or after its anchor; contexts whose sides
   stand nowhere else under their anchor hold no repeated window and are not sorted.
3. A shard concatenates its contexts and builds their suffix array by Larsson-Sadakane refinement:
   ranks by the first eight bytes, then doubling, re-sorting only the groups that still tie. Common
   prefixes follow Kasai's bound (a suffix shares at least one byte less than its predecessor in
   the text), taken in halving strides so that each step is one vector operation. Runs of
   suffixes that share 400 bytes are the repeated windows.
4. Anchors with more than ``HOT`` occurrences are split by the bytes beside them; those that are hot
   even so are dealt over several shards, which are then merged:
   the shards' distinct window digests are sorted together, and one that stands twice is in two shards.
5. Removed bytes are the union of the repeated windows, judged on the input.

Null texts count as empty; texts below 400 bytes lose nothing. Results depend on the text alone,
so repeated rows, null ids and ties behave alike. Empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulos.llm import textbytes as tb
from aulos.llm.shared import materialize, release, small, text_or_empty

LENGTH, GRAM = 400, 64
#: A window holds this many bytes before its anchor or this many after it.
SIDE = (LENGTH - GRAM) // 2
#: Occurrences of an anchor that one shard takes, bytes of contexts after which a suffix array is closed (small ones stay in cache).
HOT, SHARD_BYTES = 512, 512 << 10
SLICE, POSITION_BITS = 2 << 20, 22
BUCKETS = 64
_BYTE_STEPS = np.array([1 << 8 * k for k in range(8)], np.uint64)


# ---- anchors ------------------------------------------------------------------------------------

def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(v)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(v.dtype).max, v.dtype)
    full[:n] = v
    grid = full.reshape(blocks, width)
    left = np.minimum.accumulate(grid, 1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor's place in it, hashes of the anchor and of it with SIDE bytes
    before and after it): runs of windows of each text with one anchor."""
    out = [[] for _ in range(7)]
    for lo in range(0, max(len(data) - LENGTH + 1, 0), SLICE):
        part = data[lo : lo + SLICE + LENGTH - 1]
        if len(part) < LENGTH:
            continue
        up, down = tb.powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        grams = tb.mix64((sums[GRAM:] - sums[:-GRAM]) * down[: len(part) - GRAM + 1])
        mask = np.uint64((1 << POSITION_BITS) - 1)
        least = _least((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1)
        at = (least & mask).astype(np.int64)
        start = np.arange(lo, lo + len(at))
        text = tb.doc_of(start, offsets)
        whole = start + LENGTH <= offsets[text + 1] - 1  # without the line feed that ends each text
        start, at, text = start[whole], at[whole], text[whole]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        mine, pos = start[first], at[first]
        span = lambda a, b: tb.mix64((sums[b] - sums[a]) * down[a])
        before, after = span(np.maximum(pos - SIDE, 0), pos + GRAM), span(pos, np.minimum(pos + GRAM + SIDE, len(part)))
        for x, y in zip(out, (text[first], mine - offsets[text[first]], np.diff(np.append(first, len(start))), pos + lo - mine, grams[pos], before, after), strict=True):
            x.append(y)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _anchor_table(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for rows, data, offsets in tb.pieces(batch):
                text, lo, n, at, *hashes = anchors(data, offsets)
                made = {"key": rows.column(0).take(pa.array(text)), "lo": pa.array(lo.astype(np.int64)), "n": pa.array(n.astype(np.int32)), "at": pa.array(at.astype(np.int32))}
                yield pa.record_batch(made | {c: pa.array(h.astype(np.uint64).view(np.int64)) for c, h in zip(("anchor", "before", "after"), hashes, strict=True)})

    return texts.select("key", "text").mapInArrow(run, "key string, lo long, n int, at int, anchor long, before long, after long")


# ---- suffix arrays ------------------------------------------------------------------------------

def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one big-endian number; zeros beyond the end."""
    out, wide = np.zeros(len(data), np.uint64), np.concatenate((data, np.zeros(8, np.uint8)))
    for i in range(8):
        out = (out << np.uint64(8)) | wide[i : i + len(data)]
    return out


def suffix_array(data: np.ndarray, eights: np.ndarray | None = None) -> np.ndarray:
    """All suffixes in order."""
    n = len(data)
    first = _eights(data) if eights is None else eights
    sa = np.argsort(first).astype(np.int32)
    ordered = first[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    # zeros that pad the end may equal real zero bytes: the shorter suffix goes first
    if (data == 0).any():
        order = np.lexsort((np.minimum(n - sa, 8), ordered))
        sa = sa[order]
        size = np.minimum(n - sa, 8)
        new[1:] = (first[sa[1:]] != first[sa[:-1]]) | (size[1:] != size[:-1])
    # a group's rank is its first place, so refined ranks stay comparable; rank h places on is read from the end's zeros too
    start = np.flatnonzero(new).astype(np.int32)
    rank = np.zeros(n + 1, np.int32)
    rank[sa] = np.repeat(start, np.diff(np.append(start, n))) + 1
    tied = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
    h = 8
    while h < n and len(tied):
        at = sa[tied]
        key = rank[at].astype(np.int64) << 32  # one number for the group and the rank h places on
        key |= rank[np.minimum(at + h, n)]
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[tied] = at
        fresh = np.ones(len(tied), bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        first_of = np.flatnonzero(fresh)
        rank[at] = np.repeat(tied[first_of], np.diff(np.append(first_of, len(tied)))) + 1
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, cap: int, eights: np.ndarray | None = None) -> np.ndarray:
    """For each place of ``sa``, the bytes (``cap`` at most) its suffix shares with the one before it."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    eights, shared = _eights(data) if eights is None else eights, np.zeros(n, np.int64)
    stride, done = 64, np.zeros(0, np.int64)
    while stride:
        todo = np.arange(0, n, stride) if not len(done) else np.arange(stride, n, 2 * stride)
        if len(done):
            shared[todo] = np.maximum(shared[todo - stride] - stride, 0)
        live = todo[before[todo] >= 0]
        while len(live):
            a, b = live + shared[live], before[live] + shared[live]
            room = np.minimum(cap - shared[live], n - np.maximum(a, b))
            differ = eights[np.minimum(a, n - 1)] ^ eights[np.minimum(b, n - 1)]
            lead = 8 - np.searchsorted(_BYTE_STEPS, differ, "right")  # equal leading bytes of the two eights
            step = np.minimum(lead, np.maximum(room, 0))
            shared[live] += step
            live = live[(step == 8) & (room > 8)]
        done, stride = todo, stride // 2
    return shared[sa]


def judge(contexts: list[bytes], owned: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """For each context, which of its owned windows occur more than once among all owned windows."""
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    eights = _eights(data)
    sa = suffix_array(data, eights)  # in full: the common prefixes' bound needs the true order
    first = np.cumsum(sizes) - sizes
    weight = np.zeros(len(data) + 1, np.int64)
    np.add.at(weight, first, weights)
    np.add.at(weight, first + owned, -weights)
    weight = np.cumsum(weight)[:-1]  # 0 for suffixes that are not an owned window
    run = np.cumsum(common_prefixes(data, sa, LENGTH, eights) < LENGTH) - 1
    total = np.bincount(run, weights=weight[sa])
    again = np.zeros(len(data), bool)
    again[sa] = total[run] > 1
    return [again[f : f + o] for f, o in zip(first, owned, strict=True)]


# ---- shards -------------------------------------------------------------------------------------

def _contexts(texts: DataFrame, spots: DataFrame) -> DataFrame:
    """anchor, part, copies, key, lo, n, bytes; equal contexts of one batch are shipped once."""

    def run(batches):
        for batch in batches:
            held: dict = {}
            rest = []
            for key, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for s in places:
                    piece = raw[s["lo"] : s["lo"] + s["n"] + LENGTH - 1]
                    mine = (s["anchor"], s["part"], piece)
                    if mine in held:  # repeated wherever it stands: copies -1 says so
                        held[mine][2] += 1
                        rest.append((s["anchor"], s["part"], -1, key, s["lo"], s["n"], s["at"], b""))
                    else:
                        held[mine] = [s["anchor"], s["part"], 1, key, s["lo"], s["n"], s["at"], piece]
            rows = [*held.values(), *rest]
            for i in range(0, len(rows), 4000):
                columns = list(zip(*rows[i : i + 4000], strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                                      names=["anchor", "part", "copies", "key", "lo", "n", "at", "bytes"])

    return texts.join(small(spots, 400), "key").select("key", "text", "spots").mapInArrow(run, "anchor long, part int, copies int, key string, lo long, n int, at int, bytes binary")


def _runs(again: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], again.astype(np.int8), [0]))))
    return zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)


def _screened(classes: dict) -> tuple[list, list]:
    """The classes of contexts to sort, and the members of classes that are repeated as they stand.

    A window holds SIDE bytes before or after its anchor, so a context none of whose sides stands
    twice under its anchor has none. Parts of hot anchors see only some contexts and keep them all.
    """
    sides: dict = {}
    both = []
    for (anchor, part, piece), members in classes.items():
        n, at, weight = members[0][5], members[0][6], sum(r[2] for r in members)
        own = []
        if at >= SIDE:
            own.append((anchor, 0, piece[at - SIDE : at + GRAM]))
        if at - (n - 1) <= SIDE:
            own.append((anchor, 1, piece[at : at + GRAM + SIDE]))
        for s in own:
            sides[s] = sides.get(s, 0) + weight
        both.append((((anchor, part, piece), members), own))
    kept = [c for c, own in both if c[0][1] >= 0 or any(sides[s] > 1 for s in own)]
    classes_of: dict = {}
    for c in kept:
        classes_of[c[0][0]] = classes_of.get(c[0][0], 0) + 1
    alone = lambda c: c[0][1] < 0 and classes_of[c[0][0]] == 1
    same = [m for c in kept if alone(c) and sum(r[2] for r in c[1]) > 1 for m in c[1]]
    return [c for c in kept if not alone(c)], same


def _solve(dealt: DataFrame) -> DataFrame:
    """key, lo, hi of repeated bytes; or, with part >= 0, windows still to be merged (digests, places)."""

    def run(batches):
        rows, held = [], 0

        def shard():
            found, open_, seen = [], [], set()
            classes: dict = {}
            for r in rows:
                classes.setdefault((r[0], r[1], r[7]), []).append(r)
            groups, same = _screened(classes)
            found += [(m[3], m[4], m[4] + m[5] + LENGTH - 1) for m in same]
            marks = judge([k[2] for k, _ in groups], np.array([v[0][5] for _, v in groups]), np.array([sum(r[2] for r in v) for _, v in groups])) if groups else []
            for ((anchor, part, piece), members), again in zip(groups, marks, strict=True):
                for a, b in _runs(again):
                    found += [(m[3], m[4] + a, m[4] + b + LENGTH - 1) for m in members]
                if part >= 0:  # other shards may hold each of its windows too
                    w = np.arange(len(again))
                    for digest, start in zip(tb.span_hashes(np.frombuffer(piece, np.uint8), w, w + LENGTH).tolist(), w.tolist(), strict=True):
                        if (digest, part) not in seen:
                            seen.add((digest, part))
                            open_.append((digest, part, members[0][3], members[0][4] + start))
            rows.clear()
            return found, open_

        def out(found, open_):
            for i in range(0, len(found), 20_000):
                k, lo, hi = zip(*found[i : i + 20_000], strict=True)
                yield pa.record_batch({"bucket": pa.nulls(len(k), pa.int32()), "part": pa.nulls(len(k), pa.int32()), "key": pa.array(k), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64()),
                                       "digests": pa.nulls(len(k), pa.binary()), "keys": pa.nulls(len(k), pa.list_(pa.string())), "owner": pa.nulls(len(k), pa.binary()), "starts": pa.nulls(len(k), pa.binary())})
            by: dict = {}
            for d, part, key, start in open_:
                by.setdefault((d % BUCKETS, part), []).append((d, key, start))
            for (bucket, part), held_ in sorted(by.items()):
                held_.sort()
                keys = sorted({k for _, k, _ in held_})
                where = {k: i for i, k in enumerate(keys)}
                yield pa.record_batch({"bucket": pa.array([bucket], pa.int32()), "part": pa.array([part], pa.int32()), "key": pa.nulls(1, pa.string()), "lo": pa.nulls(1, pa.int64()), "hi": pa.nulls(1, pa.int64()),
                                       "digests": pa.array([np.array([d for d, _, _ in held_], np.uint64).tobytes()], pa.binary()), "keys": pa.array([keys], pa.list_(pa.string())),
                                       "owner": pa.array([np.array([where[k] for _, k, _ in held_], np.int32).tobytes()], pa.binary()), "starts": pa.array([np.array([s for _, _, s in held_], np.int64).tobytes()], pa.binary())})

        last, known = None, []
        for batch in batches:
            yield from out(known, [])
            known.clear()
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held > SHARD_BYTES and (r[0], r[1]) != last:
                    yield from out(*shard())
                    held = 0
                if r[2] < 0:  # known to be repeated as a whole
                    known.append((r[3], r[4], r[4] + r[5] + LENGTH - 1))
                    continue
                last = (r[0], r[1])
                rows.append(r)
                held += len(r[7])
        yield from out(known, [])
        if rows:
            yield from out(*shard())

    return dealt.mapInArrow(run, "bucket int, part int, key string, lo long, hi long, digests binary, keys array<string>, owner binary, starts binary")


def _merge(open_: DataFrame) -> DataFrame:
    """Windows that several shards of a hot anchor hold: key, lo, hi."""

    def run(batches):
        bucket, shards = None, []

        def close():
            # a row's digests are distinct, so one that stands twice in the bucket stands in two rows; one sort finds them, whatever the number of rows
            digests = np.concatenate([s[0] for s in shards]) if shards else np.zeros(0, np.uint64)
            order = np.argsort(digests)
            same = digests[order[1:]] == digests[order[:-1]]
            hit = np.zeros(len(digests), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            found, first = [], 0
            for own, keys, owner, starts in shards:
                mine = hit[first : first + len(own)]
                first += len(own)
                found += [(keys[o], s, s + LENGTH) for o, s in zip(owner[mine].tolist(), starts[mine].tolist(), strict=True)]
            shards.clear()
            return pa.record_batch({"key": pa.array([f[0] for f in found], pa.string()), "lo": pa.array([f[1] for f in found], pa.int64()), "hi": pa.array([f[2] for f in found], pa.int64())})

        for batch in batches:
            for b, d, k, o, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    yield close()
                    bucket = b
                shards.append((np.frombuffer(d, np.uint64), k, np.frombuffer(o, np.int32), np.frombuffer(s, np.int64)))
        yield close()

    cols = open_.select("bucket", "digests", "keys", "owner", "starts")
    return cols.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key string, lo long, hi long")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """key, spans array<struct<lo, hi>> for distinct texts (key, text) that hold repeated windows."""
    found = materialize(_anchor_table(texts), "suffix-anchors")
    counts = materialize(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "suffix-counts")
    shared = found.join(small(counts, 16), "anchor")
    cool = shared.filter(F.col("rows") <= HOT).select("key", "lo", "n", "at", "anchor", F.lit(-1).alias("part"))
    # a hot anchor is split by the bytes beside it: windows with SIDE bytes before it, and the others
    left = F.greatest(F.lit(0), F.least("n", F.col("at") - (SIDE - 1)))
    sides = F.array(
        F.struct("lo", left.alias("n"), "at", F.xxhash64("anchor", F.lit(0), "before").alias("anchor")),
        F.struct((F.col("lo") + left).alias("lo"), (F.col("n") - left).alias("n"), (F.col("at") - left).alias("at"), F.xxhash64("anchor", F.lit(1), "after").alias("anchor")))
    hot = materialize(shared.filter(F.col("rows") > HOT).select("key", F.explode(sides).alias("s")).select("key", "s.*").filter("n > 0"), "suffix-hot")
    again = materialize(hot.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "suffix-hot-counts")
    part = F.when(F.col("rows") <= HOT, F.lit(-1)).otherwise(F.pmod(F.xxhash64("key", "lo"), F.ceil(F.col("rows") / HOT)).cast("int"))
    hot = hot.join(again, "anchor").select("key", "lo", "n", "at", "anchor", part.alias("part"))
    spots = cool.unionByName(hot).groupBy("key").agg(F.collect_list(F.struct("lo", "n", "at", "anchor", "part")).alias("spots"))
    spots = materialize(spots, "suffix-spots")
    release(found)
    dealt = _contexts(texts, spots).repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    solved = materialize(_solve(dealt), "suffix-solved")
    spans = solved.filter("bucket is null").select("key", "lo", "hi")
    open_ = solved.filter("bucket is not null")
    if open_.limit(1).count():
        spans = spans.unionByName(_merge(open_))
    return materialize(spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans")), "suffix-spans")


def _cut(raw: bytes, spans) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, the rest) for spans sorted by start."""
    kept, end, runs, removed = [], 0, 0, 0
    for s in spans or ():
        if s["lo"] > end or not runs:
            kept.append(raw[end : s["lo"]])
            runs += 1
            removed += s["hi"] - s["lo"]
            end = s["hi"]
        elif s["hi"] > end:
            removed += s["hi"] - end
            end = s["hi"]
    kept.append(raw[end:])
    return removed, runs, b"".join(kept)


def suffix_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept bytes)."""
    own = docs.select("doc_id", text_or_empty().alias("text"))
    keyed = own.withColumn("key", F.substring(F.sha2("text", 256), 1, 24)).withColumn("size", F.octet_length("text"))
    keys = materialize(keyed.filter(f"size >= {LENGTH}").groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("size").cast("long").alias("size")), "suffix-keys")
    twice = materialize(keys.filter("rows > 1"), "suffix-twice")
    # distinct texts: of several equal rows, the aggregation keeps one
    long = keyed.filter(f"size >= {LENGTH}").select("key", "text")
    many = small(twice.select("key"), 40)
    texts = long.join(many, "key", "left_anti").unionByName(long.join(many, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")))
    whole = twice.select("key", F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"))).alias("spans"))
    spans = materialize(repeated_spans(texts).join(small(twice.select("key"), 40), "key", "left_anti").unionByName(whole), "suffix-cuts")

    def run(batches):
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                removed, runs, rest = _cut(raw, cuts)
                out.append((len(raw), removed, runs, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            made = {"doc_id": batch.column(0).cast(pa.int64())} | {c: pa.array(v, t) for c, v, t in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), columns, (pa.int64(),) * 3 + (pa.string(), pa.binary()), strict=True)}
            if not with_text:
                made.pop("kept")
            yield pa.record_batch(made)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return keyed.join(small(spans, 600), "key", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
