"""N-gram Jaccard join by prefix trees: components of documents whose shingle sets link.

1. Every document's set of distinct 5-word shingles is hashed; equal sets become one class, which
   its smallest doc_id represents.
2. All shingles have one global order: by a count of how often they repeat within the scanned
   pieces (frequent ones last), then by hash. Linked sets share a shingle among the first
   n - ceil(0.8 n) + 1 of each, whatever the order, so the order decides speed, never results.
   Prefixes are a little longer still, so linked sets share a number of their shingles; documents
   with fewer shared ones drop out.
3. The documents that share such a shingle form a block under the smallest doc_id among them.
   Blocks beyond ``SUB`` documents are cut into sub-blocks, and a few documents of the block, the
   pivots, are compared with every sub-block.
4. A sub-block's ordered sets form a trie; each document walks it with the overlap that a path
   has gathered so far and leaves subtrees whose remaining lengths can't reach the threshold, or
   whose documents it is already connected with. Only spanning links come out, not all pairs.
5. For cut blocks, documents that are still apart from the block's leader are compared with every
   other sub-block as well, so no link is lost. Components come from a distributed union-find.

Null, empty and wordless texts have no shingles and are a component of their own. Rows repeated
with one doc_id are one node. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulos.llm import textbytes as tb
from aulos.llm.components import connected_components
from aulos.llm.shared import materialize, release, small

K = 5
#: Links need NUM * intersection >= DEN * (sum of both sizes), which is intersection >= 0.8 * union.
NUM, DEN = 9, 4
SUB, PIVOTS = 256, 12
#: Prefixes are longer by n / MORE shingles; linked sets then share 0.8 * n / MORE - 1 of them at least.
MORE = 20
#: Shingles counted together; those that repeat at least HOT times in total are ordered by their count.
PIECE_SHINGLES, HOT, HOT_ROWS = 4_000_000, 2, 1_000_000


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, shingles, bounds): the sorted set of row i is shingles[bounds[i]:bounds[i + 1]]."""
    for rows, data, offsets in tb.pieces(batch):
        low = tb.LOWER[data]
        starts, ends = tb.words(low, ~tb.SPACE)
        made, at = tb.shingles(tb.span_hashes(low, starts, ends), tb.doc_of(starts, offsets), len(rows), K)
        yield rows, made, np.searchsorted(at, np.arange(len(rows) + 1))


def shingle_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (null for empty sets)."""

    def run(batches):
        for batch in batches:
            for rows, made, bounds in _sets(batch):
                n = np.diff(bounds)
                digest = [hashlib.blake2b(made[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.record_batch({"doc_id": rows.column(0).cast(pa.int64()), "n_shingles": pa.array(n.astype(np.int64)), "digest": pa.array(digest, pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary")


def _repeats(docs: DataFrame) -> DataFrame:
    """shingle, n for shingles that repeat within pieces of the table; counts are sums over all pieces."""

    def emit(held):
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        found, counts = found[counts > 1], counts[counts > 1]
        return pa.record_batch({"shingle": pa.array(found.view(np.int64)), "n": pa.array(counts.astype(np.int64))})

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, made, _ in _sets(batch):
                held.append(made)
                n += len(made)
                if n >= PIECE_SHINGLES:
                    yield emit(held)
                    held, n = [], 0
        if held:
            yield emit(held)

    made = docs.select("text").mapInArrow(run, "shingle long, n long")
    return made.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT)


def _order(spark, repeats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and their counts, sorted by hash; at most HOT_ROWS of them.

    A frequent shingle that is left out only sorts as a rare one.
    """
    top = repeats.orderBy(F.desc("n"), "shingle").limit(HOT_ROWS) if repeats.count() > HOT_ROWS else repeats
    got = top.toArrow()
    shingle = np.asarray(got["shingle"]).astype(np.int64).view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], np.asarray(got["n"]).astype(np.int64)[order]


def _prefixes(docs: DataFrame, order) -> DataFrame:
    """shingle, doc_id: the prefix of each set in the global order."""

    def run(batches):
        hot, count = order.value
        for batch in batches:
            for rows, made, bounds in _sets(batch):
                n = np.diff(bounds)
                doc = np.repeat(np.arange(len(rows)), n)
                where = np.minimum(np.searchsorted(hot, made), max(len(hot) - 1, 0))
                rank = np.where(hot[where] == made, count[where], 0) if len(hot) else np.zeros(len(made), np.int64)
                by = np.lexsort((made, rank, doc))
                place = np.arange(len(made)) - np.repeat(bounds[:-1], n)
                need = np.repeat(n - (4 * n + 4) // 5 + 1 + n // MORE, n)
                pick = by[place < need]
                ids = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.record_batch({"shingle": pa.array(made[pick].view(np.int64)), "doc_id": pa.array(ids[doc[pick]])})

    return docs.select("doc_id", "text").mapInArrow(run, "shingle long, doc_id long")


class Trie:
    """Path-compressed trie over ordered sets; node: (tokens, children, documents, least n, most tokens below)."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sizes, self.sets = sizes, sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.root = self._build(order)

    def _build(self, order: list[int]):
        """The node for sorted sets; nested sets may be as deep as they are many, so no recursion."""
        top: list = []
        todo = [(order, 0, top)]
        while todo:
            order, depth, siblings = todo.pop()
            first, last = self.sets[order[0]], self.sets[order[-1]]
            same = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:same] != last[depth:same])
            end = depth + int(differ[0]) if len(differ) else same
            here = [i for i in order if len(self.sets[i]) == end]
            runs, run = [], []
            for i in order:
                if len(self.sets[i]) == end:
                    continue
                if run and self.sets[run[-1]][end] != self.sets[i][end]:
                    runs.append(run)
                    run = []
                run.append(i)
            if run:
                runs.append(run)
            kids: list = []
            siblings.append((first[depth:end], kids, here, min(int(self.sizes[i]) for i in order), max(len(self.sets[i]) for i in order) - end, order))
            todo += [(r, end, kids) for r in reversed(runs) if len(order) > 1]
        return top[0]

    def walk(self, mark: np.ndarray, tokens: int, size: int, skip) -> Iterator[int]:
        """Documents whose set links with the marked one; ``skip`` tells documents to leave out."""
        todo = [(self.root, 0, 0)]
        while todo:
            (segment, kids, here, least, below, order), overlap, depth = todo.pop()
            if len(order) == 1 and skip(order[0]):
                continue
            overlap += int(mark[segment].sum())
            if NUM * (overlap + min(below, tokens - overlap)) < DEN * (size + least):
                continue
            for i in here:
                if NUM * overlap >= DEN * (size + int(self.sizes[i])) and not skip(i):
                    yield i
            todo += [(kid, overlap, depth + len(segment)) for kid in kids]


def block_links(ids: list[int], sets: list[np.ndarray], queries: np.ndarray, labels: list[int]) -> list[tuple[int, int]]:
    """Spanning links of one sub-block: each query against all others; equal labels are already connected."""
    sizes = np.array([len(s) for s in sets])
    joined = np.concatenate(sets)
    tokens, inverse, counts = np.unique(joined, return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens))
    shared = counts > 1
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    ordered = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = inverse[a:b]
        ordered.append(np.sort(rank[own[shared[own]]]))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, trie, mark = [], Trie(ordered, sizes), np.zeros(len(tokens), bool)
    for q in np.flatnonzero(queries):
        own = ordered[q]
        if not len(own):
            continue
        mark[own] = True
        for i in trie.walk(mark, len(own), int(sizes[q]), lambda i: find(labels[i]) == find(labels[q])):  # noqa: B023
            a, b = find(labels[i]), find(labels[q])
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((ids[q], ids[i]))
        mark[own] = False
    return links


def _blocks(docs: DataFrame, places: DataFrame) -> DataFrame:
    """a, b: links found in the blocks. places: doc_id, spots array<struct<leader, sub, query, label>>."""

    def ship(batches):
        for batch in batches:
            for rows, made, bounds in _sets(batch):
                out = [(s["leader"], s["sub"], s["query"], s["label"], d, made[a:b].tobytes())
                       for d, spots, a, b in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), bounds[:-1], bounds[1:], strict=True) for s in spots]
                for i in range(0, len(out), 2000):
                    columns = list(zip(*out[i : i + 2000], strict=True))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                          names=["leader", "sub", "query", "label", "doc_id", "tokens"])

    def solve(batches):
        key, ids, sets, asks, labels, found = None, [], [], [], [], []

        def close():
            if len(ids) > 1:
                found.extend(block_links(ids, sets, np.array(asks), labels))
            for x in (ids, sets, asks, labels):
                x.clear()

        def out():
            made = pa.record_batch({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})
            found.clear()
            return made

        for batch in batches:
            for leader, sub, query, label, d, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (leader, sub) != key:
                    close()
                    key = (leader, sub)
                if ids and ids[-1] == d:  # a repeated row
                    asks[-1] = asks[-1] or query
                    continue
                ids.append(d)
                sets.append(np.frombuffer(tokens, np.uint64))
                asks.append(query)
                labels.append(label)
            yield out()
        close()
        yield out()

    shipped = docs.select("doc_id", "text").join(small(places, 200), "doc_id").select("doc_id", "text", "spots")
    rows = shipped.mapInArrow(ship, "leader long, sub int, query boolean, label long, doc_id long, tokens binary")
    dealt = rows.repartition("leader", "sub").sortWithinPartitions("leader", "sub", "doc_id")
    return dealt.mapInArrow(solve, "a long, b long")


def _spots(rows: DataFrame, tag: str) -> DataFrame:
    """doc_id, spots from (doc_id, leader, sub, query, label); a document has few spots."""
    return materialize(rows.groupBy("doc_id").agg(F.collect_list(F.struct("leader", "sub", "query", "label")).alias("spots")), tag)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    prints = materialize(shingle_digests(docs), "join-prints")
    classes = materialize(prints.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "join-classes")
    copies = materialize(prints.join(classes.filter("rows > 1"), "digest").filter("doc_id <> rep").select("doc_id"), "join-copies")
    ours = docs.filter("doc_id is not null").join(small(copies, 8), "doc_id", "left_anti")

    repeats = materialize(_repeats(ours), "join-repeats")
    order = spark.sparkContext.broadcast(_order(spark, repeats))
    prefixes = materialize(_prefixes(ours, order), "join-prefixes")
    order.destroy()
    leaders = materialize(prefixes.groupBy("shingle").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).filter("leader < last").select("shingle", "leader"), "join-leaders")
    hits = materialize(prefixes.join(leaders, "shingle").groupBy("leader", "doc_id").agg(F.count(F.lit(1)).alias("hits")), "join-hits")
    # a set's size joins by document here, so that it doesn't travel with each shingle of its prefix
    sized = prints.filter("digest is not null").groupBy("doc_id").agg(F.min("n_shingles").alias("n"))
    able = hits.groupBy("doc_id").agg(F.sum("hits").alias("hits")).join(sized, "doc_id").filter(F.col("hits") >= F.floor(F.col("n") / MORE) * 0.8 - 1)
    able = materialize(able.select("doc_id"), "join-able")
    members = materialize(hits.join(small(able, 8), "doc_id", "left_semi").select("leader", "doc_id"), "join-members")
    alone = members.groupBy("leader").agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("two")).filter("one = two").select("leader")
    members = materialize(members.join(small(materialize(alone, "join-alone"), 8), "leader", "left_anti"), "join-members")
    release(prefixes)
    release(leaders)

    sizes = materialize(members.groupBy("leader").agg(F.count(F.lit(1)).alias("m")).filter(f"m > {SUB}").withColumn("subs", F.ceil(F.col("m") / SUB).cast("int")), "join-sizes")
    deal = members.join(small(sizes, 24), "leader", "left")
    toss = F.pmod(F.xxhash64("leader", "doc_id"), F.lit(1 << 20))
    own = F.coalesce(F.pmod(F.xxhash64("doc_id", "leader"), F.col("subs")).cast("int"), F.lit(0))
    deal = materialize(deal.withColumn("own", own).withColumn("pivot", F.col("m").isNotNull() & ((F.col("leader") == F.col("doc_id")) | (toss * F.col("m") < PIVOTS << 20))), "join-deal")
    plain = deal.select("doc_id", "leader", F.col("own").alias("sub"), F.lit(True).alias("query"), F.col("doc_id").alias("label"))
    pivots = deal.filter("pivot").select("doc_id", "leader", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.lit(True).alias("query"), F.col("doc_id").alias("label"), "own").filter("sub <> own").drop("own")
    links = materialize(_blocks(ours, _spots(plain.unionByName(pivots), "join-spots")), "join-links")

    if sizes.count():
        cut = deal.filter("m is not null").select("doc_id", "leader", "own", "subs")
        roots = materialize(connected_components(links, "join-cc"), "join-roots")
        label = lambda name: F.coalesce(F.col(name), F.col({"lead": "leader", "root": "doc_id"}[name]))
        cut = cut.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(small(roots.select(F.col("node").alias("leader"), F.col("root").alias("lead")).join(sizes.select("leader"), "leader"), 16), "leader", "left")
        cut = materialize(cut.select("doc_id", "leader", "own", "subs", label("root").alias("label"), label("lead").alias("lead")), "join-cut")
        apart = cut.filter("label <> lead")
        again = apart.select("doc_id", "leader", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.lit(True).alias("query"), "label", "own").filter("sub <> own").drop("own")
        there = materialize(apart.select("leader").distinct(), "join-there")
        rest = cut.join(small(there, 8), "leader", "left_semi").select("doc_id", "leader", F.col("own").alias("sub"), F.lit(False).alias("query"), "label")
        more = materialize(_blocks(ours, _spots(rest.unionByName(again), "join-spots-again")), "join-links-again")
        links = links.unionByName(more)

    roots = materialize(connected_components(links, "join-cc"), "join-roots")
    classes = materialize(classes.join(roots, classes["rep"] == roots["node"], "left").select("digest", F.coalesce("root", "rep").alias("component_id")), "join-labelled")
    return prints.join(classes, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def join_stage(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns.

    Documents without words or with a null doc_id are in no component and stay; rows repeated with one doc_id stay or go together.
    Empty tables give empty results.
    """
    found = jaccard_components(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
