"""Exact dedup with an extendible-hash index on shared files (built-in functions only).

1. Every text loses its white space; the key is a 64-bit hash, the fingerprint its SHA-256.
2. The directory starts with one bucket and doubles while a bucket is overfull: a bucket of
   local depth d owns the keys that begin with its d bits. Its sizes come from a histogram over
   the top ``CELL_BITS`` bits, so the driver holds at most ``2 ** CELL_BITS`` counts, no keys.
3. Copies are summed in ``SALTS`` parts before they move, so a hot group is a few partial entries.
   Each goes to the task that owns its range of buckets and keys; the owner sums the parts of an entry,
   chains the entries of one key in the order of their fingerprints, and writes its buckets to the shared folder.
4. Texts of keys that several rows share are compared as bytes: a fingerprint under which two
   byte strings stand would stop the job.

Nulls count as empty texts, and all empty texts are one group. Of equal texts the row with the
most code points stays, then the smallest doc_id (null ids last). Rows repeated with the same
doc_id count as separate members, and one of them stays. Very long texts are read whole; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aulos.llm.shared import materialize, release, small, text_or_empty

CELL_BITS = 16
#: Entries that a bucket holds before it splits.
BUCKET_ENTRIES = 8192
#: Parts in which the copies of one text are summed before they meet.
SALTS = 16


def normalised():
    return F.regexp_replace(text_or_empty(), r"[\x20\x09-\x0D]+", "")


def directory(cells: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(first cell, local depth) of each bucket, split until none is overfull or the cells are single."""
    done, todo = [], [(0, 0)]
    while todo:
        first, depth = todo.pop()
        width = 1 << (CELL_BITS - depth)
        held = sum(cells.get(c, 0) for c in range(first, first + width)) if cells else 0
        if held > capacity and depth < CELL_BITS:
            todo += [(first, depth + 1), (first + width // 2, depth + 1)]
        else:
            done.append((first, depth))
    return sorted(done)


def fingerprints(docs: DataFrame) -> DataFrame:
    """row, doc_id, n, key, sha; ``row`` tells rows of one doc_id apart once the table is written."""
    norm = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.length(text_or_empty()).cast("long").alias("n"), normalised().alias("norm"))
    return norm.select("row", "doc_id", "n", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha"))


def build_index(prints: DataFrame, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """bucket, depth, key, sha, size, keep, keep_row, chain: the index files, each bucket's entries in one range of tasks."""
    spark = prints.sparkSession
    first = F.struct("n", (-F.col("doc_id")).alias("minus"), (-F.col("row")).alias("minus_row"))
    parts = materialize(prints.groupBy("key", "sha", F.pmod("row", F.lit(SALTS)).alias("salt")).agg(F.count(F.lit(1)).alias("part"), F.max(first).alias("first")), "dedup-parts")
    cell = F.shiftrightunsigned("key", 64 - CELL_BITS).cast("int")
    counts = {r["cell"]: r["n"] for r in parts.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = directory(counts, capacity)
    owners = [(c, first, depth) for first, depth in buckets for c in range(first, first + (1 << (CELL_BITS - depth))) if c in counts]
    doors = spark.createDataFrame(owners, "cell int, bucket int, depth int")
    # the ranges of (bucket, key) serve the sum and the chain too, so neither moves an entry again
    owned = parts.withColumn("cell", cell).join(F.broadcast(doors), "cell").repartitionByRange("bucket", "key")
    entries = owned.groupBy("bucket", "key", "sha").agg(F.max("depth").alias("depth"), F.sum("part").alias("size"), F.max("first").alias("best"))
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha"))
    index = materialize(entries.select(
        "bucket", "depth", "key", "sha", "size", (-F.col("best.minus")).alias("keep"), (-F.col("best.minus_row")).alias("keep_row"), chain.alias("chain")), "dedup-index")
    release(parts)
    return index


def compare_bytes(docs: DataFrame, index: DataFrame) -> DataFrame:
    """key, sha, variants for keys of several rows; their whole texts are compared as bytes."""
    # the last of a key's chain knows the chain's length; an entry of several rows is shared by itself
    shared = materialize(index.filter("size > 1 or chain > 1").select("key").distinct(), "dedup-shared")
    norm = docs.select(normalised().alias("norm")).withColumn("key", F.xxhash64("norm"))
    held = norm.join(small(shared, 8), "key", "left_semi").groupBy("key", "norm").agg(F.count(F.lit(1)).alias("rows"))
    variants = materialize(held.groupBy("key", F.sha2("norm", 256).alias("sha")).agg(F.count(F.lit(1)).alias("variants")), "dedup-variants")
    release(shared)
    return variants


def exact_dedup(docs: DataFrame, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; one row of each group is kept."""
    prints = materialize(fingerprints(docs), "dedup-prints")
    index = build_index(prints, capacity)
    checked = compare_bytes(docs, index)
    same = F.when(F.coalesce("variants", F.lit(1)) > 1, F.raise_error(F.lit("two texts under one SHA-256"))).otherwise(F.col("size"))
    chained = materialize(
        index.join(checked, ["key", "sha"], "left").select("key", "sha", "keep", "keep_row", same.cast("long").alias("group_size")), "dedup-chained")
    for done in (checked, index):
        release(done)
    rows = prints.join(chained, ["key", "sha"])
    return rows.select("doc_id", F.col("keep").alias("keep_id"), "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


ORACLE = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
k as (
  select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
         count(*) over (partition by text_sha256) as group_size
  from t)
select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, text_sha256 from k
"""
