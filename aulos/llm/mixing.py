"""Mixing sources to target weights by hash-threshold histograms (built-in functions only).

Sizes are words. Every document has a fixed 48-bit hash. For each source the tokens are summed
by hash bucket; the bucket in which the running sum passes the budget is the only one that is
refined, twelve bits at a time, until the cut is one hash value. A last filter applies the cut, so
nothing is sorted. The whole copies that a budget above the source's size asks for are taken from
every document; the cut selects the documents that get one copy more.

Nulls: a null text has size 0, a null source is a source of its own (last in order), a null
doc_id hashes as the empty string. Repeated rows share a hash and are taken together or not at
all. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aulos.llm.shared import fresh, materialize

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights given to the sources in order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
LEVEL_BITS, LEVELS = 12, 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def hash48(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """source, source_size, weight, target: one row per source.

    Water filling in closed form: with the sources by falling tightness of their cap, the level
    is set at the first source whose share is within its cap; those before it stop at their cap.
    The windows run over one row per source, never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    tight = Window.orderBy("cap_ratio", "rank")
    every = Window.partitionBy(F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    per = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("cap_ratio", F.col("cap") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("fits", (F.col("budget") - F.col("before")) * F.col("weight") / F.col("open") <= F.col("cap"))
        .withColumn("at", F.row_number().over(tight))
        .withColumn("first", F.min(F.when(F.col("fits"), F.col("at"))).over(every))
    )
    first = F.col("at") == F.col("first")
    per = (
        per.withColumn("spare", F.max(F.when(first, F.col("budget") - F.col("before"))).over(every))
        .withColumn("among", F.max(F.when(first, F.col("open"))).over(every))
    )
    capped = F.col("first").isNull() | (F.col("at") < F.col("first"))
    target = F.when(capped, F.col("cap")).otherwise(F.least(F.col("spare") * F.col("weight") / F.col("among"), F.col("cap")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _cuts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """sid, copies, cut: documents with a hash of at most ``cut`` get one copy more."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    cuts = targets.withColumn("copies", whole).select(
        "source", "source_size", "target", "copies",
        (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"),
        F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("width"))
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        inside = sizes.alias("d").join(
            cuts.alias("c"),
            F.col("d.source").eqNullSafe(F.col("c.source")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("c.prefix")),
        ) if level > 1 else sizes.alias("d")
        tokens = inside.groupBy(F.col("d.source").alias("s"), F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("tokens"))
        run = Window.partitionBy("source").orderBy("bucket")
        # at most 2 ** LEVEL_BITS rows for each source
        passed = (
            tokens.join(cuts, F.col("s").eqNullSafe(F.col("source")))
            .withColumn("upto", F.col("below") + F.sum("tokens").over(run))
            .filter(F.col("upto") > F.col("rest"))
            .groupBy("source").agg(F.min("bucket").alias("bucket"), F.min("upto").alias("upto"))
        )
        # the running sum never falls, so the first bucket beyond the budget also has the least sum
        hit = tokens.join(passed.withColumnRenamed("source", "p"), F.col("s").eqNullSafe(F.col("p")) & (tokens["bucket"] == passed["bucket"])).select(
            F.col("s").alias("at"), passed["bucket"], "upto", "tokens")
        cuts = (
            cuts.join(hit, F.col("source").eqNullSafe(F.col("at")), "left")
            .select("source", "source_size", "target", "copies", "rest",
                    F.coalesce("bucket", F.lit(1 << (LEVEL_BITS * level)).cast("long")).alias("prefix"),
                    F.coalesce(F.col("upto") - F.col("tokens"), "below").alias("below"),
                    F.coalesce("tokens", F.lit(0).cast("long")).alias("width"))
        )
        cuts = materialize(cuts, "mix-cut")
    # prefix is now one hash value: its documents go in if that comes nearer to the budget
    nearer = (F.col("width") > 0) & (F.col("below") + F.col("width") - F.col("rest") < F.col("rest") - F.col("below"))
    return cuts.select("source", "source_size", "target", "copies", F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("cut"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken."""
    sizes = materialize(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash48(F.col("doc_id")).alias("h")), "mix-sizes")
    cuts = _cuts(sizes, materialize(source_targets(sizes, weights, share, most), "mix-targets"))
    copies = F.col("copies") + F.when((F.col("h") <= F.col("cut")) & (F.col("copies") < most), 1).otherwise(0)
    return sizes.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source"))).select(
        "doc_id", "size", F.col("d.source").alias("source"), "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_stage(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with the number of copies of each."""
    doc, source, copies = fresh(docs, "_doc", "_source", "_copies")
    made = mix(docs).filter("copies > 0").select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("copies").alias(copies)).distinct()
    joined = docs.join(made, F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)))
    return joined.select(*[c for c in docs.columns if c != "copies"], F.col(copies).alias("copies"))


ORACLE = r"""
with sizes as (
  select doc_id, source,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 12) as bigint) as h
  from documents),
per as (
  select source, cast(sum(size) as double) as source_size,
         row_number() over (order by source nulls last) - 1 as rnk
  from sizes group by source),
w as (
  select *, case rnk % 3 when 0 then 3e0 when 1 then 1e0 else 2e0 end as weight, source_size * 2e0 as cap from per),
filled as (
  select *, coalesce(sum(cap) over (order by cap / weight, rnk rows between unbounded preceding and 1 preceding), 0e0) as before,
         sum(weight) over (order by cap / weight, rnk rows between current row and unbounded following) as open,
         sum(source_size) over () * 1.5e0 as budget,
         row_number() over (order by cap / weight, rnk) as spot
  from w),
lvl as (
  select spot as first_at, budget - before as spare, open as among from filled
  where (budget - before) * weight / open <= cap order by spot limit 1),
targets as (
  select f.source, f.source_size,
         case when l.first_at is null or f.spot < l.first_at then f.cap else least(l.spare * f.weight / l.among, f.cap) end as target
  from filled f left join lvl l on true),
rests as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as copies from targets),
groups as (
  select source, h, cast(sum(size) as double) as tokens from sizes group by source, h),
cum as (
  select g.source, g.h, g.tokens,
         sum(g.tokens) over (partition by g.source order by g.h rows between unbounded preceding and current row) as upto,
         r.target - r.copies * r.source_size as rest, r.copies, r.source_size, r.target
  from groups g join rests r on g.source is not distinct from r.source),
picked as (
  select *, case when copies < 2 and (upto <= rest or (upto - tokens <= rest and upto - rest < rest - (upto - tokens))) then 1 else 0 end as extra from cum)
select d.doc_id, d.size, cast(p.source_size as bigint) as source_size, p.target,
       cast((p.copies + p.extra) * d.size as bigint) as taken
from sizes d join picked p on d.source is not distinct from p.source and d.h = p.h
"""
