"""Queries of the analysis tasks and of the store, over whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aulos.functions import analysis as an
from aulos.functions import curves as cv
from aulos.operators import store
from aulos.plans import catalog
from aulos.plans.curves import _events
from aulos.plans.registry import register
from aulos.tables import table

#: Frames a second at which an energy curve stands for a long set.
SLOW = 0.2


def _novelty(x: np.ndarray) -> np.ndarray:
    step = np.abs(np.diff(x, prepend=x[0]))
    return step / step.max() if step.max() > 0 else step


def _both(x: np.ndarray) -> tuple[list, list]:
    bass, speed = cv.gaussian(x, 1.0), cv.velocity(x, SLOW)
    made = [an.mix_events(x, bass, _novelty(x), SLOW, kind, speed, cv.sweeps(speed, SLOW, 15.0, 5.0)) for kind in ("in", "out")]
    return made[0], made[1]


def _columns(rows: list[dict], names: list[str]) -> dict:
    return {c: np.array([r[c] if isinstance(r[c], (str, int)) else round(float(r[c]), 5) for r in rows], object) for c in names}


def _mixes(x: np.ndarray) -> dict:
    entries, exits = _both(x)
    return _columns(an.merge_events(entries, "in", 20.0) + an.merge_events(exits, "out", 20.0), ["kind", "frame_idx", "time_sec", "confidence", "energy_change", "bass_change"])


def _pairs(x: np.ndarray) -> dict:
    return _columns(an.pair_events(*_both(x), merge=20.0), ["start_sec", "end_sec", "overlap_sec", "quality", "type"])


def _aligned(x: np.ndarray) -> dict:
    grid = cv.beat_grid(x, 10.0)
    edges = np.append(grid["phrases"][:, 0], grid["phrases"][-1:, 1])
    found = an.keep_surest(an.align(cv.drops(x, 10.0, least=0.05, sure=0.2), edges, 120 / grid["tempo"], 10.0), 1.0)
    return _columns(found, ["frame_idx", "time_sec", "confidence", "magnitude"])


def _timeline(x: np.ndarray) -> dict:
    return {"frame_idx": np.arange(len(x)), "likelihood": np.round(an.drop_timeline(len(x), cv.drops(x, 10.0, least=0.05, sure=0.2), 20), 5)}


def _rises(x: np.ndarray) -> dict:
    return _columns(an.buildups(x, cv.drops(x, 10.0, least=0.05, sure=0.2), 10.0, 20), ["start_sec", "end_sec", "intensity", "duration_sec"])


def _arc(x: np.ndarray) -> dict:
    return {c: [v if c == "shape" else round(float(v), 6)] for c, v in an.energy_arc(x, SLOW, 15.0).items()}


def _tempos(x: np.ndarray) -> dict:
    found = an.tempo_distribution(an.window_tempos(x, 10.0, 3.0, 0.5))
    return {c: [round(float(found[c]), 4)] for c in ("mean", "deviation", "lowest", "highest")} | {"dominant": [found["dominant"]]}


def _points(x: np.ndarray) -> dict:
    a, b = an.mix_points(x, len(x) / SLOW, [d["time_sec"] for d in cv.drops(x, SLOW)], 20.0)
    return {"mix_in": [round(a, 4)], "mix_out": [round(b, 4)]}


def _quality(x: np.ndarray) -> dict:
    g = cv.beat_grid(x, 10.0)
    return {"regularity": [round(an.beat_regularity(g["times"], 60 / g["tempo"]), 5)], "downbeat_confidence": [round(an.downbeat_confidence(x[g["frames"]], g["bar_position"]), 5)]}


_events("mix_events", _mixes, "kind string, frame_idx long, time_sec double, confidence double, energy_change double, bass_change double")
_events("transition_pairs", _pairs, "start_sec double, end_sec double, overlap_sec double, quality double, type string")
_events("aligned_drops", _aligned, "frame_idx long, time_sec double, confidence double, magnitude double")
_events("drop_timeline", _timeline, "frame_idx long, likelihood double")
_events("buildup_zones", _rises, "start_sec double, end_sec double, intensity double, duration_sec double")
_events("energy_arc", _arc, "opening double, peak double, closing double, deviation double, peak_place double, shape string")
_events("tempo_distribution", _tempos, "mean double, deviation double, lowest double, highest double, dominant long")
_events("mix_points", _points, "mix_in double, mix_out double", None)
_events("grid_quality", _quality, "regularity double, downbeat_confidence double")


# ---- tables of tracks and pairs -----------------------------------------------------------------

def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.run_sql(spark, sf_dir, f"select * from {catalog.TRACKS} t")


def octave_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpm = F.col("bpm") * F.when(F.col("rating") < 2, 0.5).otherwise(F.when(F.col("rating") > 4, 1.6).otherwise(1.0))
    fits = lambda r, low, high: (F.col("x") * r).between(low, high)
    up = F.when(fits(1.5, 118, 145), F.col("x") * 1.5).when(fits(2, 118, 150), F.col("x") * 2).when(fits(1.25, 118, 145), F.col("x") * 1.25).otherwise(F.col("x"))
    down = F.when(fits(0.5, 118, 145), F.col("x") / 2).otherwise(F.col("x"))
    fixed = F.when(F.col("x") < 115, up).when(F.col("x") > 155, down).otherwise(F.col("x"))
    return _tracks(spark, sf_dir).select("id", bpm.alias("x")).select("id", F.round(fixed, 4).alias("bpm"))


def running_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track with the next one of its artist, by tempo and id."""
    order = Window.partitionBy("artist").orderBy("bpm", "id")
    own = _tracks(spark, sf_dir).withColumn("drops", F.array(F.col("rating") * 8.0, F.col("duration") / 2.0, F.col("duration") - F.col("num") * 5.0))
    return own.select("id", "duration", "drops", F.lead("id").over(order).alias("next"), F.lead("drops").over(order).alias("next_drops")).filter("next is not null")


def drop_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.size(F.filter("drops", lambda d: F.col("duration") - d < 32))
    early = F.size(F.filter("next_drops", lambda d: d < 32))
    pairs = running_pairs(spark, sf_dir).select("id", "next", (late + early).alias("n"))
    return pairs.select("id", "next", F.when(F.col("n") == 0, 1.0).when(F.col("n") == 1, 0.7).when(F.col("n") == 2, 0.4).otherwise(0.2).alias("score"))


def energy_curve_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track's curve against that of the track with the next number."""
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("v")).select("user_id", F.col("v.value").alias("a"))
    pairs = own.join(own.select((F.col("user_id") - 1).alias("user_id"), F.col("a").alias("b")), "user_id")

    def score(batches):
        for p in batches:
            p["score"] = [round(float(an.energy_curve_score(np.asarray(a, float) / 100, np.asarray(b, float) / 100)), 5) for a, b in zip(p["a"], p["b"], strict=True)]
            yield p[["user_id", "score"]]

    return pairs.mapInPandas(score, "user_id long, score double")


_OCTAVE = f"""select id, round(case when x < 115 then case when x * 1.5E0 between 118 and 145 then x * 1.5E0 when x * 2 between 118 and 150 then x * 2 when x * 1.25E0 between 118 and 145 then x * 1.25E0 else x end
  when x > 155 and x / 2 between 118 and 145 then x / 2 else x end, 4) as bpm from (select id, bpm * case when rating < 2 then 5E-1 when rating > 4 then 1.6E0 else 1E0 end as x from {catalog.TRACKS} t) u"""
_CONFLICT = f"""with d as (select id, duration, lead(id) over w as next, [rating * 8E0, duration / 2E0, duration - num * 5E0] as a, lead([rating * 8E0, duration / 2E0, duration - num * 5E0]) over w as b
  from {catalog.TRACKS} t window w as (partition by artist order by bpm, id)), x as (select id, next, duration, unnest(a) as p, unnest(b) as q from d where next is not null),
n as (select id, next, sum(cast(duration - p < 32 as int) + cast(q < 32 as int)) as n from x group by id, next)
select id, next, case n when 0 then 1E0 when 1 then 7E-1 when 2 then 4E-1 else 2E-1 end as score from n"""

register("octave_fix", octave_fix, _OCTAVE)
register("score_drop_conflict", drop_conflict, _CONFLICT)
register("score_energy_curve", energy_curve_pairs)


# ---- store --------------------------------------------------------------------------------------

def _plans(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 2 == (1 if late else 0))
    return rows.select(F.col("o_custkey").alias("plan"), F.col("o_orderdate").alias("created"), F.col("o_orderdate").alias("updated"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("total"))


def upsert_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One half of the orders stored by customer, then the other half saved over it; the first creation date stays."""
    held = store.latest(_plans(spark, sf_dir, False), ["plan"], ["updated", "version"])
    made = store.upsert(held, _plans(spark, sf_dir, True), ["plan"], ["updated", "version"], ["created"])
    return made.select("plan", F.col("created").cast("string").alias("created"), F.col("updated").cast("string").alias("updated"), "version", "total")


def invalidate_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("plan"))
    return store.without(_plans(spark, sf_dir, False), gone, ["plan"]).groupBy("plan").agg(F.count(F.lit(1)).alias("versions"))


def profile_add_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of a customer counted once however often they are added."""
    sets = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dj"), F.col("o_orderkey").alias("set_id"), (F.col("o_totalprice") / 1000).alias("hours"))
    made = store.add_sets(sets.filter("set_id % 3 < 2"), sets.filter("set_id % 3 > 0"), "dj", "set_id", "hours")
    return made.select("dj", "n_sets", F.round("hours", 1).alias("hours"))


def complete_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type")
    return store.has_all(rows, "user_id", "event_type", ["click", "view", "purchase", "error"])


def profile_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    held = line.groupBy(F.col("l_orderkey").alias("dj")).agg(F.collect_list(F.col("l_quantity") % 7).alias("hashes"))
    asked = line.filter("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("dj")).agg(F.collect_list(F.col("l_quantity") % 7).alias("hashes"))
    return store.same_sets(held, asked, "dj", "hashes")


def index_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("plan"))
    return store.orphans(index, table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("plan")), ["plan"])


_UPSERT = """with h as (select * from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders where o_orderkey % 2 = 0) a where r = 1),
n as (select * from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders where o_orderkey % 2 = 1) a where r = 1)
select coalesce(n.o_custkey, h.o_custkey) as plan, cast(coalesce(h.o_orderdate, n.o_orderdate) as varchar) as created, cast(coalesce(n.o_orderdate, h.o_orderdate) as varchar) as updated,
coalesce(n.o_orderkey, h.o_orderkey) as version, coalesce(n.o_totalprice, h.o_totalprice) as total from h full join n on h.o_custkey = n.o_custkey"""

register("upsert_plans", upsert_plans, _UPSERT)
register("invalidate_plans", invalidate_plans, "select o_custkey as plan, count(*) as versions from orders join customer on c_custkey = o_custkey where o_orderkey % 2 = 0 and c_nationkey >= 5 group by o_custkey")
register("profile_add_sets", profile_add_sets, "select o_custkey as dj, count(*) as n_sets, round(sum(o_totalprice / 1000), 1) as hours from orders group by o_custkey")
register("complete_features", complete_features, "select user_id, bool_or(event_type = 'click') and bool_or(event_type = 'view') and bool_or(event_type = 'purchase') and bool_or(event_type = 'error') as complete from events group by user_id")
register("profile_validity", profile_validity, """select l_orderkey as dj, count(distinct l_quantity % 7) = count(distinct case when l_linenumber > 1 then l_quantity % 7 end) as valid
from lineitem group by l_orderkey having bool_or(l_linenumber > 1)""")
register("index_orphans", index_orphans, "select c_custkey as plan from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 5 = 0)")
