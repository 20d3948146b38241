"""Queries over the input tables written once as standard SQL and planned by Catalyst.

Each entry is one operator of the sequence, grid, pair, store, planning or job families. ``{frames}``,
``{bins}``, ``{tracks}``, ``{grid}`` and ``{jobs}`` stand for the derived tables below, ``{pairs}`` for the
pairs of tracks. The text of ``{bins}``, ``{pairs}``, ``best_next_tracks`` and the low frames differs between
engines: Spark joins on tempo cells, the oracle compares every pair. All sequence windows are partitioned by track, so a
table of many tracks spreads over the cluster and none is gathered.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

from aulos.functions.analysis import GENRES
from aulos.plans.qualities import counted
from aulos.plans.registry import register
from aulos.tables import table

FRAMES = """(select user_id as track_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_idx,
  count(*) over (partition by user_id) as n, value as energy from events)"""
BINS_SPARK = """(select vec_id, cast(label as bigint) as track_id, cast(pos as bigint) as k, abs(cast(x as double)) as s, cast(x as double) as v, pos * 1.5625E2 as f
  from embeddings lateral view posexplode(embedding) e as pos, x)"""
BINS_DUCK = """(select vec_id, cast(label as bigint) as track_id, cast(i - 1 as bigint) as k, abs(cast(embedding[i] as double)) as s, cast(embedding[i] as double) as v, (i - 1) * 1.5625E2 as f
  from embeddings, (select unnest(range(1, 65)) as i) r)"""
TRACKS = """(select p_partkey as id, 9E1 + ((p_partkey * 37) % 900) / 1E1 as bpm, cast(p_size % 12 + 1 as bigint) as num,
  case when p_partkey % 2 = 0 then 'A' else 'B' end as letter, p_brand as artist, cast(p_size % 6 as bigint) as rating,
  case p_partkey % 7 when 0 then 'Techno' when 1 then 'House' when 2 then 'Trance' when 3 then 'Disco/Funk' when 4 then 'Bass' when 5 then 'Hip-Hop' else 'Ambient' end as genre,
  cast(180 + 6 * p_size as bigint) as duration, cast((p_partkey * 13) % (180 + 6 * p_size) as bigint) as drop_at, p_retailprice as centroid,
  (p_partkey % 10) / 1E1 as intro, ((p_partkey * 7) % 10) / 1E1 as outro from part)"""
# A frame is low below its track's mean. A frame at the mean turns on the order in which doubles are added, so Spark adds them in frame order.
LOW_SPARK = """(select track_id, frame_idx, energy < avg(energy) over (partition by track_id order by frame_idx rows between unbounded preceding and unbounded following) as low from {frames} t)"""
#: A beat every half second per set (order); bars of 4 beats, phrases of 16.
GRID = """(select l_orderkey as set_id, cast(l_linenumber as bigint) as pos, l_quantity as t, floor(l_quantity / 2E0) * 2E0 as bar_start,
  floor(l_quantity / 8E0) * 8E0 as phrase_start from lineitem)"""
JOBS = """(select event_id as job_id, user_id, event_type, ts, value, case when event_type = 'error' then 'failed' when event_type = 'purchase' then 'complete'
  when event_type = 'signup' then 'in_progress' else 'queued' end as state, cast(event_id % 5 as bigint) as tries from events)"""

_KEY = "(case when a.num = b.num and a.letter = b.letter then 0 when a.num = b.num then 1 else least(abs(a.num - b.num), 12 - abs(a.num - b.num)) + case when a.letter = b.letter then 0 else 1 end end)"
_BPM = "(least(abs(a.bpm - b.bpm) / least(a.bpm, b.bpm), abs(a.bpm - 2 * b.bpm) / a.bpm, abs(2 * a.bpm - b.bpm) / (2 * a.bpm)) * 1E2)"
_H = f"(case {_KEY} when 0 then 1E0 when 1 then 9E-1 when 2 then 6E-1 when 3 then 3E-1 else 1E-1 end)"
_B = f"(case when {_BPM} <= 2E0 then 1E0 when {_BPM} <= 6E0 then 8E-1 when {_BPM} <= 9E0 then 5E-1 else 2E-1 end)"
_S = "greatest(0E0, 1E0 - abs(a.centroid - b.centroid) / 2E3)"
_G = "(case when a.genre = b.genre then 1E0 " + " ".join(f"when (a.genre = '{x}' and b.genre = '{y}') or (a.genre = '{y}' and b.genre = '{x}') then {v:E}" for (x, y), v in GENRES.items()) + " else 4E-1 end)"
# drops in the last 32 seconds of the first track or the first 32 of the second clash
_LATE, _EARLY = "case when a.duration - a.drop_at < 32 then 1 else 0 end", "case when b.drop_at < 32 then 1 else 0 end"
_D = f"(1E0 - 3E-1 * ({_LATE} + {_EARLY}))"
_E = "(case when b.intro - a.outro between 0E0 and 1.5E-1 then 1E0 when abs(b.intro - a.outro) <= 2E-1 then 9E-1 when abs(b.intro - a.outro) <= 3E-1 then 7E-1 when abs(b.intro - a.outro) <= 5E-1 then 4E-1 else 2E-1 end)"
# key moves that keep a set going: a neighbour, the relative mode and a diagonal come before staying
_STEP = "least(abs(a.num - b.num), 12 - abs(a.num - b.num))"
_MOVE = f"(case when a.num = b.num and a.letter = b.letter then 7E-1 when a.letter = b.letter and {_STEP} = 1 then 1E0 when a.num = b.num then 9.5E-1 when {_STEP} = 1 then 8.5E-1 when {_STEP} = 2 and a.letter = b.letter then 5E-1 when {_STEP} = 2 then 4E-1 else 2E-1 end)"
_GAP = "(case when abs(a.bpm - b.bpm) <= 2E0 then 1E0 when abs(a.bpm - b.bpm) <= 4E0 then 8E-1 when abs(a.bpm - b.bpm) <= 6E0 then 5E-1 else 2E-1 end)"
_NEXT = f"(3.5E-1 * {_MOVE} + 2E-1 * (case when a.artist = b.artist then 0E0 else 1E0 end) + 1.5E-1 * (case when b.rating > 0 then b.rating / 5E0 else 5E-1 end) + 1.5E-1 * {_GAP} + 7.5E-2)"
_TOTAL = f"round((3E-1 * {_H} + 2.5E-1 * {_E} + 2E-1 * {_D} + 1.5E-1 * {_S} + 1E-1 * {_G}) * (5E-1 + 5E-1 * {_B}), 9)"
# Pairs are the tracks whose tempo, or its half or double, is within 9 percent: beyond it the tempo score is constant and the lowest.
# Cells are 0.02 wide in ln(bpm), so the eleven around a tempo hold all within 9 percent; a pair meets in one of a's cells only. The left
# side is spread over the cluster by track before the pairs are made, since a small library is one file.
_CELL = "cast(floor(ln(bpm {0}) / 2E-2) as bigint)"
_CELLS = "explode(concat(" + ", ".join(f"sequence({c} - 5, {c} + 5)" for c in (_CELL.format(m) for m in ("* 5E-1", "* 1E0", "* 2E0"))) + ")) as cell"
PAIRS_SPARK = f"""(select /*+ repartition({{parts}}, id) */ *, {_CELLS} from {{tracks}} s) a
  join (select *, {_CELL.format("")} as cell from {{tracks}} t) b on a.cell = b.cell and a.id <> b.id and {_BPM} <= 9E0"""
PAIRS_DUCK = f"{{tracks}} a join {{tracks}} b on a.id <> b.id and {_BPM} <= 9E0"
# Best successors look at tracks of any tempo. Of tracks alike in key and rating, one further than 6 BPM away loses to any with a smaller id,
# unless that one is by the same artist: so of each key and rating the first twelve ids, six an artist at most, stand for all that are far.
# Of tracks alike in tempo too the same holds at any distance. Cells of 1 BPM find the near ones.
_ALIKE = "row_number() over (partition by {0} order by id)"
_FIRST = "(select * from (select *, " + _ALIKE.format("{0}") + " as nth from (select *, " + _ALIKE.format("{0}, artist") + " as own from {{tracks}} t) u where own <= 6) w where nth <= 12)"
_NEXT_PAIR = f"select a.id as a, b.id as b, round({_NEXT}, 6) as total from "
_BEST = "select a, b, rnk, total from (select a, b, total, row_number() over (partition by a order by total desc, b) as rnk from ({0}) u) w where rnk <= 5"
# What is left depends on a track's tempo and key only, but for its artist. So for each tempo, tracks alike in key, rating and step of distance give their first
# twelve ids, six an artist at most; then for each tempo and key, as if all artists were others, the twelve best of those, six an artist at most, stand for
# all in the same way. Each track looks at the twelve of its own tempo and key.
_TOP = "(select * from (select *, row_number() over (partition by {0} order by {1}) as nth from (select *, row_number() over (partition by {0}, artist order by {1}) as own from ({2}) p) q where own <= 6) r where nth <= 12)"
_STEPPED = "select a.bpm as at, " + _GAP + " as gap, b.id, b.bpm, b.num, b.letter, b.artist, b.rating from "
_POOL = _TOP.format("at, gap, num, letter, rating", "id",
    _STEPPED + "(select /*+ repartition({parts}, bpm) */ *, explode(sequence(cast(floor(bpm) as bigint) - 7, cast(floor(bpm) as bigint) + 7)) as cell from (select distinct bpm from {tracks} c) s) a join (select *, cast(floor(bpm) as bigint) as cell from "
    + _FIRST.format("num, letter, rating, bpm") + " x) b on a.cell = b.cell and abs(a.bpm - b.bpm) <= 6E0 union all "
    + _STEPPED + "(select /*+ repartition({parts}, bpm) */ * from (select distinct bpm from {tracks} c) s) a join " + _FIRST.format("num, letter, rating") + " b on abs(a.bpm - b.bpm) > 6E0")
_TWELVE = _TOP.format("at, at_num, at_letter", "liked desc, id",
    "select b.at, a.num as at_num, a.letter as at_letter, b.id, b.bpm, b.num, b.letter, b.artist, b.rating, round(" + _NEXT + ", 6) as liked from (select distinct bpm, num, letter, cast(null as string) as artist from {tracks} c) a join " + _POOL + " b on a.bpm <=> b.at")
BEST_SPARK = _BEST.format(_NEXT_PAIR + "{tracks} a join " + _TWELVE + " b on a.bpm <=> b.at and a.num <=> b.at_num and a.letter <=> b.at_letter and a.id <> b.id")
BEST_DUCK = _BEST.format(_NEXT_PAIR + "{tracks} a join {tracks} b on a.id <> b.id")

# fixed values: weights of the twelve semitones above the tonic of a major and a minor key
_MAJOR = "(0, 6.35E0), (1, 2.23E0), (2, 3.48E0), (3, 2.33E0), (4, 4.38E0), (5, 4.09E0), (6, 2.52E0), (7, 5.19E0), (8, 2.39E0), (9, 3.66E0), (10, 2.29E0), (11, 2.88E0)"
_MINOR = "(0, 6.33E0), (1, 2.68E0), (2, 3.52E0), (3, 5.38E0), (4, 2.6E0), (5, 3.53E0), (6, 2.54E0), (7, 4.75E0), (8, 3.98E0), (9, 2.69E0), (10, 3.34E0), (11, 3.17E0)"
_PC = "cast(round((12 * log2(f / 4.4E2) + 69) % 12) as bigint) % 12"
_CHROMA = f"(select vec_id, track_id, pc, e / (sqrt(sum(e * e) over (partition by vec_id)) + 1E-10) as c from (select vec_id, track_id, {_PC} as pc, sum(s * s) as e from {{bins}} t where f > 0 group by vec_id, track_id, {_PC}) u)"
_SECONDS = "cast(floor(l_extendedprice / 1E1) as bigint)"

QUERIES = {
    # energy curves
    "energy_derivative": "select track_id, frame_idx, round(coalesce(energy - lag(energy) over (partition by track_id order by frame_idx), 0E0), 6) as d1 from {frames} t",
    "energy_derivative_2": "select track_id, frame_idx, round(case when frame_idx < 2 then coalesce(d1, 0E0) else d1 - p end, 6) as d2 from (select track_id, frame_idx, d1, lag(d1) over (partition by track_id order by frame_idx) as p from (select track_id, frame_idx, coalesce(energy - lag(energy) over (partition by track_id order by frame_idx), 0E0) as d1 from {frames} t) u) w",
    "low_energy_frames": "select track_id, frame_idx, energy < m as low from (select track_id, frame_idx, energy, avg(energy) over (partition by track_id) as m from {frames} t) u",
    "low_energy_ratio": "select track_id, round(avg(case when energy < m then 1E0 else 0E0 end), 6) as low_ratio from (select track_id, energy, avg(energy) over (partition by track_id) as m from {frames} t) u group by track_id",
    "energy_variance": "select track_id, round(case when avg(energy) <= 0 then 0E0 else power(stddev_pop(energy) / avg(energy), 2) end, 6) as variance from {frames} t group by track_id",
    "dynamic_range": "select track_id, round(case when p5 > 0 then 2E1 * log10(p95 / p5) else 0E0 end, 6) as range_db from (select track_id, percentile_cont(0.95) within group (order by energy) as p95, percentile_cont(0.05) within group (order by energy) as p5 from {frames} t where energy > 0 group by track_id) u",
    "rms_time_domain": "select track_id, cast(floor(frame_idx / 8) as bigint) as hop, round(sqrt(avg(energy * energy)), 6) as rms from {frames} t group by track_id, floor(frame_idx / 8)",
    "zero_crossing_rate": "select track_id, cast(floor(frame_idx / 16) as bigint) as hop, round(sum(case when s <> p then 1E0 else 0E0 end) / 32E0, 6) as zcr from (select track_id, frame_idx, s, lag(s) over (partition by track_id order by frame_idx) as p from (select track_id, frame_idx, sign(energy - m) as s from (select track_id, frame_idx, energy, avg(energy) over (partition by track_id) as m from {frames} t) u) w) x group by track_id, floor(frame_idx / 16)",
    # filtering and normalisation
    "smooth_uniform": "select track_id, frame_idx, sm as smooth from (select track_id, frame_idx, real, round(avg(energy) over (partition by track_id order by frame_idx rows between 2 preceding and 2 following), 6) as sm from (select track_id, frame_idx, energy, 1 as real from {frames} t union all select track_id, -1 - frame_idx, energy, 0 from {frames} t where frame_idx < 2 union all select track_id, 2 * n - 1 - frame_idx, energy, 0 from {frames} t where frame_idx >= n - 2) u) w where real = 1",
    "normalize_minmax": "select track_id, frame_idx, round((energy - lo) / (hi - lo + 1E-10), 6) as x from (select track_id, frame_idx, energy, min(energy) over (partition by track_id) as lo, max(energy) over (partition by track_id) as hi from {frames} t) u",
    "normalize_zscore": "select track_id, frame_idx, round((energy - m) / (sd + 1E-10), 5) as x from (select track_id, frame_idx, energy, avg(energy) over (partition by track_id) as m, stddev_pop(energy) over (partition by track_id) as sd from {frames} t) u",
    "normalize_l2": "select track_id, frame_idx, round(energy / (sqrt(q) + 1E-10), 6) as x from (select track_id, frame_idx, energy, sum(energy * energy) over (partition by track_id) as q from {frames} t) u",
    "compute_delta": "select track_id, frame_idx, round((1E0 * (m1 - p1) + 2E0 * (m2 - p2)) / 1E1, 6) as delta from (select track_id, frame_idx, coalesce(lag(energy, 1) over w, first_value(energy) over w) as m1, coalesce(lag(energy, 2) over w, first_value(energy) over w) as m2, coalesce(lead(energy, 1) over w, e) as p1, coalesce(lead(energy, 2) over w, e) as p2 from (select track_id, frame_idx, energy, last_value(energy) over (partition by track_id order by frame_idx rows between unbounded preceding and unbounded following) as e from {frames} t) u window w as (partition by track_id order by frame_idx)) x",
    "clip_outliers": "select t.track_id, t.frame_idx, round(least(greatest(t.energy, p.lo), p.hi), 6) as x from {frames} t join (select track_id, percentile_cont(0.01) within group (order by energy) as lo, percentile_cont(0.99) within group (order by energy) as hi from {frames} q group by track_id) p on t.track_id = p.track_id",
    "pad_or_truncate": "select track_id, frame_idx, energy from {frames} t where frame_idx < 32 union all select a.track_id, i, 0E0 from {frames} a join (values " + ", ".join(f"({i})" for i in range(32)) + ") v(i) on v.i >= a.n where a.frame_idx = 0",
    "resample_half": "select track_id, frame_idx / 2 as slot, round((energy + coalesce(nx, energy)) / 2E0, 6) as x from (select track_id, frame_idx, energy, lead(energy) over (partition by track_id order by frame_idx) as nx from {frames} t) u where frame_idx % 2 = 0",
    "interpolate_gaps": "select track_id, frame_idx, round(case when frame_idx % 3 <> 1 then energy when nx is null then pv else (pv + nx) / 2E0 end, 6) as x from (select track_id, frame_idx, energy, lag(energy) over (partition by track_id order by frame_idx) as pv, lead(energy) over (partition by track_id order by frame_idx) as nx from {frames} t) u",
    # spectra
    "spectral_centroid_magnitude": "select vec_id, round(sum(f * s) / (sum(s) + 1E-10), 4) as centroid from {bins} t group by vec_id",
    "spectral_centroid_power": "select vec_id, round(sum(f * s * s) / (sum(s * s) + 1E-10), 4) as centroid from {bins} t group by vec_id",
    "spectral_rolloff": "select vec_id, min(f) as rolloff from (select vec_id, f, sum(s * s) over (partition by vec_id order by k) as run, sum(s * s) over (partition by vec_id) as tot from {bins} t) u where run >= 8.5E-1 * tot group by vec_id",
    "spectral_brightness": "select vec_id, round(sum(case when f >= 3E3 then s * s else 0E0 end) / (sum(s * s) + 1E-10), 6) as brightness from {bins} t group by vec_id",
    "spectral_flatness_power": "select vec_id, round(exp(avg(ln(s * s + 1E-10))) / (avg(s * s) + 1E-10), 6) as flatness from {bins} t group by vec_id",
    "spectral_flatness_magnitude": "select vec_id, round(exp(avg(ln(s + 1E-10))) / (avg(s) + 1E-10), 6) as flatness from {bins} t group by vec_id",
    "spectral_bandwidth": "select t.vec_id, round(sqrt(sum(s * power(f - c, 2)) / (sum(s) + 1E-10)), 4) as bandwidth from {bins} t join (select vec_id, sum(f * s) / (sum(s) + 1E-10) as c from {bins} q group by vec_id) m on t.vec_id = m.vec_id group by t.vec_id",
    "spectral_rms": "select vec_id, round(sqrt(avg(s * s)), 6) as rms from {bins} t group by vec_id",
    "spectral_slope": "select vec_id, round(regr_slope(log10(s + 1E-10), (k - 3.15E1) / 1.8472953E1), 5) as slope from {bins} t group by vec_id",
    "band_energy": "select vec_id, round(sum(case when f between 20 and 250 then s * s else 0E0 end), 6) as bass, round(sum(case when f between 250 and 2000 then s * s else 0E0 end), 6) as mid, round(sum(case when f between 2000 and 20000 then s * s else 0E0 end), 6) as high from {bins} t group by vec_id",
    "spectral_contrast": "select vec_id, band, round(log10((max(s * s) + 1E-10) / (min(s * s) + 1E-10)), 4) as contrast from (select vec_id, s, cast(least(floor(ln(f / 2E2) / ln(2E0)), 6) as bigint) as band from {bins} t where f >= 200) u group by vec_id, band",
    "amplitude_to_db": "select vec_id, k, round(greatest(db, mx - 8E1), 4) as db from (select vec_id, k, db, max(db) over (partition by track_id) as mx from (select vec_id, track_id, k, 2E1 * log10(greatest(s, 1E-10)) as db from {bins} t) u) w",
    "chroma_mean": "select vec_id, pc, round(e / (sqrt(q) + 1E-10), 6) as chroma from (select vec_id, pc, e, sum(e * e) over (partition by vec_id) as q from (select vec_id, cast(k % 12 as bigint) as pc, sum(s * s) as e from {bins} t group by vec_id, k % 12) u) w",
    "mfcc_stats": "select track_id, k, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std from {bins} t group by track_id, k",
    "spectral_flux": "select vec_id, round(sqrt(sum(power(s - coalesce(p, 0E0), 2))), 5) as flux from (select vec_id, k, s, lag(s) over (partition by track_id, k order by vec_id) as p from {bins} t) u group by vec_id",
    "onset_strength": "select vec_id, round(avg(greatest(0E0, coalesce(v - p, 0E0))), 6) as onset from (select vec_id, k, v, lag(v) over (partition by track_id, k order by vec_id) as p from {bins} t) u group by vec_id",
    "novelty_cosine": "select vec_id, round(1E0 - sum(v * p) / (sqrt(sum(v * v)) * sqrt(sum(p * p)) + 1E-10), 5) as novelty from (select vec_id, k, v, lag(v) over (partition by track_id, k order by vec_id) as p from {bins} t) u where p is not null group by vec_id",
    "novelty_euclidean": "select vec_id, round(sqrt(sum(power(v - p, 2))), 5) as novelty from (select vec_id, k, v, lag(v) over (partition by track_id, k order by vec_id) as p from {bins} t) u where p is not null group by vec_id",
    "novelty_correlation": "select vec_id, round(1E0 - corr(v, p), 5) as novelty from (select vec_id, k, v, lag(v) over (partition by track_id, k order by vec_id) as p from {bins} t) u where p is not null group by vec_id",
    "path_similarity": "select vec_id, round(exp(-d / (md + 1E-10)), 5) as similarity from (select u.vec_id, u.d, m.md from (select vec_id, track_id, sum(power(v - p, 2)) as d from (select vec_id, track_id, k, v, lag(v) over (partition by track_id, k order by vec_id) as p from {bins} t) x where p is not null group by vec_id, track_id) u join (select track_id, median(d) as md from (select vec_id, track_id, sum(power(v - p, 2)) as d from (select vec_id, track_id, k, v, lag(v) over (partition by track_id, k order by vec_id) as p from {bins} t) y where p is not null group by vec_id, track_id) z group by track_id) m on u.track_id = m.track_id) w",
    # events on curves
    "label_boundaries": "select user_id as track_id, frame_idx from (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_idx, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) u where p is null or p <> event_type",
    "low_energy_runs": "select track_id, min(frame_idx) as first_frame, max(frame_idx) as last_frame, count(*) as frames from (select track_id, frame_idx, frame_idx - row_number() over (partition by track_id order by frame_idx) as grp from (select track_id, frame_idx, energy, avg(energy) over (partition by track_id) as m from {frames} t) u where energy < m) w group by track_id, grp",
    "autocorrelate": "select a.track_id, b.frame_idx - a.frame_idx as lag_frames, round(sum(a.energy * b.energy) / max(a.n), 3) as ac from {frames} a join {frames} b on a.track_id = b.track_id and b.frame_idx between a.frame_idx and a.frame_idx + 7 group by a.track_id, b.frame_idx - a.frame_idx",
    "onset_density": "select track_id, frame_idx, round(sum(hit) over (partition by track_id order by frame_idx rows between 5 preceding and 4 following), 6) as density from (select t.track_id, t.frame_idx, case when t.energy > c.h then 1E0 else 0E0 end as hit from {frames} t join (select track_id, percentile_cont(0.75) within group (order by energy) as h from {frames} q group by track_id) c on t.track_id = c.track_id) u",
    "beat_strength": "select track_id, frame_idx, energy from {frames} t where frame_idx % 8 = 0",
    "groove": "select track_id, round(f / (b + f + 1E-10), 6) as groove from (select track_id, avg(case when frame_idx % 8 = 0 then energy end) as b, coalesce(avg(case when frame_idx % 8 = 4 then energy end), 0E0) as f from {frames} t group by track_id) u",
    "beat_sync_mask": "select track_id, frame_idx, least(frame_idx % 8, 8 - frame_idx % 8) <= 2 as on_beat from {frames} t",
    "spectral_velocity": "select track_id, frame_idx, round(case when p is null and x is null then 0E0 when p is null then x - energy when x is null then energy - p else (x - p) / 2E0 end, 6) as velocity from (select track_id, frame_idx, energy, lag(energy) over (partition by track_id order by frame_idx) as p, lead(energy) over (partition by track_id order by frame_idx) as x from {frames} t) u",
    # grid
    "grid_bars": "select set_id, bar_start, count(*) as events, max(t) as last_t from {grid} g group by set_id, bar_start",
    "grid_phrases": "select set_id, phrase_start, phrase_start + 8E0 as phrase_end, count(*) as events from {grid} g group by set_id, phrase_start",
    "snap_to_bar": "select set_id, pos, case when t - bar_start <= 1E0 then bar_start else bar_start + 2E0 end as snapped from {grid} g",
    "snap_to_phrase": "select set_id, pos, case when t - phrase_start <= 4E0 then phrase_start else phrase_start + 8E0 end as snapped from {grid} g",
    "phrase_position": "select set_id, pos, cast(phrase_start / 8E0 as bigint) as phrase, cast((bar_start - phrase_start) / 2E0 as bigint) as bar_in_phrase, cast(floor((t - bar_start) * 2E0) as bigint) as beat_in_bar from {grid} g",
    "event_offsets": "select set_id, pos, case when t - phrase_start <= 4E0 then t - phrase_start else t - phrase_start - 8E0 end as off from {grid} g",
    "alignment_score": "select set_id, round(avg(case when least(t - phrase_start, phrase_start + 8E0 - t) <= 1E0 then 1E0 else 0E0 end), 6) as aligned from {grid} g group by set_id",
    "grid_phase_shift": "select set_id, round(0E0 - median(case when t - phrase_start <= 4E0 then t - phrase_start else t - phrase_start - 8E0 end), 6) as shift from {grid} g group by set_id having count(*) >= 2",
    "beat_aligned_features": "select track_id, cast(floor(frame_idx / 8) as bigint) as beat, round(avg(energy), 6) as mean, max(energy) as peak, round(sum(energy), 4) as total from {frames} t group by track_id, floor(frame_idx / 8)",
    "snap_to_beat": "select set_id, pos, floor(t * 2E0 + 5E-1) / 2E0 as snapped from {grid} g",
    "on_bar_boundary": "select set_id, pos, least(t - bar_start, bar_start + 2E0 - t) <= 5E-1 as near from {grid} g",
    "on_phrase_boundary": "select set_id, pos, least(t - phrase_start, phrase_start + 8E0 - t) <= 1E0 as near from {grid} g",
    "bar_at_time": "select set_id, pos, cast(bar_start / 2E0 as bigint) as bar, bar_start, bar_start + 2E0 as bar_end from {grid} g",
    "phrase_at_time": "select set_id, pos, cast(phrase_start / 8E0 as bigint) as phrase, phrase_start, phrase_start + 8E0 as phrase_end from {grid} g",
    "snap_events_to_grid": "select set_id, pos, case when least(t - phrase_start, phrase_start + 8E0 - t) > 1E0 then t when t - phrase_start <= 4E0 then phrase_start else phrase_start + 8E0 end as snapped from {grid} g",
    "phase_corrected": "select g.set_id, g.pos, round(g.t + s.shift, 6) as t from {grid} g join (select set_id, 0E0 - median(case when t - phrase_start <= 4E0 then t - phrase_start else t - phrase_start - 8E0 end) as shift from {grid} h group by set_id) s on g.set_id = s.set_id",
    # pairs
    "score_harmonic": "select a.id as a, b.id as b, cast(" + _KEY + " as bigint) as distance, " + _H + " as harmonic from {pairs}",
    "score_bpm": "select a.id as a, b.id as b, round(" + _BPM + ", 6) as diff, " + _B + " as score from {pairs}",
    "score_spectral": "select a.id as a, b.id as b, round(" + _S + ", 6) as score from {pairs}",
    "score_genre": "select a.id as a, b.id as b, " + _G + " as score from {pairs}",
    "score_energy_flow": "select a.id as a, b.id as b, " + _E + " as score from {pairs}",
    "transition_score": "select a.id as a, b.id as b, " + _TOTAL + " as total from {pairs}",
    "transition_quality": "select quality, count(*) as pairs from (select case when total >= 8E-1 then 'Excellent' when total >= 6E-1 then 'Good' when total >= 4E-1 then 'Fair' else 'Poor' end as quality from (select " + _TOTAL + " as total from {pairs}" + ") u) w group by quality",
    "key_progression": "select a.id as a, b.id as b, " + _MOVE + " as score from {pairs}",
    "best_next_tracks": BEST_SPARK,
    # planning
    "filter_tracks_for_phase": "select p.name as phase, t.id from (select 'intro' as name, 1.0E2 as lo, 1.15E2 as hi union all select 'build', 1.15E2, 1.25E2 union all select 'peak', 1.25E2, 1.35E2 union all select 'outro', 1.1E2, 1.2E2) p join {tracks} t on t.bpm > 0 and (t.bpm between p.lo and p.hi or 2 * t.bpm between p.lo and p.hi or t.bpm / 2 between p.lo and p.hi)",
    "weak_transitions": "select set_id, pos, round(score, 6) as score from (select o.l_orderkey as set_id, cast(o.l_linenumber as bigint) as pos, 1E0 - abs(o.l_discount - lag(o.l_discount) over (partition by o.l_orderkey order by o.l_linenumber, o.l_partkey, o.l_suppkey)) * 1E1 as score from lineitem o) u where score < 6E-1",
    "plan_running_time": "select l.l_orderkey as set_id, cast(l.l_linenumber as bigint) as pos, cast(sum(180 + 6 * p.p_size) over (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey rows between unbounded preceding and current row) - (180 + 6 * p.p_size) as bigint) as start_sec from lineitem l join part p on l.l_partkey = p.p_partkey",
    "plan_metrics": "select l.l_orderkey as set_id, count(*) as n_tracks, round(sum(180 + 6 * p.p_size) / 6E1, 4) as minutes, round(avg(9E1 + ((p.p_partkey * 37) % 900) / 1E1), 4) as mean_bpm from lineitem l join part p on l.l_partkey = p.p_partkey group by l.l_orderkey",
    "plans_by_dj": "select dj, plan_id, rnk from (select o_custkey as dj, o_orderkey as plan_id, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rnk from orders) u where rnk <= 10",
    "preferred_keys": "select artist, num, letter, round(5E-1 + 5E-1 * n / max(n) over (partition by artist), 6) as weight from (select artist, num, letter, count(*) as n from {tracks} t group by artist, num, letter) u",
    # store
    "latest_predictions": "select user_id, event_id, value from (select user_id, event_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) u where r = 1",
    "ttl_sweep": "select event_type, count(*) as kept from events where ts >= (select max(ts) from events) - interval '30' day group by event_type",
    "orphans": "select p_partkey as orphan from part p where not exists (select 1 from lineitem l where l.l_partkey = p.p_partkey)",
    "cached_track_paths": "select s.s_suppkey as track, n.n_name as path from supplier s join nation n on s.s_nationkey = n.n_nationkey",
    "folder_status": "select c.c_custkey as file, case when o.n is null then 'missing' else 'cached' end as status, coalesce(o.n, 0) as entries from customer c left join (select o_custkey, count(*) as n from orders group by o_custkey) o on c.c_custkey = o.o_custkey",
    "set_plans_stats": "select o_orderstatus as status, count(*) as plans, count(distinct o_custkey) as djs, round(avg(case when o_totalprice > 1E5 then o_totalprice end), 2) as mean_large from orders group by o_orderstatus",
    "track_metadata_query": "select id, artist, genre, bpm, rating from {tracks} t where bpm between 1.1E2 and 1.3E2 and rating >= 3 and artist in ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#34')",
    "track_metadata_stats": "select count(*) as tracks, count(distinct artist) as artists, count(distinct genre) as genres from {tracks} t",
    "dj_profile_totals": "select o_custkey as dj, count(distinct o_orderkey) as n_sets, round(sum(l_quantity) / 6E1, 4) as hours from orders join lineitem on o_orderkey = l_orderkey group by o_custkey",
    "content_hash": "select doc_id, md5(substr(text, 1, 1048576)) as h from documents",
    "duplicate_hashes": "select h, min(doc_id) as keep, count(*) as copies from (select doc_id, md5(text) as h from documents) u group by h having count(*) > 1",
    "invalidate_by_prefix": "select count(*) as gone from part where p_name like 'a%'",
    # jobs
    "pending_jobs": "select user_id, count(*) as jobs, min(ts) as oldest from {jobs} j where state = 'queued' group by user_id",
    "failed_jobs": "select user_id, job_id from {jobs} j where state = 'failed'",
    "expired_retries": "select job_id, tries from {jobs} j where state = 'queued' and tries >= 4",
    "queue_summary": "select state, count(*) as jobs, round(avg(value), 4) as mean_value, round(max(value), 4) as max_value from {jobs} j group by state",
    "job_status": "select user_id, job_id, state from (select user_id, job_id, state, row_number() over (partition by user_id order by ts desc, job_id desc) as r from {jobs} j) u where r = 1",
    "exactly_once_enqueue": "select md5(event_type) as job_key, min(event_id) as first_event, count(*) as attempts from events group by md5(event_type)",
    # scalar functions
    "format_time": "select l_orderkey, l_linenumber, concat(case when l_extendedprice < 36000 then '0' else '' end, cast(cast(floor(l_extendedprice / 3600) as bigint) as varchar(9)), ':', lpad(cast(cast(floor(l_extendedprice / 60) as bigint) % 60 as varchar(9)), 2, '0'), ':', lpad(cast(cast(floor(l_extendedprice) as bigint) % 60 as varchar(9)), 2, '0')) as hms from lineitem",
    "format_time_range": "select l_orderkey, l_linenumber, l_partkey, concat(concat(lpad(cast(cast(floor(l_quantity / 60) as bigint) as varchar(9)), 2, '0'), ':', lpad(cast(cast(floor(l_quantity) as bigint) % 60 as varchar(9)), 2, '0')), ' - ', concat(lpad(cast(cast(floor((l_quantity + 60) / 60) as bigint) as varchar(9)), 2, '0'), ':', lpad(cast(cast(floor((l_quantity + 60)) as bigint) % 60 as varchar(9)), 2, '0'))) as span from lineitem",
    "format_bpm": "select id, concat(cast(cast(bpm as decimal(10, 1)) as varchar(20)), ' BPM') as shown from {tracks} t",
    "format_percent": "select l_orderkey, l_linenumber, l_partkey, concat(cast(cast(l_discount * 100 as decimal(10, 1)) as varchar(20)), '%') as shown from lineitem",
    "format_confidence": "select l_orderkey, l_linenumber, case when l_discount >= 8E-2 then 'HIGH' when l_discount >= 5E-2 then 'MED' else 'LOW' end as band from lineitem",
    "truncate_for_display": "select doc_id, case when length(text) <= 100 then text else concat(substr(text, 1, 97), '... (', cast(length(text) as varchar(12)), ' chars)') end as shown from documents",
    "url_host": "select page_id, regexp_extract(url, 'https?://([^/?#]+)', 1) as host from pages",
    "urls_in_text": "select doc_id, length(text) - length(replace(text, 'http', 'ttp')) as n_urls from documents where text like '%http%'",
    # keys and timbre over time
    "detect_key": "select track_id, tonic, mode, round(greatest(r, 0E0), 5) as confidence from (select track_id, tonic, mode, r, row_number() over (partition by track_id order by r desc, mode, tonic) as rnk from (select c.track_id, (c.pc - w.i + 12) % 12 as tonic, w.mode, round(corr(c.m, w.x), 9) as r from (select track_id, pc, avg(c) as m from " + _CHROMA + " v group by track_id, pc) c join (select i, x, 'major' as mode from (values " + _MAJOR + ") p(i, x) union all select i, x, 'minor' from (values " + _MINOR + ") q(i, x)) w on true group by c.track_id, (c.pc - w.i + 12) % 12, w.mode) u) z where rnk = 1",
    "chroma_novelty": "select vec_id, round(d / (max(d) over (partition by track_id) + 1E-10), 5) as novelty from (select vec_id, track_id, sqrt(sum(power(coalesce(c - p, 0E0), 2))) as d from (select vec_id, track_id, c, lag(c) over (partition by track_id, pc order by vec_id) as p from " + _CHROMA + " v) u group by vec_id, track_id) w",
    "timbral_novelty": "select vec_id, round(3E-1 * s / greatest(max(s) over (partition by track_id), 1E-300) + 7E-1 * l / greatest(max(l) over (partition by track_id), 1E-300), 5) as novelty from (select vec_id, track_id, sqrt(sum(power(coalesce(v - p, 0E0), 2))) as s, sqrt(sum(case when frame >= 8 then power(near - far, 2) else 0E0 end)) as l from (select vec_id, track_id, v, lag(v) over (partition by track_id, k order by vec_id) as p, row_number() over (partition by track_id, k order by vec_id) - 1 as frame, avg(v) over (partition by track_id, k order by vec_id rows between 4 preceding and 1 preceding) as near, avg(v) over (partition by track_id, k order by vec_id rows between 8 preceding and 5 preceding) as far from {bins} t) u group by vec_id, track_id) w",
    "hz_to_mel": "select vec_id, k, round(case when f < 1E3 then f * 3 / 2E2 else 1.5E1 + ln(f / 1E3) * 27 / ln(6.4E0) end, 6) as mel from {bins} t",
    "stuck_jobs": "select j.job_id, j.user_id from {jobs} j join (select max(ts) as latest from events) m on j.state = 'in_progress' and j.ts < m.latest - interval '30' minute",
    "format_duration": "select l_orderkey, l_linenumber, l_partkey, case when t < 60 then concat(cast(t as varchar(12)), 's') when t < 3600 then concat(cast(cast(floor(t / 60) as bigint) as varchar(12)), 'm', case when t % 60 > 0 then concat(' ', cast(t % 60 as varchar(12)), 's') else '' end) else concat(cast(cast(floor(t / 3600) as bigint) as varchar(12)), 'h', case when floor(t / 60) % 60 > 0 then concat(' ', cast(cast(floor(t / 60) % 60 as bigint) as varchar(12)), 'm') else '' end, case when t % 60 > 0 then concat(' ', cast(t % 60 as varchar(12)), 's') else '' end) end as shown from (select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_partkey, " + _SECONDS + " as t from lineitem) u",
    "truncate_for_metrics": "select doc_id, case when length(text) <= 500 then text else concat(substr(text, 1, 500), '... (truncated from ', cast(length(text) as varchar(12)), ' chars)') end as stored from documents",
    "validate_url": "select page_id, host, host in ('soundcloud.com', 'mixcloud.com', 'youtube.com', 'youtu.be', 'm.youtube.com') or host like '%.soundcloud.com' or host like '%.mixcloud.com' or host like '%.youtube.com' or host like '%.youtu.be' as valid from (select page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www[.]', '') as host from pages) u",
}


#: Oracles whose text differs as a whole.
DUCK = {"best_next_tracks": BEST_DUCK}
#: Spark's text where it differs as a whole.
SPARK = {
    "low_energy_frames": "select track_id, frame_idx, low from {low} l",
    "low_energy_ratio": "select track_id, round(avg(case when low then 1E0 else 0E0 end), 6) as low_ratio from {low} l group by track_id",
    "low_energy_runs": "select track_id, min(frame_idx) as first_frame, max(frame_idx) as last_frame, count(*) as frames from (select track_id, frame_idx, frame_idx - row_number() over (partition by track_id order by frame_idx) as grp from {low} l where low) w group by track_id, grp",
}


def _text(sql: str, bins: str, pairs: str, parts: str = "1") -> str:
    for name, value in (("{pairs}", pairs), ("{low}", LOW_SPARK), ("{frames}", FRAMES), ("{bins}", bins), ("{tracks}", TRACKS), ("{grid}", GRID), ("{jobs}", JOBS), ("{parts}", parts)):
        sql = sql.replace(name, value)
    return sql


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Plan ``sql`` over the tables it names."""
    text = _text(sql, BINS_SPARK, PAIRS_SPARK, spark.conf.get("spark.sql.shuffle.partitions"))
    for name in _TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def transition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of its SQL are counted, not made."""
    return counted(functools.partial(run_sql, spark, sf_dir), {"H": _H, "E": _E, "G": _G, "B": _B, "near": f"{_BPM} <= 9E0", "late": _LATE, "early": _EARLY}, _TOTAL)


#: Queries that plan something else than their oracle's text.
PLANNED = {"transition_quality": transition_quality}

for _name, _sql in QUERIES.items():
    register(_name, PLANNED.get(_name) or functools.partial(lambda spark, sf_dir, sql: run_sql(spark, sf_dir, sql), sql=SPARK.get(_name, _sql)), _text(DUCK.get(_name, _sql), BINS_DUCK, PAIRS_DUCK))
