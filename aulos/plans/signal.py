"""Queries over short-time spectra; the vectors of ``embeddings`` are the blocks of one recording a label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from aulos.operators import separation, spectrum
from aulos.plans.registry import register
from aulos.tables import table

N_FFT, HOP, SR, N_MELS = 64, 16, 10000, 16


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("label").orderBy("vec_id")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("samples"))
    return vectors.select(F.col("label").cast("long").alias("track_id"), (F.row_number().over(order) - 1).cast("long").alias("block"), "samples")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.stft(recordings(spark, sf_dir), N_FFT, HOP)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.frame_features(_frames(spark, sf_dir), SR, N_FFT, N_MELS)


def stft_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("track_id", "frame", F.posexplode("mag").alias("bin", "m")).select("track_id", "frame", F.col("bin").cast("long").alias("bin"), F.round("m", 4).alias("mag"))


def stft_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("track_id", "frame", F.round("rms", 5).alias("rms"), F.round("centroid", 3).alias("centroid"), "rolloff", F.round("bandwidth", 3).alias("bandwidth"), F.round("flatness", 5).alias("flatness"))


def stft_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("mag").over(Window.partitionBy("track_id").orderBy("frame"))
    change = F.aggregate(F.zip_with("mag", F.coalesce("was", F.transform("mag", lambda x: F.lit(0.0))), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return _frames(spark, sf_dir).withColumn("was", before).select("track_id", "frame", F.round(F.sqrt(change), 4).alias("flux"))


def stft_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("track_id", "frame", F.posexplode("chroma").alias("p", "c")).select("track_id", "frame", F.col("p").cast("long").alias("pitch_class"), F.round("c", 5).alias("chroma"))


def _vector(name: str):
    return lambda spark, sf_dir: _features(spark, sf_dir).select("track_id", "frame", F.transform(name, lambda x: F.round(x, 5)).alias(name))


def stft_mfcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.mfcc(_features(spark, sf_dir)).select("track_id", "frame", F.transform("mfcc", lambda x: F.round(x, 4)).alias("mfcc"))


def estimate_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = _features(spark, sf_dir).select("track_id", "frame", F.col("rms").alias("onset"))
    found = spectrum.tempo(curve, 16.0, std_bpm=40.0)
    return found.select("track_id", F.round("bpm", 4).alias("bpm"), F.round("confidence", 5).alias("confidence"))


def hpss_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separation.harmonic_ratio(separation.hpss(_frames(spark, sf_dir))).select("track_id", F.round("ratio", 5).alias("ratio"))


_SPECTRA = """with x as (select cast(label as bigint) as track_id, (row_number() over (partition by label order by vec_id) - 1) * 64 as base, embedding from embeddings),
s as (select track_id, base + i - 1 as pos, cast(embedding[i] as double) as v from x, (select unnest(range(1, 65)) as i) r),
n as (select track_id, count(*) as total from s group by track_id),
t as (select track_id, total, unnest(range(0, total // 16 + 1)) as frame from n),
j as (select track_id, frame, o, abs(frame * 16 - 32 + o) as i, total from t, (select unnest(range(0, 64)) as o) r),
w as (select j.track_id, frame, o, v * (0.5E0 - 0.5E0 * cos(2 * pi() * o / 64)) as y from j join s on s.track_id = j.track_id and s.pos = case when i >= total then 2 * (total - 1) - i else i end),
m as (select track_id, frame, k as bin, k * 1.5625E2 as f, sqrt(power(sum(y * cos(2 * pi() * ((k * o) % 64) / 64)), 2) + power(sum(y * sin(2 * pi() * ((k * o) % 64) / 64)), 2)) as mag
  from w, (select unnest(range(0, 33)) as k) b group by track_id, frame, k)
"""
_FEATURES = """, c as (select track_id, frame, sum(f * mag * mag) / (sum(mag * mag) + 1E-10) as centroid, sum(mag * mag) as total from m group by track_id, frame),
r as (select track_id, frame, bin, f, sum(mag * mag) over (partition by track_id, frame order by bin) as run from m)
select m.track_id, m.frame, round(sqrt(avg(mag * mag)), 5) as rms, round(min(centroid), 3) as centroid, min(case when run >= 0.85E0 * total then m.f end) as rolloff,
round(sqrt(sum(mag * mag * power(m.f - centroid, 2)) / (min(total) + 1E-10)), 3) as bandwidth, round(exp(avg(ln(mag * mag + 1E-10))) / (avg(mag * mag) + 1E-10), 5) as flatness
from m join c on c.track_id = m.track_id and c.frame = m.frame join r on r.track_id = m.track_id and r.frame = m.frame and r.bin = m.bin group by m.track_id, m.frame"""
_FLUX = """select track_id, frame, round(sqrt(sum(power(mag - p, 2))), 4) as flux from (select track_id, frame, mag, coalesce(lag(mag) over (partition by track_id, bin order by frame), 0E0) as p from m) u group by track_id, frame"""
_CHROMA = """, p as (select track_id, frame, cast(round_even((12 * log2(f / 4.4E2) + 69) % 12, 0) as bigint) % 12 as pitch_class, sum(mag * mag) as e from m where bin > 0 group by all),
g as (select track_id, frame, pitch_class from (select distinct track_id, frame from m) a, (select unnest(range(0, 12)) as pitch_class) b)
select g.track_id, g.frame, g.pitch_class, round(coalesce(e, 0E0) / (sqrt(sum(e * e) over (partition by g.track_id, g.frame)) + 1E-10), 5) as chroma
from g left join p on p.track_id = g.track_id and p.frame = g.frame and p.pitch_class = g.pitch_class"""

register("stft_magnitude", stft_magnitude, _SPECTRA + "select track_id, frame, bin, round(mag, 4) as mag from m")
register("stft_features", stft_features, _SPECTRA + _FEATURES)
register("stft_flux", stft_flux, _SPECTRA + _FLUX)
register("stft_chroma", stft_chroma, _SPECTRA + _CHROMA)
register("stft_tonnetz", _vector("tonnetz"))
register("stft_contrast", _vector("contrast"))
register("stft_mel", _vector("mel"))
register("stft_mfcc", stft_mfcc)
register("estimate_tempo", estimate_tempo)
register("hpss_ratio", hpss_ratio)
