"""Short-time spectra of recordings stored as blocks of samples, and features of their frames.

A recording is rows (track_id, block, samples array<double>): consecutive blocks of one size, of at
least ``n_fft`` samples, the last one shorter. Each block gets the edges of its neighbours by one
aggregation on (track_id, block), so a recording of any length spreads over the cluster and only the
edges are shipped twice. Frames are centred and the signal is mirrored at both ends of the recording.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-10
#: Frames transformed at a time, which bounds a task's memory.
FRAMES_AT_ONCE = 512


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def mirrored(index: np.ndarray, n: int) -> np.ndarray:
    """Positions of a signal of ``n`` samples mirrored at its ends, the edge sample not repeated."""
    period = max(2 * (n - 1), 1)
    folded = np.abs(index) % period
    return np.minimum(folded, period - folded)


def with_edges(audio: DataFrame, n_fft: int) -> DataFrame:
    """Each block with the samples before and after it that its frames read, its first position and the recording's length."""
    edge = n_fft // 2 + 1
    size = F.size("samples")
    parts = F.array(
        F.struct(F.col("block").alias("to"), F.lit("own").alias("side"), F.col("samples").alias("part")),
        F.struct((F.col("block") + 1).alias("to"), F.lit("before").alias("side"), F.slice("samples", F.greatest(size - edge + 1, F.lit(1)), edge).alias("part")),
        F.struct((F.col("block") - 1).alias("to"), F.lit("after").alias("side"), F.slice("samples", 1, edge).alias("part")))
    parted = audio.filter(size > 0).select("track_id", F.explode(parts).alias("p")).select("track_id", F.col("p.to").alias("block"), "p.side", "p.part")
    sides = [F.max(F.when(F.col("side") == s, F.col("part"))).alias(s) for s in ("before", "own", "after")]
    joined = parted.groupBy("track_id", "block").agg(*sides).filter("own is not null")
    lengths = audio.groupBy("track_id").agg(F.sum(size).cast("long").alias("total"), F.max(F.when(F.col("block") == 0, size)).cast("long").alias("block_size"))
    return joined.join(lengths, "track_id").withColumn("base", F.col("block") * F.col("block_size"))


def _block_spectra(before, own, after, base: int, total: int, n_fft: int, hop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    empty = np.empty(0)
    before = empty if before is None else np.asarray(before, float)
    buffer = np.concatenate([before, np.asarray(own, float), empty if after is None else np.asarray(after, float)])
    end = total // hop + 1 if after is None else -(-(base + len(own)) // hop)
    window, offsets = hann(n_fft), np.arange(n_fft) - n_fft // 2
    for first in range(-(-base // hop), end, FRAMES_AT_ONCE):
        frames = np.arange(first, min(first + FRAMES_AT_ONCE, end))
        index = mirrored(frames[:, None] * hop + offsets, total) - (base - len(before))
        yield frames, np.abs(np.fft.rfft(buffer[index] * window, axis=1))


def stft(audio: DataFrame, n_fft: int = 2048, hop: int = 512) -> DataFrame:
    """track_id, frame, mag array<double>: magnitudes of ``n_fft // 2 + 1`` bins; empty recordings have no frames."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                for frames, mags in _block_spectra(row.before, row.own, row.after, int(row.base), int(row.total), n_fft, hop):
                    yield pd.DataFrame({"track_id": [row.track_id] * len(frames), "frame": frames, "mag": list(mags)})

    track = audio.schema["track_id"].dataType.simpleString()
    return with_edges(audio, n_fft).mapInPandas(run, f"track_id {track}, frame long, mag array<double>")


def hz_to_mel(f):
    """Mel scale that is linear below 1000 Hz and logarithmic above."""
    f = np.asarray(f, float)
    return np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) * 27 / np.log(6.4))


def mel_to_hz(m):
    m = np.asarray(m, float)
    return np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))


def mel_basis(sr: float, n_fft: int, n_mels: int, fmin: float = 0.0, fmax: float | None = None) -> np.ndarray:
    """(n_mels, bins) triangles of unit area."""
    freqs = np.arange(n_fft // 2 + 1) * sr / n_fft
    knots = mel_to_hz(np.linspace(hz_to_mel(fmin), hz_to_mel(fmax or sr / 2), n_mels + 2))
    return np.stack([np.interp(freqs, knots[i:i + 3], [0, 1, 0], left=0, right=0) * 2 / (knots[i + 2] - knots[i]) for i in range(n_mels)])


def pitch_classes(sr: float, n_fft: int) -> np.ndarray:
    """Pitch class of each bin; -1 for the constant part."""
    freqs = np.arange(1, n_fft // 2 + 1) * sr / n_fft
    return np.concatenate([[-1], np.round((12 * np.log2(freqs / 440) + 69) % 12).astype(int) % 12])


def chroma(mags: np.ndarray, sr: float, n_fft: int) -> np.ndarray:
    sums = np.square(mags) @ (pitch_classes(sr, n_fft)[:, None] == np.arange(12))
    return sums / (np.linalg.norm(sums, axis=1, keepdims=True) + EPS)


def tonnetz(chroma_rows: np.ndarray) -> np.ndarray:
    """Sines and cosines of fifths, minor and major thirds."""
    angles = 2 * np.pi * np.arange(12)[:, None] * np.array([7, 3, 4]) / 12
    return chroma_rows @ np.stack([np.sin(angles), np.cos(angles)], axis=2).reshape(12, 6)


def contrast(mags: np.ndarray, sr: float, n_fft: int, bands: int = 6, fmin: float = 200.0) -> np.ndarray:
    """log10 of the mean of the top quarter of an octave's power over that of its bottom quarter."""
    freqs, power = np.arange(n_fft // 2 + 1) * sr / n_fft, np.square(mags) + EPS
    edges = np.searchsorted(freqs, np.minimum(fmin * 2.0 ** np.arange(bands + 2), sr / 2))
    out = np.zeros((len(mags), bands + 1))
    for band, (low, high) in enumerate(zip(edges, edges[1:])):
        if high > low:
            ranked, quarter = np.sort(power[:, low:high], axis=1), max(1, (high - low) // 4)
            out[:, band] = np.log10(ranked[:, -quarter:].mean(axis=1) / (ranked[:, :quarter].mean(axis=1) + EPS))
    return out


def _features(mags: np.ndarray, sr: float, n_fft: int, n_mels: int) -> dict[str, list]:
    freqs, power = np.arange(n_fft // 2 + 1) * sr / n_fft, np.square(mags)
    total = power.sum(axis=1)
    centroid = power @ freqs / (total + EPS)
    running = np.cumsum(power, axis=1)
    rows = chroma(mags, sr, n_fft)
    return {
        "rms": np.sqrt(power.mean(axis=1)), "centroid": centroid, "rolloff": freqs[np.argmax(running >= 0.85 * running[:, -1:], axis=1)],
        "flatness": np.exp(np.log(power + EPS).mean(axis=1)) / (power.mean(axis=1) + EPS),
        "bandwidth": np.sqrt((power * np.square(freqs - centroid[:, None])).sum(axis=1) / (total + EPS)),
        "chroma": list(rows), "tonnetz": list(tonnetz(rows)), "contrast": list(contrast(mags, sr, n_fft)), "mel": list(power @ mel_basis(sr, n_fft, n_mels).T)}


def frame_features(frames: DataFrame, sr: float = 22050, n_fft: int = 2048, n_mels: int = 128) -> DataFrame:
    """One row of features for each frame of :func:`stft`; every frame stands alone, so nothing is shuffled."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"track_id": batch["track_id"], "frame": batch["frame"]} | _features(np.stack(batch["mag"].to_list()), sr, n_fft, n_mels))

    track = frames.schema["track_id"].dataType.simpleString()
    many = ", ".join(f"{c} array<double>" for c in ("chroma", "tonnetz", "contrast", "mel"))
    return frames.mapInPandas(run, f"track_id {track}, frame long, rms double, centroid double, rolloff double, flatness double, bandwidth double, {many}")


def mfcc(features: DataFrame, n_mfcc: int = 13, top_db: float = 80.0) -> DataFrame:
    """track_id, frame, mfcc: orthonormal cosine transform of the mel powers in dB, floored ``top_db`` below the track's loudest."""
    db = F.transform("mel", lambda m: 10 * F.log10(F.greatest(m, F.lit(EPS))))
    loud = features.groupBy("track_id").agg((F.max(F.array_max(db)) - top_db).alias("floor"))
    levels = features.select("track_id", "frame", db.alias("db")).join(loud, "track_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.maximum(np.stack(batch["db"].to_list()), batch["floor"].to_numpy()[:, None])
                n = x.shape[1]
                basis = np.cos(np.pi * np.outer(np.arange(n) + 0.5, np.arange(n_mfcc)) / n) * np.sqrt(2 / n)
                basis[:, 0] /= np.sqrt(2)
                yield pd.DataFrame({"track_id": batch["track_id"], "frame": batch["frame"], "mfcc": list(x @ basis)})

    track = features.schema["track_id"].dataType.simpleString()
    return levels.mapInPandas(run, f"track_id {track}, frame long, mfcc array<double>")


def tempo_of(onset: np.ndarray, frame_rate: float, start_bpm: float = 120.0, std_bpm: float = 1.0, ac_size: float = 8.0, max_tempo: float = 200.0, prior_weight: float = 1.0) -> tuple[float, float]:
    """Tempo and confidence: the autocorrelation under a Gaussian prior; too short a curve gives (start_bpm, 0)."""
    n = len(onset)
    kept = min(n, int(ac_size * frame_rate))
    low, high = int(60 * frame_rate / max_tempo), min(kept - 1, int(60 * frame_rate / 30))
    if high <= low:
        return start_bpm, 0.0
    size = 1 << (2 * n - 1).bit_length()
    correlated = np.fft.irfft(np.square(np.abs(np.fft.rfft(onset, size))), size)[:kept] / n
    bpm = 60 * frame_rate / np.arange(max(low, 1), high)
    weighted = correlated[max(low, 1):high] * np.exp(-0.5 * np.square((bpm - start_bpm) / std_bpm)) ** prior_weight
    best = int(np.argmax(weighted))
    return float(bpm[best]), float(min(2 * weighted[best] / weighted.sum(), 1.0)) if weighted[best] > 0 else 0.0


def tempo(curve: DataFrame, frame_rate: float, **parameters) -> DataFrame:
    """track_id, bpm, confidence from (track_id, frame, onset); one track's curve is one task's input, a double a frame."""
    track = curve.schema["track_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bpm, confidence = tempo_of(rows.sort_values("frame")["onset"].fillna(0).to_numpy(float), frame_rate, **parameters)
        return pd.DataFrame({"track_id": rows["track_id"].iloc[:1], "bpm": [bpm], "confidence": [confidence]})

    return curve.select("track_id", "frame", "onset").groupBy("track_id").applyInPandas(run, f"track_id {track}, bpm double, confidence double")
