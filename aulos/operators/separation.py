"""Harmonic and percussive parts of spectra by median filters over time and over frequency."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulos.operators.spectrum import EPS

CHUNK = 256


def median_filter(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Running median of odd ``size`` along ``axis``; ends are mirrored with the edge value repeated."""
    half = size // 2
    padded = np.pad(x, [(half, half) if a == axis else (0, 0) for a in range(x.ndim)], mode="symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, size, axis=axis), axis=-1)


def separate(mags: np.ndarray, kernel: int, power: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(harmonic, percussive) magnitudes of (frames, bins)."""
    steady, sudden = median_filter(mags, kernel, 0) ** power, median_filter(mags, kernel, 1) ** power
    return tuple(np.minimum(1.0, part / (steady + sudden + EPS) * margin) * mags for part in (steady, sudden))


def hpss(frames: DataFrame, kernel: int = 31, power: float = 2.0, margin: float = 1.0, chunk: int = CHUNK) -> DataFrame:
    """track_id, frame, harmonic, percussive (arrays like ``mag``).

    A frame goes to its chunk and, near an edge, to the neighbour's, so a group is ``chunk`` frames
    and two half kernels however long the recording is.
    """
    half, track = kernel // 2, frames.schema["track_id"].dataType.simpleString()
    own = F.floor(F.col("frame") / chunk)
    spots = F.array_distinct(F.array(own, F.floor(F.greatest(F.col("frame") - half, F.lit(0)) / chunk), F.floor((F.col("frame") + half) / chunk)))
    if half > chunk:
        raise ValueError("a chunk must hold half a kernel")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame", ignore_index=True)
        harmonic, percussive = separate(np.stack(rows["mag"].to_list()), kernel, power, margin)
        mine = (rows["frame"] // chunk == rows["chunk"]).to_numpy()
        # a chunk past the last frame holds only its neighbour's, and a column of no lists needs its type named
        part = lambda x: pd.Series(list(x[mine]), rows.index[mine], object)
        return pd.DataFrame({"track_id": rows["track_id"][mine], "frame": rows["frame"][mine], "harmonic": part(harmonic), "percussive": part(percussive)})

    spread = frames.select("track_id", "frame", "mag", F.explode(spots).alias("chunk"))
    return spread.groupBy("track_id", "chunk").applyInPandas(run, f"track_id {track}, frame long, harmonic array<double>, percussive array<double>")


def harmonic_ratio(separated: DataFrame) -> DataFrame:
    """track_id, ratio of harmonic to percussive energy."""
    energy = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return separated.groupBy("track_id").agg((energy("harmonic") / (energy("percussive") + EPS)).alias("ratio"))
