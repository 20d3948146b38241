"""PCM WAV files as recordings in blocks of samples (the form ``operators.spectrum`` reads)."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _samples(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Mono samples in -1 to 1: the mean of the channels."""
    if width == 1:  # unsigned
        x = np.frombuffer(raw, np.uint8).astype(float) - 128
    elif width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8).astype(float)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(float)
    return x.reshape(-1, channels).mean(axis=1) / (1 << (8 * width - 1))


def files(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """path, length, content of the files below ``path``; a scan without content reads only names and sizes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def read_wav(spark: SparkSession, path: str, block: int = BLOCK, offset: float = 0.0, duration: float | None = None) -> DataFrame:
    """track_id (the path), block, sr, samples; ``offset`` and ``duration`` in seconds limit what is decoded.

    A file is decoded block by block. Files that aren't PCM WAV give one row with null block, sr and samples.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    audio = wave.open(io.BytesIO(content))
                except (wave.Error, EOFError):
                    yield pd.DataFrame({"track_id": [name], "block": [None], "sr": [None], "samples": [None]})
                    continue
                sr, total = audio.getframerate(), audio.getnframes()
                first = min(int(offset * sr), total)
                left = total - first if duration is None else min(int(duration * sr), total - first)
                audio.setpos(first)
                for i, at in enumerate(range(0, left, block)):
                    samples = _samples(audio.readframes(min(block, left - at)), audio.getsampwidth(), audio.getnchannels())
                    yield pd.DataFrame({"track_id": [name], "block": [i], "sr": [sr], "samples": [samples]})

    return files(spark, path).select("path", "content").mapInPandas(run, "track_id string, block long, sr int, samples array<double>")


def wav_durations(spark: SparkSession, path: str) -> DataFrame:
    """track_id, seconds from the headers; null for files that aren't PCM WAV."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seconds = []
            for content in batch["content"]:
                try:
                    with wave.open(io.BytesIO(content)) as audio:
                        seconds.append(audio.getnframes() / audio.getframerate())
                except (wave.Error, EOFError):
                    seconds.append(None)
            yield pd.DataFrame({"track_id": batch["path"], "seconds": pd.Series(seconds, dtype=float)}).astype({"seconds": object}).where(lambda d: d.notna(), None)

    return files(spark, path).select("path", "content").mapInPandas(run, "track_id string, seconds double")


def estimate_total_minutes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """n_files and minutes, a minute for each MB of compressed audio; reads no content."""
    return files(spark, path, pattern).agg(F.count(F.lit(1)).alias("n_files"), (F.coalesce(F.sum("length"), F.lit(0)) / (1 << 20)).alias("minutes"))
