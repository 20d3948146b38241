"""Spectral operators against DuckDB and direct definitions."""

import wave

import duckdb
import numpy as np
import pytest

from aulos.operators import spectrum
from aulos.plans import registry, signal  # noqa: F401
from tests.test_catalog import SF, plain


@pytest.mark.parametrize("name", ["stft_magnitude", "stft_features", "stft_flux", "stft_chroma"])
def test_same_rows_as_duckdb(spark, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    there = [d[0] for d in cursor.description]
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(there)
    columns = sorted(there)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(plain(r[there.index(c)]) for c in columns) for r in cursor.fetchall())
    assert len(ours) == len(theirs) > 0
    assert ours == theirs


def blocks(spark, signals, size):
    rows = [(name, i // size, [float(v) for v in x[i:i + size]]) for name, x in signals.items() for i in range(0, len(x), size)]
    return spark.createDataFrame(rows, "track_id string, block long, samples array<double>")


def whole(x, n_fft, hop):
    """The spectra of a signal that is held whole."""
    padded = np.pad(x, n_fft // 2, mode="reflect")
    return np.array([np.abs(np.fft.rfft(padded[i:i + n_fft] * spectrum.hann(n_fft))) for i in range(0, len(padded) - n_fft + 1, hop)])


def test_blocks_give_the_spectra_of_the_whole_signal(spark):
    rng = np.random.default_rng(3)
    signals = {f"n{n}": rng.normal(size=n) for n in (1, 7, 64, 65, 128, 130, 200, 321)}
    got = {}
    for r in spectrum.stft(blocks(spark, signals, 64), 64, 24).collect():
        got.setdefault(r.track_id, {})[r.frame] = r.mag
    for name, x in signals.items():
        expected = whole(x, 64, 24)
        assert sorted(got[name]) == list(range(len(expected)))
        assert np.allclose([got[name][i] for i in range(len(expected))], expected, atol=1e-9)


def test_a_tone_has_its_frequency_and_pitch_class(spark):
    sr, n_fft = 22050, 2048
    x = np.sin(2 * np.pi * 440 * np.arange(sr) / sr)
    features = spectrum.frame_features(spectrum.stft(blocks(spark, {"a": x}, 4096), n_fft, 512), sr, n_fft).orderBy("frame").collect()
    middle = features[len(features) // 2]
    assert abs(middle.centroid - 440) < 10 and int(np.argmax(middle.chroma)) == 9
    assert len(middle.mel) == 128 and len(middle.tonnetz) == 6 and len(middle.contrast) == 7


def test_mel_scale_round_trips():
    f = np.array([0.0, 10, 999, 1000, 1001, 8000])
    assert np.allclose(spectrum.mel_to_hz(spectrum.hz_to_mel(f)), f)
    basis = spectrum.mel_basis(22050, 2048, 40)
    assert basis.shape == (40, 1025) and (basis >= 0).all() and (basis.sum(axis=1) > 0).all()


def test_mfcc_is_an_orthonormal_cosine_transform(spark):
    mel = [np.exp(np.arange(8) / 3.0).tolist(), [0.0] * 8]
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate(mel)], "track_id long, frame long, mel array<double>")
    rows = {r.frame: np.array(r.mfcc) for r in spectrum.mfcc(df, n_mfcc=8).collect()}
    db = 10 * np.log10(np.maximum(mel, 1e-10))
    db = np.maximum(db, db.max() - 80)
    assert np.allclose([np.linalg.norm(rows[i]) for i in range(2)], np.linalg.norm(db, axis=1))
    assert np.allclose(rows[1][1:], 0, atol=1e-9)


def test_tempo_of_regular_clicks():
    rate = 40.0
    clicks = np.zeros(1200)
    clicks[::20] = 1.0
    bpm, confidence = spectrum.tempo_of(clicks, rate, std_bpm=30.0)
    assert bpm == 120.0 and confidence > 0.9
    assert spectrum.tempo_of(np.zeros(3), rate) == (120.0, 0.0)
