import wave

import numpy as np
from aulos.operators import separation
from aulos.sources import wav


def save(path, samples, width, channels=1, sr=8000):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels), f.setsampwidth(width), f.setframerate(sr)
        x = np.round(np.asarray(samples) * ((1 << (8 * width - 1)) - 1)).astype(np.int64)
        if width == 1:
            raw = (x + 128).astype(np.uint8).tobytes()
        else:
            raw = b"".join(int(v).to_bytes(width, "little", signed=True) for v in x.ravel())
        f.writeframes(raw)


def test_wav_files_come_back_in_blocks(spark, tmp_path):
    x = np.sin(np.arange(1000) / 9) * 0.9
    for width in (1, 2, 3, 4):
        save(tmp_path / f"w{width}.wav", x, width)
    save(tmp_path / "stereo.wav", np.stack([x, -x], axis=1), 2, channels=2)
    (tmp_path / "bad.wav").write_bytes(b"no sound")
    rows = wav.read_wav(spark, str(tmp_path), block=300).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.track_id, r.block or 0)):
        got.setdefault(r.track_id.rsplit("/", 1)[1], []).append(r)
    assert got["bad.wav"][0].samples is None and len(got["bad.wav"]) == 1
    for width, allowed in ((1, 2e-2), (2, 1e-4), (3, 1e-6), (4, 1e-8)):
        blocks = got[f"w{width}.wav"]
        assert [len(r.samples) for r in blocks] == [300, 300, 300, 100] and blocks[0].sr == 8000
        assert np.abs(np.concatenate([r.samples for r in blocks]) - x).max() < allowed
    assert np.abs(np.concatenate([r.samples for r in got["stereo.wav"]])).max() < 1e-4
    part = wav.read_wav(spark, str(tmp_path / "w2.wav"), offset=0.01, duration=0.05).collect()
    assert len(part) == 1 and np.allclose(part[0].samples, x[80:480], atol=1e-4)
    seconds = {r.track_id.rsplit("/", 1)[1]: r.seconds for r in wav.wav_durations(spark, str(tmp_path)).collect()}
    assert seconds["w2.wav"] == 0.125 and seconds["bad.wav"] is None
    assert wav.estimate_total_minutes(spark, str(tmp_path)).first().n_files == 6


def test_chunks_separate_like_the_whole(spark):
    rng = np.random.default_rng(5)
    mags = np.abs(rng.normal(size=(53, 9)))
    df = spark.createDataFrame([(1, i, m.tolist()) for i, m in enumerate(mags)], "track_id long, frame long, mag array<double>")
    out = separation.hpss(df, kernel=7, chunk=10).orderBy("frame").collect()
    harmonic, percussive = separation.separate(mags, 7, 2.0, 1.0)
    assert [r.frame for r in out] == list(range(53))
    assert np.allclose([r.harmonic for r in out], harmonic) and np.allclose([r.percussive for r in out], percussive)
    ratio = separation.harmonic_ratio(separation.hpss(df, kernel=7, chunk=10)).first().ratio
    assert np.isclose(ratio, np.square(harmonic).sum() / np.square(percussive).sum())


def test_an_edge_that_reaches_into_an_empty_chunk(spark):
    """Twenty-eight frames in chunks of ten: the last three also go to a chunk of which no frame is."""
    mags = np.abs(np.random.default_rng(6).normal(size=(28, 9)))
    df = spark.createDataFrame([(1, i, m.tolist()) for i, m in enumerate(mags)], "track_id long, frame long, mag array<double>")
    out = separation.hpss(df, kernel=7, chunk=10).orderBy("frame").collect()
    assert [r.frame for r in out] == list(range(28))
    assert np.allclose([r.harmonic for r in out], separation.separate(mags, 7, 2.0, 1.0)[0])
