"""Curve operators against their SQL definitions, direct versions and short cases."""

import os

import duckdb
import numpy as np
import pytest

from aulos.functions import curves as cv
from aulos.plans import curves, registry, tasks
from tests.test_catalog import plain

SF = "/root/testdata/sf0.001"
NAMES = [n for n in registry.queries() if registry.queries()[n].__module__ in (curves.__name__, tasks.__name__)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_the_definition(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in registry.oracle_sql():
        few = ("drop_candidates", "beat_grid_phrases", "mix_events", "transition_pairs", "buildup_zones", "aligned_drops")
        assert rows or name in few  # events that the smallest tables may not have
        return
    cursor = duck.execute(registry.oracle_sql()[name])
    there = [d[0] for d in cursor.description]
    assert sorted(there) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[there.index(c)]) for c in columns) for r in cursor.fetchall())


def test_savgol_is_a_sliding_polynomial_fit():
    x = np.random.default_rng(1).normal(size=40)
    got = cv.savgol(x, 11, 3)
    for i in range(40):
        mid = min(max(i, 5), 34)
        t = np.arange(mid - 5, mid + 6)
        assert np.isclose(got[i], np.polyval(np.polyfit(t, x[t], 3), i))
    assert (cv.savgol(x[:4], 11, 3) == x[:4]).all()


def test_taller_peaks_keep_others_at_bay():
    x = np.zeros(50)
    x[[10, 12, 30, 33]] = [5, 6, 9, 4]
    assert cv.peaks(x, 1.0, 5).tolist() == [12, 30]
    assert cv.peaks(x, 1.0, 1, 4.5).tolist() == [10, 12, 30]
    flat = np.array([0, 1, 1, 1, 0, 2, 0.0])
    assert cv.peaks(flat, 0.5, 1).tolist() == [2, 5]
    assert cv.valleys(-flat, -0.5, 1).tolist() == [2, 5]


def test_tempo_of_a_click_track():
    rate = 43.066
    x = np.zeros(1300)
    x[np.round(np.arange(0, 1300, 60 * rate / 128)).astype(int)[:-1]] = 1.0
    bpm, sure = cv.tempo(x, rate, 128, 30)
    assert abs(bpm - 128) < 4 and sure > 0
    grid = cv.beat_grid(x, rate)
    assert len(grid["phrases"]) == len(grid["bars"]) // 4 and (np.diff(grid["times"]) > 0).all()
    local, _ = cv.local_tempo(x, rate)
    assert np.abs(local - 128).max() < 6
    assert len(cv.tempo_segments(local, np.ones(1300), rate)) == 1


def test_autocorrelation_is_direct_sum():
    x = np.random.default_rng(2).normal(size=70)
    assert np.allclose(cv.autocorrelation(x, 20), [x[: 70 - k] @ x[k:] / 70 for k in range(20)])


def test_checkerboard_by_direct_kernel():
    rows = np.random.default_rng(3).normal(size=(60, 5))
    rows[30:] += 2
    got = cv.ssm_novelty(rows, 10.0, 1.2, 1)
    u = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    half = 6
    t = np.arange(-half, half)
    g = np.exp(-(t**2) / (2 * (half / 2) ** 2))
    sign = np.outer(np.where(t < 0, 1, -1), np.where(t < 0, 1, -1))
    want = np.zeros(60)
    for i in range(half, 55):
        patch = u[i - half : i + half] @ u[i - half : i + half].T
        want[i] = abs((patch * sign * np.outer(g, g)).sum())
    assert np.allclose(got, want / want.max(), atol=1e-8) and abs(int(got.argmax()) - 30) <= 2


def test_drop_needs_a_lasting_rise():
    x = np.full(400, 0.5)
    x[180:200] = 0.1
    x[200:260] = np.linspace(30, 12, 60)
    found = cv.drops(x, 10.0)
    assert found and all(190 <= d["frame_idx"] <= 212 for d in found)
    assert cv.drops(np.full(100, 0.5), 10.0) == [] and cv.drop_intensity([]) == 0.0


def test_short_and_empty_curves():
    for x in (np.zeros(0), np.ones(1), np.ones(3)):
        for f in (cv.box, cv.gaussian, cv.savgol, cv.delta, cv.buildup):
            assert len(f(x)) == len(x)
        assert len(cv.peaks(x)) == 0 and cv.drops(x, 10.0) == [] and len(cv.transitions(x)[0]) == 0
        assert cv.tempo(x, 10.0) == (120.0, 0.0)
        assert len(cv.local_tempo(x, 10.0)[0]) == len(x)
    assert cv.fill_gaps(np.array([np.nan, np.nan])).tolist() == [0, 0]
    assert cv.fill_gaps(np.array([np.nan, 1, np.nan, 3, np.nan])).tolist() == [1, 1, 2, 3, 3]


def test_calibration_shifts_events_onto_phrases():
    grid = {"tempo": 120.0, "phrases": np.array([[0.0, 8.0], [8.0, 16.0], [16.0, 24.0]])}
    fix = cv.calibrate(np.array([0.4, 8.4, 16.4]), grid, 0.5)
    assert fix["shift"] == pytest.approx(-0.4) and (fix["before"], fix["after"]) == (0.0, 1.0)
    assert cv.calibrate(np.array([1.0]), grid)["confidence"] == 0.0


@pytest.mark.parametrize("name", ["detect_peaks", "detect_valleys"])
def test_peaks_of_long_tracks_with_plateaus_and_gaps_follow_their_sql(spark, tmp_path, name):
    x = np.round(np.random.default_rng(4).normal(50, 9, 700)).tolist()
    x[300] = None
    rows = [(i, i, 1, "view", v) for i, v in enumerate(x)] + [(1000 + i, i, 2, "view", v) for i, v in enumerate([1.0, 5.0, 5.0, 1.0, 4.0, 1.0])]
    spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect())
    assert len(got) > 50 and got == sorted(con.execute(registry.oracle_sql()[name]).fetchall())
