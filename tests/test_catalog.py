"""Every catalogue query against DuckDB on the smallest tables."""

import functools
import operator
import os

import duckdb
import pytest

from aulos.plans import catalog, registry

SF = "/root/testdata/sf0.001"
NAMES = list(catalog.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or hasattr(v, "is_finite"):
        return f"{float(v):.8g}"
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(registry.oracle_sql()[name])
    there = [d[0] for d in cursor.description]
    assert sorted(there) == columns
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(plain(r[there.index(c)]) for c in columns) for r in cursor.fetchall())
    assert ours == theirs


def test_registering_twice_fails():
    with pytest.raises(ValueError):
        registry.register(NAMES[0], lambda spark, sf_dir: None)


@pytest.mark.parametrize("brands", [1, 2, 7])
def test_best_successors_in_a_library_of_alike_tracks(spark, tmp_path, brands):
    """Few keys, tempos and artists: most scores tie, and the first ids of a key may all be by one artist."""
    rows = [(i, 5 if i % 3 else 17, f"Brand#{0 if i < 60 else i % brands}", 900.0 + i % 7) for i in range(1, 420)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = sorted(tuple(r) for r in registry.queries()["best_next_tracks"](spark, str(tmp_path)).collect())
    assert len(got) == 419 * 5
    assert got == sorted(con.execute(registry.oracle_sql()["best_next_tracks"]).fetchall())


def test_pairs_meet_at_half_and_double_tempo_and_across_whole_bpm(spark):
    bpm = {r.id: r.bpm for r in catalog.run_sql(spark, SF, "select id, bpm from {tracks} t").collect()}
    got = {(r.a, r.b) for r in registry.queries()["score_bpm"](spark, SF).collect()}
    apart = lambda x, y: min(abs(x - y) / min(x, y), abs(x - 2 * y) / x, abs(2 * x - y) / (2 * x)) * 100
    assert got == {(a, b) for a in bpm for b in bpm if a != b and apart(bpm[a], bpm[b]) <= 9}
    assert any(bpm[a] > 1.8 * bpm[b] for a, b in got)


@pytest.mark.parametrize("name", ["low_energy_ratio", "low_energy_frames", "low_energy_runs"])
def test_low_frames_take_the_mean_in_frame_order(spark, tmp_path, name):
    """Frames at the mean: added in the order of the file, the doubles of half of these tracks give another answer."""
    values = [[0.1, 0.2, 0.3], [0.3, 0.2, 0.1], [1.1, 2.2, 3.3], [3.3, 2.2, 1.1], [0.1] * 6, [0.7, 0.7, 0.7]]
    rows = [(100 * u + i, i, u, v) for u, x in enumerate(values) for i, v in enumerate(x)]
    spark.createDataFrame(rows[::-1], "event_id long, ts long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    low = {(u, i): v < functools.reduce(operator.add, values[u]) / len(values[u]) for _, i, u, v in rows}
    got = registry.queries()[name](spark, str(tmp_path)).collect()
    if name == "low_energy_ratio":
        assert {r.track_id: r.low_ratio for r in got} == {u: round(sum(low[u, i] for i in range(len(x))) / len(x), 6) for u, x in enumerate(values)}
    elif name == "low_energy_frames":
        assert {(r.track_id, r.frame_idx): r.low for r in got} == low
    else:
        assert {(r.track_id, i) for r in got for i in range(r.first_frame, r.last_frame + 1)} == {k for k, v in low.items() if v}
