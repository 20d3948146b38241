"""The matrix of likenesses, block against block."""

import tracemalloc

import duckdb
import numpy as np
import pytest

from aulos.functions import curves as cv
from aulos.plans import curves, registry


@pytest.mark.parametrize("block", [5, 64])
def test_recurrence_in_blocks_lists_what_its_sql_says(spark, tmp_path, monkeypatch, block):
    """tracks of several blocks, of an odd and an even number of pairs, too short for any, and with likenesses that round to 0."""
    monkeypatch.setattr(curves, "BLOCK", block)
    rng = np.random.default_rng(3)
    # the last track's median is about 1e-8, so the far pairs' likeness is 0; they are rows all the same
    still = [[1.0, 0.0, 0.0]] * 40 + [[0.0, 1.0, 0.0]]
    made = {1: rng.normal(size=(70, 3)).tolist(), 2: rng.normal(size=(7, 3)).tolist(), 3: rng.normal(size=(4, 3)).tolist(), 4: still, 5: rng.normal(size=(129, 3)).tolist()}
    rows = [(1000 * label + k, v, label) for label, vs in made.items() for k, v in enumerate(vs)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in registry.queries()["recurrence_matrix"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(registry.oracle_sql()["recurrence_matrix"]).fetchall())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=2e-5)


@pytest.mark.parametrize("block", [5, 64])
def test_affinity_in_blocks_is_that_of_whole_tracks(spark, tmp_path, monkeypatch, block):
    """tracks of several blocks, with copies, too short for likenesses or for a median along the diagonals; no task gets a whole track."""
    monkeypatch.setattr(curves, "BLOCK", block)
    rng = np.random.default_rng(4)
    made = {n: rng.normal(size=(n, 4)).astype(np.float32) for n in (1, 2, 3, 4, 5, 6, 7, 8, 11, 16, 70, 131)}
    made[40] = np.repeat(rng.normal(size=(4, 4)).astype(np.float32), 10, axis=0)
    made[41] = np.array([[1, 0, 0, 0]] * 40 + [[0, 1, 0, 0]], np.float32)
    rows = [(1000 * label + k, v, label) for label, vs in made.items() for k, v in enumerate(vs.tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = registry.queries()["structure_affinity"](spark, str(tmp_path))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    got = sorted(tuple(r) for r in found.collect())
    want = []
    for label, vs in sorted(made.items()):
        r = np.triu(curves._affinity(vs.astype(float)), 1)
        want += [(label, int(i), int(j), round(float(r[i, j]), 5)) for i, j in np.argwhere(r)]
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1.01e-5)


@pytest.mark.parametrize("block,held", [(5, 0), (16, 3000), (64, 1 << 20)])
def test_embedding_in_blocks_is_that_of_the_whole_matrix(block, held):
    """blocks that are kept, in part or not at all, give the eigenvectors of the dense matrix."""
    rng = np.random.default_rng(7)
    for n in (12, 31, 90, 150):
        rows = rng.normal(size=(n, 4)) + np.repeat(rng.normal(size=(5, 4)), -(-n // 5), axis=0)[:n]
        d = cv.cosine_distance(rows)
        middle = float(np.median(d[np.triu_indices(n, 4)]))
        got = np.abs(curves.embed_in_blocks(rows, middle, 3, block, held))
        assert np.allclose(got, np.abs(cv.laplacian_embedding(curves._affinity(rows), 3)), atol=1e-6)


def test_leading_vectors_finds_repeated_values():
    q = np.linalg.qr(np.random.default_rng(8).normal(size=(60, 60)))[0]
    m = (q * np.array([5.0, 5.0, 5.0, 2.0] + [1.0] * 30 + [-3.0] * 26)) @ q.T
    v = cv.leading_vectors(lambda x: m @ x, 60, 3)
    assert np.allclose(v @ v.T, np.eye(3), atol=1e-8) and np.allclose(m @ v.T, 5 * v.T, atol=1e-8)


def test_embedding_of_a_long_track_needs_no_whole_matrix(spark, tmp_path):
    """a track longer than ``DENSE`` comes out as before, in less memory than its matrix takes."""
    rng = np.random.default_rng(9)
    made = {1: rng.normal(size=(1100, 8)).astype(np.float32), 2: rng.normal(size=(40, 8)).astype(np.float32)}
    rows = [(10000 * label + k, v, label) for label, vs in made.items() for k, v in enumerate(vs.tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in registry.queries()["laplacian_embedding"](spark, str(tmp_path)).collect())
    want = []
    for label, vs in sorted(made.items()):
        x = np.abs(cv.laplacian_embedding(curves._affinity(vs.astype(float)), 3))
        want += [(label, k, *np.round(x[k], 4)) for k in range(len(x))]
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], atol=1.01e-4)
    some = made[1][:700].astype(float)
    tracemalloc.start()
    curves.embed_in_blocks(some, 1.0, block=64, held=0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * len(some) ** 2


def test_leading_vectors_takes_few_products():
    """each product may make all blocks of a track again, so columns go through it together."""
    m = np.random.default_rng(10).normal(size=(400, 400))
    m, calls = m + m.T, []
    v = cv.leading_vectors(lambda x: calls.append(1) or m @ x, 400, 3)
    values, vectors = np.linalg.eigh(m)
    assert np.allclose(np.abs(v @ vectors[:, :-4:-1]), np.eye(3), atol=1e-6) and np.allclose(m @ v.T, v.T * values[:-4:-1], atol=1e-6)
    assert len(calls) < 80


@pytest.mark.parametrize("few", [1, 5, 1 << 20])
def test_median_of_parts_holds_few_values(few):
    """odd and even counts, signs, roundings below 0 and one value many times."""
    rng = np.random.default_rng(11)
    for n in (1, 2, 3, 50, 1001):
        for x in (rng.normal(size=n), np.round(rng.normal(size=n), 1), np.zeros(n), np.repeat([1.0, -2.0], n)[:n], -1e-16 * rng.random(n)):
            assert cv.median_of(lambda: iter(np.array_split(x, 3)), n, few) == np.median(x)


def test_embedding_moves_tracks_and_no_tiles(spark, tmp_path):
    """a track's tiles are made where the track is, and tracks are not put together in few tasks."""
    rows = [(k, [float(k % 7), 1.0], k % 3) for k in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = registry.queries()["laplacian_embedding"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan.replace("FlatMapGroupsInPandas", "") and "REPARTITION_BY_NUM" in plan
