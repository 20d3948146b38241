"""Qualities of transitions, counted without the pairs."""

import random

import duckdb
import pytest

from aulos.plans import catalog, qualities, registry

SCHEMA = "p_partkey long, p_size int, p_brand string, p_retailprice double"


def _rows(seed, n, price):
    rng = random.Random(seed)
    return [(i * rng.choice((1, 1, 7)), rng.randint(1, 50), "B", price(rng)) for i in range(n)]


def _made(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/part.parquet")
    found = registry.queries()["transition_quality"](spark, str(folder))
    return {r.quality: r.pairs for r in found.collect()}


@pytest.mark.parametrize("seed,n,price", [(1, 700, lambda r: r.uniform(0, 3000)), (2, 600, lambda r: r.randint(0, 40) * 50.0), (3, 300, lambda r: 900.0), (4, 0, None), (5, 1, lambda r: 5.0)])
@pytest.mark.parametrize("tiny", [False, True])
def test_counts_are_those_of_the_sql(spark, tmp_path, monkeypatch, seed, n, price, tiny):
    """centroids far apart, on a grid, all equal; equal ids; spans in many parts and few distances at once."""
    if tiny:
        for name, value in (("SPAN", 150), ("LEFT", 40), ("RIGHT", 90), ("REACH", 50)):
            monkeypatch.setattr(qualities, name, value)
    got = _made(spark, tmp_path, _rows(seed, n, price))
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert got == dict(con.execute(registry.oracle_sql()["transition_quality"]).fetchall())


def test_counts_with_missing_values_are_those_of_the_pairs(spark, tmp_path):
    """Null sizes and keys, and centroids that are null, endless or not a number."""
    rng = random.Random(6)
    rows = [(rng.choice((i, i, i, None)), rng.choice((None, 3, 17, 40)), "B", rng.choice((None, float("nan"), float("inf"), float("-inf"), 10.0, 700.0, 1900.0))) for i in range(400)]
    got = _made(spark, tmp_path, rows)
    want = {r.quality: r.pairs for r in catalog.run_sql(spark, str(tmp_path), catalog.QUERIES["transition_quality"]).collect()}
    assert got == want and sum(got.values()) > 10_000


def _most_rows(spark, run):
    """What ``run`` gives, and the most rows that any step of its plans made."""
    store = spark._jsparkSession.sharedState().statusStore()
    every = lambda found: [found.apply(i) for i in range(found.size())]
    before, most = store.executionsCount(), 0
    made = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for execution in every(store.executionsList())[before:]:
        values = store.executionMetrics(execution.executionId())
        for node in every(store.planGraph(execution.executionId()).allNodes()):
            counts = [values.get(m.accumulatorId()) for m in every(node.metrics()) if m.name() == "number of output rows"]
            most = max([most, *(int(v.get().replace(",", "")) for v in counts if v.isDefined())])
    return made, most


def test_a_library_of_copies_makes_no_pairs(spark, tmp_path):
    """four copies of a library have 16 million pairs; no step makes more rows than there are pairs of tempos."""
    con = duckdb.connect()
    con.execute(f"copy (select p_partkey + 2000 * k as p_partkey, p_size, p_brand, p_retailprice from '/root/testdata/sf0.01/part.parquet', (select unnest(range(4)) as k) r) to '{tmp_path}/part.parquet' (format parquet)")
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    rows, most = _most_rows(spark, lambda: registry.queries()["transition_quality"](spark, str(tmp_path)).collect())
    assert {r.quality: r.pairs for r in rows} == dict(con.execute(registry.oracle_sql()["transition_quality"]).fetchall())
    assert sum(r.pairs for r in rows) > 16_000_000 > 10 * most
