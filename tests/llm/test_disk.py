"""What steps leave on disk and send through it."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from aulos.llm import line_dedup, shared, suffix_dedup


def _all(found):
    return [found.apply(i) for i in range(found.size())]


def test_materialize_drops_its_shuffles(spark):
    """files of a finished step are not kept until the driver collects garbage."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f.getName() for f in _all(files.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = held()
    made = shared.materialize(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "test-shuffles")
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before
    assert made.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get(shared.CLEAN) == "false"


def test_line_dedup_opens_only_classes_with_candidates(spark, monkeypatch):
    """in buckets of unlike lines no line moves; a pair in another component is still found, in and across blocks."""
    rng = random.Random(5)
    words = lambda: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(12))
    base = [words() for _ in range(40)]
    rows = [(i, line) for i, line in enumerate(base)] + [(100 + i, base[i] + " x") for i in (3, 17, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {r.line_id: r.doc_id for r in line_dedup._lines(docs).collect()}
    signed = line_dedup._signed(docs)
    texts = line_dedup._lines(docs).select("line_id", "line")
    for sub in (4, 64):
        monkeypatch.setattr(line_dedup, "SUB", sub)
        members = signed.select(F.lit(1).cast("long").alias("bucket"), F.lit(len(rows)).cast("long").alias("n"), "line_id", F.col("line_id").alias("root"), *line_dedup.SKETCH)
        assert {ids[r.line_id] for r in line_dedup._open(members).collect()} == {3, 17, 30, 103, 117, 130}
        links = line_dedup._apart(members, signed.select("line_id", "keys"), texts).collect()
        assert {tuple(sorted((ids[r.a], ids[r.b]))) for r in links} == {(3, 103), (17, 117), (30, 130)}


def _generated(spark, run):
    """What ``run`` gives, and the most rows that any generator made in it."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    made = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    for execution in _all(store.executionsList())[before:]:
        values = store.executionMetrics(execution.executionId())
        for node in _all(store.planGraph(execution.executionId()).allNodes()):
            if node.name() == "Generate":
                counts = [values.get(m.accumulatorId()) for m in _all(node.metrics()) if m.name() == "number of output rows"]
                most = max([most, *(int(v.get().replace(",", "")) for v in counts if v.isDefined())])
    return made, most


def test_line_dedup_lists_an_open_class_once_a_bucket(spark, monkeypatch):
    """Blocks of a large bucket that meet many others make no row for each class and meeting."""
    monkeypatch.setattr(line_dedup, "SUB", 8)
    n = 400  # 50 blocks of about 8, each two of which meet
    members = spark.range(n).select(F.lit(1).cast("long").alias("bucket"), F.lit(n).cast("long").alias("n"), F.col("id").alias("line_id"), F.col("id").alias("root"), *[F.lit(0).cast("long").alias(c) for c in line_dedup.SKETCH])
    left, most = _generated(spark, lambda: line_dedup._open(members))
    assert sorted(r.line_id for r in left.collect()) == list(range(n))
    assert n <= most <= 4 * n


def test_line_dedup_keeps_open_classes_beyond_64_places(spark, monkeypatch):
    """A block of more than 64 classes: all that have a candidate are open, wherever they stand in it."""
    monkeypatch.setattr(line_dedup, "SUB", 500)
    far = [F.when(F.col("id") < 400, F.xxhash64("id", F.lit(c))).otherwise(0).cast("long").alias(c) for c in line_dedup.SKETCH]
    members = spark.range(402).select(F.lit(1).cast("long").alias("bucket"), F.lit(402).cast("long").alias("n"), F.col("id").alias("line_id"), F.col("id").alias("root"), *far)
    assert {400, 401} <= {r.line_id for r in line_dedup._open(members).collect()}


def test_suffix_dedup_merges_many_shards_of_a_bucket(spark):
    """the work of a merge follows the digests, not the square of the shards; only digests of two shards count."""
    n, rows = 3000, []
    for part in range(n):
        digests = np.sort(np.array([10 * part, 10 * part + 1, 10**9 + part // 2], np.uint64))
        rows.append((0, part, digests.tobytes(), [f"k{part}"], np.zeros(3, np.int32).tobytes(), np.arange(3, dtype=np.int64).tobytes()))
    open_ = spark.createDataFrame(rows, "bucket int, part int, digests binary, keys array<string>, owner binary, starts binary").coalesce(1)
    began = time.time()
    got = sorted(tuple(r) for r in suffix_dedup._merge(open_).collect())
    assert time.time() - began < 10
    assert got == sorted((f"k{part}", 2, 2 + suffix_dedup.LENGTH) for part in range(n))
