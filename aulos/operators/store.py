"""A keyed store on Parquet snapshots: upserts, lookups, invalidation and clean-up as joins and windows.

A snapshot is a folder ``v<n>`` under the store's path; a write makes the next one whole and readers take the greatest whose ``_SUCCESS``
file is there, so a lost executor or driver leaves the last good snapshot in place.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key, the last by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in order]))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def upsert(held: DataFrame, new: DataFrame, key: list[str], order: list, keep: list[str] = ()) -> DataFrame:
    """``held`` with the rows of ``new`` in place of those with equal keys; later duplicates win, ``keep`` columns stay as first stored."""
    new = latest(new, key, order)
    if keep:
        old = held.select(*key, *[F.col(c).alias(f"_old_{c}") for c in keep])
        new = new.join(old, key, "left").select(*[F.coalesce(F.col(f"_old_{c}"), F.col(c)).alias(c) if c in keep else F.col(c) for c in held.columns])
    return held.join(new.select(*key), key, "left_anti").select(*held.columns).unionByName(new.select(*held.columns))


def usable(rows: DataFrame, needed: list[str]) -> DataFrame:
    """The rows of a batch that have all needed values; bad rows are skipped."""
    return rows.dropna(subset=needed)


def without(held: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return held.join(gone.select(*key), key, "left_anti")


def under(held: DataFrame, column: str, folder: str) -> DataFrame:
    """The rows whose path is in the folder or below it."""
    return held.filter(F.col(column).startswith(folder.rstrip("/") + "/"))


def fresh_enough(held: DataFrame, stamp: str, now, days: int = 30) -> DataFrame:
    return held.filter(F.col(stamp) >= F.lit(now) - F.expr(f"interval {int(days)} days"))


def orphans(index: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """Rows of an index that point at nothing."""
    return index.join(held.select(*key).distinct(), key, "left_anti")


def has_all(features: DataFrame, key: str, name: str, names: list[str]) -> DataFrame:
    """key, complete: whether every one of the names is stored."""
    return features.groupBy(key).agg((F.count_distinct(F.when(F.col(name).isin(names), F.col(name))) == len(set(names))).alias("complete"))


def same_sets(profiles: DataFrame, asked: DataFrame, key: str, hashes: str) -> DataFrame:
    """key, valid: whether the stored and the asked hashes are equal as sets."""
    both = profiles.join(asked.withColumnRenamed(hashes, "_asked"), key)
    return both.select(key, (F.sort_array(F.array_distinct(hashes)) == F.sort_array(F.array_distinct("_asked"))).alias("valid"))


def add_sets(held: DataFrame, new: DataFrame, key: str, item: str, hours: str) -> DataFrame:
    """key, n_sets, hours after more sets; a set that was counted before, or comes twice, counts once."""
    every = held.select(key, item, hours).unionByName(new.select(key, item, hours))
    return every.groupBy(key, item).agg(F.max(hours).alias(hours)).groupBy(key).agg(F.count(F.lit(1)).alias("n_sets"), F.sum(hours).alias(hours))


def track_query(tracks: DataFrame, bpm: tuple[float, float] | None = None, genres: list[str] | None = None, artists: list[str] | None = None, rating: int | None = None, limit: int | None = None) -> DataFrame:
    """The tracks that pass every filter given, by artist and id; all filters reach the scan."""
    if bpm is not None:
        tracks = tracks.filter(F.col("bpm").between(*bpm))
    if genres:
        tracks = tracks.filter(F.col("genre").isin(genres))
    if artists:
        tracks = tracks.filter(F.col("artist").isin(artists))
    if rating is not None:
        tracks = tracks.filter(F.col("rating") >= rating)
    tracks = tracks.orderBy("artist", "id")
    return tracks if limit is None else tracks.limit(limit)


class SnapshotStore:
    """A table of rows by key in snapshot folders of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], order: list[str]):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._root = hadoop.fs.Path(self.path)
        self._files = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._at = lambda name: hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        if not self._files.exists(self._root):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._root)]
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and self._files.exists(self._at(f"{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        done = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{done[-1]}") if done else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, keep: int = 2) -> None:
        done = self.versions()
        rows.write.mode("overwrite").parquet(f"{self.path}/v{done[-1] + 1 if done else 0}")
        for old in done[: max(0, len(done) + 1 - keep)]:
            self._files.delete(self._at(f"v{old}"), True)

    def save(self, new: DataFrame, keep: list[str] = ()) -> None:
        self._write(upsert(self.read(), new, self.key, self.order, keep))

    def get(self, **key) -> DataFrame:
        rows = self.read()
        for name, value in key.items():
            rows = rows.filter(F.col(name) == value)
        return rows

    def invalidate(self, gone: DataFrame) -> None:
        self._write(without(self.read(), gone, self.key))

    def clear(self) -> None:
        self._write(self.read().limit(0))

    def stats(self) -> dict:
        sizes = self._files.getContentSummary(self._root).getLength() if self._files.exists(self._root) else 0
        return {"rows": self.read().count(), "bytes": sizes}
