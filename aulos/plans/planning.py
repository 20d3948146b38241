"""The set-planning query: one plan a region over the track library derived from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aulos.operators.planner import generate_plans
from aulos.plans.catalog import run_sql
from aulos.plans.registry import register

REQUESTS = """select cast(r_regionkey as bigint) as plan_id, 45 + 15 * r_regionkey as minutes, case when r_regionkey > 0 then 116E0 + 4 * r_regionkey end as dominant,
  map('8A', 1E0, '5B', 9E-1) as liked from region"""


def generate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate_plans(run_sql(spark, sf_dir, REQUESTS), run_sql(spark, sf_dir, "select * from {tracks} t"))


register("generate_plan", generate_plan)
