"""Driver / lake tables as DataFrames and SQL views."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; filters and projections are pushed into the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register the raw tables and the telemetry views for ad-hoc ``spark.sql``."""
    from . import dimensions, jobs, telemetry

    for t in ("events", "orders"):
        load(spark, sf_dir, t).createOrReplaceTempView(t)
    telemetry.infra_readings(spark, sf_dir).createOrReplaceTempView("infra_readings")
    telemetry.compute_readings(spark, sf_dir).createOrReplaceTempView("compute_readings")
    telemetry.readings(spark, sf_dir).createOrReplaceTempView("readings")
    jobs.jobs(spark, sf_dir).createOrReplaceTempView("jobs")
    dimensions.inventory(spark).createOrReplaceTempView("inventory")
    dimensions.metric_defs(spark).createOrReplaceTempView("metric_defs")
    dimensions.rack_info(spark).createOrReplaceTempView("rack_info")
