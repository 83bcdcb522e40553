"""A session with the settings the engine is designed for. All operators work without them; results don't depend on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(app: str = "logloom", master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    return (builder.master(master) if master else builder).getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as tasks run at once: for small inputs, which Spark reads by fewer, before costly work on their rows. Larger ones stay as they are."""
    most = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(most) if df.rdd.getNumPartitions() < most else df
