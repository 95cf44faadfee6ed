"""One place for session defaults, so that tests, bench and jobs plan alike."""

from __future__ import annotations

from pyspark import SparkConf
from pyspark.sql import SparkSession


def build(master: str = "local[8]", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session in UTC with adaptive execution; what spark-submit or the defaults file sets stays as it is."""
    own = {
        "spark.master": master, "spark.app.name": "tessera", "spark.driver.memory": driver_memory, "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false",
    }
    given = SparkConf()
    builder = SparkSession.builder
    for key, value in own.items():
        if not given.contains(key):
            builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """A table of the data folder; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
