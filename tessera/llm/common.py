"""What the operators share: reading, and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder and the master is local, as in tests.
OWN_CHECKPOINTS = "/tmp/checkpoints"
#: A word, as the contracts define it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver see: spark.checkpoint.dir; a cluster without one is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or OWN_CHECKPOINTS).rstrip("/")


def stored(df: DataFrame, name: str, after: Iterable[DataFrame] = ()) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends, lost executors lose nothing.

    The tables of `after`, which stored() gave and only df still read, are deleted then; all others when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place, files = on_disk(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    dropped(*after)
    return out


def on_disk(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that stored() gave and nothing reads any more."""
    for df in tables:
        if getattr(df, "stored_at", None):
            place, files = on_disk(df.sparkSession, df.stored_at)
            files.delete(place, True)


def shuffle_width(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that Python objects are made of some texts at a time; Spark bounds a batch's bytes itself."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
