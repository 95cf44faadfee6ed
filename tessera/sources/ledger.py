"""Incremental processing: a ledger of what each stage read and wrote, so that unchanged input stops at the first stage.

A ledger row says: stage, source, validator (a file's length and time), digest of what was read, digest of what came out,
output, run. A file whose validator is the known one is not read at all; one that was touched is read and its content's
digest decides. A stage runs if what it needs has another digest than in its last run; if its output's digest is the old
one, the old output stays and what follows stops. Ledger rows are only added, so a run that is lost is run again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .watchlist import publish

LEDGER = "stage string, source string, validator string, digest string, output_digest string, output string, run long"
#: Hexadecimal digits of a row's MD5 that go into a table's digest, which is a sum, so that order and partitions don't matter.
DIGITS = 12


def row_digest(*columns: Column) -> Column:
    """A whole number of a row's values; nulls count as a value of their own."""
    shown = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns])
    return F.conv(F.substring(F.md5(shown), 1, DIGITS), 16, 10).cast("decimal(38,0)")


def table_digest(df: DataFrame) -> str:
    """The table's digest: number of rows and the sum of their digests, one aggregate without a shuffle of rows."""
    values = [F.to_json(F.struct(F.col(c))) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in sorted(df.dtypes)]
    n, total = df.agg(F.count(F.lit(1)), F.sum(row_digest(*values))).first()
    return f"{n}:{total or 0}"


def last_runs(ledger: DataFrame) -> DataFrame:
    """The newest row of each stage and source."""
    rest = [c for c in ledger.columns if c not in ("stage", "source", "run")]
    return ledger.groupBy("stage", "source").agg(F.max(F.struct("run", *rest)).alias("last")).select("stage", "source", "last.*")


def states(ledger: DataFrame, inputs: DataFrame) -> DataFrame:
    """stage, source, state of inputs (stage, source, digest) against the ledger: new, changed, unchanged, or gone; a source that
    is as it was in an earlier run, but not in the last one, has changed."""
    known = last_runs(ledger).select("stage", "source", F.col("digest").alias("known"), F.lit(True).alias("seen"))
    both = inputs.select("stage", "source", "digest", F.lit(True).alias("here")).join(known, ["stage", "source"], "full_outer")
    state = F.when(F.col("here").isNull(), "gone").when(F.col("seen").isNull(), "new").when(F.col("digest").eqNullSafe(F.col("known")), "unchanged").otherwise("changed")
    return both.select("stage", "source", state.alias("state"))


def fetched(spark: SparkSession, path: str, ledger: DataFrame, stage: str = "fetch") -> DataFrame:
    """stage, source, validator, digest, state of every file under path; state is not_modified where the validator is the known
    one, and then the file is not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = files.select("path", F.concat_ws("-", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")).alias("validator"))
    known = last_runs(ledger).where(F.col("stage") == stage).select(F.col("source").alias("path"), F.col("validator").alias("__validator"), F.col("digest").alias("__digest"))
    same = listed.join(known, "path").where(F.col("validator") == F.col("__validator")).select("path", "validator", F.col("__digest").alias("digest"), F.lit("not_modified").alias("state"))
    touched = listed.join(same.select("path"), "path", "left_anti")
    names = [r.path for r in touched.select("path").collect()]  # names of files that changed, to read these alone
    empty = spark.createDataFrame([], "path string, sha string")
    read = spark.read.format("binaryFile").load(names).select("path", F.sha2("content", 256).alias("sha")) if names else empty
    state = F.when(F.col("__digest").isNull(), "new").when(F.col("__digest") == F.col("sha"), "unchanged").otherwise("changed")
    opened = touched.join(read, "path").join(known, "path", "left").select("path", "validator", F.col("sha").alias("digest"), state.alias("state"))
    return same.unionByName(opened).select(F.lit(stage).alias("stage"), F.col("path").alias("source"), "validator", "digest", "state")


@dataclass(frozen=True)
class Stage:
    """name, the stages whose outputs it needs (none: the files themselves), and build(inputs by name, or spark and path)."""

    name: str
    needs: Sequence[str]
    build: Callable[..., DataFrame]


class Pipeline:
    """Stages over the files of a folder, with their ledger and outputs under root."""

    def __init__(self, spark: SparkSession, root: str, stages: Sequence[Stage]):
        self.spark, self.root, self.stages = spark, root.rstrip("/"), list(stages)
        known: set[str] = set()
        for stage in self.stages:
            if not set(stage.needs) <= known or stage.name in known | {"fetch"}:
                raise ValueError(f"stage {stage.name} stands before what it needs, or twice")
            known.add(stage.name)

    def ledger(self) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/ledger")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).json(f"{self.root}/ledger")

    def note(self, rows: DataFrame) -> None:
        rows.select(*[f.split()[0] for f in LEDGER.split(", ")]).coalesce(1).write.mode("append").json(f"{self.root}/ledger")

    def output(self, name: str) -> DataFrame:
        """What the stage wrote last."""
        return self.spark.read.parquet(last_runs(self.ledger()).where(F.col("stage") == name).first()["output"])

    def run(self, path: str) -> dict[str, str]:
        """What became of each stage: ran, same (it ran and gave what it had given), or skipped. All files skipped: nothing is read."""
        spark, ledger = self.spark, self.ledger()
        number = 1 + (ledger.agg(F.max("run")).first()[0] or 0)
        files = fetched(spark, path, ledger)
        blank = lambda df: df.withColumns({c: F.lit(None).cast("string") for c in ("output_digest", "output")}).withColumn("run", F.lit(number))
        rows = files.select("source", "validator", "digest", "state").collect()  # a row a file of the list's folder
        if any(r.state != "not_modified" for r in rows):
            self.note(blank(spark.createDataFrame([("fetch", r.source, r.validator, r.digest) for r in rows if r.state != "not_modified"], "stage string, source string, validator string, digest string")))
        digests = {"": ";".join(sorted(r.digest for r in rows))}
        last = {r.stage: r for r in last_runs(ledger).where("stage <> 'fetch'").collect()}
        done = {}
        for stage in self.stages:
            digest = "+".join(digests[n] for n in (stage.needs or [""]))
            before = last.get(stage.name)
            if before and before.digest == digest:
                done[stage.name], digests[stage.name] = "skipped", before.output_digest
                continue
            inputs = {n: self.output(n) for n in stage.needs}
            df = stage.build(inputs) if stage.needs else stage.build(spark, path)
            written = spark.read.parquet(publish(df, f"{self.root}/{stage.name}", f"run-{number}"))
            digests[stage.name] = table_digest(written)
            same = bool(before) and before.output_digest == digests[stage.name]
            output = before.output if same else f"{self.root}/{stage.name}/run-{number}"
            self.note(spark.createDataFrame([(stage.name, "", None, digest, digests[stage.name], output, number)], LEDGER))
            done[stage.name] = "same" if same else "ran"
        return done

    def follow(self, folder: str, checkpoint: str):
        """A streaming query that runs the stages whenever files came into the folder; the caller starts or awaits it."""
        arrived = self.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
        return arrived.select("path").writeStream.foreachBatch(lambda batch, _: self.run(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

