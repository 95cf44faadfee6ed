"""Watchlist files: nested XML to typed records, version checks, and the plain readers and writers."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text

ENTRY = """
uid STRING, firstName STRING, lastName STRING, title STRING, sdnType STRING, remarks STRING,
programList STRUCT<program: ARRAY<STRING>>,
akaList STRUCT<aka: ARRAY<STRUCT<uid: STRING, type: STRING, category: STRING, firstName: STRING, lastName: STRING>>>,
addressList STRUCT<address: ARRAY<STRUCT<uid: STRING, address1: STRING, address2: STRING, city: STRING, stateOrProvince: STRING, postalCode: STRING, country: STRING>>>,
idList STRUCT<id: ARRAY<STRUCT<uid: STRING, idType: STRING, idNumber: STRING, idCountry: STRING, issueDate: STRING, expirationDate: STRING>>>,
dateOfBirthList STRUCT<dateOfBirthItem: ARRAY<STRUCT<uid: STRING, dateOfBirth: STRING, mainEntry: STRING>>>,
placeOfBirthList STRUCT<placeOfBirthItem: ARRAY<STRUCT<uid: STRING, placeOfBirth: STRING, mainEntry: STRING>>>,
nationalityList STRUCT<nationality: ARRAY<STRUCT<uid: STRING, country: STRING, mainEntry: STRING>>>,
citizenshipList STRUCT<citizenship: ARRAY<STRUCT<uid: STRING, country: STRING, mainEntry: STRING>>>
"""
GROUND_TRUTH = "query_name STRING, dob_year INT, label STRING, true_entity_uid BIGINT"


def words(c: Column) -> Column:
    """Trimmed; empty becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def flag(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))


def primary_name(kind: Column, first: Column, last: Column) -> Column:
    """Individuals: first and last name; others: the last name, else the first, else nothing."""
    return F.when(kind == "Individual", F.concat_ws(" ", words(first), words(last))).otherwise(F.coalesce(words(last), words(first), F.lit("")))




def read_entries(spark: SparkSession, path: str, namespace: str | None = None) -> DataFrame:
    """One typed record per entry. With a namespace given, files that don't declare it have no entries; a missing uid is an error."""
    raw = spark.read.format("xml").option("rowTag", "sdnEntry").schema(ENTRY).load(path)
    if namespace is not None:
        files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").contains(namespace).alias("declared"))
        name = lambda c: F.element_at(F.split(c, "/"), -1)
        good = files.where("declared").select(name(F.col("path")).alias("__file"))
        raw = raw.withColumn("__file", name(F.input_file_name())).join(good, "__file", "left_semi").drop("__file")
    listed = lambda c, inner: F.coalesce(F.col(f"{c}.{inner}"), F.array())
    uid = F.coalesce(F.col("uid").try_cast("int"), F.raise_error(F.lit("an entry has no uid")).cast("int"))
    return raw.select(
        uid.alias("uid"), words(F.col("firstName")).alias("first_name"), words(F.col("lastName")).alias("last_name"), words(F.col("title")).alias("title"),
        words(F.col("sdnType")).alias("sdn_type"), words(F.col("remarks")).alias("remarks"), primary_name(F.col("sdnType"), F.col("firstName"), F.col("lastName")).alias("primary_name"),
        listed("programList", "program").alias("programs"), listed("akaList", "aka").alias("akas"), listed("addressList", "address").alias("addresses"), listed("idList", "id").alias("ids"),
        F.transform(listed("dateOfBirthList", "dateOfBirthItem"), lambda d: F.struct(words(d["dateOfBirth"]).alias("text"), flag(d["mainEntry"]).alias("main"))).alias("births"),
        F.transform(listed("placeOfBirthList", "placeOfBirthItem"), lambda d: F.struct(words(d["placeOfBirth"]).alias("text"), flag(d["mainEntry"]).alias("main"))).alias("birth_places"),
        F.transform(listed("nationalityList", "nationality"), lambda d: words(d["country"])).alias("nationalities"),
        F.transform(listed("citizenshipList", "citizenship"), lambda d: words(d["country"])).alias("citizenships"),
    )


def children(entries: DataFrame) -> dict[str, DataFrame]:
    """The child tables of entries, each by uid: names, identifiers, births, nationalities, addresses."""
    each = lambda c: entries.select("uid", F.explode(c).alias("x"))
    own = F.struct(F.col("primary_name").alias("name"), F.lit("primary").alias("kind"), F.lit(False).alias("weak"))
    aka = F.transform("akas", lambda a: F.struct(
        F.concat_ws(" ", words(a["firstName"]), words(a["lastName"])).alias("name"), F.coalesce(words(a["type"]), F.lit("a.k.a.")).alias("kind"), F.coalesce(F.lower(F.trim(a["category"])) == "weak", F.lit(False)).alias("weak")))
    of = lambda c, kind: F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("country")))
    part, born = (lambda f: words(F.col(f"x.{f}"))), text.parse_birth(F.col("x.text"))
    return {
        "names": each(F.concat(F.array(own), aka)).select("uid", "x.*").where("name <> ''"),
        "identifiers": each("ids").select("uid", F.coalesce(part("idType"), F.lit("unknown")).alias("id_type"), F.coalesce(part("idNumber"), F.lit("")).alias("id_number"), part("idCountry").alias("id_country")),
        "births": each("births").select("uid", born["exact"].alias("date_of_birth"), born["year"].alias("year_only"), F.col("x.text").alias("dob_text")),
        "nationalities": each(F.concat(of("nationalities", "nationality"), of("citizenships", "citizenship"))).select("uid", "x.*"),
        "addresses": each("addresses").select("uid", part("address1").alias("address1"), part("address2").alias("address2"), part("city").alias("city"), part("stateOrProvince").alias("state_province"), part("postalCode").alias("postal_code"), part("country").alias("country")),
    }


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """publish_date, record_count; an error when the file has no header."""
    h = spark.read.format("xml").option("rowTag", "publshInformation").schema("Publish_Date STRING, Record_Count STRING").load(path)
    one = h.agg(F.first("Publish_Date").alias("d"), F.first("Record_Count").alias("n"))
    return one.select(
        F.coalesce(F.to_date(F.trim("d"), "MM/dd/yyyy"), F.raise_error(F.lit("no publish information")).cast("date")).alias("publish_date"), F.trim("n").cast("int").alias("record_count"))


def content_versions(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """path, sha256, changed: whether a file's content is not among the known digests."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    seen = known.select("sha256", F.lit(True).alias("__seen"))
    return files.join(seen, "sha256", "left").select("path", "sha256", F.col("__seen").isNull().alias("changed"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("nullValue", "").schema(GROUND_TRUTH).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


POINTERS = "_versions"


def publish(df: DataFrame, root: str, version: str) -> str:
    """Writes a new version folder, then a numbered pointer to it: readers see the old or the new version whole, as nothing is overwritten.

    A version is written once; publishing it again is an error. Of writers at once each gets a number of its own: a
    pointer is created only where none is, and who comes too late takes the next number. The file system must create
    without overwriting as one step, as HDFS does.
    """
    path, spark = f"{root}/{version}", df.sparkSession
    df.write.mode("error").parquet(path)
    last = latest(spark, root)
    number = 1 + (last["n"] if last else 0)
    while not pointed(spark, root, number, path):
        number += 1
    return path


def pointed(spark: SparkSession, root: str, number: int, path: str) -> bool:
    """Creates the pointer of that number, unless there is one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTERS}/{number:012d}.json")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = files.create(place, False)
    except Py4JJavaError as e:
        if files.exists(place):
            return False
        raise e
    out.write(bytearray(json.dumps({"n": number, "path": path}).encode()))
    out.close()
    return True


def latest(spark: SparkSession, root: str):
    """The pointer of the largest number, or none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTERS}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema("n long, path string").json(f"{root}/{POINTERS}").orderBy(F.desc("n"), "path").first()


def current(spark: SparkSession, root: str) -> DataFrame:
    last = latest(spark, root)
    if last is None:
        raise ValueError(f"nothing was published under {root}")
    return spark.read.parquet(last["path"])


def refresh_views(views: dict[str, DataFrame], root: str, version: str, prefix: str = "mv_") -> list[str]:
    """Publishes a new version of the persisted aggregates whose names carry the prefix; readers take current(root/name)."""
    names = sorted(n for n in views if n.startswith(prefix))
    for n in names:
        publish(views[n], f"{root}/{n}", version)
    return names
