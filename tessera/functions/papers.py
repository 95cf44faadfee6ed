"""Rules over papers and credentials: machine-readable zones, cross-references, file rules, codes, passwords, addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fuzzy, text

NAME_MATCH, MOST_BYTES = 90.0, 10 * 1024 * 1024
ALLOWED_TYPES = ("image/jpeg", "image/png", "application/pdf")
# Countries by their codes, as far as the rules need them.
COUNTRIES = (("US", "USA", "United States"), ("GB", "GBR", "United Kingdom"), ("DE", "DEU", "Germany"), ("FR", "FRA", "France"), ("ES", "ESP", "Spain"), ("CA", "CAN", "Canada"), ("JP", "JPN", "Japan"), ("SE", "SWE", "Sweden"))


def zone(lines: Column) -> Column:
    """Fields of the first two-line passport zone of a text, and whether its four check digits and the composite hold; null without one."""
    rows = F.filter(F.transform(F.split(lines, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) == 44)
    one, two = F.get(rows, F.lit(0)), F.get(rows, F.lit(1))
    part = lambda a, n: F.substr(two, F.lit(a), F.lit(n))
    holds = lambda a, n: text.mrz_check_digit(part(a, n)) == F.coalesce(part(a + n, 1).try_cast("int"), F.lit(0))
    whole = text.mrz_check_digit(F.concat(part(1, 10), part(14, 7), part(22, 22))) == F.coalesce(part(44, 1).try_cast("int"), F.lit(0))
    names = F.split(F.substr(one, F.lit(6), F.lit(39)), "<<")
    clean = lambda c: F.trim(F.replace(c, F.lit("<"), F.lit(" ")))
    return F.when(two.isNotNull(), F.struct(
        clean(F.get(names, F.lit(0))).alias("surname"), clean(F.coalesce(F.get(names, F.lit(1)), F.lit(""))).alias("given_names"), F.replace(part(1, 9), F.lit("<"), F.lit("")).alias("number"),
        text.mrz_date(part(14, 6)).alias("birth"), text.mrz_date(part(22, 6)).alias("expiry"), F.replace(part(11, 3), F.lit("<"), F.lit("")).alias("country"),
        (holds(1, 9) & holds(14, 6) & holds(22, 6) & holds(29, 14) & whole).alias("valid")))


def iso_countries(spark: SparkSession) -> list[tuple[str, str, str]]:
    """Two-letter code, three-letter code and English name of every country that the platform's ISO 3166 table knows."""
    locale = spark._jvm.java.util.Locale
    each = [locale("", code) for code in locale.getISOCountries()]
    return [(x.getCountry(), x.getISO3Country(), x.getDisplayCountry(locale.ENGLISH)) for x in each]


def same_country(a: Column, b: Column, countries: Sequence[tuple[str, str, str]] = COUNTRIES) -> Column:
    """Whether two codes or names mean the same country; unknown ones are compared as written."""
    names = {k.lower(): full.lower() for row in countries for full in row[2:] for k in row}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    plain = lambda c: F.lower(F.trim(c))
    known = lambda c: F.coalesce(F.try_element_at(table, plain(c)), plain(c))
    return known(a) == known(b)


def cross_references(df: DataFrame, mrz: str, name: str, birth: str, nation: str, as_of: Column, countries: Sequence[tuple[str, str, str]] = COUNTRIES) -> DataFrame:
    """Adds status and issues of an application against its paper's zone; without a zone a warning."""
    m = F.col(mrz)
    paper_name = F.lower(F.trim(F.concat_ws(" ", m["given_names"], m["surname"])))
    out = df.withColumn("__ratio", fuzzy.token_set_ratio(F.lower(F.col(name)), paper_name))
    stated = F.try_to_date(F.col(birth))
    issues = F.array_compact(F.array(
        F.when(F.col("__ratio") < NAME_MATCH, F.lit("name mismatch")), F.when(stated != m["birth"], F.lit("date of birth mismatch")), F.when(m["expiry"] < as_of, F.lit("document expired")),
        F.when((F.trim(F.col(nation)) != "") & ~same_country(F.col(nation), m["country"], countries), F.lit("issuing country inconsistent")),
    ))
    status = F.when(m.isNull(), "warn").when(F.size(issues) > 0, "fail").otherwise("pass")
    return out.withColumns({"status": status, "issues": F.when(m.isNull(), F.array(F.lit("no zone"))).otherwise(issues)}).drop("__ratio")


def file_rule(size: Column, detected: Column, declared: Column) -> Column:
    """fail for files that are too large or of another type, warn where the declared type differs."""
    return F.when((size > MOST_BYTES) | ~F.coalesce(detected, F.lit("")).isin(*ALLOWED_TYPES), "fail").when(declared != detected, "warn").otherwise("pass")


def code_digest(code: Column) -> Column:
    """Recovery codes are compared without blanks, dashes and case."""
    return F.sha2(F.upper(F.regexp_replace(code, "[\\s-]", "")), 256)


def spend_code(digests: Column, code: Column) -> Column:
    """struct(ok, rest): a code that is among the digests is used up."""
    d = code_digest(code)
    return F.struct(F.coalesce(F.array_contains(digests, d), F.lit(False)).alias("ok"), F.array_remove(digests, F.coalesce(d, F.lit(""))).alias("rest"))


def password_faults(df: DataFrame, column: str, common: DataFrame, least: int = 12) -> DataFrame:
    """Adds the fault of each password: too short, common, or null for none. common: (word)."""
    listed = common.select(F.lower("word").alias("__word")).distinct().withColumn("__common", F.lit(True))
    out = df.join(listed, F.lower(F.col(column)) == F.col("__word"), "left")
    return out.withColumn("fault", F.when(F.length(column) < least, "too short").when(F.col("__common"), "common")).drop("__word", "__common")


def address(c: Column) -> Column:
    """An IPv4 or IPv6 address as it is, anything else null."""
    octet = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    v4 = rf"^{octet}(\.{octet}){{3}}$"
    hextet = "[0-9A-Fa-f]{1,4}"
    v6 = rf"^(({hextet}:){{7}}{hextet}|(?=(.*::))(?!.*::.*::)(({hextet})?(:{hextet})*)?::(({hextet})(:{hextet})*)?)$"
    short = F.size(F.filter(F.split(c, ":"), lambda x: x != "")) <= 7
    return F.when(c.rlike(v4) | (c.rlike(v6) & (short | ~c.contains("::"))), c)


