"""Operational analytics over event and case tables. Every moment in time is a parameter, never the clock."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.storage import written

# Upper bounds of the latency histogram, in seconds.
LATENCY_BOUNDS = (0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0, 5.0, 10.0)


def daily_volume(df: DataFrame, ts: str, as_of: Column, days: int = 30) -> DataFrame:
    """Rows per day over the days before as_of."""
    recent = df.where(F.col(ts) >= as_of - F.make_interval(days=F.lit(days)))
    return recent.groupBy(F.date_trunc("day", ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def funnel(df: DataFrame, state: Column, subject: str, milestones: dict[str, Sequence[str]]) -> DataFrame:
    """Distinct subjects that reached each milestone, in one pass."""
    return df.agg(*[F.count_distinct(F.when(state.isin(*states), F.col(subject))).alias(name) for name, states in milestones.items()])


def sla(df: DataFrame, is_open: Column, due: Column, as_of: Column) -> DataFrame:
    """Open rows past due, and the rest; without a due time a row is on track."""
    late = F.coalesce(due < as_of, F.lit(False))
    return df.where(is_open).agg(F.count_if(late).alias("breached"), F.count_if(~late).alias("on_track"))


def usage(df: DataFrame, provider: Column, status: Column, tokens: Column) -> DataFrame:
    """Calls and tokens by provider and status, with the share of cached calls over all groups."""
    per = df.groupBy(provider.alias("provider"), status.alias("status")).agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"))
    every = W.partitionBy()
    cached, total = F.sum(F.when(F.col("status") == "cached", F.col("calls")).otherwise(0)).over(every), F.sum("calls").over(every)
    return per.withColumn("cache_rate", F.when(total > 0, F.round(cached / total, 4)).otherwise(0.0))


def pivoted(df: DataFrame, row: str, column: Column, values: Sequence, value: Column) -> DataFrame:
    return df.withColumn("__c", column).groupBy(row).pivot("__c", list(values)).agg(value).na.fill(0)


def latest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of the largest order of each key, without a sort: a maximum of structs."""
    rest = [c for c in df.columns if c != key and c not in order]
    return df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("m")).select(key, "m.*")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def histogram(df: DataFrame, value: Column, bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative counts by upper bound: one pass of conditional counts, then one row a bound."""
    counts = df.agg(*[F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])).alias("h")).select("h.*")


def nearest_rank(df: DataFrame, value: str, q: float) -> DataFrame:
    """The value at place floor(n * q) of the sorted values: the exact smallest value whose rank passes it.

    Counts by value are dealt over ranges; the ranges' sums, a row each, say which one holds the place, and only that one is ordered.
    """
    by_value = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = written(by_value.repartitionByRange(width, value).withColumn("part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("part").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.floor(F.sum("m").over(W.partitionBy()) * q)
    inside = sums.withColumns({"before": before, "place": place}).where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("m")))
    upto = F.col("before") + F.sum("n").over(W.partitionBy("part").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    return dealt.join(inside, "part").select(value, upto.alias("upto"), "place").where(F.col("upto") > F.col("place")).agg(F.min(value).alias("p"))


def interpolated_quantile(buckets: DataFrame, q: float) -> DataFrame:
    """p: the q-quantile of a cumulative histogram (le, n), by linear interpolation inside the bucket that holds it.

    The lowest bucket begins at 0; what lies above the last finite bound gives that bound; an empty histogram gives null.
    """
    by = W.orderBy("le")
    edges = buckets.withColumns({"low": F.coalesce(F.lag("le").over(by), F.lit(0.0)), "below": F.coalesce(F.lag("n").over(by), F.lit(0)), "rank": q * F.max("n").over(W.partitionBy())})
    finite = F.col("le") < float("inf")
    held = edges.where((F.col("n") >= F.col("rank")) & (F.col("n") > F.col("below")))
    inner = F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("below")) / (F.col("n") - F.col("below"))
    return held.agg(F.min(F.struct("le", F.when(finite, inner).otherwise(F.col("low")).alias("p"))).alias("m")).select("m.p")


def freshness(df: DataFrame, ts: str, as_of: Column) -> DataFrame:
    """Seconds from the last row to as_of, to the nearest."""
    epoch = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return df.agg(F.rint(epoch(as_of) - epoch(F.max(ts))).cast("long").alias("seconds"))


def paged(df: DataFrame, filters: Sequence[Column | None], order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page of a queue; filters that are not given don't apply."""
    for f in filters:
        df = df if f is None else df.where(f)
    return df.orderBy(*order).offset(offset).limit(limit)


def seek(df: DataFrame, order: Sequence[tuple[str, bool]], last: Mapping[str, object] | None, limit: int) -> DataFrame:
    """The page of a queue after the row `last` (none: the first page); order has (column, descending), the last of which makes it unique.

    A range on the first column reaches the scan, so that a later page reads less, not more, and rows that came meanwhile
    shift nothing. Nulls stand last in either direction.
    """
    column = lambda c, down: (F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last())
    if last is not None:
        further, same = F.lit(False), F.lit(True)
        for c, down in order:
            v = last[c]
            if v is not None:  # after a null in this column comes nothing but another null
                beyond = (F.col(c) < F.lit(v)) if down else (F.col(c) > F.lit(v))
                further = further | (same & (beyond | F.col(c).isNull()))
            same = same & F.col(c).eqNullSafe(F.lit(v))
        first, down = order[0]
        if last[first] is None:
            df = df.where(F.col(first).isNull())
        else:
            df = df.where((F.col(first) <= F.lit(last[first]) if down else F.col(first) >= F.lit(last[first])) | F.col(first).isNull())
        df = df.where(further)
    return df.orderBy(*[column(*o) for o in order]).limit(limit)


def least_loaded(people: DataFrame, load: DataFrame, key: str, group: str) -> DataFrame:
    """Of each group the person with the fewest open cases, the smallest key among equals."""
    n = load.groupBy(key).agg(F.count(F.lit(1)).alias("open_cases"))
    joined = people.join(n, key, "left").withColumn("open_cases", F.coalesce("open_cases", F.lit(0)))
    return joined.groupBy(group).agg(F.min(F.struct("open_cases", key)).alias("m")).select(group, F.col(f"m.{key}").alias(key), F.col("m.open_cases").alias("open_cases"))


def worst_of(df: DataFrame, key: str, status: Column) -> DataFrame:
    """fail over warn over pass; keys whose statuses are all null get null."""
    severity = F.when(status == "fail", 2).when(status == "warn", 1).when(status.isNotNull(), 0)
    names = F.array(F.lit("pass"), F.lit("warn"), F.lit("fail"))
    return df.groupBy(key).agg(F.max(severity).alias("s")).select(key, F.get(names, F.col("s")).alias("worst"))


def quality_checks(df: DataFrame, key: str, name: str, previous: Column, floor: int, tolerance: float = 0.1) -> DataFrame:
    """One row: duplicate keys, blank names, whether the count is within tolerance of the previous one, and above the floor."""
    n = F.count(F.lit(1))
    close = F.coalesce(n.between(previous * (1 - tolerance), previous * (1 + tolerance)), F.lit(True)) | (F.coalesce(previous, F.lit(0)) == 0)
    return df.agg(n.alias("n"), (n - F.count_distinct(key)).alias("duplicates"), F.count_if(F.trim(F.coalesce(F.col(name), F.lit(""))) == "").alias("blank"), close.alias("within_tolerance"), (n >= floor).alias("above_floor"))


def require_floor(df: DataFrame, floor: int) -> DataFrame:
    """df's count, or an error when it is below the floor."""
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("ok", F.assert_true(F.col("n") >= floor, F.lit("too few records")))
