"""Snapshot comparison: upsert, soft delete, change rows, and what a change touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields as ordered JSON, nulls included; sort lists before."""
    return F.sha2(F.to_json(F.struct(*[f.alias(f"f{i}") for i, f in enumerate(fields)]), {"ignoreNullFields": "false"}), 256)


def compare(old: DataFrame, new: DataFrame, keys: Sequence[str], print_col: str = "fingerprint") -> DataFrame:
    """keys, change_type of every key of either snapshot. A key that was inactive counts by its content, as if active."""
    a = old.select(*keys, F.col(print_col).alias("__old"), F.col("is_active").alias("__active")) if "is_active" in old.columns else old.select(*keys, F.col(print_col).alias("__old"), F.lit(True).alias("__active"))
    b = new.select(*keys, F.col(print_col).alias("__new"))
    kind = (
        F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull() & F.col("__active"), "removed")
        .when(F.col("__new").isNotNull() & (F.col("__old") != F.col("__new")), "modified").when(F.col("__new").isNotNull(), "unchanged")
    )
    return a.join(b, list(keys), "full_outer").select(*keys, kind.alias("change_type")).where("change_type is not null")


def change_rows(old: DataFrame, new: DataFrame, changes: DataFrame, keys: Sequence[str], before: Sequence[str], after: Sequence[str], name: str) -> DataFrame:
    """keys, change_type, diff as JSON: the name of added and removed rows, before and after of modified ones."""
    a = old.select(*keys, F.col(name).alias("__old_name"), F.struct(*before).alias("__before"))
    b = new.select(*keys, F.col(name).alias("__new_name"), F.struct(*after).alias("__after"))
    both = changes.where("change_type <> 'unchanged'").join(a, list(keys), "left").join(b, list(keys), "left")
    diff = F.when(F.col("change_type") == "modified", F.to_json(F.struct(F.col("__before").alias("before"), F.col("__after").alias("after")))).otherwise(
        F.to_json(F.struct(F.coalesce("__new_name", "__old_name").alias("name"))))
    return both.select(*keys, "change_type", diff.alias("diff"))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], version: int) -> DataFrame:
    """The entities after the load: new content where there is any, the rest inactive; first and last seen versions kept up."""
    rest = [c for c in new.columns if c not in keys]
    a = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in rest], F.col("first_seen_version").alias("__first"), F.col("last_seen_version").alias("__last"))
    joined = a.join(new.withColumn("__here", F.lit(True)), list(keys), "full_outer")
    here = F.col("__here").isNotNull()
    return joined.select(
        *keys, *[F.when(here, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in rest], here.alias("is_active"),
        F.coalesce("__first", F.lit(version)).alias("first_seen_version"), F.when(here, F.lit(version)).otherwise(F.col("__last")).alias("last_seen_version"),
    )


def load_stats(changes: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: added, removed, modified, unchanged, total_active."""
    kinds = ("added", "removed", "modified", "unchanged")
    return changes.agg(*[F.count_if(F.col("change_type") == k).alias(k) for k in kinds]).crossJoin(entities.agg(F.count_if("is_active").alias("total_active")))


def affected(changed: DataFrame, hits: DataFrame, runs: DataFrame) -> DataFrame:
    """Customers with a hit on a changed entity."""
    touched = hits.join(changed.select("entity_id").distinct(), "entity_id", "left_semi")
    return runs.join(touched, "run_id", "left_semi").select("customer_id").distinct()


def to_embed(names: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """names with the vector that is known for their keys; null where one must be made."""
    return names.join(known.select(*keys, "embedding"), list(keys), "left")


def absent(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows to append so that each key is stored once."""
    return new.join(old, list(keys), "left_anti")


#: Child rows of a task, about.
CHILD_ROWS = 1 << 20


def reloaded_children(old: DataFrame, new: DataFrame, entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows after a load: those of the keys in entries are replaced by new's, all others stay as they were.

    The keys grow with the table, so they are sent to no task whole: both sides are sorted, which spills, in tasks whose
    number grows with the rows."""
    keys = list(keys)
    width = max(int(old.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-old.count() // CHILD_ROWS))
    every = old.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True))).repartition(width, *keys)
    loaded = entries.select(*keys).repartition(width, *keys).distinct().withColumn("__loaded", F.lit(True))
    return every.join(loaded.hint("merge"), keys, "left").where(F.col("__new") == F.coalesce("__loaded", F.lit(False))).select(*old.columns)


def not_appended(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, fault of each row of old that new has 'deleted' or 'updated'; a table that only grows has none."""
    rest = [c for c in old.columns if c not in keys]
    shown = lambda df, name: df.select(*keys, fingerprint([F.col(c) for c in rest]).alias(name))
    fault = F.when(F.col("__new").isNull(), "deleted").when(F.col("__new") != F.col("__old"), "updated")
    return shown(old, "__old").join(shown(new, "__new"), list(keys), "left").select(*keys, fault.alias("fault")).where("fault is not null")


def require_appended(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new, if it only adds to old; an error otherwise."""
    if not not_appended(old, new, keys).isEmpty():
        raise ValueError("rows of an append-only table were deleted or updated")
    return new
