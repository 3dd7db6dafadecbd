"""Inspection of a rebuild: what was before and what is after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBJECT_TYPES = {"BASE TABLE": "table", "VIEW": "view", "MATERIALIZED VIEW": "materialized view", "EXTERNAL": "external table"}


def object_type(raw: Column) -> Column:
    """Label of a warehouse's object type; an unknown one in lower case."""
    label = F.lower(raw)
    for name, shown in OBJECT_TYPES.items():
        label = F.when(raw == name, shown).otherwise(label)
    return label


def compare_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, type, before, after): row counts of each object on both sides; objects of one side only drop out.

    Both: key, object_type. The type is that of the later snapshot.
    """
    b = before.groupBy(key).agg(F.count(F.lit(1)).alias("before"))
    a = after.groupBy(key).agg(F.count(F.lit(1)).alias("after"), F.max("object_type").alias("raw"))
    return b.join(a, key).select(key, object_type(F.col("raw")).alias("type"), "before", "after")


def has_changes(items: Column) -> Column:
    """Whether any struct of the array has before different from after; null equals null."""
    return F.exists(items, lambda i: ~i["before"].eqNullSafe(i["after"]))


def changed_groups(items: DataFrame, key: str) -> DataFrame:
    """(key, changed): whether any of a group's rows has before different from after, for groups of any size."""
    return items.groupBy(key).agg(F.bool_or(~F.col("before").eqNullSafe(F.col("after"))).alias("changed"))


def list_inspections(df: DataFrame, n: int, changed_only: bool = False) -> DataFrame:
    """The last n inspections of each asset with ``nth`` from the oldest of them, which is 1."""
    rows = df.where("changed") if changed_only else df
    newest = Window.partitionBy("asset").orderBy(F.desc("inspected_at"), F.desc("execution_id"))
    oldest = Window.partitionBy("asset").orderBy("inspected_at", "execution_id")
    kept = rows.withColumn("__rank", F.row_number().over(newest)).where(F.col("__rank") <= n).drop("__rank")
    return kept.withColumn("nth", F.row_number().over(oldest).cast("long"))


def inspection_key(ts: Column, changed: Column, execution_id: Column) -> Column:
    """Sortable text: UTC time to the millisecond, changed or nochange, execution id."""
    stamp = F.date_format(ts.cast("timestamp_ntz"), "yyyyMMdd'T'HHmmss.SSS'Z'")
    return F.concat_ws("_", stamp, F.when(changed, "changed").otherwise("nochange"), execution_id.cast("string"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All new records, and the old ones whose key is not among them."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def jobs_by_label(jobs: DataFrame, key: str, value: str) -> DataFrame:
    """Jobs whose label array (structs of key and value) has the pair."""
    return jobs.where(F.exists("labels", lambda x: (x["key"] == key) & (x["value"] == value)))


def backfill_jobs(inspections: DataFrame, jobs: DataFrame) -> DataFrame:
    """Inspections (execution_id, jobs array) with the job list filled in where it is empty.

    jobs: execution_id, job_id.
    """
    found = jobs.groupBy("execution_id").agg(F.sort_array(F.collect_set("job_id")).alias("__found"))
    none = F.coalesce(F.size("jobs"), F.lit(0)) <= 0
    return inspections.join(found, "execution_id", "left").withColumn("jobs", F.when(none, F.coalesce("__found", "jobs")).otherwise(F.col("jobs"))).drop("__found")
