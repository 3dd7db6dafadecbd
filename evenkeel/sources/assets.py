"""Reading tables by name, rows as JSON, JSON lines, and the logs partitioned by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.times import date_key


def read_asset(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """The table behind an asset. CSV has a header; text formats take an explicit schema."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def query_rows(spark: SparkSession, query: str) -> DataFrame:
    """Every row of a query as one JSON object; nulls are kept as null."""
    rows = spark.sql("SELECT * FROM (\n" + query.strip().rstrip(";") + "\n)")
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


def write_jsonl(df: DataFrame, path: str, row_id: str | None = None, mode: str = "overwrite") -> None:
    """JSON lines; null stays null, binary becomes base64, the row id column is left out."""
    columns = [F.base64(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in df.schema if f.name != row_id]
    df.select(*columns).write.mode(mode).option("ignoreNullFields", "false").json(path)


def load_jsonl(spark: SparkSession, path: str, staging: str, schema: T.StructType | str | None = None, single_column: bool = False) -> DataFrame:
    """Replace the staging table at ``staging`` by JSON lines.

    Without a schema it is inferred; with single_column each line stays one JSON text in ``value``.
    """
    if single_column:
        rows = spark.read.text(path)
    else:
        rows = (spark.read.schema(schema) if schema is not None else spark.read).json(path)
    rows.write.mode("overwrite").parquet(staging)
    return spark.read.parquet(staging)


def append_log(df: DataFrame, path: str, ts: str = "started_at") -> None:
    """Append log rows in a folder for each date; a row whose time has no date key is refused.

    Rows are rebalanced by date: small dates share a task, a large one is split over several.
    """
    text = F.col(ts).cast("string")
    keyed = df.withColumn("date", F.coalesce(date_key(text), F.raise_error(F.concat(F.lit("no date in "), text)).cast("string")))
    keyed.hint("rebalance", "date").write.partitionBy("date").mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Log rows, with ``date`` as text; first and last (inclusive) prune folders."""
    rows = spark.read.parquet(path)
    if first:
        rows = rows.where(F.col("date") >= F.lit(first).cast("date"))
    if last:
        rows = rows.where(F.col("date") <= F.lit(last).cast("date"))
    return rows.withColumn("date", F.col("date").cast("string"))
