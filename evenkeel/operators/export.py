"""Incremental export: rows above a watermark, merged into a target that keeps what it has."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def unexported(df: DataFrame, row_id: str, watermark: int, paths: Sequence[str] = ()) -> DataFrame:
    """(rows, with_paths): rows above the watermark, and those of them with a path in any of the columns."""
    has = F.coalesce(*paths).isNotNull() if paths else F.lit(False)
    return df.where(F.col(row_id) > watermark).agg(F.count(F.lit(1)).alias("rows"), F.count_if(has).alias("with_paths"))


def extract(df: DataFrame, row_id: str, watermark: int) -> tuple[DataFrame, DataFrame]:
    """Rows above the watermark, and the new watermark as a row: the greatest id, or the old one."""
    rows = df.where(F.col(row_id) > watermark)
    return rows, rows.agg(F.coalesce(F.max(row_id), F.lit(watermark).cast("long")).alias("watermark"))


def merge_new(target: DataFrame, staging: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Staged rows to append: keys the target lacks, each once (the row that is first by ``order``)."""
    first = Window.partitionBy(*keys).orderBy(order)
    once = staging.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return once.join(target.select(*keys), list(keys), "left_anti").select(*staging.columns)


class BucketedTarget:
    """An export's target, a Parquet table at ``path`` bucketed by its keys, so that a merge shuffles what is staged and never the target.

    The session's catalogue knows the table by a name of its own until ``forget``; its files stay. Appended
    batches are more files of the same buckets.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self.name = f"evenkeel_target_{uuid.uuid4().hex}"

    def append(self, rows: DataFrame) -> None:
        writer = rows.write.format("parquet").mode("append").option("path", self.path)
        writer.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(self.name)

    def new_rows(self, staging: DataFrame, order: str) -> DataFrame:
        """Staged rows to append, dealt once, as the buckets are; see ``merge_new``."""
        target = self.spark.table(self.name)
        return merge_new(target, staging.repartition(self.buckets, *self.keys), self.keys, order).select(*target.columns)

    def merge(self, staging: DataFrame, order: str) -> None:
        self.append(self.new_rows(staging, order))

    def forget(self) -> DataFrame:
        """Take the table out of the catalogue; its rows, as files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        return self.spark.read.parquet(self.path)


def rewrite_paths(df: DataFrame, mapping: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with local paths replaced by remote ones where the mapping (local, remote) has them."""
    for c in columns:
        m = mapping.select(F.col("local").alias("__local"), F.col("remote").alias("__remote"))
        df = df.join(m, F.col(c) == F.col("__local"), "left").withColumn(c, F.coalesce("__remote", c)).drop("__local", "__remote")
    return df


def upload_list(df: DataFrame, row_id: str, watermark: int, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null paths of the columns above the watermark."""
    rows = df.where(F.col(row_id) > watermark).select(F.explode(F.array(*columns)).alias("path"))
    return rows.where("path is not null").distinct()


def export_all(spark: SparkSession, exports: dict[str, Callable[[], int]]) -> DataFrame:
    """(table, rows): what each export returned; one that fails has -1 and the rest go on."""
    done = []
    for name, export in exports.items():
        try:
            done.append((name, int(export())))
        except Exception:  # noqa: BLE001  any failure of one table leaves the others alone
            done.append((name, -1))
    return spark.createDataFrame(done, "table string, rows long")
