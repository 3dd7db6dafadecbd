"""What the corpus operators share: reading documents and settings of the Arrow exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenkeel.session import ship_package

#: Rows and bytes in one Arrow batch. Documents run to megabytes, so both are bounded.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def prepared(spark: SparkSession) -> SparkSession:
    """Make a session ready for operators that run Python on the executors.

    Batch settings that the caller has not made are made for the session; those there are stay.
    """
    ship_package(spark)
    for name, value in BATCH.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(value))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
