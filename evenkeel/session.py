"""Helpers around the session: shipping this package, the shared scratch folder, a local session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from pathlib import Path
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

T = TypeVar("T")
PACKAGE = Path(__file__).resolve().parent
#: Tables of the scopes that are open in this thread or context.
_scopes: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("evenkeel_scopes", default=())


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for operators that run Python there."""
    sc = spark.sparkContext
    if getattr(sc, "_evenkeel_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "evenkeel.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(target)
    sc._evenkeel_shipped = True


def shared_folder(configured: str | None, master: str) -> str | None:
    """The folder for scratch tables: the configured one, or none of that only where everything runs in this process."""
    if not configured and not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured or None


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name in the shared scratch folder that ``spark.checkpoint.dir`` names.

    Without that setting a local session uses a temporary folder of this machine; a cluster is refused.
    """
    base = shared_folder(spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master)
    if not base:
        base = getattr(spark.sparkContext, "_evenkeel_scratch", None) or tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext._evenkeel_scratch = base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends at a durable table.

    ``discard`` deletes the table. What an operator's lazy result still reads stays there.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    out = scratch_table(spark, path, df.schema)
    if open_scopes := _scopes.get():
        open_scopes[-1].append(out)
    return out


def scratch_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A table in the scratch folder, which ``discard`` can delete."""
    out = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    out._evenkeel_path = path
    return out


def is_scratch(df: DataFrame) -> bool:
    """Whether ``df`` is a table as ``materialize`` wrote it, so that reading it again computes nothing."""
    return hasattr(df, "_evenkeel_path")


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing will read them any more."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, getattr(df, "_evenkeel_path", None)
        if path:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Delete on leaving all tables that ``materialize`` wrote inside; only results written elsewhere outlast it.

    A scope is that of its thread, and of threads that run in a copy of its context (see ``side_by_side``).
    """
    tables: list[DataFrame] = []
    before = _scopes.set((*_scopes.get(), tables))
    try:
        yield
    finally:
        _scopes.reset(before)
        discard(*tables)


def side_by_side(spark: SparkSession, tasks: Sequence[Callable[[], T]], most: int = 8) -> list[T]:
    """What the tasks return, of which up to ``most`` run at a time, each in a thread with the caller's Spark properties and open scopes.

    A task's jobs are in a scheduler pool of its own, which makes a difference if ``spark.scheduler.mode`` is FAIR.
    """

    def pooled(n: int, task: Callable[[], T]) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"evenkeel-{n % most}")
        return task()

    with ThreadPoolExecutor(most) as pool:
        contexts = [copy_context() for _ in tasks]
        runs = [pool.submit(inheritable_thread_target(spark)(lambda n=n, task=task: contexts[n].run(pooled, n, task))) for n, task in enumerate(tasks)]
        return [r.result() for r in runs]


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName("evenkeel").config(map=settings).getOrCreate()
