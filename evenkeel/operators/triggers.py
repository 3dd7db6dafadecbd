"""Greedy coalescing of triggers: which of an asset's triggers start a run, the rest being absorbed.

The first trigger is accepted, and after an accepted one the first that comes at or after its end. So
every trigger points to the one that would be accepted next, and the accepted ones are the path from an
asset's first trigger. An asset may have any number of triggers:

1. Triggers are numbered in order, by windows within chunks of time and the chunks' counts, and a forward
   as-of join finds where each points.
2. An asset's triggers fall into blocks of ``BLOCK`` numbers. Only triggers to which an earlier block
   points can be where the path enters a block. For these a task doubles pointers until they leave the
   block, so each gets the place where the path would go on.
3. The places where the path does enter are found by doubling over these candidates: a round for each
   doubling of the number of blocks, none where an asset has one block.
4. Each block is entered once at most, and a task marks the path through it, by doubling again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.operators.asof import CHUNK_US, asof_join
from evenkeel.session import discard, materialize

#: Triggers of an asset that a task handles at once.
BLOCK = 100_000
#: Where a trigger points that is the last its path could accept.
NOWHERE = 2**62


def numbered(df: DataFrame, by: str, time: str, ties: Sequence[str], chunk: int = CHUNK_US) -> DataFrame:
    """``df`` with ``n``, counting the rows of each ``by`` from 1 in the order of (time, ties); time is a whole number.

    A busy key's rows are sorted by chunks of time; the counts of the chunks before are added.
    """
    rows = df.withColumn("__chunk", F.floor(F.col(time) / chunk))
    before = Window.partitionBy(by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(by, "__chunk").agg(F.count(F.lit(1)).alias("__rows"))
    counts = counts.select(by, "__chunk", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(by, "__chunk").orderBy(time, *ties))
    found = rows.withColumn("__within", within).join(counts, [by, "__chunk"])
    return found.select(*df.columns, (F.col("__before") + F.col("__within")).alias("n"))


def _block(table: pa.Table) -> tuple[pa.Table, np.ndarray, int]:
    """A block's rows by number, where each points as an index (those that leave the block at its end or beyond), and the first number."""
    rows = table.sort_by("n")
    n = rows.column("n").to_numpy()
    return rows, rows.column("succ").to_numpy() - n[0], int(n[0])


def _exits(table: pa.Table) -> pa.Table:
    """Where the path from each candidate of a block leaves it."""
    rows, to, first = _block(table)
    while (inside := to < len(to)).any():
        to = np.where(inside, to[np.where(inside, to, 0)], to)
    chosen = rows.column("candidate").to_numpy(zero_copy_only=False)
    picked = rows.filter(pa.array(chosen))
    return pa.table({"asset": picked.column("asset"), "n": picked.column("n"), "next": to[chosen] + first})


def _marked(table: pa.Table) -> pa.Table:
    """A block's rows with ``accepted``: whether they are on the path from where it enters, if it does."""
    rows, to, _ = _block(table)
    accepted = rows.column("entry").to_numpy(zero_copy_only=False).astype(bool)
    end = len(to)
    on_path, to = np.append(accepted, False), np.append(np.minimum(to, end), end)
    while (to[:end] < end).any():
        on_path[to[on_path]] = True
        to = to[to]
    kept = rows.select(["asset", "execution_id", "start_us", "duration_s"])
    return kept.append_column("accepted", pa.array(on_path[:end]))


def _entries(rows: DataFrame, blocks: int) -> DataFrame:
    """(asset, n) at which each asset's path enters its blocks. rows: asset, n, succ, block."""
    path = rows.where("n = 1").select("asset", "n")
    if blocks < 2:
        return path
    candidates = rows.where((F.col("succ") - 1) >= (F.col("block") + 1) * BLOCK).select("asset", F.col("succ").alias("n")).unionByName(path).distinct()
    flagged = rows.select("asset", "block", "n", "succ").join(candidates.withColumn("candidate", F.lit(True)), ["asset", "n"], "left").withColumn("candidate", F.coalesce("candidate", F.lit(False)))
    jumps = materialize(flagged.groupBy("asset", "block").applyInArrow(_exits, f"asset {dict(rows.dtypes)['asset']}, n long, next long"))
    for _ in range((blocks - 1).bit_length()):
        landed = path.join(jumps, ["asset", "n"]).select("asset", F.col("next").alias("n"))
        onward = jumps.select("asset", F.col("n").alias("next"), F.col("next").alias("later"))
        path, longer = materialize(path.unionByName(landed).distinct()), materialize(jumps.join(onward, ["asset", "next"]).select("asset", "n", F.col("later").alias("next")))
        discard(jumps)
        jumps = longer
    return path


def coalesce_triggers(triggers: DataFrame) -> DataFrame:
    """Triggers with ``accepted``: one that comes before the last accepted one's end is absorbed.

    triggers: asset, execution_id, start_us, duration_s. Of equal times the smaller execution id comes
    first, and then the shorter duration; a duration that is null, zero or negative ends at once. A trigger without an asset or a start is
    never accepted.
    """
    kinds = dict(triggers.dtypes)
    given = triggers.select("asset", "execution_id", F.col("start_us").cast("long").alias("start_us"), F.col("duration_s").cast("long").alias("duration_s"))
    whole = F.col("asset").isNotNull() & F.col("start_us").isNotNull()
    known = materialize(numbered(given.where(whole), "asset", "start_us", ["execution_id", "duration_s"]))
    end = F.col("start_us") + F.greatest(F.coalesce("duration_s", F.lit(0)), F.lit(0)) * 1_000_000
    starts = known.select("asset", "start_us", "n")
    pointed = asof_join(known.withColumn("end_us", end), starts, ["asset"], "end_us", "start_us", "n", "next", "forward")
    succ = F.when(F.col("next.n").isNotNull(), F.greatest(F.col("next.n"), F.col("n") + 1)).otherwise(F.lit(NOWHERE))
    rows = materialize(pointed.select(*given.columns, "n", succ.alias("succ"), F.floor((F.col("n") - 1) / BLOCK).alias("block")))
    blocks = 1 + (rows.agg(F.max("block")).head()[0] or 0)
    entered = _entries(rows, blocks).withColumn("entry", F.lit(True))
    ready = rows.join(entered, ["asset", "n"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    schema = f"asset {kinds['asset']}, execution_id {kinds['execution_id']}, start_us long, duration_s long, accepted boolean"
    found = ready.groupBy("asset", "block").applyInArrow(_marked, schema)
    discard(known)
    return found.unionByName(given.where(~whole).withColumn("accepted", F.lit(False)))
