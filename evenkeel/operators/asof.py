"""As-of joins and running values by window, with no range join.

Time is cut into chunks and each (key, chunk) is sorted on its own, so the rows of one busy key
spread over many tasks. What a chunk hands on to the next ones is its last right row; those rows, one
for each key and chunk, are filled along the chunks and joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.times import micros

CHUNK_US = 7 * 86_400 * 1_000_000


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    right_tie: str,
    match: str,
    direction: str = "backward",
    equal: bool = True,
    chunk: int = CHUNK_US,
) -> DataFrame:
    """``left`` with a struct ``match`` of the nearest right row at or before (backward) or after (forward) its time.

    equal: whether a right row of the same time counts. Of right rows of one time the greatest tie
    counts backward and the least forward. Without a right row ``match`` is null. Times are both
    timestamps (a chunk is in microseconds) or both whole numbers (a chunk is in their unit).
    """
    fields = F.struct(*[F.col(c) for c in right.columns if c not in by])
    l_struct = F.struct(*[F.col(c) for c in left.columns])
    r = right.select(*by, F.col(right_ts).alias("__ts"), F.lit(0 if equal else 2).alias("__side"), F.col(right_tie).cast("long").alias("__tie"), fields.alias("__right"))
    none_right = F.lit(None).cast(r.schema["__right"].dataType)
    l = left.select(*by, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__tie"), none_right.alias("__right"), l_struct.alias("__left"))
    r = r.withColumn("__left", F.lit(None).cast(l.schema["__left"].dataType))
    number = F.col("__ts").cast("long") if dict(r.dtypes)["__ts"] in ("bigint", "int") else micros("__ts")
    both = l.unionByName(r).withColumn("__chunk", F.floor(number / chunk))

    backward = direction == "backward"
    order = ["__ts", "__side", "__tie"] if backward else [F.desc("__ts"), F.asc("__side"), F.desc("__tie")]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("__near", F.last("__right", ignorenulls=True).over(before(Window.partitionBy(*by, "__chunk").orderBy(*order))))

    key = F.struct("__ts", "__tie")
    held = r.withColumn("__chunk", F.floor(number / chunk)).groupBy(*by, "__chunk").agg((F.max_by if backward else F.min_by)("__right", key).alias("__held"))
    chunks = both.where("__left is not null").select(*by, "__chunk").distinct().join(held, [*by, "__chunk"], "full")
    along = before(Window.partitionBy(*by).orderBy("__chunk" if backward else F.desc("__chunk")))
    filled = chunks.select(*by, "__chunk", F.last("__held", ignorenulls=True).over(along).alias("__far"))

    found = near.where("__left is not null").join(filled, [*by, "__chunk"], "left")
    return found.select("__left.*", F.coalesce("__near", "__far").alias(match))


def carry(
    df: DataFrame, by: Sequence[str], ts: str, order: Sequence[str], values: Mapping[str, tuple[str, Column]], current: bool = False, descending: bool = False, chunk: int = CHUNK_US
) -> DataFrame:
    """``df`` with running values of each key's rows: for each name a sum, the greatest value, or the last value that isn't null.

    values: name to (sum, max or last, expression). order begins with ``ts``; a row sees the rows before it,
    and itself if ``current``; with ``descending`` those after it, nearest last. Rows whose ``by`` is
    null see only their own chunk.
    """
    number = {name: f"__v{n}" for n, name in enumerate(values)}
    rows = df.withColumns({"__chunk": F.floor(micros(ts) / chunk)} | {number[k]: v for k, (_, v) in values.items()})
    asc = [F.desc(c) if descending else F.asc(c) for c in order]
    inside = Window.partitionBy(*by, "__chunk").orderBy(*asc).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    running = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    near = rows.withColumns({f"{number[k]}_near": running[how](number[k]).over(inside) for k, (how, _) in values.items()})

    pick = F.min_by if descending else F.max_by
    held = lambda c: pick(c, F.when(F.col(c).isNotNull(), F.struct(*order)))
    total = {"sum": F.sum, "max": F.max, "last": held}
    totals = rows.groupBy(*by, "__chunk").agg(*[total[how](number[k]).alias(number[k]) for k, (how, _) in values.items()])
    along = Window.partitionBy(*by).orderBy(F.desc("__chunk") if descending else F.asc("__chunk")).rowsBetween(Window.unboundedPreceding, -1)
    far = totals.select(*by, "__chunk", *[running[how](number[k]).over(along).alias(f"{number[k]}_far") for k, (how, _) in values.items()])

    both = near.join(far, [*by, "__chunk"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = {"sum": lambda near, far: zero(near) + zero(far), "max": F.greatest, "last": F.coalesce}
    out = {k: joined[how](f"{number[k]}_near", f"{number[k]}_far") for k, (how, _) in values.items()}
    return both.select(*[F.col(c) for c in df.columns if c not in out], *[v.alias(k) for k, v in out.items()])
