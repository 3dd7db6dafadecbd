"""Conditions: what a table must satisfy to count as in its desired state.

A condition comes down to a few aggregates of its table and a verdict over them. The verdict is one
of Ready, Drifted with a reason, and Error with a reason; an error never stops other conditions.
All conditions of one table whose aggregates are plain share a single pass over it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException, ParseException

from evenkeel.functions.times import micros

READY, DRIFTED, ERROR = "Ready", "Drifted", "Error"
RESULT = "state string, reason string"
Verdict = Callable[[Callable[[str], Column]], tuple[Column, Column]]


@dataclass(frozen=True)
class Condition:
    """aggregates: what to compute over the table, by alias; verdict: state and reason from the aliases.

    source, where given, turns the table into the rows that the aggregates are over; such a
    condition is evaluated in a pass of its own. Several that only count keys share one pass: ``keys``.
    """

    name: str
    kind: str
    aggregates: dict[str, Column]
    verdict: Verdict
    source: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)
    keys: tuple[str, ...] = ()


def _drift(ready: Column, reason: Column) -> tuple[Column, Column]:
    return F.when(ready, READY).otherwise(DRIFTED), F.when(~ready, reason)


def _none_of(count: Column, what: str) -> tuple[Column, Column]:
    return _drift(count == 0, F.format_string(f"%d {what}", count))


def freshness(column: str, max_age_s: int, now: Column, name: str = "freshness") -> Condition:
    """Ready iff now minus the newest value is at most the greatest age; no value is an error."""

    def verdict(get: Callable[[str], Column]) -> tuple[Column, Column]:
        return freshness_verdict(get("newest"), max_age_s, now)

    return Condition(name, "Freshness", {"newest": F.max(column)}, verdict)


def freshness_verdict(newest: Column, max_age_s: int, now: Column) -> tuple[Column, Column]:
    age = micros(now) - micros(newest)
    text = F.format_string(f"last updated %ds ago, max age is {max_age_s}s", F.floor(age / 1_000_000))
    state = F.when(newest.isNull(), ERROR).when(age <= max_age_s * 1_000_000, READY).otherwise(DRIFTED)
    return state, F.when(newest.isNull(), "no timestamp").when(age > max_age_s * 1_000_000, text)


def freshness_by(df: DataFrame, keys: Sequence[str], column: str, max_age_s: int, now: Column) -> DataFrame:
    """The freshness rule for every group of the keys in one pass."""
    state, reason = freshness_verdict(F.col("__newest"), max_age_s, now)
    return df.groupBy(*keys).agg(F.max(column).alias("__newest")).select(*keys, state.alias("state"), reason.alias("reason"))


def freshness_files(df: DataFrame, max_age_s: int, now: Column) -> DataFrame:
    """Freshness by the newest modification time of the files a table is read from."""
    newest = df.agg(F.max("_metadata.file_modification_time").alias("newest"))
    age = F.unix_micros(now) - F.unix_micros("newest")
    state = F.when(F.col("newest").isNull(), ERROR).when(age <= max_age_s * 1_000_000, READY).otherwise(DRIFTED)
    text = F.format_string(f"last updated %ds ago, max age is {max_age_s}s", F.floor(age / 1_000_000))
    return newest.select(state.alias("state"), F.when(F.col("newest").isNull(), "no timestamp").when(state == DRIFTED, text).alias("reason"))


def row_count(op: str, n: int, where: Column | None = None, name: str = "row_count") -> Condition:
    """Number of rows, of those that satisfy ``where`` if given, against n by one of = > >= < <= <>."""
    tests = {"=": "__eq__", "<>": "__ne__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}
    counted = F.count(F.lit(1)) if where is None else F.count_if(where)
    verdict = lambda get: _drift(getattr(get("rows"), tests[op])(n), F.format_string(f"%d rows, not {op} {n}", get("rows")))
    return Condition(name, "RowCount", {"rows": counted}, verdict)


def not_null(column: str | Column, name: str = "not_null") -> Condition:
    value = F.col(column) if isinstance(column, str) else column
    return Condition(name, "NotNull", {"nulls": F.count_if(value.isNull())}, lambda get: _none_of(get("nulls"), "null values"))


def accepted_values(column: str, values: Sequence[object], name: str = "accepted_values") -> Condition:
    """Every non-null value is one of ``values``."""
    return Condition(name, "AcceptedValues", {"others": F.count_if(~F.col(column).isin(*values))}, lambda get: _none_of(get("others"), "other values"))


def unique(*columns: str, name: str = "unique") -> Condition:
    """No key without a null occurs twice. Keys are counted before they are shuffled."""

    def source(df: DataFrame) -> DataFrame:
        present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        return df.where(present).groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")

    return Condition(name, "Unique", {"repeated": F.count(F.lit(1))}, lambda get: _none_of(get("repeated"), "repeated keys"), source, columns)


def repeated_keys(df: DataFrame, keys: Sequence[tuple[str, ...]]) -> tuple[DataFrame, list[Column]]:
    """For each set of columns the keys of ``df`` without a null that occur twice, counted in one pass by grouping sets.

    Returns a table of all repeated keys and, for each set, whether a row of it is a key of that set. Plain
    conditions stay out of that pass: their sums would be kept, and shuffled, for every key.
    """
    columns = sorted({c for k in keys for c in k})
    groups = df.groupingSets([list(k) for k in dict.fromkeys(map(tuple, map(sorted, keys)))], *columns)
    counted = groups.agg(F.count(F.lit(1)).alias("__n"), F.grouping_id().alias("__set")).where("__n > 1")
    number = lambda k: sum(1 << n for n, c in enumerate(reversed(columns)) if c not in k)
    return counted, [reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in k], F.col("__set") == number(k)) for k in keys]


def relationships(column: str, parent: DataFrame, parent_column: str, name: str = "relationships") -> Condition:
    """Every non-null value is in the parent's column; orphans are counted by row."""

    def source(df: DataFrame) -> DataFrame:
        keys = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
        return keys.join(parent.select(F.col(parent_column).alias("__parent")), F.col(column) == F.col("__parent"), "left_anti")

    return Condition(name, "Relationships", {"orphans": F.coalesce(F.sum("__n"), F.lit(0))}, lambda get: _none_of(get("orphans"), "orphan rows"), source)


def python_condition(predicate: Column, name: str = "python") -> Condition:
    """All rows satisfy a predicate, usually a pandas UDF of boolean type; null counts as false."""
    return Condition(name, "Python", {"failed": F.count_if(~F.coalesce(predicate, F.lit(False)))}, lambda get: _none_of(get("failed"), "rows failed"))


def evaluate(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """(condition, type, state, reason) for each condition of a table; plain ones share one aggregate, and so do several keys."""
    plain, keyed = [c for c in conditions if c.source is None], [c for c in conditions if c.keys]
    alone = [c for c in conditions if c.source and (not c.keys or len(keyed) < 2)]
    parts, groups = [], [(plain, df, None), *(([c], c.source(df), None) for c in alone)]
    if len(keyed) > 1:
        groups.append((keyed, *repeated_keys(df, [c.keys for c in keyed])))
    for group, rows, own in groups:
        if not group:
            continue
        named = [(f"c{n}_{alias}", F.count_if(own[n]) if own else column) for n, c in enumerate(group) for alias, column in c.aggregates.items()]
        one = rows.agg(*[column.alias(alias) for alias, column in named])
        results = []
        for n, c in enumerate(group):
            state, reason = c.verdict(lambda alias, n=n: F.col(f"c{n}_{alias}"))
            results.append(F.struct(F.lit(c.name).alias("condition"), F.lit(c.kind).alias("type"), state.alias("state"), reason.cast("string").alias("reason")))
        parts.append(one.select(F.inline(F.array(*results))))
    if not parts:
        return df.sparkSession.createDataFrame([], "condition string, type string, state string, reason string")
    return reduce(DataFrame.unionByName, parts)


def evaluate_assets(rules: dict[str, Sequence[Condition]], tables: dict[str, DataFrame]) -> DataFrame:
    """(asset, condition, type, state, reason) over many assets; an asset's name is its table's."""
    parts = [evaluate(tables[asset], conditions).select(F.lit(asset).alias("asset"), "*") for asset, conditions in sorted(rules.items())]
    return reduce(DataFrame.unionByName, parts)


def sql_condition(spark: SparkSession, query: str) -> DataFrame:
    """State of a user's query: the first column of its first row must be true or false, or such a word.

    The query stands in a FROM clause, so the parser refuses anything but one read-only query; a
    refusal and a failed analysis are errors like null, a number, other text and no row.
    """
    try:
        rows = spark.sql("SELECT * FROM (\n" + query.strip().rstrip(";") + "\n) LIMIT 1")
    except (ParseException, AnalysisException) as e:
        return spark.createDataFrame([(ERROR, type(e).__name__)], RESULT)
    first = F.col(f"`{rows.columns[0]}`")
    kind = rows.dtypes[0][1]
    value = F.lower(first.cast("string")) if kind in ("boolean", "string") else F.lit(None).cast("string")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.first(value).alias("value"), F.first(first.cast("string")).alias("shown"))
    state = F.when(F.col("value") == "true", READY).when(F.col("value") == "false", DRIFTED).otherwise(ERROR)
    reason = F.when(F.col("n") == 0, "no row").when(F.col("shown").isNull(), "null").when(F.col("value") == "false", "query returned false")
    reason = reason.when(state == ERROR, F.concat(F.lit("not a boolean: "), F.col("shown")))
    return found.select(state.alias("state"), F.when(state != READY, reason).alias("reason"))


def asset_ready(results: DataFrame, assets: DataFrame) -> DataFrame:
    """(asset, ready): all conditions Ready; an asset without conditions is Ready."""
    judged = results.groupBy("asset").agg(F.bool_and(F.col("state") == READY).alias("all_ready"))
    return assets.select("asset").distinct().join(judged, "asset", "left").select("asset", F.coalesce("all_ready", F.lit(True)).alias("ready"))


def ready_count(results: DataFrame, *keys: str) -> DataFrame:
    """Number of Ready conditions of each evaluation."""
    return results.groupBy(*keys).agg(F.count_if(F.col("result") == READY).alias("ready_count"))


def to_log_rows(evaluations: DataFrame) -> DataFrame:
    """A row for each condition of an evaluation (evaluation_id, asset, started_at, conditions); no reason is ''."""
    exploded = evaluations.select("evaluation_id", "asset", "started_at", F.explode("conditions").alias("c"))
    return exploded.select("evaluation_id", "c.condition_name", "asset", "started_at", F.col("c.state").alias("result"), F.coalesce("c.reason", F.lit("")).alias("detail"))
