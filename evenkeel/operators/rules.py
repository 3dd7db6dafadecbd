"""Rule and metadata tables: assets, conditions, syncs, models and jobs as joins.

Assets have a name ``asset`` and entries (conditions, sync) in order; conditions are groups of named
conditions with a text, a type and an interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.text import expand_template, selected_models


def bind_rules(assets: DataFrame, conditions: DataFrame, syncs: DataFrame) -> DataFrame:
    """Each asset's entries with their conditions and sync, in entry order; unknown names drop out.

    assets: asset, entries array<struct<conditions, sync>>; conditions: conditions, ...; syncs: sync, ...
    """
    entries = assets.select("asset", F.posexplode("entries").alias("position", "entry"))
    entries = entries.select("asset", "position", "entry.conditions", "entry.sync")
    return entries.join(conditions, "conditions").join(syncs, "sync")


def expand_rules(rules: DataFrame, text: str, model_name: str | None = None, values: str | None = None) -> DataFrame:
    """``rules`` with template variables of the text column filled in."""
    model = F.col(model_name) if model_name else F.lit(None).cast("string")
    found = F.col(values) if values else F.lit(None).cast("map<string,string>")
    return rules.withColumn(text, expand_template(F.col(text), F.col("asset"), model, found))


def plan_rules(rules: DataFrame) -> DataFrame:
    """What an evaluation would look at, without evaluating: asset, position, conditions, text."""
    return rules.select("asset", "position", "conditions", "text")


def unresolved(refs: DataFrame, ref: str, catalog: DataFrame, name: str) -> DataFrame:
    """Rows whose non-null reference the catalogue doesn't have."""
    known = catalog.select(F.col(name).alias("__known")).distinct()
    return refs.where(F.col(ref).isNotNull()).join(known, F.col(ref) == F.col("__known"), "left_anti")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def merge_entries(before: DataFrame, generated: DataFrame, after: DataFrame) -> DataFrame:
    """Entries (asset, position, ...) of three origins, numbered in order within each asset."""
    parts = [df.withColumn("__rank", F.lit(n)) for n, df in enumerate((before, generated, after))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    order = Window.partitionBy("asset").orderBy("__rank", "position")
    return every.withColumn("merged", F.row_number().over(order) - 1).drop("__rank", "position")


def _relation(df: DataFrame) -> list[Column]:
    return [F.lower(df[c]) for c in ("db", "sch", "ident")]


def link_relations(sources: DataFrame, models: DataFrame) -> DataFrame:
    """(source_id, model_id) of relations equal but for case, of different origins.

    Both sides: db, sch, ident, origin and an id. A null database or schema never matches.
    """
    m = models.select(*[x.alias(f"m_{c}") for c, x in zip(("db", "sch", "ident"), _relation(models), strict=True)], F.col("origin").alias("m_origin"), "model_id")
    s = sources.select(*[x.alias(c) for c, x in zip(("db", "sch", "ident"), _relation(sources), strict=True)], "origin", "source_id")
    same = [F.col(c) == F.col(f"m_{c}") for c in ("db", "sch", "ident")]
    return s.join(m, same, "inner").where("origin <> m_origin").select("source_id", "model_id")


def rewire_upstreams(edges: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (upstream, asset) with linked sources replaced by their models, without the sources' own; and the replaced names."""
    names = links.select(F.col("source").alias("__source"), F.col("model").alias("__model"))
    kept = edges.join(names, F.col("asset") == F.col("__source"), "left_anti")
    moved = kept.join(names, F.col("upstream") == F.col("__source"), "left")
    return moved.select(F.coalesce("__model", "upstream").alias("upstream"), "asset"), names.select(F.col("__source").alias("asset")).distinct()


def duplicate_outputs(models: DataFrame) -> DataFrame:
    """Relations written by more than one model, with the number and the sorted origins."""
    named = models.select(*[x.alias(c) for c, x in zip(("db", "sch", "ident"), _relation(models), strict=True)], "origin")
    grouped = named.groupBy("db", "sch", "ident").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("origin")).alias("origins"))
    return grouped.where("n > 1")


def tests_by_model(nodes: DataFrame) -> DataFrame:
    """(node, tests): sorted test nodes under each model or source they depend on.

    nodes: id, kind, depends_on array.
    """
    tests = nodes.where("kind = 'test'").select(F.col("id").alias("test"), F.explode("depends_on").alias("node"))
    targets = nodes.where("kind in ('model', 'source')").select("id")
    held = tests.join(targets, F.col("node") == F.col("id"), "left_semi")
    return held.groupBy("node").agg(F.sort_array(F.collect_list("test")).alias("tests"))


def resolve_upstreams(deps: DataFrame, sources: DataFrame, models: DataFrame) -> DataFrame:
    """(id, upstream): dependency ids as asset names; sources first, then models, else dropped."""
    s = sources.select(F.col("id").alias("s_id"), F.col("name").alias("s_name"))
    m = models.select(F.col("id").alias("m_id"), F.col("name").alias("m_name"))
    found = deps.join(s, F.col("dep") == F.col("s_id"), "left").join(m, F.col("dep") == F.col("m_id"), "left")
    return found.select("id", F.coalesce("s_name", "m_name").alias("upstream")).where("upstream is not null")


def job_mapping(jobs: DataFrame) -> DataFrame:
    """(model, job_ids): jobs (job_id, commands array) by the models their commands select."""
    picked = jobs.select("job_id", F.explode("commands").alias("command")).select("job_id", F.explode(selected_models(F.col("command"))).alias("model"))
    return picked.groupBy("model").agg(F.sort_array(F.collect_set("job_id")).alias("job_ids"))


def running_conflicts(runs: DataFrame, mapping: DataFrame) -> DataFrame:
    """(model, run_id) of running jobs that belong to a model's job set."""
    wanted = mapping.select("model", F.explode("job_ids").alias("job_id"))
    return runs.where("status = 'running'").join(wanted, "job_id").select("model", "run_id", "job_id")


def rule_warnings(assets: DataFrame) -> DataFrame:
    """(asset, warning): NoOnDrift without entries, NoEvalTriggers without upstreams and intervals; else null.

    assets: asset, n_entries, n_upstreams, min_interval.
    """
    warning = F.when(F.col("n_entries") == 0, "NoOnDrift").when((F.col("n_upstreams") == 0) & F.col("min_interval").isNull(), "NoEvalTriggers")
    return assets.select("asset", warning.alias("warning"))


def min_interval(rules: DataFrame, assets: DataFrame) -> DataFrame:
    """(asset, min_interval): the least condition interval, null when there is none."""
    least = rules.groupBy("asset").agg(F.min("interval_s").alias("min_interval"))
    return assets.select("asset").distinct().join(least, "asset", "left")


KINDS = ("asset", "connection", "sync", "conditions")


def _dealt(rules: DataFrame) -> DataFrame:
    """``rules`` dealt by asset over as many tasks as a shuffle has.

    Groups that are as many as assets become no fewer before a shuffle: there a task would hold those of all the rows it reads.
    """
    return rules.repartition(int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions")), "asset")


def asset_summaries(assets: DataFrame, rules: DataFrame) -> DataFrame:
    """Each asset (asset, labels, upstreams, auto_sync) with its ``entries``, structs of conditions and sync in order of position."""
    placed = F.sort_array(F.collect_list(F.struct("position", "conditions", "sync")))
    entries = _dealt(rules).groupBy("asset").agg(F.transform(placed, lambda e: F.struct(e["conditions"].alias("conditions"), e["sync"].alias("sync"))).alias("entries"))
    none = F.array().cast("array<struct<conditions:string,sync:string>>")
    return assets.join(entries.hint("merge"), "asset", "left").withColumn("entries", F.coalesce("entries", none))


def catalog(rules: DataFrame, conditions: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(kind, name, n_assets, condition_names): what the rules refer to, by kind, in any case; condition groups with their sorted names.

    rules: asset, connection, sync, conditions; conditions: conditions, condition_name.
    """
    wanted = [k.lower() for k in kinds]
    if unknown := set(wanted) - set(KINDS):
        raise ValueError(f"no such kind: {', '.join(sorted(unknown))}")
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in wanted]))
    named = _dealt(rules.select(*dict.fromkeys(["asset", *wanted]))).select("asset", entries.alias("e")).select("asset", "e.kind", "e.name").where("name is not null")
    counted = named.groupBy("kind", "name").agg(F.count_distinct("asset").alias("n_assets"))
    groups = conditions.groupBy(F.col("conditions").alias("__group")).agg(F.sort_array(F.collect_set("condition_name")).alias("condition_names"))
    return counted.join(groups, (F.col("kind") == "conditions") & (F.col("name") == F.col("__group")), "left").drop("__group")
