"""Templates, tags and job commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expand_template(text: Column, asset: Column, model_name: Column, values: Column) -> Column:
    """Replace {{ asset.name }}, {{ asset.modelName }} and {{ sync.<key> }}; unknown variables stay.

    A null model name falls back to the asset's name; values is a map, null for none.
    """
    out = F.replace(text, F.lit("{{ asset.name }}"), asset)
    out = F.replace(out, F.lit("{{ asset.modelName }}"), F.coalesce(model_name, asset))
    entries = F.coalesce(F.map_entries(values), F.array().cast("array<struct<key:string,value:string>>"))
    step = lambda acc, e: F.replace(acc, F.concat(F.lit("{{ sync."), e["key"], F.lit(" }}")), e["value"])
    return F.aggregate(entries, out, step)


def tags_to_labels(tags: Column, prefix: str = "dbt/") -> Column:
    """Map of prefixed tags to empty texts; a repeated tag counts once."""
    labels = F.transform(F.array_distinct(tags), lambda t: F.struct(F.concat(F.lit(prefix), t), F.lit("")))
    return F.map_from_entries(labels)


def selected_models(command: Column) -> Column:
    """Models named after each --select or -s in a job's command, without depth marks; x:y selectors are none."""
    state = "struct<flag:boolean,found:array<string>>"
    start = F.struct(F.lit(False).alias("flag"), F.array().cast("array<string>").alias("found")).cast(state)

    def step(acc: Column, word: Column) -> Column:
        found = F.when(acc["flag"], F.array_append(acc["found"], word)).otherwise(acc["found"])
        return F.struct((~acc["flag"] & word.isin("--select", "-s")).alias("flag"), found.alias("found")).cast(state)

    named = F.aggregate(F.split(command, r"\s+"), start, step)["found"]
    bare = F.transform(named, lambda w: F.regexp_replace(w, r"^[0-9]*\+|\+[0-9]*$", ""))
    return F.filter(bare, lambda w: (w != "") & ~F.contains(w, F.lit(":")))
