"""Lineage graphs: closures, selection, components, cycles, waves and gates.

Edges are (src, dst). Iterations keep only a frontier: each round joins the newest nodes with the
edges, which are written out once, so a fixture or view behind them is not computed again. Rounds are
written to the shared scratch folder, so plans stay short; tables that no result reads are deleted.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.components import component_labels
from evenkeel.operators.peeling import peeled
from evenkeel.session import discard, is_scratch, materialize


def build_edges(assets: DataFrame) -> DataFrame:
    """(src, dst) from assets (asset, upstreams array)."""
    return assets.select(F.explode("upstreams").alias("src"), F.col("asset").alias("dst"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, upstreams, downstreams) as sorted lists; a side without neighbours is empty."""
    down = edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("downstreams"))
    up = edges.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_list("src")).alias("upstreams"))
    none = F.array().cast("array<string>")
    return down.join(up, "node", "full").select("node", F.coalesce("upstreams", none).alias("upstreams"), F.coalesce("downstreams", none).alias("downstreams"))


def adjacency_chunks(edges: DataFrame, most: int) -> DataFrame:
    """(node, side, chunk, neighbours): sorted lists of about ``most`` neighbours, so that a hub of any number is many rows.

    side is up or down. A neighbour's chunk follows from its name and the number of neighbours; repeated
    edges are repeated neighbours.
    """
    end = lambda node, side, other: F.struct(F.col(node).alias("node"), F.lit(side).alias("side"), F.col(other).alias("neighbour"))
    edges = materialize(edges)
    rows = edges.select(F.inline(F.array(end("dst", "up", "src"), end("src", "down", "dst"))))
    chunks = materialize(rows.groupBy("node", "side").agg(F.ceil(F.count(F.lit(1)) / most).alias("chunks")).where("chunks > 1"))
    number = F.conv(F.substring(F.md5("neighbour"), 1, 8), 16, 10).cast("long")
    dealt = rows.join(chunks, ["node", "side"], "left").withColumn("chunk", F.pmod(number, F.coalesce("chunks", F.lit(1))))
    return dealt.groupBy("node", "side", "chunk").agg(F.sort_array(F.collect_list("neighbour")).alias("neighbours"))


#: Levels of a closure that are put into one table, so that a deep closure doesn't read ever more of them.
FOLD = 8


def closure(edges: DataFrame, roots: DataFrame, direction: str = "down", depth: int | None = None) -> DataFrame:
    """(node, level): roots and all nodes reachable from them, with the least number of steps.

    direction is down (along edges) or up. Only the newest level is joined with the edges in each round;
    what it finds is held against the nodes seen so far, in at most ``FOLD`` tables. Edges that
    ``materialize`` wrote are read as they are, others are written first.
    """
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    written = is_scratch(edges)
    edges = edges if written else materialize(edges.select("src", "dst"))
    steps = edges.select(F.col(a).alias("__from"), F.col(b).alias("node"))
    level = 0
    at_level = lambda n: F.lit(n).cast("long").alias("level")
    seen = [materialize(roots.select(F.col(roots.columns[0]).alias("node")).distinct().select("node", at_level(0)))]
    frontier = seen[0]
    while depth is None or level < depth:
        level += 1
        found = frontier.select(F.col("node").alias("__from")).join(steps, "__from").select("node").distinct()
        frontier = materialize(found.join(reduce(DataFrame.unionByName, seen), "node", "left_anti").select("node", at_level(level)))
        if frontier.isEmpty():
            break
        seen.append(frontier)
        if len(seen) == FOLD:
            folded = materialize(reduce(DataFrame.unionByName, seen))
            discard(*seen[:-1])
            seen = [folded]
    if not written:
        discard(edges)
    return reduce(DataFrame.unionByName, seen)


def neighborhood(edges: DataFrame, roots: DataFrame, up: int, down: int) -> DataFrame:
    """Nodes at most ``up`` levels above or ``down`` levels below the roots."""
    return closure(edges, roots, "up", up).unionByName(closure(edges, roots, "down", down)).select("node").distinct()


def select_label(nodes: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Nodes (node, labels map) with a label, of a value if one is given; no match is an error."""
    found = nodes.where(F.map_contains_key("labels", key) if value is None else F.try_element_at("labels", F.lit(key)) == value).select("node")
    if found.isEmpty():
        raise ValueError(f"no node has the label {key}" + (f"={value}" if value is not None else ""))
    return found


def parse_selector(text: str) -> tuple[int | None, list[str], int | None]:
    """Levels up, the patterns to intersect, and levels down of ``N+pattern,pattern+M``.

    Levels are 0 without a plus sign and None, that is all, for one without a number.
    """
    up, patterns, down = re.fullmatch(r"(?:([0-9]*)\+)?+(.*?)(?:\+([0-9]*))?", text, re.DOTALL).groups()
    if not all(patterns.split(",")):
        raise ValueError(f"the selector {text!r} has an empty part")
    levels = lambda mark: 0 if mark is None else int(mark) if mark else None
    return levels(up), patterns.split(","), levels(down)


def select_one(nodes: DataFrame, edges: DataFrame, selector: str) -> DataFrame:
    """Nodes of one selector: those of all its patterns (a name, ``label:key`` or ``label:key=value``), with their surroundings.

    nodes: node, labels map. A pattern that nothing matches is an error.
    """
    up, patterns, down = parse_selector(selector)
    found = []
    for pattern in patterns:
        if pattern.startswith("label:"):
            key, given, value = pattern.removeprefix("label:").partition("=")
            if not key:
                raise ValueError("a label selector needs a key")
            found.append(select_label(nodes, key, value if given else None))
        else:
            named = nodes.where(F.col("node") == pattern).select("node")
            if named.isEmpty():
                raise ValueError(f"no node has the name {pattern}")
            found.append(named)
    roots = reduce(DataFrame.intersect, found)
    around = [closure(edges, roots, way, depth).select("node") for way, depth in (("up", up), ("down", down)) if depth != 0]
    return reduce(DataFrame.unionByName, around, roots).distinct()


def select(nodes: DataFrame, edges: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Nodes of any of the selectors, all nodes if there is none, without those of the excluding ones.

    Edges are written once for all selectors.
    """
    edges = edges if is_scratch(edges) else materialize(edges.select("src", "dst"))
    return select_nodes(nodes, [[select_one(nodes, edges, s)] for s in include], [[select_one(nodes, edges, s)] for s in exclude])


def select_nodes(nodes: DataFrame, include: Sequence[Sequence[DataFrame]], exclude: Sequence[Sequence[DataFrame]] = ()) -> DataFrame:
    """Set algebra over selections: inner lists intersect, outer lists unite, excluded nodes go; no list is all nodes."""
    intersect = lambda parts: reduce(DataFrame.intersect, [p.select("node") for p in parts])
    chosen = reduce(DataFrame.unionByName, map(intersect, include)).distinct() if include else nodes.select("node").distinct()
    for parts in exclude:
        chosen = chosen.join(intersect(parts), "node", "left_anti")
    return chosen


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): undirected components over all edges; only nodes of kind Asset come out."""
    labels = component_labels(edges, "src", "dst")
    return nodes.where("kind = 'Asset'").select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(found: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(component, assets, edges, too_many): sizes, and whether there are more components than ``most``."""
    assets = found.groupBy("component").agg(F.count(F.lit(1)).alias("assets"))
    starting = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("edges"))
    inside = found.join(starting, "node").groupBy("component").agg(F.sum("edges").alias("edges"))
    total = assets.agg((F.count(F.lit(1)) > most).alias("too_many"))
    return assets.join(inside, "component", "left").crossJoin(F.broadcast(total)).select("component", "assets", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), "too_many")


def cycle_residue(edges: DataFrame) -> DataFrame:
    """Nodes left when nodes without incoming edges are removed again and again: cycles and all below them."""
    return peeled(materialize(edges.select("src", "dst"))).where("wave is null").select("node")


def waves(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, wave): the longest path from a root, so every upstream has a smaller wave. Edges have no cycle.

    Nodes that only an edge names are there too; without ``nodes`` there are no others.
    """
    found = materialize(peeled(materialize(edges.select("src", "dst"))))
    if not found.where("wave is null").isEmpty():
        raise ValueError("the edges have a cycle")
    if nodes is None:
        return found
    alone = nodes.select("node").distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.withColumn("wave", F.lit(0).cast("long")))


def gate(assets: DataFrame, edges: DataFrame, readiness: DataFrame) -> DataFrame:
    """(asset, open): all upstreams Ready; unknown counts as not Ready, no upstream as open."""
    known = readiness.select(F.col("asset").alias("src"), "ready")
    judged = edges.join(known, "src", "left").groupBy(F.col("dst").alias("asset")).agg(F.bool_and(F.coalesce("ready", F.lit(False))).alias("__open"))
    return assets.select("asset").distinct().join(judged, "asset", "left").select("asset", F.coalesce("__open", F.lit(True)).alias("open"))


def initial_set(assets: DataFrame, edges: DataFrame, saved: DataFrame) -> DataFrame:
    """Assets to evaluate first after a restart: gate open and not Ready in the saved state."""
    return gate(assets, edges, saved).where("open").join(saved.where("ready").select("asset"), "asset", "left_anti").select("asset")


def propagate(transitions: DataFrame, edges: DataFrame) -> DataFrame:
    """(asset, cause): direct downstream assets of assets that became Ready."""
    became = transitions.select(F.col("asset").alias("src")).distinct()
    return edges.join(became, "src").select(F.col("dst").alias("asset"), F.col("src").alias("cause")).distinct()
