"""URL filters: allow and block entries in a trie over reversed host labels and path segments.

An entry is a host with an optional path that begins with ``/``. It fits its host and all
subdomains if the URL's path starts with the entry's path; the last segment of an entry may be a
part of a segment. Of all entries that fit, the longest (host and path together) decides; between
equally long ones block wins. The trie is broadcast: an entry list is configuration, and one of
more than ``MAX_ENTRIES`` is refused there; ``judge_by_join`` takes entry tables of any size.

A null URL, and one without ``://``, has an empty host and path and gets the default verdict. Rows
alike get verdicts alike, keys are not read, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm.common import prepared

MAX_ENTRIES = 1_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build_trie(entries: Iterable[tuple[str, str, str]]) -> dict:
    """Trie of (host, path, verdict) entries.

    A host node is {"labels": {label: node}, "paths": path node}; a path node is
    {"segments": {segment: node}, "ends": {part of the next segment: (length, rank, rule, verdict)}}.
    The key None in "ends" stands for a path that ends before the slash.
    """
    root: dict = {"labels": {}, "paths": None}
    for n, (host, path, verdict) in enumerate(entries):
        if n >= MAX_ENTRIES:
            raise ValueError(f"more than {MAX_ENTRIES} entries; too many to broadcast")
        if path and not path.startswith("/"):
            raise ValueError("a path begins with /")
        host = host.lower()
        node = root
        for label in reversed(host.split(".")):
            node = node["labels"].setdefault(label, {"labels": {}, "paths": None})
        at = node["paths"] = node["paths"] or {"segments": {}, "ends": {}}
        *full, last = path.split("/")[1:] or [None]
        for segment in full:
            at = at["segments"].setdefault(segment, {"segments": {}, "ends": {}})
        found = (len(host) + len(path), verdict == "block", host + path, verdict)
        at["ends"][last] = max(found, at["ends"].get(last, found))
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """Rule and verdict of the longest entry that fits, or None."""
    best = None
    segments = path.split("/")[1:] if path.startswith("/") else []
    node = trie
    for label in reversed(host.split(".")):
        node = node["labels"].get(label)
        if node is None:
            break
        at = node["paths"]
        if at is None:
            continue
        if None in at["ends"]:
            best = max(at["ends"][None], best or at["ends"][None])
        for i, segment in enumerate(segments):
            ends = at["ends"]
            if ends:
                for n in range(len(segment) + 1) if len(segment) < len(ends) else (len(e) for e in ends if e is not None):
                    if (found := ends.get(segment[:n])) is not None:
                        best = max(found, best or found)
            at = at["segments"].get(segment) if i + 1 < len(segments) else None
            if at is None:
                break
    return best and best[2:]


def judge_urls(df: DataFrame, url: str, entries: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict for the column ``url``; columns of these names are replaced."""
    trie = df.sparkSession.sparkContext.broadcast(build_trie(entries))

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        rules = trie.value
        for hosts, paths in batches:
            found = [longest_match(rules, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    judged = df.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    judged = judged.withColumn("__judged", judge("host", "path"))
    return judged.withColumns({"rule": F.col("__judged.rule"), "verdict": F.col("__judged.verdict")}).drop("__judged")


#: Characters of an entry's last segment that are part of its join key.
HEAD = 2


def judge_by_join(df: DataFrame, url: str, entries: DataFrame, default: str = "allow") -> DataFrame:
    """What ``judge_urls`` does, for a table of entries (host, path, verdict) too large to broadcast.

    An entry is known by its host, its whole segments and the first letters of its last one. Each
    distinct host and path looks up all its beginnings, as many as labels times segments, and keeps
    the longest of those that fit.
    """
    host, path = F.lower("host"), F.coalesce("path", F.lit(""))
    cut = F.length(path) - F.length(F.substring_index(path, "/", -1))
    listed = entries.select(host.alias("e_host"), path.alias("e_path"), F.substring(path, F.lit(1), cut).alias("e_whole"), F.substring_index(path, "/", -1).alias("e_last"), "verdict")
    listed = listed.withColumns({"e_head": F.substring("e_last", 1, HEAD), "rank": F.struct(F.length(F.concat("e_host", "e_path")).alias("length"), (F.col("verdict") == "block").alias("block"), F.concat("e_host", "e_path").alias("rule"), "verdict")})

    judged = df.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    places = judged.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    slashes = F.filter(F.transform(F.split("path", ""), lambda c, i: F.when(c == "/", i + 1)), lambda i: i.isNotNull())
    ends = F.array_union(F.array(F.lit(0)), slashes)
    found = places.select("host", "path", F.explode(tails).alias("e_host"), ends.alias("ends")).select("host", "path", "e_host", F.explode("ends").alias("end"))
    heads = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(HEAD)), lambda n: F.substring("path", F.col("end") + 1, n)))
    found = found.select("host", "path", "e_host", F.substring("path", F.lit(1), F.col("end")).alias("e_whole"), F.explode(heads).alias("e_head"))
    fits = found.join(listed, ["e_host", "e_whole", "e_head"]).where(F.startswith("path", F.col("e_path")))
    best = fits.groupBy("host", "path").agg(F.max("rank").alias("__best"))
    out = judged.join(best, ["host", "path"], "left")
    out = out.withColumns({"rule": F.col("__best.rule"), "verdict": F.coalesce("__best.verdict", F.lit(default))})
    return out.select(*[c for c in df.columns if c not in ("host", "path", "rule", "verdict")], "host", "path", "rule", "verdict")


RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = prepared(spark).read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, "url", RULES).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN url IS NULL THEN 0 ELSE strpos(url, '://') END AS mark FROM pages
), part AS (
  SELECT page_id, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM cut
), url AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM part
), rules(rule_host, rule_path, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host) + length(rule_path)) AS rule,
         max_by(v, length(rule_host) + length(rule_path)) AS v
  FROM (SELECT DISTINCT page_id, host, path FROM url) u JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM url u LEFT JOIN fits f ON u.page_id IS NOT DISTINCT FROM f.page_id
"""
