"""Verdicts on URLs from host and path rules, found through a token index. Built-in functions only.

A rule is indexed under one literal token: of its tokens the one that the fewest URLs hold. The tokens of a URL fetch
candidate rules from the index, and only those run their regular expression. The index is a map in a single broadcast
row; its size is that of the rule list, a parameter. URLs are never shuffled: candidates live in an array on their row.

A null URL, or one without ``://``, has an empty host and path, fits no rule and gets the default verdict.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgraph.llm.common import lowered


@dataclass(frozen=True)
class Rule:
    """A literal host and path rule, or a pattern over host and path with the literal token it needs."""

    name: str | None
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the path starts with ``path``; longer rules win."""
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    # the part behind the last slash may be cut inside a word, so it is no token
    tokens = re.split("[^0-9a-z]+", f"{host}/{path.rpartition('/')[0]}".lower())
    return Rule(host + path, verdict, pattern, tuple(sorted({t for t in tokens if t})), 1_000_000 + len(host + path))


#: The literal rules, longest wins.
BASE = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words that block a URL when no literal rule fits, as a whole token of host or path.
BLOCKED_WORDS = ("porn", "xxx", "sex", "casino", "gambling", "poker", "viagra", "torrent", "warez", "phishing", "malware", "doubleclick", "adserver")
#: Literal rules outweigh patterns.
RULES = tuple(host_rule(*x) for x in BASE) + tuple(
    Rule(None, "block", rf"(?:^|[^0-9a-z]){w}(?:[^0-9a-z]|$)", (w,), len(w)) for w in BLOCKED_WORDS)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(lowered(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?>.*?://)[^/?#]*+(/[^?#]*)?", 1), F.lit(""))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """Add host, path, rule (null for none) and verdict."""
    spark = pages.sparkSession
    d = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    d = d.withColumn("_tokens", F.array_distinct(F.split(F.concat_ws(".", "host", F.lower("path")), "[^0-9a-z]+")))
    known = sorted({t for r in rules for t in r.tokens})
    schema = "id INT, name STRING, verdict STRING, pattern STRING, weight INT, tokens ARRAY<STRING>"
    listed = spark.createDataFrame([(i, r.name, r.verdict, r.pattern, r.weight, list(r.tokens)) for i, r in enumerate(rules)], schema)
    # how many URLs hold each rule token: one partially combined count over at most as many keys as the rules have tokens
    hits = d.select(F.explode(F.array_intersect("_tokens", F.array(*[F.lit(t) for t in known]))).alias("token")).groupBy("token").count()
    rarest = (listed.withColumn("token", F.explode("tokens")).join(hits, "token", "left")
              .groupBy("id", "name", "verdict", "pattern", "weight").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token")))
    per_token = rarest.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("weight", "id", "name", "verdict", "pattern"))).alias("rules"))
    index = per_token.agg(F.map_from_entries(F.collect_list(F.struct("token", "rules"))).alias("_index"))
    found = F.filter(F.flatten(F.transform(F.array_intersect("_tokens", F.map_keys("_index")), lambda t: F.col("_index")[t])),
                     lambda r: F.regexp_like(F.concat("host", F.when(r["name"].isNull(), F.lower("path")).otherwise(F.col("path"))), r["pattern"]))
    best = F.array_max(found)
    return (d.crossJoin(F.broadcast(index)).withColumn("_best", best)
            .withColumns({"rule": F.col("_best.name"), "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default))})
            .drop("_best", "_index", "_tokens"))
