"""Allow and block lists for URLs, as a trie over reversed host labels and path segments."""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A trie goes to every executor only up to this many bytes of rule text; beyond, rules are joined.
BROADCAST_BYTES = 32 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VERDICT = "host string, path string, rule string, verdict string"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nested tables from (action, host, path): one level for each host label from the right, then
    one for each full path segment. The last, partial segment of a rule is kept at its node with
    (rule, action); of two rules for the same place, block wins."""
    root: dict = {"labels": {}}
    for action, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node["labels"].setdefault(label, {"labels": {}})
        node = node.setdefault("path", {"segments": {}, "tails": {}})
        *full, tail = path.split("/")
        for segment in full:
            node = node["segments"].setdefault(segment, {"segments": {}, "tails": {}})
        if node["tails"].get(tail, ("", "allow"))[1] != "block":
            node["tails"][tail] = (host + path, action)
    return root


def _longest(node: dict, segments: list[str]) -> tuple[str, str] | None:
    found = None
    for segment in segments:
        fits = [t for t in node["tails"] if segment.startswith(t)]
        if fits:
            found = node["tails"][max(fits, key=len)]
        node = node["segments"].get(segment)
        if node is None:
            break
    return found


def look_up(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, action) of the longest match: of the most host labels, then of the longest path."""
    nodes, node = [], trie
    for label in reversed(host.split(".")):
        node = node["labels"].get(label)
        if node is None:
            break
        if "path" in node:
            nodes.append(node["path"])
    segments = path.split("/")
    for node in reversed(nodes):
        if found := _longest(node, segments):
            return found
    return None


def _by_trie(urls: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(pickle.dumps(build_trie(rules)))
    tries: list[dict] = []

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        if not tries:
            tries.append(pickle.loads(shared.value))
        found = [look_up(tries[0], h, p) or (None, default) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    return urls.withColumn("_found", judge("host", "path")).select(
        *urls.columns, F.col("_found.rule").alias("rule"), F.col("_found.verdict").alias("verdict"))


def _by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for rules too large to be sent: every host suffix of a distinct (host, path) meets
    the rules of that host."""
    labels = F.split("host", r"\.")
    distinct = urls.select("host", "path").distinct()
    suffixes = distinct.select(
        "host", "path", F.posexplode(labels).alias("_from", "_label"), labels.alias("_labels")
    ).select("host", "path", F.concat_ws(".", F.slice("_labels", F.col("_from") + 1, F.size("_labels"))).alias("_host"))
    ruled = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("action").alias("_action"))
    best = (
        suffixes.join(ruled, "_host").filter(F.startswith("path", F.col("_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(
            F.size(F.split("_host", r"\.")).alias("labels"), F.length("_path").alias("length"),
            F.col("_action").alias("action"), F.concat("_host", "_path").alias("rule"))).alias("_best"))
    )
    return urls.join(best, ["host", "path"], "left").select(
        *urls.columns, F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"))


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    url_col: str = "url",
    default: str = "allow",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` (allow or block).

    ``rules`` has ``action`` (allow or block), ``host`` and ``path``. A rule fits its host and all
    subdomains when the path begins with the rule's path. The longest match decides: of the most
    host labels, then of the longest path; at the very same place block wins. Without a match
    ``rule`` is null and the verdict ``default``. A null URL, or one without ``://``, has an empty
    host and path and no match. Rules with null host or path are ignored, other actions refused.

    The rule text is measured first: up to ``broadcast_bytes`` it is sent to the executors as one
    trie, beyond that rules are joined. Columns of ``pages`` named like a new one are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    rules = rules.select("action", "host", "path").dropna().distinct()
    measure = rules.agg(
        F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 16), F.lit(0)).alias("bytes"),
        F.coalesce(F.max(~F.col("action").isin("allow", "block")), F.lit(False)).alias("odd")).first()
    if measure["odd"]:
        raise ValueError("a rule's action is allow or block")
    host, path = split_url(F.col(url_col))
    urls = pages.withColumns({"host": host, "path": path})
    if measure["bytes"] <= broadcast_bytes:
        return _by_trie(urls, [tuple(r) for r in rules.collect()], default)
    return _by_join(urls, rules, default)
