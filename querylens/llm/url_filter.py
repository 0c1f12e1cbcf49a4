"""URL filters: a trie over reversed host labels and path segments, longest match first.

Rules are (verdict, host, path). A rule fits its host and all subdomains when the url's path starts
with the rule's path. Among fitting rules the longest ``host + path`` wins; of equally long ones the
longer host, then ``block``.

Null urls and urls without ``://`` have an empty host and path, fit no rule and get the default
verdict. Empty tables give empty results; repeated rows give repeated rows; very long urls
are walked whole, segment by segment; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def order(self) -> tuple:
        return (len(self.text), len(self.host), self.verdict == "block")


#: The rules that the query judges pages by.
PAGE_RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

#: A trie of more bytes than this isn't broadcast; the rules are then joined as a table.
MAX_TRIE_BYTES = 64 << 20


class UrlTrie:
    """Host labels from the right; below each host that has rules, path segments from the left.

    A node is ``[children, paths]``; a path node is ``[children, tails]``, where tails are the
    rules whose path ends within the next segment.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: list = [{}, None]
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node[0].setdefault(label, [{}, None])
            node[1] = node[1] or [{}, []]
            *segments, tail = rule.path.split("/")
            at = node[1]
            for s in segments:
                at = at[0].setdefault(s, [{}, []])
            at[1].append((tail, rule))

    def find(self, host: str, path: str) -> Rule | None:
        best = None
        node = self.root
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1]:
                at = node[1]
                for segment in path.split("/"):
                    for tail, rule in at[1]:
                        if segment.startswith(tail) and (best is None or rule.order > best.order):
                            best = rule
                    at = at[0].get(segment)
                    if at is None:
                        break
        return best


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _parts(df: DataFrame, url: str) -> DataFrame:
    return df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))


def filter_urls(df: DataFrame, rules: Iterable[Rule] = PAGE_RULES, *, key: str = "page_id", url: str = "url", default: str = "allow", max_trie_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """``key, host, path, rule, verdict`` of each row. The trie is broadcast while its size allows."""
    rules = list(rules)
    trie = UrlTrie(rules)
    if len(pickle.dumps(trie)) > max_trie_bytes:
        return filter_urls_by_join(df, rules, key=key, url=url, default=default)
    shared = df.sparkSession.sparkContext.broadcast(trie)

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = shared.value.find
        for hosts, paths in batches:
            found = [find(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [r and r.text for r in found], "verdict": [r.verdict if r else default for r in found]}, dtype=object)

    got = _parts(df.select(key, url), url).withColumn("r", judge("host", "path"))
    return got.select(key, "host", "path", "r.rule", "r.verdict")


def filter_urls_by_join(df: DataFrame, rules: Iterable[Rule], *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """The same result for rule sets too large to broadcast: each url meets the rules of every suffix of its host.

    Spark joins on the host; rows are numbered by content, so repeated rows stay apart by their count.
    """
    spark = df.sparkSession
    rows = _parts(df.select(key, url), url)
    table = spark.createDataFrame([(r.host, r.path, r.text, r.verdict, len(r.text), len(r.host), int(r.verdict == "block")) for r in rules], "r_host string, r_path string, rule string, r_verdict string, size int, host_size int, blocks int")
    sites = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = sites.withColumn("r_host", F.explode(suffixes)).join(table, "r_host").where("startswith(path, r_path)")
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "r_verdict"), F.struct("size", "host_size", "blocks")).alias("b"))
    return rows.join(best, ["host", "path"], "left").select(key, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.r_verdict", F.lit(default)).alias("verdict"))
