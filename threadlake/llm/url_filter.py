"""URL allow and block lists: a broadcast trie over reversed host labels and path segments.

A rule fits its host and all subdomains where the url's path starts with the rule's path; the rule with the most host labels
wins, then the one with the longest path; of one rule in both lists, block wins. Tries are bounded in size: a longer list is split
over several tries, each broadcast in its turn and walked in a narrow pass that keeps the better match.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TRIE_CHARS = 16_000_000  # of rules in one broadcast trie; a node takes some hundred bytes
URL_HOST = r"(?s)^.*?://([^/?#]*)"
URL_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DOWN = str.maketrans(_UPPER, _LOWER)

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def split_rule(rule: str) -> tuple[str, str]:
    """Host and path of a rule such as ``example.com/en/``; a rule without a slash has an empty path, which any path starts with."""
    host, slash, path = rule.partition("/")
    return host.translate(_DOWN), slash + path


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of an url; both are empty where it is null or has no ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    host = rest[: min(ends, default=len(rest))]
    path = rest[len(host) :]
    ends = [i for i in map(path.find, "?#") if i >= 0]
    return host.translate(_DOWN), path[: min(ends, default=len(path))]


class Trie:
    """Nodes are dicts. Host nodes: label -> node, "" -> path node. Path nodes: segment (with the slash that ends it) -> node,
    None -> (length, verdict, rule) for a rule that ends here, "" -> rules that end within a segment, longest first."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.root: dict = {}
        for verdict, rule in rules:
            host, path = split_rule(rule)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("", {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment + "/", {})
            if last:
                node.setdefault("", []).append((last, (len(path), verdict, rule)))
                node[""].sort(key=lambda x: (-len(x[0]), x[1][1] != "block"))
            elif None not in node or verdict == "block":
                node[None] = (len(path), verdict, rule)

    @staticmethod
    def _path(node: dict, path: str):
        found, at = None, 0
        while True:
            found = node.get(None, found)
            for part, what in node.get("", ()):
                if path.startswith(part, at):
                    found = what
                    break
            slash = path.find("/", at)
            node = node.get(path[at : slash + 1]) if slash >= 0 else None
            if node is None:
                return found
            at = slash + 1

    def match(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """(host labels, path length, verdict, rule) of the longest rule that fits."""
        node, best = self.root, None
        for depth, label in enumerate(reversed(host.split(".")), 1):
            node = node.get(label)
            if node is None:
                break
            if "" in node and (found := self._path(node[""], path)):
                best = (depth, *found)
        return best


def tries(rules: list[tuple[str, str]], limit: int = MAX_TRIE_CHARS) -> list[Trie]:
    out, part, size = [], [], 0
    for verdict, rule in rules:
        if part and size + len(rule) > limit:
            out, part, size = [*out, Trie(part)], [], 0
        part.append((verdict, rule))
        size += len(rule)
    return [*out, Trie(part)]


_KIND = "host string, path string, labels int, length int, rule string, verdict string"
_ARROW = pa.struct([("host", pa.string()), ("path", pa.string()), ("labels", pa.int32()), ("length", pa.int32()), ("rule", pa.string()), ("verdict", pa.string())])


def _walker(shared):
    @F.arrow_udf(_KIND)
    def walk(urls: pa.Array) -> pa.Array:
        out = []
        for url in urls.to_pylist():
            host, path = split_url(url)
            labels, length, verdict, rule = shared.value.match(host, path) or (0, 0, None, None)
            out.append({"host": host, "path": path, "labels": labels, "length": length, "rule": rule, "verdict": verdict})
        return pa.array(out, _ARROW)

    return walk


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url_col: str = "url", default: str = "allow", limit: int = MAX_TRIE_CHARS) -> DataFrame:
    """``pages`` with a struct column ``url_match``: host, path, rule (null where none fits) and verdict (then ``default``).

    A null url, one without ``://`` and an empty one have an empty host and path and fit no rule with a host. An url of any
    length is walked whole. An empty rule list gives every row the default; an empty table an empty result. A column of
    ``pages`` that is called ``url_match`` is replaced.
    """
    context = pages.sparkSession.sparkContext
    best = None
    for trie in tries(rules, limit):
        walk = _walker(context.broadcast(trie))
        here = walk(F.col(url_col).cast("string"))
        if best is None:
            pages, best = pages.withColumn("url_match", here), F.col("url_match")
        else:
            old, new = F.col("url_match"), F.col("_next_match")
            pages = pages.withColumn("_next_match", here)
            tie = (new.labels == old.labels) & (new.length == old.length)
            better = (new.labels > old.labels) | ((new.labels == old.labels) & (new.length > old.length)) | (tie & (new.verdict == "block"))
            pages = pages.withColumn("url_match", F.when(better, new).otherwise(old)).drop("_next_match")
    m = F.col("url_match")
    return pages.withColumn("url_match", F.struct(m.host.alias("host"), m.path.alias("path"), m.rule.alias("rule"), F.coalesce(m.verdict, F.lit(default)).alias("verdict")))
