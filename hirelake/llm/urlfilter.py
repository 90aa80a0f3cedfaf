"""URL filtering by a broadcast trie over reversed host labels and path segments."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rule list is broadcast whole, so its size is checked.
MAX_RULES = 1_000_000
DEFAULT_VERDICT = "allow"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    #: Rules whose path ends inside the next segment, as (prefix of that segment, rule).
    ends: list[tuple[str, Rule]] = field(default_factory=list)
    #: The trie over path segments of the rules for this host; None where no rule names the host.
    paths: Node | None = None


def build_trie(rules: list[Rule]) -> Node:
    """Host labels from the right, then whole path segments; equal (host, path) pairs prefer block."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; a broadcast trie takes {MAX_RULES} at most")
    root = Node()
    for rule in sorted(set(rules), key=lambda r: (r.host, r.path, r.verdict)):
        if rule.verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {rule.verdict!r}")
        node = root
        for label in reversed(rule.host.split(".")):
            node = node.children.setdefault(label, Node())
        node.paths = node = node.paths or Node()
        *whole, rest = rule.path.split("/")
        for segment in whole:
            node = node.children.setdefault(segment, Node())
        node.ends.append((rest, rule))
    return root


def longest_match(root: Node, host: str, path: str) -> Rule | None:
    """The rule with the longest host and path that fits; block where two are equally long."""
    found: list[Rule] = []
    segments, node = path.split("/"), root
    for label in reversed(host.split(".")):
        if (node := node.children.get(label)) is None:
            break
        at = node.paths
        for segment in segments:
            if at is None:
                break
            found += (rule for prefix, rule in at.ends if segment.startswith(prefix))
            at = at.children.get(segment)
    return max(found, key=lambda r: (len(r.name), r.verdict == "block"), default=None)


def split_url(url):
    """(host, path) columns of a url column: host with A-Z lower-cased, both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    A rule fits its host and every subdomain when the path starts with the rule's path; the longest
    rule decides, and ``default`` where none fits. A null url, and one without ``://``, has an empty
    host and path, which no rule with a host fits. Null ids and repeated rows are kept as they come;
    other columns of ``pages`` are ignored, whatever their names.
    """
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        matched = [longest_match(trie.value, h, p) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame({"rule": [m and m.name for m in matched], "verdict": [m.verdict if m else default for m in matched]}, dtype=object)

    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    return parts.withColumn("judged", judge("host", "path")).select(id_col, "host", "path", "judged.rule", "judged.verdict")
