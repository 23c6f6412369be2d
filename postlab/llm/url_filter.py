"""Allow and block rules for urls: a trie over reversed host labels and path segments.

A rule holds for its host and all its subdomains if the path of the url starts with the path of the rule. The most
specific rule wins: the one with the longest host and, among these, the longest path; if the
same host and path are both allowed and blocked, the block wins. Where no rule fits, the
``default`` verdict holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The trie is sent to every executor, so the number of rules is bounded.
MAX_RULES = 1_000_000
_ASCII_LOWER = {ord("A") + i: ord("a") + i for i in range(26)}
_HOST_PATH = re.compile(r"([^/?#]*)([^?#]*)")
_PIECES = re.compile(r"[^/]*/|[^/]+$")


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host, path = _HOST_PATH.match(url, at + 3).groups()
    return host.translate(_ASCII_LOWER), path


class Trie:
    """Nodes are dicts: ``hosts`` by label, ``paths`` by whole path piece, ``parts`` by the start of one, ``rule``."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.translate(_ASCII_LOWER).split(".")):
                node = node.setdefault("hosts", {}).setdefault(label, {})
            node = node.setdefault("start", {})
            for piece in _PIECES.findall(rule.path):
                node = node.setdefault("paths" if piece.endswith("/") else "parts", {}).setdefault(piece, {})
            if node.get("rule") is None or rule.verdict == "block":
                node["rule"] = rule

    def match(self, host: str, path: str) -> Rule | None:
        node, best, pieces = self.root, None, _PIECES.findall(path)
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            if "start" in node:
                best = _deepest(node["start"], pieces) or best
        return best


def _deepest(node: dict, pieces: list[str]) -> Rule | None:
    best = node.get("rule")
    for piece in pieces:
        fits = [p for p in node.get("parts", {}) if piece.startswith(p)]
        if fits:
            best = node["parts"][max(fits, key=len)]["rule"]
        node = node.get("paths", {}).get(piece)
        if node is None:
            break
        best = node.get("rule") or best
    return best


def judge_urls(df: DataFrame, rules: Iterable[Rule], url_col: str = "url", result: str = "judged",
               default: str = "allow") -> DataFrame:
    """Add a struct column ``result`` (host, path, rule, verdict); a column of that name is replaced.

    ``rule`` is the host and path of the deciding rule, null if none fits. A null url, or one without ``://``,
    has an empty host and path.
    """
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    shared = df.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(urls: pd.Series) -> pd.DataFrame:
        trie, rows = shared.value, []
        for url in urls:
            host, path = split_url(url)
            rule = trie.match(host, path)
            rows.append((host, path, rule and rule.host + rule.path, rule.verdict if rule else default))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"], dtype=object)

    return df.withColumn(result, judged(F.col(url_col)))
