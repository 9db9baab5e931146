"""URL rules in a trie over reversed host labels and path segments; the longest match decides between allow and block.

``URLFilter(rules).judge(df, "url")`` adds host, path, rule and verdict.

Defined cases: a null url, or one without ``://``, has an empty host and path and gets the default verdict; a rule fits its
host and every subdomain if the url's path starts with the rule's path (``net/es/`` has the path ``/es/``); of several
fitting rules the longest text wins, then the one with more host labels, then block over allow. Hosts are compared without regard to the case of A-Z. The rules are
checked against ``max_rules`` before they are broadcast; beyond that they are joined by host suffix instead. Columns of the
input with the names of the results are replaced; rows are kept one for one, repeated rows too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(*CASES)
RESULT = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


class _Node:
    __slots__ = ("labels", "paths")

    def __init__(self):
        self.labels: dict[str, _Node] = {}
        self.paths: _Path | None = None


class _Path:
    """A node of path segments: whole segments below it, rules that end within a segment, the rule that ends here."""

    __slots__ = ("here", "parts", "segments")

    def __init__(self):
        self.segments: dict[str, _Path] = {}
        self.parts: list[tuple[str, tuple[str, str]]] = []
        self.here: tuple[str, str] | None = None


def build(rules: Iterable[tuple[str, str]]) -> _Node:
    """The trie of (rule, verdict) pairs; ``rule`` is host, slash and path."""
    root = _Node()
    for rule, verdict in rules:
        host, _, path = rule.partition("/")
        node = root
        for label in reversed(host.translate(LOWER).split(".")):
            node = node.labels.setdefault(label, _Node())
        node.paths = node.paths or _Path()
        at, (*whole, rest) = node.paths, path.split("/")
        for segment in whole:
            at = at.segments.setdefault(segment, _Path())
        found = (rule, verdict)
        if rest:
            at.parts = sorted([*(p for p in at.parts if p[0] != rest or verdict == "allow" and p[1][1] == "block"), *([] if any(p[0] == rest and p[1][1] == "block" for p in at.parts) else [(rest, found)])], key=lambda p: -len(p[0]))
        elif at.here is None or verdict == "block":
            at.here = found
    return root


def lookup(root: _Node, host: str, path: str) -> tuple[str, str] | None:
    """The longest rule that fits; of equally long ones that of the deeper host."""
    if not path.startswith("/") or not host:
        return None
    node, levels = root, []
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        if node.paths:
            levels.append(node.paths)
    segments, longest = path[1:].split("/"), None
    for at in reversed(levels):
        best = None
        for i, segment in enumerate(segments):
            best = at.here or best
            for part, found in at.parts:
                if segment.startswith(part):
                    best = found
                    break
            if i == len(segments) - 1 or segment not in at.segments:
                break
            at = at.segments[segment]
        if best and (longest is None or len(best[0]) > len(longest[0])):
            longest = best
    return longest


class URLFilter:
    def __init__(self, rules: list[tuple[str, str]], default: str = "allow", max_rules: int = 1_000_000):
        if any(v not in ("allow", "block") for _, v in rules):
            raise ValueError("a rule's verdict is allow or block")
        if len(rules) > max_rules:
            raise ValueError(f"{len(rules)} rules are more than the {max_rules} that may be broadcast; use judge_joined()")
        self.rules, self.default = list(rules), default

    @staticmethod
    def parts(df: DataFrame, column: str) -> DataFrame:
        """``df`` with host and path."""
        url = F.col(column)
        at = F.instr(url, "://")
        rest = F.substring(url, at + 3, F.length(url))
        host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
        tail = F.substring(rest, F.length(host) + 1, F.length(url))
        has = F.coalesce(at > 0, F.lit(False))
        lower = F.translate(host, *CASES)
        return df.withColumns({"host": F.when(has, lower).otherwise(""), "path": F.when(has, F.regexp_extract(tail, r"(?s)^([^?#]*)", 1)).otherwise("")})

    def judge(self, df: DataFrame, column: str = "url") -> DataFrame:
        shared, default = df.sparkSession.sparkContext.broadcast(self.rules), self.default
        made: list[_Node] = []

        @F.pandas_udf(RESULT)
        def judge(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            if not made:
                made.append(build(shared.value))
            for hosts, paths in pairs:
                found = [lookup(made[0], h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
                yield pd.DataFrame(found, columns=["rule", "verdict"])

        out = self.parts(df, column).withColumn("_judged", judge("host", "path"))
        return out.withColumns({"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")}).drop("_judged")


def judge_joined(df: DataFrame, rules: DataFrame, column: str = "url", default: str = "allow") -> DataFrame:
    """As ``URLFilter.judge`` for rules (rule, verdict) of any number: each url's host suffixes are joined with the rules' hosts.

    Each row of ``df`` is told apart by its url, so urls are judged once and joined back.
    """
    urls = URLFilter.parts(df.select(F.col(column).alias("_url")).distinct(), "_url")
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    ours = urls.where("host <> ''").withColumn("_host", F.explode(suffix))
    theirs = rules.select("rule", "verdict", F.translate(F.substring_index("rule", "/", 1), *CASES).alias("_host"), F.expr("substring(rule, instr(rule, '/'), length(rule))").alias("_path"))
    fits = ours.join(theirs, "_host").where(F.expr("startswith(path, _path)"))
    rank = F.struct(F.length("rule"), F.size(F.split("_host", r"\.")), (F.col("verdict") == "block").cast("int"), "rule")
    best = fits.groupBy("_url").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("_best"))
    out = URLFilter.parts(df, column).join(best.withColumnRenamed("_url", "_u"), F.col(column) == F.col("_u"), "left")
    return out.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(default))}).drop("_best", "_u")
