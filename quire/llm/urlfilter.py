"""URL filter: a trie over reversed host labels and path text, longest match first.

A rule has a host and a path.  It fits the host and all its subdomains if the url's path starts with the
rule's.  The trie descends the url's host labels from the last; at each node hang the rules' paths as a
second trie over segments, and the deepest host, then the longest path, decides.  The rule list is
broadcast only below ``max_rules``; a longer list is joined on the host suffixes instead.

Defined results: a null url or one without ``://`` has empty host and path, no rule and the default
verdict; equal rules count once, and of rules that differ in the verdict alone ``block`` wins; repeated
pages give repeated rows; without rules every page gets the default verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, UPPER, map_batches


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query's contract.
RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


class Trie:
    """Nodes are dicts; "/" holds the path trie of the host that ends at a node (no label contains it)."""

    def __init__(self, rules: list[Rule]):
        self.root: dict = {}
        for rule in sorted(rules, key=lambda r: (r.text, r.verdict)):  # block overwrites allow
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})
            *segments, tail = rule.path.split("/")
            for s in segments:
                node = node.setdefault(s, {})
            # the last piece of a rule may be part of a segment: its texts hang under "/"
            node.setdefault("/", {})[tail] = rule

    def paths(self, host: str) -> list[dict]:
        """The path tries of the host's rules, deepest host first."""
        node, found = self.root, []
        for label in reversed(host.split(".")):
            if label == "/" or not (node := node.get(label)):
                break
            if "/" in node:
                found.append(node["/"])
        return found[::-1]

    @staticmethod
    def longest(node: dict, path: str) -> Rule | None:
        best = None
        segments = path.split("/")
        for depth, s in enumerate(segments):
            tails = node.get("/")
            if tails:
                rest = "/".join(segments[depth:]) if any("/" in t for t in tails) else s
                fits = [t for t in tails if rest.startswith(t)]
                if fits:
                    best = tails[max(fits, key=len)]
            if depth == len(segments) - 1 or not (node := node.get(s)):
                break
        return best

    def find(self, host: str, path: str) -> Rule | None:
        for node in self.paths(host):
            if rule := self.longest(node, path):
                return rule
        return None


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[Rule] = RULES, default: str = "allow", max_rules: int = 1_000_000) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules are too many to broadcast; use judge_by_join")
    packed = pages.sparkSession.sparkContext.broadcast(rules)

    def start():
        trie = Trie(packed.value)
        known: dict[str, list[dict]] = {}

        def one(batch: pa.RecordBatch) -> dict:
            text, verdict = [], []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                nodes = known.get(host)
                if nodes is None:
                    if len(known) > 100_000:
                        known.clear()
                    nodes = known[host] = trie.paths(host)
                rule = next((r for n in nodes if (r := trie.longest(n, path))), None)
                text.append(rule.text if rule else None)
                verdict.append(rule.verdict if rule else default)
            return {"page_id": batch.column("page_id"), "host": batch.column("host"), "path": batch.column("path"), "rule": pa.array(text, pa.string()), "verdict": pa.array(verdict, pa.string())}

        return one

    return map_batches(parts, start, f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """As judge, for a table of rules (host, path, verdict) of any size: each distinct host is joined on its suffixes."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("suffix")
    fits = keys.select("host", "path", suffix).join(rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), F.col("verdict").alias("said")), "suffix").where(F.startswith("path", "start"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("suffix", "start").alias("rule"), "said"), F.struct(F.length("suffix"), F.length("start"), (F.col("said") == "block"))).alias("b"))
    return parts.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.said", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
       coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1), '') AS path FROM pages),
r(rhost, rpath, said) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, host, path, rhost || rpath AS rule, said, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.said, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
"""
