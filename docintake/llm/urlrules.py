"""URL filters: allow and block entries in a trie over reversed host labels and path segments.

``judge(df, rules)`` gives each row's host, path, the rule that decides and the verdict. A rule (host, path, action)
fits its host and all subdomains where the url's path starts with the rule's path. Of the rules that fit, that with the
longest host decides, then the longest path, and of an allow and a block entry with the same host and path the block.

Rules that stay below ``MAX_RULES`` and ``MAX_RULE_CHARS`` (checked by an aggregate before anything is collected) become
one trie, which is broadcast: a url walks down its host's labels from the right, then the path's segments. Larger rule
sets are joined: every url is looked up under its host's suffixes and its path's whole segments, and the longest
rule found is kept (``judge_by_join``); the answers are the same.

Defined cases: a null url, or one without ``://``, has an empty host and path; a host keeps ports and user names, so
that ``com:80`` isn't ``com``; only A-Z are lower-cased, in hosts alone; where no rule fits, ``rule`` is null and the
verdict is ``default``; a rule without host (null or empty) fits nothing, a null path is the empty path, which every
path starts with, and actions other than ``block`` allow; repeated rows each give a row; an empty table gives an
empty table, and without rules every row gets the default; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docintake.llm.common import table

ALLOW, BLOCK = "allow", "block"
#: Rules, and characters of rules, that one trie may hold; it takes some 1 KB a rule in each Python worker.
MAX_RULES, MAX_RULE_CHARS = 100_000, 8_000_000

#: The rules of the query: host, path, action.
RULES = (
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: from there up to ``?``, ``#`` or the
    end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


class PathNode:
    """The rules' paths below one host: whole segments lead to other nodes, last segments (which a url's segment only
    has to begin with) end rules."""

    __slots__ = ("below", "ends", "sizes")

    def __init__(self):
        self.below: dict[str, PathNode] = {}
        self.ends: dict[str, tuple[str, str]] = {}
        self.sizes: tuple[int, ...] = ()

    def add(self, path: str, found: tuple[str, str]) -> None:
        *whole, last = path.split("/")
        node = self
        for x in whole:
            node = node.below.setdefault(x, PathNode())
        if last not in node.ends or found[1] == BLOCK:
            node.ends[last] = found
        node.sizes = tuple(sorted({len(x) for x in node.ends}, reverse=True))

    def longest(self, path: str) -> tuple[str, str] | None:
        node, best = self, None
        for x in path.split("/"):
            for n in node.sizes:
                if len(x) >= n and (found := node.ends.get(x[:n])):
                    best = found
                    break
            node = node.below.get(x)
            if node is None:
                break
        return best


class Trie:
    """Host labels from the right; each host that has rules carries the trie of their paths."""

    def __init__(self, rules: Iterable[tuple[str | None, str | None, str]]):
        self.root: dict = {}
        for host, path, action in rules:
            if not host:
                continue
            host, path = host.translate(str.maketrans(UPPER, LOWER)), path or ""
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node.setdefault(None, PathNode()).add(path, (host + path, BLOCK if action == BLOCK else ALLOW))

    def paths(self, host: str) -> list[PathNode]:
        """The path tries of the host and of what it is a subdomain of, the longest host first."""
        node, out = self.root, []
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                out.append(node[None])
        return out[::-1]

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        return next((x for p in self.paths(host) if (x := p.longest(path))), None)


@lru_cache(maxsize=2)
def _trie(rules: tuple[tuple[str | None, str | None, str], ...]) -> Trie:
    return Trie(rules)


def parts(df: DataFrame, key: str, url: str) -> DataFrame:
    host, path = host_and_path(F.col(url).cast("string"))
    return df.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))


def judge_by_trie(df: DataFrame, rules: list[tuple[str | None, str | None, str]], key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(tuple(rules))

    def run(batches):
        trie = _trie(sent.value)
        for b in batches:
            hosts: dict[str, list[PathNode]] = {}
            rule, verdict = [], []
            for host, path in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True):
                below = hosts.get(host)
                if below is None:
                    below = hosts[host] = trie.paths(host)
                found = next((x for p in below if (x := p.longest(path))), (None, default))
                rule.append(found[0])
                verdict.append(found[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*b.schema.names, "rule", "verdict"])

    rows = parts(df, key, url)
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string").withColumnRenamed("key", key)


def judge_by_join(df: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """For rule sets that are too large for one trie. Hosts and paths are judged once each, however many rows share
    them. Suffixes of hosts are no deeper than the deepest rule's host; those that have rules at all are looked up with
    the path's whole-segment prefixes, no more of them than the longest rule has segments."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rules = rules.select(F.translate(text("host"), UPPER, LOWER).alias("r_host"), text("path").alias("r_path"), (text("action") == BLOCK).alias("blocks")).filter("r_host <> ''")
    rules = rules.groupBy("r_host", "r_path").agg(F.max("blocks").alias("blocks"))
    rules = rules.withColumn("at", F.regexp_extract("r_path", r"^(?:[^/]*/)*", 0))
    rows = parts(df, key, url)
    pairs = rows.select("host", "path").distinct()
    labels, cuts = F.split("host", r"\."), F.split("path", "/")
    deep, long = rules.agg(F.max(F.size(F.split("r_host", r"\."))), F.max(F.size(F.split("at", "/")) - 1)).first()
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deep or 1))), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(cuts) - 1, F.lit(long or 0))), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(cuts, 1, i), "/"), F.lit("/"))))
    looks = pairs.withColumn("r_host", F.explode(suffixes)).join(rules.select("r_host").distinct(), "r_host").withColumn("at", F.explode(prefixes))
    found = looks.join(rules, ["r_host", "at"]).filter(F.startswith("path", "r_path"))
    order = F.struct(F.length("r_host").alias("a"), F.length("r_path").alias("b"), F.concat("r_host", "r_path").alias("rule"), "blocks")
    best = found.groupBy("host", "path").agg(F.max(order).alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    verdict = F.when(F.col("best.blocks"), BLOCK).when(F.col("best").isNotNull(), ALLOW).otherwise(default)
    return out.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def judge(df: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """``rules``: host, path, action."""
    n, size = rules.agg(F.count(F.lit(1)), F.sum(F.length(F.concat_ws("", "host", "path")))).first()
    if n > MAX_RULES or (size or 0) > MAX_RULE_CHARS:
        return judge_by_join(df, rules, key, url, default)
    few = [tuple(r) for r in rules.select("host", "path", "action").distinct().collect()]
    return judge_by_trie(df, sorted(few, key=repr), key, url, default)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge(table(spark, sf_dir, "pages"), rules)


_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_ORDERED = sorted(RULES, key=lambda r: (-len(r[0]), -len(r[1])))
SQL = f"""
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{a}'" for h, p, a in _ORDERED)} ELSE '{ALLOW}' END AS verdict
FROM (SELECT page_id, host, path, CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for h, p, _ in _ORDERED)} END AS rule
  FROM (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages) a) b) c
"""
