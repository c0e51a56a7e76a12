"""URL filters: a trie over reversed host labels and path segments, longest match first.

A rule is an action (``allow`` or ``block``) and a host with a path, like ``example.com/en/``.
It fits its host and all hosts below it if the url's path starts with the rule's path. The
trie leads from the last host label to the first, then along the path segments; the
last, open segment of a rule is kept at its node. One walk a url collects every rule that
fits; the longest wins (as text; then the longer host), and of equal rules ``block``.
Urls that no rule fits get ``default``.

A trie of at most ``RULES_PER_TRIE`` rules goes to the tasks as a broadcast. A larger table
of rules is cut by hash into tries of that size which are applied one after another, each
pass keeping the best rule so far, so that no more than one is held at a time.

Edge cases: a null url, or one without ``://``, has an empty host and path, which no rule
fits; empty labels and segments are labels and segments like any other; repeated rows give
the same row again, repeated rules count once; rules that are null or not of the form
above are an error; an empty table or an empty rule list is fine; other columns of the pages are
left alone, and those named like the results do not get in the way.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noisesift.llm.common import query, staged, table

RULES_PER_TRIE = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: fixed values: the rules of the query
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def host_and_path(url: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_extract(text, "://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(text, "://[^/?#]*([^?#]*)", 1)


class Trie:
    """Edges by (node, label or segment). A node of the host part may lead to one of the path part,
    which holds its rules by their open last segment."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.edge: dict[tuple[int, str], int] = {}
        self.paths: dict[int, int] = {}
        self.ends: dict[tuple[int, str], tuple[str, str, int]] = {}
        self.sizes: dict[int, set[int]] = {}
        for action, rule in rules:
            if action not in ("allow", "block") or not rule:
                raise ValueError(f"not a rule: {action!r}, {rule!r}")
            host, slash, rest = rule.partition("/")
            host = host.translate(str.maketrans(UPPER, LOWER))
            node = 0
            for label in reversed(host.split(".")):
                node = self._down(self.edge, (node, label))
            node = self._down(self.paths, node)
            *whole, end = (slash + rest).split("/")
            for segment in whole:
                node = self._down(self.edge, (node, segment))
            self.sizes.setdefault(node, set()).add(len(end))
            if self.ends.get((node, end), ("allow",))[0] == "allow":
                self.ends[node, end] = (action, host + slash + rest, len(host))

    def _down(self, edges: dict, key) -> int:
        return edges.setdefault(key, len(self.edge) + len(self.paths) + 1)

    def best(self, host: str, path: str) -> tuple[str, str, int] | None:
        """``(action, rule, host length)`` of the longest rule that fits."""
        found, node, segments = None, 0, path.split("/")
        for label in reversed(host.split(".")):
            node = self.edge.get((node, label))
            if node is None:
                break
            below = self.paths.get(node)
            for segment in segments:
                if below is None:
                    break
                for size in self.sizes.get(below, ()):
                    rule = self.ends.get((below, segment[:size]))
                    if rule and (found is None or (len(rule[1]), rule[2]) > (len(found[1]), found[2])):
                        found = rule
                below = self.edge.get((below, segment))
        return found


def _pass(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The best rule of this trie or of those before, by (length, host length)."""
    spark = rows.sparkSession
    trie = spark.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("struct<action: string, rule: string, host: int>")
    def match(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [trie.value.best(h, p) or (None, None, None) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(found, columns=["action", "rule", "host"]).astype({"host": "Int32"})

    out = rows.withColumn("_now", match("host", "path"))
    longer = F.col("_best.rule").isNull() | (F.struct(F.length("_now.rule"), F.col("_now.host")) > F.struct(F.length("_best.rule"), F.col("_best.host")))
    return out.withColumn("_best", F.when(F.col("_now.rule").isNotNull() & longer, F.col("_now")).otherwise(F.col("_best"))).drop("_now")


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] | DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row a page: its id (as ``page_id``), host, path, rule (null if none fits), verdict.

    ``rules``: pairs (action, rule), or a DataFrame with the columns ``action`` and ``rule``.
    """
    spark = pages.sparkSession
    host, path = host_and_path(url_col)
    none = F.lit(None).cast("struct<action: string, rule: string, host: int>")
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), none.alias("_best"))
    if not isinstance(rules, DataFrame):
        rows = _pass(rows, list(rules))
    else:
        # of equal rules block wins here, as those in one trie only meet there
        key = F.concat_ws("/", F.translate(F.split_part("rule", F.lit("/"), F.lit(1)), UPPER, LOWER), F.regexp_extract("rule", "(?s)/(.*)", 1))
        key = F.when(F.contains("rule", F.lit("/")), key).otherwise(F.translate("rule", UPPER, LOWER))
        once = staged(rules.groupBy(key.alias("rule")).agg(F.max("action").alias("action")), "rules")
        parts = -(-once.count() // RULES_PER_TRIE) * 2
        if parts <= 2:
            rows = _pass(rows, [tuple(r) for r in once.select("action", "rule").collect()])
        else:
            for k in range(parts):  # half full on average, so that none of them runs over
                part = once.where(F.pmod(F.xxhash64("rule"), F.lit(parts)) == k).select("action", "rule")
                rows = staged(_pass(rows, [tuple(r) for r in part.collect()]), "judged")
    return rows.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"))


_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}:{a}'"
    for a, (h, _, p) in sorted(((a, r.partition("/")) for a, r in RULES), key=lambda x: -len("".join(x[1])))
)
ORACLE = f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), judged AS (SELECT *, CASE {_FITS} END AS fit FROM parts)
SELECT page_id, host, path, nullif(split_part(fit, ':', 1), '') AS rule, coalesce(split_part(fit, ':', 2), 'allow') AS verdict
FROM judged
"""


@query("op11_url_filter", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)
