"""URL filters as a sort-merge range join.

A host's labels are reversed, so that ``www.example.com`` with the path ``/en/`` has the canonical key
``com.example.www./en/`` and a host with all its subdomains is an interval of keys: those that begin with the host's.
So is a path with all that begin with it. Keys and rules are range-partitioned and sorted together, and a sweep over
each partition keeps the stack of the nested rules that are open at a key. Two sweeps: the first finds the rule hosts
that a url's host is under, the second, for each of these hosts, the longest rule that the url's path begins with.
The stack holds nested prefixes of one key only, whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

_ROW = "key string, kind int, a string, b string"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (from there up to
    ``?``, ``#`` or the end); both empty where there is no ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://([^/?#]*+)([^?#]*+)", i), F.lit(""))
    return lower_az(part(1)), part(2)


def lower_az(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def reversed_host(host: Column) -> Column:
    """The labels from the last to the first, with a dot after each."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweeper(carried: dict[int, list[tuple[str, str, str]]], every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sweeps sorted rows; gives for each point the rules open at it, all or the innermost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, str]] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if stack is None:
                stack = list(carried.get(batch.column("part")[0].as_py(), ()))
            out: list[tuple[str, str, str, str, str]] = []
            for key, kind, a, b in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "a", "b"))):
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind:
                    out += [(a, b, *rule) for rule in (stack if every else stack[-1:])]
                elif not stack or stack[-1][0] != key:
                    stack.append((key, a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(5)], ["a", "b", "rule_key", "rule_a", "rule_b"])

    return run


def covering(points: DataFrame, rules: DataFrame, every: bool) -> DataFrame:
    """For the points (key, a, b), the rules (key, a, b; distinct keys) whose keys their keys begin with: all of
    them, or the longest. Returns a, b, rule_key, rule_a, rule_b.

    Points are told apart by key and a, so that a key with very many points is split over partitions. A partition
    begins with the rules already open there: those whose keys its first key begins with, found by an equality join
    of that key's prefixes. They go through the driver: at most one nest of rules for each partition.
    """
    rows = points.select("key", F.lit(1).alias("kind"), "a", "b").unionByName(rules.select("key", F.lit(0).alias("kind"), "a", "b"))
    order = ["key", "kind", "a"]
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    first = rows.groupBy("part").agg(F.min("key").alias("first"))
    lengths = [n for (n,) in rules.select(F.length("key")).distinct().collect()]  # as many as the longest rule has characters
    carried: dict[int, list[tuple[str, str, str]]] = {}
    if lengths:
        cuts = first.select("part", "first", F.explode(F.array(*map(F.lit, lengths))).alias("n")).where("n <= length(first)")
        open_ = cuts.select("part", F.expr("substring(first, 1, n)").alias("key")).join(rules, "key")
        for r in open_.orderBy("part", F.length("key")).collect():
            carried.setdefault(r["part"], []).append((r["key"], r["a"], r["b"]))
    return rows.mapInArrow(_sweeper(carried, every), "a string, b string, rule_key string, rule_a string, rule_b string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Which rule each url falls under, and its verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all hosts that end with a dot and its host, if
    the url's path begins with its path. Of the rules that fit, the one with most characters in host and path wins,
    of equally long ones that with the longer host; of rules with equal host and path that with the greatest verdict
    (block before allow).

    Returns page_id, host, path, rule (host and path, null where none fits) and verdict (``default`` there), a row
    for each row of pages. Null urls and urls without ``://`` have empty hosts and paths; repeated and null page_ids
    are rows like others; other columns don't matter; an empty table gives no rows, and without rules all rows get
    the default. Rules with a null column, with ``/``, ``?`` or ``#`` in the host, or with a path that is neither
    empty nor begins with ``/`` fit no url.
    """
    host, path = parsed(pages["url"])
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    r = rules.select(lower_az(rules["host"]).alias("host"), "path", "verdict").where(r"NOT host RLIKE '[/?#]' AND (path = '' OR startswith(path, '/')) AND verdict IS NOT NULL")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("host_key", reversed_host(F.col("host")))
    hosts = r.select(F.col("host_key").alias("key"), F.lit("").alias("a"), F.lit("").alias("b")).distinct()
    marks = r.select(F.concat("host_key", "path").alias("key"), F.concat("host", "path").alias("a"), F.col("verdict").alias("b"))
    urls = p.select("host", "path").distinct()
    under = covering(urls.select(F.concat(reversed_host(F.col("host")), "path").alias("key"), F.col("host").alias("a"), F.col("path").alias("b")), hosts, every=True)
    found = covering(under.select(F.concat("rule_key", "b").alias("key"), "a", "b"), marks, every=False)
    size = F.struct(F.length("rule_a").alias("n"), F.length(F.substring_index("rule_key", "/", 1)).alias("h"), F.col("rule_a").alias("rule"), F.col("rule_b").alias("verdict"))
    best = found.groupBy(F.col("a").alias("host"), F.col("b").alias("path")).agg(F.max(size).alias("best"))
    out = p.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
