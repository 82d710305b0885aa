"""URL filters as a sort-merge range join.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's path. Hosts are
written with reversed labels and a closing dot (``com.example.``): all subdomains of a host then lie in one interval of
keys, and intervals are nested or disjoint. Per top-level label a sorted sweep over the interval ends keeps the stack of
active rules and cuts the key space into segments, each with its stack. Urls and segment starts are sorted together and
the last segment start before a url gives its stack, in which the longest rule whose path fits wins.

Urls are dealt by (top-level label, salt), so that one host or label may hold any share of the rows; the segments, of
which there are at most two a rule, go to every salt. The sweep holds the rules of one top-level label in one row:
meant for up to some 100,000 rules a label.

Cases: null url or no ``://``: host and path are empty and only a rule with an empty host fits. Rules with null host or
path: taken as empty. Very long urls are handled like others. Two rules alike: the one whose verdict sorts first. Repeated urls and rows: each has its result. No
rules: all get the default verdict. Columns of the input with the names of new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, partitions


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``www.example.com`` -> ``com.example.www.``; an empty host has an empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _top(key: Column) -> Column:
    return F.substring_index(key, ".", 1)


def _segments(rules: DataFrame) -> DataFrame:
    """(top, key, stack): the rules that are active from ``key`` on, outermost first."""
    rule = "struct<key:string,upto:string,host:string,path:string,verdict:string>"
    hosts = (
        rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
        .withColumn("key", host_key(F.col("host")))
        .filter(F.col("host") != "")
        .withColumn("upto", F.concat(F.expr("substr(key, 1, length(key) - 1)"), F.lit("/")))  # '/' follows '.'
    )
    r = F.struct("key", "upto", "host", "path", "verdict")
    events = F.array(F.struct(F.col("key").alias("at"), F.lit(1).alias("opens"), r.alias("rule")), F.struct(F.col("upto").alias("at"), F.lit(0).alias("opens"), r.alias("rule")))
    swept = (
        hosts.select(_top(F.col("key")).alias("top"), F.explode(events).alias("e"))
        .groupBy("top")
        .agg(F.array_sort(F.collect_list("e")).alias("events"))
        .select(
            "top",
            F.aggregate(
                "events",
                F.struct(F.array().cast(f"array<{rule}>").alias("stack"), F.array().cast(f"array<struct<key:string,stack:array<{rule}>>>").alias("out")),
                lambda acc, e: _push(acc, e, rule),
                lambda acc: acc["out"],
            ).alias("segments"),
        )
    )
    one = swept.select("top", F.explode("segments").alias("s")).select("top", F.col("s.key").alias("key"), F.col("s.stack").alias("stack"))
    # of events at one key the one with the fullest sweep counts: closings sort before openings, so it is the last
    return one.groupBy("top", "key").agg(F.max_by("stack", F.size("stack")).alias("opened"), F.min_by("stack", F.size("stack")).alias("closed")).select("top", "key", F.when(F.col("key").endswith("/"), F.col("closed")).otherwise(F.col("opened")).alias("stack"))


def _push(acc: Column, e: Column, rule: str) -> Column:
    stack = F.filter(acc["stack"], lambda r: r["upto"] > e["at"])
    stack = F.when(e["opens"] == 1, F.concat(stack, F.array(e["rule"]))).otherwise(stack)
    return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.struct(e["at"].alias("key"), stack.alias("stack")))).alias("out"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (``host`` + ``path`` of the longest fitting rule, else null) and verdict."""
    spark = pages.sparkSession
    host, path = split_url(F.col(url))
    new = ("host", "path", "rule", "verdict")
    kept = [F.col(c).alias(f"p{i}") for i, c in enumerate(pages.columns) if c not in new]
    names = [c for c in pages.columns if c not in new]
    salts = max(64, 4 * partitions(spark))
    rows = pages.select(*kept, host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    # dealt by all columns of a row, so the same way each time: no hot host fills one salt (rows that are equal in all columns stay together)
    rows = rows.withColumn("top", _top(F.col("key"))).withColumn("salt", F.pmod(F.xxhash64(*(c for c, kind in rows.dtypes if "map" not in kind)), F.lit(salts)).cast("int"))
    segments = _segments(rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    merged = rows.withColumn("url_row", F.lit(True)).unionByName(segments.withColumn("url_row", F.lit(False)), allowMissingColumns=True)
    swept = Window.partitionBy("top", "salt").orderBy("key", "url_row").rowsBetween(Window.unboundedPreceding, 0)
    root = rules.filter(F.coalesce("host", F.lit("")) == "").groupBy(F.coalesce("path", F.lit("")).alias("path")).agg(F.min("verdict").alias("verdict"))
    roots = root.agg(F.collect_list(F.struct(F.lit("").alias("host"), "path", "verdict")).alias("roots"))  # rules for every host: one small row
    found = merged.withColumn("stack", F.last(F.when(~F.col("url_row"), F.col("stack")), ignorenulls=True).over(swept)).filter("url_row").join(F.broadcast(roots))
    active = F.concat(F.col("roots"), F.coalesce(F.transform("stack", lambda r: F.struct(r["host"], r["path"], r["verdict"])), F.array().cast("array<struct<host:string,path:string,verdict:string>>")))
    fitting = F.filter(active, lambda r: F.col("path").startswith(r["path"]))
    best = F.element_at(F.array_sort(F.transform(fitting, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("h"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict")))), -1)
    found = found.withColumn("best", F.when(F.size(fitting) > 0, best))
    return found.select(*[F.col(f"p{i}").alias(c) for i, c in enumerate(names)], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
