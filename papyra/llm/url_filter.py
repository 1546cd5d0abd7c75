"""URL filters: a sort-merge range join of urls with nested allow and block rules.

A rule is (host, path, verdict).  It fits a url whose host is the rule's host or
a subdomain of it and whose path starts with the rule's path; of the rules that
fit, the one with the longest host, then the longest path, decides.

Both parts of a rule are intervals of a sorted key space: the host written label
by label from the right ("org.example.") is a prefix of exactly the keys of its
subdomains, and a path is a prefix of the longer paths.  Intervals of prefixes
are nested or apart, so one sweep in key order needs only a stack: a begin event
pushes its rule, an end event uncovers the enclosing one.  The sweep runs inside
range partitions; the state at the start of each partition is one row per
partition.  Distinct keys are swept, so a host that holds a third of all urls
is one point.

Edge cases: null urls and urls without "://" have empty host and path and fit no
rule; repeated rules count once and "block" wins over "allow"; an empty rule set
gives the default verdict everywhere; ports and user names belong to the host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.common import ascii_lower, in_order, without

_END = "X'FF'"     # no UTF-8 text holds this byte, so prefix || FF closes the prefix's interval


def split_url(url):
    """(host, path) columns of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _host_key(host: str):
    return F.encode(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")), "UTF-8")


def _path_key(host: str, path: str):
    return F.concat(F.encode(F.col(host), "UTF-8"), F.expr("X'00'"), F.encode(F.col(path), "UTF-8"))


def _innermost(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """points (k) against nodes (k, node, parent): each point's innermost node, "" for none."""
    events = (nodes.select(F.concat("k", F.expr(_END)).alias("k"), F.lit(0).alias("kind"),
                           F.col("parent").alias("top"))
              .unionByName(nodes.select("k", F.lit(1).alias("kind"), F.col("node").alias("top")))
              .unionByName(points.select("k", F.lit(2).alias("kind"), F.lit(None).cast("string").alias("top"))))
    swept = in_order(events, "k", "kind")
    inside = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition: the top of the stack where the partition begins
    carried = (swept.groupBy("_pid").agg(F.max_by("top", F.when(F.col("top").isNotNull(), F.col("_mid"))).alias("_t"))
               .select("_pid", F.last("_t", ignorenulls=True).over(before).alias("_carry")))
    return (swept.withColumn("_top", F.last("top", ignorenulls=True).over(inside))
            .where("kind = 2").join(F.broadcast(carried), "_pid")
            .select("k", F.coalesce("_top", "_carry", F.lit("")).alias("node")))


def _host_stacks(rules: DataFrame) -> DataFrame:
    """(host, parent, stack): the rule hosts that enclose each rule host, itself first."""
    hosts = rules.select("host").distinct()
    labels = F.split("host", r"\.")
    outer = F.explode(F.expr(r"transform(sequence(1, size(split(host, '\\.'))), "
                             r"i -> array_join(slice(split(host, '\\.'), i, size(split(host, '\\.'))), '.'))"))
    up = hosts.select("host", F.size(labels).alias("n"), outer.alias("outer"))
    up = up.join(hosts.select(F.col("host").alias("outer")), "outer")
    longest_first = F.reverse(F.array_sort(F.collect_list(F.struct(F.size(F.split("outer", r"\.")), "outer"))))
    return (up.groupBy("host").agg(longest_first["outer"].alias("stack"))
            .withColumn("parent", F.coalesce(F.get("stack", F.lit(1)), F.lit(""))))


def _path_nodes(rules: DataFrame) -> DataFrame:
    """(k, node, parent) of the paths of each rule host; a node is the path, with "=" before it."""
    own = rules.select("host", "path")
    shorter = F.explode_outer(F.expr("if(length(path) > 0, transform(sequence(0, length(path) - 1), "
                                     "i -> substring(path, 1, i)), cast(array() as array<string>))"))
    up = (own.select("host", "path", shorter.alias("outer"))
          .join(own.select("host", F.col("path").alias("outer"), F.lit(True).alias("hit")), ["host", "outer"], "left")
          .groupBy("host", "path")
          .agg(F.max_by("outer", F.when(F.col("hit"), F.length("outer"))).alias("up")))
    return up.select(_path_key("host", "path").alias("k"), F.concat(F.lit("="), "path").alias("node"),
                     F.coalesce(F.concat(F.lit("="), "up"), F.lit("")).alias("parent"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule (host and path of the deciding rule, or null) and verdict to each row.

    Columns of ``pages`` named like the new ones are replaced; all others are kept.
    """
    rules = (rules.select(ascii_lower(F.coalesce(F.col("host"), F.lit(""))).alias("host"),
                          F.coalesce(F.col("path"), F.lit("")).alias("path"), "verdict")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    host, path = split_url(F.col(f"`{url_col}`"))
    urls = without(pages.withColumns({"_host": host, "_path": path}), "host", "path", "rule", "verdict")
    places = urls.select("_host", "_path").distinct()

    stacks = _host_stacks(rules)
    host_nodes = stacks.select(_host_key("host").alias("k"), F.concat(F.lit("="), "host").alias("node"),
                               F.when(F.col("parent") != "", F.concat(F.lit("="), "parent"))
                               .otherwise("").alias("parent"))
    hosts = places.select("_host").distinct().select("_host", _host_key("_host").alias("k"))
    tops = _innermost(hosts.select("k"), host_nodes)
    active = (hosts.join(tops.where("node <> ''"), "k")
              .join(stacks.select(F.concat(F.lit("="), "host").alias("node"), "stack"), "node")
              .select("_host", F.explode("stack").alias("anchor")))
    tests = places.join(active, "_host").withColumn("k", _path_key("anchor", "_path"))
    found = _innermost(tests.select("k").distinct(), _path_nodes(rules)).where("node <> ''")
    best = (tests.join(found, "k").select("_host", "_path", "anchor", F.substring("node", 2, 1 << 30).alias("rpath"))
            .groupBy("_host", "_path")
            .agg(F.max_by(F.struct("anchor", "rpath"), F.length("anchor")).alias("best"))
            .select("_host", "_path", "best.anchor", "best.rpath")
            .join(rules.select(F.col("host").alias("anchor"), F.col("path").alias("rpath"), "verdict"),
                  ["anchor", "rpath"])
            .select("_host", "_path", F.concat("anchor", "rpath").alias("rule"), "verdict"))
    return (urls.join(best, ["_host", "_path"], "left")
            .withColumn("verdict", F.coalesce("verdict", F.lit(default)))
            .withColumnsRenamed({"_host": "host", "_path": "path"}))
