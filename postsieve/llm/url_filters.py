"""Rules for hosts and paths of urls, by a sort-merge range join. DataFrame operations only.

A rule is a host and the beginning of a path (``example.org/es/``); it fits the urls of its host and of all
subdomains whose path begins so. The canonical key of a rule is its host with the labels reversed, a slash and the
path (``org.example//es/``): it is a prefix of the keys that it fits, so it opens an interval that begins at the key
and ends before the key followed by a byte that no text has. A url stands in the same order once for each domain that
encloses its host (``org.example``, ``org``), but for no more labels than any rule has.

One sorted sweep over all keys answers all urls. Intervals of prefixes are nested or apart, so the stack of active
rules at a key is told by its depth (intervals opened less intervals closed before it), and the rule on top is the
last one that was opened at that depth. The order is cut into ranges of keys, one per task: each range adds up its own
depths and what was opened last at each depth, and a row per range and depth carries both into the ranges after it. So
neither a host with a third of all urls nor one with most of the rules meets in one task.

Of the rules that fit at any of a url's domains the longest (host and path together) decides; of two of that length
that with the longer host. The same rule given twice with both verdicts blocks. A url that no rule fits gets
``default``.

Edge cases: a null url and one without ``://`` have an empty host and path, which no rule fits. A port or user name is
a part of the host, as it stands. An empty path fits rules without a path only (``org`` but not ``org/``). Rules that
are null, have no host or neither verdict are left out; without rules every url gets the default. Repeated rows are
judged as often as they come, null keys stay null, long urls are taken whole, an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.skew import hot_keys, spread_join
from ..session import stage
from .common import partitions

ALLOW, BLOCK = "allow", "block"
OPEN, PROBE, CLOSE = 0, 1, 2
AFTER_ALL_TEXT = bytes([0xFF])  # no UTF-8 text has this byte


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://``, A-Z in lower case, and the path up to a query or fragment."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def labels_of(host: Column) -> Column:
    """The labels of a host from the last to the first."""
    return F.reverse(F.split(host, r"\."))


def canonical(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("/"), path).cast("binary")


def rules_of(rules: DataFrame, rule: str = "rule", verdict: str = "verdict") -> DataFrame:
    """host, path and verdict of each different rule."""
    host = F.substring_index(rule, "/", 1)
    found = rules.where(F.col(verdict).isin(ALLOW, BLOCK)).select(
        lower(host).alias("host"), F.substr(rule, F.length(host) + 1).alias("path"), F.col(verdict).alias("verdict")
    )
    return found.where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block comes after allow


def fixed_rules(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")) for rule, verdict in rules))
    return spark.range(1).select(F.inline(rows))


def events(urls: DataFrame, rules: DataFrame, most_labels: int) -> DataFrame:
    """Beginnings and ends of the rules' intervals and the keys of the urls: key, kind, step, host, path, verdict."""
    ranges = rules.withColumn("key", canonical(labels_of(F.col("host")), F.col("path")))
    opened = ranges.select("key", F.lit(OPEN).alias("kind"), F.lit(1).alias("step"), "host", "path", "verdict")
    closed = ranges.select(
        F.concat("key", F.lit(AFTER_ALL_TEXT)).alias("key"), F.lit(CLOSE).alias("kind"), F.lit(-1).alias("step"), "host", "path", "verdict"
    )
    labels = urls.select("host", "path", labels_of(F.col("host")).alias("labels"))
    levels = labels.select("*", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(most_labels)))).alias("level"))
    probes = levels.select(
        canonical(F.slice("labels", F.lit(1), F.col("level")), F.col("path")).alias("key"),
        F.lit(PROBE).alias("kind"), F.lit(0).alias("step"), "host", "path", F.lit(None).cast("string").alias("verdict"),
    )
    return opened.unionByName(closed).unionByName(probes)


def swept(events: DataFrame) -> DataFrame:
    """For each url and domain with an active rule that on top of the stack: host, path, rule_host, rule, verdict."""
    count = partitions(events.sparkSession)
    dealt = events.repartitionByRange(count, "key", "kind", F.xxhash64("host", "path"))
    dealt = stage(dealt.withColumn("range", F.spark_partition_id()))

    so_far = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    base = dealt.groupBy("range").agg(F.sum("step").alias("step"))
    base = base.select("range", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("base"))
    rows = dealt.withColumn("inner", F.sum("step").over(so_far)).join(F.broadcast(base), "range")
    rows = rows.withColumn("depth", F.col("base") + F.col("inner")).where((F.col("depth") > 0) & (F.col("kind") != CLOSE))

    opening = F.when(F.col("kind") == OPEN, F.struct(F.col("host").alias("rule_host"), F.concat("host", "path").alias("rule"), "verdict"))
    rows = rows.withColumn("opened", opening)
    same_depth = Window.partitionBy("range", "depth").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("depth").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy("range", "depth").agg(F.max_by("opened", F.when(F.col("kind") == OPEN, F.col("key"))).alias("opened"))
    carried = last.select("range", "depth", F.last("opened", ignorenulls=True).over(earlier).alias("carried"))
    topped = rows.withColumn("top", F.last("opened", ignorenulls=True).over(same_depth)).where(F.col("kind") == PROBE)
    topped = topped.join(carried, ["range", "depth"], "left").withColumn("top", F.coalesce("top", "carried"))
    return topped.select("host", "path", "top.*")


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """``key``, host, path, rule (null where none fits) and verdict of every row of ``urls``. ``rules`` has the
    columns rule and verdict (allow, block)."""
    host, path = host_and_path(F.col(url))
    rows = urls.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rules = stage(rules_of(rules))
    most_labels = rules.agg(F.max(F.size(labels_of(F.col("host"))))).first()[0]
    if most_labels is None:
        found = rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
        return found.withColumnRenamed("key", key)
    different = stage(rows.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n")))
    tops = swept(events(different, rules, most_labels))
    order = F.struct(F.length("rule").alias("length"), F.length("rule_host").alias("host_length"), "rule", "verdict")
    best = tops.groupBy("host", "path").agg(F.max(order).alias("best"))
    on = ["host", "path"]
    hosted = spread_join(rows.where("host <> ''"), best, on, "left", ["key"], hot_keys(different, on, count=F.col("n")))
    rest = rows.where("host = ''").withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    judged = hosted.unionByName(rest)
    return judged.select(
        F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
