"""URL filters by a sort-merge range join on reversed hosts, in DataFrame operations.

A host's key is its labels in reverse, each ended by a dot, so the hosts under a rule's host are one
interval of keys: from the rule's key up to it with the last dot raised to the next character.
Intervals are nested or apart. Where one opens or closes, the stack of open rules is known from the
rules alone; urls and these events are sorted together by key, and each url takes the stack of the
last event before it. Of the stack's rules whose path fits, the longest decides.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binsieve.llm.common import written

RULE_SCHEMA = "host string, path string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def events(rules: DataFrame) -> DataFrame:
    """(key, kind, stack) where intervals close (kind 0) and open (kind 1); stacks have the longest rules first."""
    clean = rules.where("host is not null and path is not null").select(F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("host"), "path", "verdict").distinct()
    entry = F.struct((-F.length("host") - F.length("path")).alias("order"), F.concat("host", "path").alias("rule"), "path", "verdict")
    clean = clean.select(host_key(F.col("host")).alias("key"), F.split("host", r"\.").alias("labels"), entry.alias("entry"))
    own = clean.groupBy("key").agg(F.array_sort(F.collect_list("entry")).alias("entries"), F.first("labels").alias("labels"))
    # A rule's host is inside those of its last labels: at most as many as it has labels.
    above = own.select("key", F.size("labels").alias("depth"), F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.struct(n.alias("n"), host_key(F.array_join(F.slice("labels", -n, n), ".")).alias("key")))).alias("a"))
    found = above.join(own.select(F.col("key").alias("outer"), "entries"), F.col("a.key") == F.col("outer"))
    stack = lambda rows: F.array_sort(F.flatten(F.collect_list(rows)))
    stacks = found.groupBy("key").agg(stack(F.col("entries")).alias("inside"), stack(F.when(F.col("a.n") < F.col("depth"), F.col("entries"))).alias("outside"))
    closed = F.concat(F.substring("key", F.lit(1), F.length("key") - 1), F.lit("/"))
    return stacks.select(F.col("key"), F.lit(1).alias("kind"), F.col("inside").alias("stack")).union(stacks.select(closed, F.lit(0), F.col("outside")))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Host, path, deciding rule (or null) and verdict of each url: one row out for each row in.

    Rows are sorted into ranges of (key, row): a host with a large part of all urls is cut by row, so
    it fills several ranges. What is open where a range begins comes from the last event before it,
    one row for each range. A null url has an empty host and path and the default verdict; an empty
    rule table gives every url the default; other columns are dropped, whatever their names.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    changes = events(rules)
    kind = changes.schema["stack"].dataType
    rows = urls.select(host_key(F.col("host")).alias("key"), F.lit(2).alias("kind"), F.lit(None).cast(kind).alias("stack"), "row", "id", "host", "path")
    rows = rows.unionByName(changes, allowMissingColumns=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, "key", "kind", "row").withColumn("range", F.spark_partition_id()), "url-ranges")
    last = ranged.groupBy("range").agg(F.max(F.when(F.col("kind") < 2, F.struct("key", "kind", "stack"))).alias("last"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = last.select("range", F.last("last", ignorenulls=True).over(before)["stack"].alias("begin"))
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 2")
    # One row for each range: as many as there are shuffle partitions.
    held = swept.join(F.broadcast(begins), "range").withColumn("open", F.coalesce("open", "begin"))
    best = F.get(F.filter("open", lambda r: F.col("path").startswith(r["path"])), 0)
    return held.withColumn("best", best).select(F.col("id").alias(id_column), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
