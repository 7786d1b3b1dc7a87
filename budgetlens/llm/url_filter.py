"""URL filters as a sort-merge range join, in DataFrame operations only.

A host is keyed by its labels in reverse, each followed by a slash, which no host holds (``net/example/www/``), so a rule for a host and
all its subdomains is the key interval that starts at the rule's key and holds every key it is a prefix of. Intervals
nest. URLs and rules are sorted together by key, range-partitioned with a salt so that one hot host spreads over many
partitions, and each partition is swept in order with a stack: slot j holds the last rule host of j labels. The sort
order makes slot j the URL's enclosing rule if its key is a prefix of the URL's key (else that rule has ended). The rules
that enclose a partition's first key are put in front of it by an equi-join on that key's prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from budgetlens.llm.common import shuffle_partitions, stored

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# fixed values: the rules of the contract (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _AZ, _az), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/")))


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``urls``.

    A rule fits its host and all subdomains if the URL's path starts with the rule's; of several the one with the
    longest host wins, then the longest path (of rules that repeat a host and path, ``block`` wins). URLs that no rule
    fits, nulls included, get a null rule and the ``default`` verdict. Rules with a null or empty host fit nothing; a null path
    reads as empty. Ids may be null or repeated; other columns (any names) are not read.
    """
    n = shuffle_partitions(urls.sparkSession)
    host, path = url_host(F.col("u")), url_path(F.col("u"))
    src = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("u")).select("id", host.alias("host"), path.alias("path"))
    stack = (
        rules.select(F.lower("verdict").alias("verdict"), F.translate("host", _AZ, _az).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .where("host IS NOT NULL AND host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .groupBy(host_key(F.col("host")).alias("key"), "host")
        .agg(F.array_sort(F.collect_list(F.struct((-F.length("path")).alias("by"), "path", "verdict"))).alias("paths"))
        .select("key", F.size(F.split("key", "/")).alias("labels"), F.struct("key", "host", "paths").alias("rule")))
    depths = [r[0] for r in stack.select("labels").distinct().collect()]  # one row for each number of labels
    rule_type = stack.schema["rule"].dataType
    none = [F.lit(None).cast(t).alias(c) for c, t in (("id", src.schema["id"].dataType), ("host", "string"), ("path", "string"))]
    opens = stack.select("key", F.lit(0).alias("kind"), "labels", "rule", *none)
    visits = src.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("labels"), F.lit(None).cast(rule_type).alias("rule"), "id", "host", "path")
    dealt = stored(
        opens.unionByName(visits).withColumn("salt", F.xxhash64("id", "path"))
        .repartitionByRange(n, "key", "kind", "salt").drop("salt").withColumn("part", F.spark_partition_id()), "url-ranges")

    # rules that began before a partition and are still open at its first key: one row a partition and label
    first = dealt.groupBy("part").agg(F.min("key").alias("low")).select("part", F.split(F.expr("left(low, length(low) - 1)"), "/").alias("names"))
    prefix = F.transform(F.sequence(F.lit(1), F.size("names")), lambda k: F.concat(F.array_join(F.slice("names", 1, k), "/"), F.lit("/")))
    still_open = first.select("part", F.explode(prefix).alias("key")).join(stack, "key").select("part", "key", F.lit(0).alias("kind"), "labels", "rule", *none)
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = [F.last(F.when((F.col("kind") == 0) & (F.col("labels") == d), F.col("rule")), ignorenulls=True).over(sweep).alias(f"s{d}") for d in depths]
    swept = still_open.unionByName(dealt).select("key", "kind", "id", "host", "path", *slots).where("kind = 1")

    def best(slot: str) -> Column:
        rule = F.col(slot)
        fits = F.filter(rule["paths"], lambda p: F.startswith(F.col("path"), p["path"]))
        hit = F.get(fits, F.lit(0))
        return F.when(F.startswith(F.col("key"), rule["key"]) & hit.isNotNull(),
                      F.struct(F.concat(rule["host"], hit["path"]).alias("rule"), hit["verdict"].alias("verdict")))

    won = F.coalesce(*[best(f"s{d}") for d in sorted(depths, reverse=True)], F.lit(None).cast("struct<rule:string,verdict:string>")).alias("won")
    return swept.select("id", "host", "path", won).select(
        F.col("id").alias(id_col), "host", "path", F.col("won")["rule"].alias("rule"),
        F.coalesce(F.col("won")["verdict"], F.lit(default)).alias("verdict"))
