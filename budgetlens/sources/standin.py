"""Raw wide "unit x item" table derived from the TPC-H-like test tables.

Unit = customer, item k = spend on parts of size k (``l_extendedprice*(1-l_discount)``),
income = total order value. Items 1-33 are stored as monthly amounts (divided by 12),
34-50 as annual ones, so the roll-up has mixed recall periods to undo.

Plan: lineitem -> part -> orders is two shuffle joins, then one hash aggregate by
customer with 50 conditional sums (map-side partial aggregation collapses hot
customers before the shuffle). The per-customer order aggregate is hash
partitioned on the same key, so the final joins to it do not re-shuffle it.
nation (25 rows) and region (5 rows) are fixed-size TPC-H dimensions and are
broadcast; every other join is left to Catalyst and AQE (which broadcasts at run
time only below ``spark.sql.adaptive.autoBroadcastJoinThreshold``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import STANDIN_SPEC, RollupSpec

N_ITEMS = 50
MONTHLY_ITEMS = 33
# fixed values: stand-in thresholds
FLAG_ORDER_VALUE = 450_000.0
SEGMENT_NULL_ABOVE = 9950.0
PRIORITIES = [label for _, label in STANDIN_SPEC.count_labels]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form ``(unit_id, item, amount)``: one row per line item."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .join(orders, li.l_orderkey == orders.o_orderkey)
        .select(
            F.col("o_custkey").alias("unit_id"),
            F.col("p_size").alias("item"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
        )
    )


def item_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide ``(unit_id, item_1..item_50)``; NULL where a unit bought nothing of that size."""
    spend = item_spend(spark, sf_dir)
    cols = []
    for k in range(1, N_ITEMS + 1):
        s = F.sum(F.when(F.col("item") == k, F.col("amount")))
        cols.append((s / 12 if k <= MONTHLY_ITEMS else s).alias(f"item_{k}"))
    return spend.groupBy("unit_id").agg(*cols)


def order_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    pri = [
        F.count_if(F.col("o_orderpriority") == lab).alias(col)
        for col, lab in STANDIN_SPEC.count_labels
    ]
    return o.groupBy(F.col("o_custkey").alias("unit_id")).agg(
        F.sum("o_totalprice").alias("income"),
        F.count(F.lit(1)).alias("size"),
        F.count_if(F.col("o_orderstatus") == "P").alias("dependents"),
        *pri,
        F.max((F.col("o_totalprice") > FLAG_ORDER_VALUE).cast("int")).alias("has_flag"),
    )


def raw_units(spark: SparkSession, sf_dir: str, spec: RollupSpec = STANDIN_SPEC) -> DataFrame:
    """The raw wide table the unit build starts from (one row per customer)."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = F.broadcast(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey))
    orders = order_table(spark, sf_dir)
    items = item_table(spark, sf_dir)
    base = cust.join(geo, cust.c_nationkey == geo.n_nationkey, "left").select(
        F.col("c_custkey").alias("unit_id"),
        (1 + F.col("c_nationkey") / F.lit(25.0)).alias("weight"),
        F.col("r_name").alias("area"),
        F.when(F.col("c_acctbal") > SEGMENT_NULL_ABOVE, F.lit(None).cast("string"))
        .otherwise(F.col("c_mktsegment"))
        .alias("segment"),
        F.greatest(-F.col("c_acctbal"), F.lit(0.0)).alias("debt"),
    )
    counts = [c for c, _ in spec.count_labels]
    return (
        base.join(orders, "unit_id", "left")
        .join(items, "unit_id", "left")
        .select(
            "unit_id", "weight", "income",
            F.coalesce("size", F.lit(0)).alias("size"),
            F.coalesce("dependents", F.lit(0)).alias("dependents"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
            "area", "segment", "debt",
            F.coalesce("has_flag", F.lit(0)).alias("has_flag"),
            *[f"item_{k}" for k in range(1, N_ITEMS + 1)],
        )
    )
