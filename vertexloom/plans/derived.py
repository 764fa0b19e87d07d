"""Graphs and feature tables that follow from ordinary tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph, from_pairs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """part -> the next part in an order, each pair once."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    pairs = lines.select(F.col("l_partkey").alias("row"), F.lead("l_partkey").over(order).alias("col")).where("col is not null").distinct()
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    return from_pairs(pairs, 0 if n is None else int(n) + 1, name="part_graph")


def supply_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """supplier -> part, every line item an edge, on one set of vertices: suppliers have few ids, so they are hubs."""
    lines = table(spark, sf_dir, "lineitem")
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    m = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0]
    return from_pairs(lines.select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")), max(n or 0, m or 0) + 1, name="supply_graph")


EDGE_SQL = """
s as (select cast(l_partkey as int) as src, cast(lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as int) as dst from lineitem),
edge as (select distinct src, dst from s where dst is not null),
v as (select cast(p_partkey as int) as id from part)
"""


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for measured features: a customer is a graph, shares of quantities are its histogram, early lines its sample."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = lines.join(orders, "l_orderkey").select("o_custkey", F.expr("cast(floor((l_quantity - 1) / 5) as int) + 1").alias("bin"), (F.col("l_linenumber") <= 3).alias("early"), (F.col("l_suppkey") % 97).alias("mark"))
    early = F.count_if("early")
    bins = [b for i in range(1, 11) for b in ((F.count_if(F.col("bin") == i) / F.count("*")).alias(f"exact_r{i}"), F.when(early > 0, F.count_if((F.col("bin") == i) & F.col("early")) / early).otherwise(0.0).alias(f"sampled_r{i}"))]
    out = rows.groupBy("o_custkey").agg(F.count("*").cast("double").alias("exact_time_ms"), (early + 1).cast("double").alias("sampled_time_ms"), (0.5 + F.sum("mark") / (97.0 * F.count("*"))).alias("speedup"), *bins)
    return out.select(F.col("o_custkey").cast("string").alias("graph_id"), "speedup", "exact_time_ms", "sampled_time_ms", *[f"{v}_r{i}" for v in ("exact", "sampled") for i in range(1, 11)]).withColumn("base_graph", (F.col("graph_id").cast("long") % 100).cast("string"))


_BINS = ",\n".join(f"count(*) filter (bin = {i}) / count(*) as exact_r{i}, case when count(*) filter (early) > 0 then count(*) filter (bin = {i} and early) / count(*) filter (early) else 0.0 end as sampled_r{i}" for i in range(1, 11))
FEATURE_SQL = f"""
lines as (select o_custkey, cast(floor((l_quantity - 1) / 5) as int) + 1 as bin, l_linenumber <= 3 as early, l_suppkey % 97 as mark from lineitem join orders on l_orderkey = o_orderkey),
f as (select cast(o_custkey as varchar) as graph_id, cast(o_custkey % 100 as varchar) as base_graph, cast(count(*) as double) as exact_time_ms, cast(count(*) filter (early) + 1 as double) as sampled_time_ms,
      cast(0.5 as double) + cast(sum(mark) as double) / (cast(97.0 as double) * count(*)) as speedup, {_BINS} from lines group by o_custkey)
"""
