"""Delimited tables: header-driven CSV, logs with `&` between fields, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

R = [f"r{i}" for i in range(1, 11)]
#: A record of an ordering: exact features and times.
RUN_LOG = "graph_id int, method string, param string, t_order_ms double, t_apply_ms double, " + ", ".join(f"{r} double" for r in R) + ", t_prep_ms double, t_spmv_ms double"
#: A record with exact and sampled features.
DUAL_LOG = (
    "graph_id int, method string, param string, t_order_ms double, t_apply_ms double, " + ", ".join(f"exact_{r} double" for r in R) + ", exact_time_ms double, " + ", ".join(f"sampled_{r} double" for r in R)
    + ", sampled_time_ms double, t_stream_ms double, exact_reuse_cnt long, sampled_reuse_cnt long, cold_cnt long, large_cnt long, unresolved_cnt long, t_prep_ms double, t_spmv_ms double"
)
CDF_LOG = "graph_id int, degree int, rows_in double, nnz_in double, rows_out double, nnz_out double"


def normalised(rows: DataFrame) -> DataFrame:
    """Column names in lower case without spaces around."""
    return rows.toDF(*[c.strip().lower() for c in rows.columns])


def require(rows: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, by normalised name; types are for the reader's checks."""
    return normalised(spark.read.option("header", True).csv(path))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fields between `&`, without a header; blank ones are null."""
    raw = spark.read.option("sep", "&").schema(", ".join(f"{f.split()[0]} string" for f in schema.split(", "))).csv(path)
    return raw.select(*[F.expr(f"try_cast(nullif(trim({n}), '') as {t})").alias(n) for n, t in (f.split() for f in schema.split(", "))])


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("sep", "&").option("header", False).csv(path)


def append_cdf(cdf: DataFrame, graph_id: int, path: str) -> None:
    """Degree distributions as lines of the six fields, one for each degree, by degree."""
    append_log(cdf.select(F.lit(graph_id).alias("graph_id"), "degree", "rows_in", "nnz_in", "rows_out", "nnz_out").orderBy("degree"), path)


def append_records(rows: DataFrame, path: str) -> None:
    """The run log as Parquet, to which each run adds a file."""
    rows.write.mode("append").parquet(path)


def speedups(log: DataFrame, base: str = "origin", method: str = "gorder1") -> DataFrame:
    """graph_id, speedup: the time of the base run over that of the method, where both were recorded."""
    of = lambda m, n: log.where(F.col("method") == m).select("graph_id", F.col("t_spmv_ms").alias(n))
    return of(base, "a").join(of(method, "b"), "graph_id").select("graph_id", (F.col("a") / F.col("b")).alias("speedup"))
