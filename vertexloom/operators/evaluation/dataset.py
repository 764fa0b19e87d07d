"""Feature tables: loading with checks, views, profiles, groups and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.scalars import base_graph, natural_order
from ...sources.tables import normalised, require
from ..positions import with_positions

BINS = range(1, 11)
VARIANTS = ("exact", "sampled")
FEATURES = [f"r{i}" for i in BINS]
COLUMNS = ["graph_id", *[f"{v}_{c}" for v in VARIANTS for c in [*FEATURES, "time_ms"]], "speedup"]
NUMERIC = COLUMNS[1:]


class BadData(ValueError):
    """What a feature table must not hold."""


def _examples(rows: DataFrame, what: str, limit: int = 10) -> None:
    found = [r[0] for r in rows.select("graph_id").limit(limit).collect()]
    if found:
        raise BadData(f"{what}: {', '.join(map(str, found))}")


def coerced(rows: DataFrame) -> DataFrame:
    """Numeric columns as doubles, null where a cell is no number."""
    return rows.withColumns({c: F.expr(f"try_cast(nullif(trim(cast(`{c}` as string)), '') as double)") for c in NUMERIC}).withColumn("graph_id", F.trim(F.col("graph_id").cast("string")))


def load(rows: DataFrame, kernel: str, dataset: str, perturbed: bool = False, slack: float = 1e-12, off: float = 1e-3) -> DataFrame:
    """A checked feature table with base_graph, kernel, dataset; sum_warning marks rows whose probabilities don't sum to 1.

    Missing columns, cells that are no numbers, repeated ids, speedups and times that aren't above 0, and negative
    probabilities fail with up to ten ids as examples.
    """
    rows = normalised(rows)
    require(rows, COLUMNS)
    rows = coerced(rows)
    gap, infinite, negative = F.col("graph_id").isNull(), F.lit(False), F.lit(False)
    for c in NUMERIC:
        gap = gap | F.col(c).isNull() | F.isnan(c)
        infinite = infinite | (F.abs(c) == float("inf"))
        if "_r" in c:
            negative = negative | (F.col(c) < -slack)
    small = (F.col("speedup") <= 0) | (F.col("exact_time_ms") <= 0) | (F.col("sampled_time_ms") <= 0)
    checks = {"missing or unreadable numbers": gap, "numbers that aren't finite": infinite, "speedups or times that aren't above 0": small, "negative probabilities": negative}
    # one pass counts all of them; ids are looked for only where there are any
    failed = rows.agg(*[F.count_if(F.coalesce(bad, F.lit(False))) for bad in checks.values()]).first()
    if failed[0]:
        _examples(rows.where(gap), "missing or unreadable numbers")
    _examples(rows.groupBy("graph_id").count().where("count > 1").orderBy("graph_id"), "repeated graph ids")
    for (what, bad), n in zip(checks.items(), failed, strict=True):
        if n:
            _examples(rows.where(bad), what)
    sums = [F.abs(sum((F.col(f"{v}_{f}") for f in FEATURES), F.lit(0.0)) - 1.0) > off for v in VARIANTS]
    name = base_graph(F.col("graph_id")) if perturbed else F.col("graph_id")
    return rows.withColumns({"base_graph": name, "kernel": F.lit(kernel), "dataset": F.lit(dataset), "sum_warning": sums[0] | sums[1]})


def feature_view(rows: DataFrame, variant: str) -> DataFrame:
    """The rows with one variant's features as r1 to r10 and its time as feature_time_ms."""
    if variant not in VARIANTS:
        raise ValueError(f"no variant {variant!r}")
    kept = [c for c in rows.columns if c not in {f"{v}_{f}" for v in VARIANTS for f in [*FEATURES, "time_ms"]}]
    return rows.select(*kept, *[F.col(f"{variant}_{f}").alias(f) for f in FEATURES], F.col(f"{variant}_time_ms").alias("feature_time_ms"), F.lit(variant).alias("feature_variant"))


def profile(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, base graphs, and the distribution of the speedup."""
    s = F.col("speedup")
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"), F.countDistinct("base_graph").alias("base_graphs"), F.avg(s).alias("speedup_mean"), F.percentile(s, 0.5).alias("speedup_median"), F.min(s).alias("speedup_min"), F.max(s).alias("speedup_max"),
        F.count_if(s > 1).alias("beneficial"), F.percentile("exact_time_ms", 0.5).alias("exact_time_median"), F.percentile("sampled_time_ms", 0.5).alias("sampled_time_median"), F.percentile("exact_time_ms", 0.9).alias("exact_time_p90"), F.percentile("sampled_time_ms", 0.9).alias("sampled_time_p90"),
    )


def group_sizes(rows: DataFrame, expected: int | None = None) -> DataFrame:
    """base_graph, rows; fails if a group hasn't the expected size."""
    sizes = rows.groupBy("base_graph").agg(F.count("*").alias("rows"))
    if expected is not None:
        bad = sizes.where(F.col("rows") != expected).limit(10).collect()
        if bad:
            raise BadData(f"groups without {expected} rows: " + ", ".join(f"{r['base_graph']} ({r['rows']})" for r in bad))
    return sizes


def common_graphs(one: DataFrame, two: DataFrame, key: str = "base_graph") -> DataFrame:
    """key, side: both, left_only or right_only."""
    left, right = (x.select(key).distinct().withColumn(n, F.lit(True)) for x, n in ((one, "_l"), (two, "_r")))
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    return left.join(right, key, "full").select(key, side.alias("side"))


def folds(rows: DataFrame, count: int = 5, key: str = "base_graph", order: list[Column] | None = None) -> DataFrame:
    """key, fold: different graphs in natural order, dealt round robin."""
    names = rows.select(key).distinct()
    placed = with_positions(names, *(order or natural_order(F.col(key))), name="turn")
    return placed.select(key, (F.col("turn") % count).cast("int").alias("fold"))


def split(rows: DataFrame, dealt: DataFrame, fold: int, key: str = "base_graph") -> tuple[DataFrame, DataFrame]:
    """The rows of the other folds, and those of this one."""
    train, test = dealt.where(F.col("fold") != fold).select(key), dealt.where(F.col("fold") == fold).select(key)
    return rows.join(train, key, "left_semi"), rows.join(test, key, "left_semi")


def aligned(one: DataFrame, two: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """A row for each column: both, left_only, right_only, and the largest difference in rows on both sides."""
    left = one.select(*keys, F.lit(True).alias("_l"), *[F.col(c).alias(f"{c}_l") for c in columns])
    right = two.select(*keys, F.lit(True).alias("_r"), *[F.col(c).alias(f"{c}_r") for c in columns])
    joined = left.join(right, keys, "full")
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.abs(F.col(f"{c}_l") - F.col(f"{c}_r")).alias("diff")) for c in columns])).alias("p")
    rows = joined.select(side.alias("side"), pairs).select("side", "p.*")
    out = rows.groupBy("column").agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("both", "left_only", "right_only")], F.max("diff").alias("max_abs_diff"))
    return out.withColumn("within", (F.coalesce("max_abs_diff", F.lit(0.0)) <= tolerance) & (F.col("left_only") == 0) & (F.col("right_only") == 0))
