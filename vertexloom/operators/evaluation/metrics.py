"""Errors, correlations, gates and comparisons of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dataset import FEATURES

FLOOR = 1e-12
# fixed values: (skip at or below, relabel at or above)
BANDS = ((0.99, 1.01), (0.98, 1.02), (0.97, 1.03), (0.96, 1.04), (0.95, 1.05), (0.94, 1.06), (0.93, 1.07))


def with_rank(rows: DataFrame, column: str, name: str, by: list[str] | None = None) -> DataFrame:
    """rows with the average rank of a column: ties share the mean of their places.

    Values are counted first and places summed over the different values, so rows themselves aren't put in one order.
    """
    by = by or []
    keys = [*by, column]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_same"))
    before = Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(name, F.coalesce(F.sum("_same").over(before), F.lit(0)) + (F.col("_same") + 1) / 2.0)
    ranks = ranks.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)], name)
    condition = F.lit(True)
    for i, c in enumerate(keys):
        condition = condition & F.col(c).eqNullSafe(F.col(f"_key{i}"))
    return rows.join(ranks, condition).drop(*[f"_key{i}" for i in range(len(keys))])


def guarded_corr(x: Column, y: Column, least: float) -> Column:
    """Pearson's correlation; null for fewer than two rows or a side that hardly varies."""
    spread = F.least(F.stddev_pop(x), F.stddev_pop(y))
    # corr itself divides, and fails where a side doesn't vary
    found = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when((F.count("*") >= 2) & (spread >= least), found)


def pearson(rows: DataFrame, x: str, y: str, name: str = "pearson", by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(guarded_corr(F.col(x), F.col(y), 1e-12).alias(name))


def spearman(rows: DataFrame, x: str, y: str, name: str = "spearman", by: list[str] | None = None) -> DataFrame:
    ranked = with_rank(with_rank(rows.select(*(by or []), x, y), x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*(by or [])).agg(guarded_corr(F.col("_rx"), F.col("_ry"), 1e-15).alias(name))


def mape(true: Column, found: Column) -> Column:
    return F.avg(F.abs(true - found) / F.greatest(F.abs(true), F.lit(FLOOR)))


def smape(true: Column, found: Column) -> Column:
    return F.avg(2.0 * F.abs(true - found) / F.greatest(F.abs(true) + F.abs(found), F.lit(FLOOR)))


def approximation_rows(rows: DataFrame) -> DataFrame:
    """graph_id, l1, tv, l2, cosine, max_abs, time_ratio of exact and sampled features."""
    e, s = F.array(*[F.col(f"exact_{f}") for f in FEATURES]), F.array(*[F.col(f"sampled_{f}") for f in FEATURES])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda n, x: n + x)
    gap = F.zip_with(e, s, lambda a, b: F.abs(a - b))
    rows = rows.select("*", gap.alias("_gap"), F.sqrt(total(F.transform(e, lambda x: x * x))).alias("_ne"), F.sqrt(total(F.transform(s, lambda x: x * x))).alias("_ns"), total(F.zip_with(e, s, lambda a, b: a * b)).alias("_dot"))
    l1 = total(F.col("_gap"))
    cosine = F.when((F.col("_ne") > FLOOR) & (F.col("_ns") > FLOOR), F.col("_dot") / (F.col("_ne") * F.col("_ns")))
    return rows.select("graph_id", l1.alias("l1"), (l1 / 2).alias("tv"), F.sqrt(total(F.transform("_gap", lambda x: x * x))).alias("l2"), cosine.alias("cosine"), F.array_max("_gap").alias("max_abs"), (F.col("exact_time_ms") / F.col("sampled_time_ms")).alias("time_ratio"))


def approximation_summary(rows: DataFrame) -> DataFrame:
    """One row over approximation_rows: means, quantiles, and the geometric mean of the time ratio."""
    r = approximation_rows(rows)
    return r.agg(
        F.count("*").alias("rows"), F.avg("l1").alias("l1_mean"), F.avg("tv").alias("tv_mean"), F.percentile("tv", 0.5).alias("tv_median"), F.percentile("tv", 0.9).alias("tv_p90"), F.percentile("tv", 0.95).alias("tv_p95"), F.max("tv").alias("tv_max"),
        F.avg("l2").alias("l2_mean"), F.avg("cosine").alias("cosine_mean"), F.percentile("cosine", 0.1).alias("cosine_p10"), F.avg("max_abs").alias("max_abs_mean"), F.max("max_abs").alias("max_abs_max"), F.exp(F.avg(F.ln("time_ratio"))).alias("time_ratio_geomean"), F.percentile("time_ratio", 0.5).alias("time_ratio_median"),
    )


def approximation_by_bin(rows: DataFrame) -> DataFrame:
    """A row for each feature: bias, MAE, RMSE, largest error, Pearson, Spearman."""
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"exact_{f}").alias("exact"), F.col(f"sampled_{f}").alias("sampled")) for f in FEATURES])).alias("p")).select("p.*")
    gap = F.col("sampled") - F.col("exact")
    errors = pairs.groupBy("feature").agg(F.avg(gap).alias("bias"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.max(F.abs(gap)).alias("max_abs"), guarded_corr(F.col("exact"), F.col("sampled"), 1e-12).alias("pearson"))
    return errors.join(spearman(pairs, "exact", "sampled", by=["feature"]), "feature")


def predictions(rows: DataFrame, log_prediction: Column | str, experiment: str = "", fold: int | str | None = None) -> DataFrame:
    """The prediction frame: true and predicted log speedup, errors, and whether reordering pays."""
    rows = rows.withColumns({"true_log_speedup": F.ln("speedup"), "pred_log_speedup": F.col(log_prediction) if isinstance(log_prediction, str) else log_prediction})
    rows = rows.withColumn("pred_speedup", F.exp("pred_log_speedup"))
    gap = F.col("pred_speedup") - F.col("speedup")
    return rows.withColumns({"signed_error_speedup": gap, "abs_error_speedup": F.abs(gap), "ape": F.abs(gap) / F.greatest(F.abs("speedup"), F.lit(FLOOR)), "true_beneficial": F.col("speedup") > 1.0, "experiment": F.lit(experiment), "fold": (F.col(fold) if isinstance(fold, str) else F.lit(fold)).cast("int")})


def regression(frame: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Errors of the log speedup and of the speedup, with correlations."""
    by = by or []
    t, p, s, q = (F.col(c) for c in ("true_log_speedup", "pred_log_speedup", "speedup", "pred_speedup"))
    residual, spread = F.sum((t - p) ** 2), F.var_pop(t) * F.count("*")
    out = frame.groupBy(*by).agg(
        F.count("*").alias("rows"), F.avg(F.abs(t - p)).alias("mae_log"), F.sqrt(F.avg((t - p) ** 2)).alias("rmse_log"), F.when(spread > 0, 1 - residual / spread).alias("r2_log"), guarded_corr(t, p, 1e-12).alias("pearson"),
        F.avg(F.abs(s - q)).alias("mae_speedup"), F.sqrt(F.avg((s - q) ** 2)).alias("rmse_speedup"), mape(s, q).alias("mape"), smape(s, q).alias("smape"),
    )
    ranked = spearman(frame, "true_log_speedup", "pred_log_speedup", by=by)
    return out.join(ranked, by) if by else out.join(F.broadcast(ranked))  # one row


def fold_summary(by_fold: DataFrame) -> DataFrame:
    """Mean and sample deviation over folds of the MAE of the log, Spearman and MAPE."""
    return by_fold.agg(*[f(c).alias(f"{c}_{n}") for c in ("mae_log", "spearman", "mape") for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def _thresholds(frame: DataFrame, values, names: list[str]) -> DataFrame:
    rows = frame.sparkSession.createDataFrame([tuple(map(float, v)) if isinstance(v, (tuple, list)) else (float(v),) for v in values], ", ".join(f"{n} double" for n in names))
    return F.broadcast(rows)  # a few rows


def band_gate(frame: DataFrame, bands=BANDS) -> DataFrame:
    """For each band: confusion counts of what is decided, coverage, accuracy, precision, recall, specificity."""
    each = frame.select("pred_speedup", "true_beneficial").crossJoin(_thresholds(frame, bands, ["low", "high"]))
    yes, no, good = F.col("pred_speedup") >= F.col("high"), F.col("pred_speedup") <= F.col("low"), F.col("true_beneficial")
    out = each.groupBy("low", "high").agg(F.count("*").alias("rows"), F.count_if(yes & good).alias("tp"), F.count_if(yes & ~good).alias("fp"), F.count_if(no & ~good).alias("tn"), F.count_if(no & good).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    decided = tp + fp + tn + fn
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return out.withColumns({"uncertain": F.col("rows") - decided, "coverage": share(decided, F.col("rows")), "accuracy": share(tp + tn, decided), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "specificity": share(tn, tn + fp)})


def conservative_gate(frame: DataFrame, taus=(1.0, 1.01, 1.02, 1.03, 1.05, 1.1)) -> DataFrame:
    """For each threshold: what reordering where the prediction reaches it would bring, against always and at best."""
    each = frame.select("speedup", "pred_speedup").crossJoin(_thresholds(frame, taus, ["tau"]))
    chosen = F.col("pred_speedup") >= F.col("tau")
    got = F.when(chosen, F.col("speedup")).otherwise(1.0)
    return each.groupBy("tau").agg(F.count("*").alias("rows"), F.count_if(chosen).alias("selected"), F.count_if(chosen & (F.col("speedup") <= 1)).alias("bad"), F.avg(got).alias("mean"), F.percentile(got, 0.5).alias("median"), F.exp(F.avg(F.ln(got))).alias("geomean"), F.avg(F.greatest("speedup", F.lit(1.0))).alias("oracle_mean"), F.avg("speedup").alias("always_mean"))


def paired(one: DataFrame, two: DataFrame, keys: list[str], names=("exact", "sampled")) -> DataFrame:
    """speedup and both predictions per key; fails where a side repeats a key, lacks one, or the true values differ."""
    for side in (one, two):
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError("a key is repeated")
    left = one.select(*keys, "speedup", F.col("pred_speedup").alias(f"{names[0]}_pred"))
    right = two.select(*keys, F.col("speedup").alias("_other"), F.col("pred_speedup").alias(f"{names[1]}_pred"))
    both = left.join(right, keys)
    counts = [x.count() for x in (both, one, two)]
    if len(set(counts)) > 1:
        raise ValueError(f"keys differ: {counts[1]} and {counts[2]} rows, {counts[0]} in both")
    if not both.where(F.abs(F.col("speedup") - F.col("_other")) > 1e-12).isEmpty():
        raise ValueError("the sides' true speedups differ")
    return both.drop("_other")


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """How two predictions differ: mean and largest difference, correlations."""
    gap = F.abs(F.col(a) - F.col(b))
    out = pairs.agg(F.count("*").alias("rows"), F.avg(gap).alias("mean_abs"), F.percentile(gap, 0.95).alias("p95_abs"), F.max(gap).alias("max_abs"), guarded_corr(F.col(a), F.col(b), 1e-12).alias("pearson"))
    return out.join(F.broadcast(spearman(pairs, a, b)))  # one row


def disagreement(pairs: DataFrame, a: str, b: str, taus=(1.0, 1.01, 1.02, 1.03, 1.05, 1.1)) -> DataFrame:
    """For each threshold: rows that only one prediction would reorder, and how many of them lose by it."""
    each = pairs.crossJoin(_thresholds(pairs, taus, ["tau"]))
    x, y, bad = F.col(a) >= F.col("tau"), F.col(b) >= F.col("tau"), F.col("speedup") <= 1
    return each.groupBy("tau").agg(F.count("*").alias("rows"), F.count_if(x != y).alias("differ"), F.count_if(x & ~y).alias("first_only"), F.count_if(y & ~x).alias("second_only"), F.count_if(x & ~y & bad).alias("first_only_bad"), F.count_if(y & ~x & bad).alias("second_only_bad"), F.avg((x != y).cast("double")).alias("rate"))


def compared(metrics: DataFrame, key: str, one: str, two: str, columns: list[str]) -> DataFrame:
    """A row for each metric: its value for two kinds of `key`, and the difference."""
    long = metrics.where(F.col(key).isin(one, two)).select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("m")).select(key, "m.*")
    side = lambda k: F.max(F.when(F.col(key) == k, F.col("value")))
    return long.groupBy("metric").agg(side(one).alias(one), side(two).alias(two)).withColumn("delta", F.col(two) - F.col(one))
