"""Ridge regression in closed form: one aggregation gathers the moments of all groups, the driver solves 10 x 10 systems."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...storage import written
from ..predictor import Model, log_speedup
from .dataset import FEATURES, folds
from .metrics import predictions, regression


def medians(rows: DataFrame, features: list[str] | None = None) -> list[float]:
    names = features or FEATURES
    found = rows.agg(*[F.percentile(F.when(~F.isnan(c), F.col(c)), 0.5).alias(c) for c in names]).first()
    return [0.0 if found[c] is None else float(found[c]) for c in names]


def filled(rows: DataFrame, values: list[float], features: list[str] | None = None) -> DataFrame:
    """Missing features at the given values."""
    return rows.withColumns({c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(v)) for c, v in zip(features or FEATURES, values, strict=True)})


def moments(rows: DataFrame, target: Column, by: list[str] | None = None, features: list[str] | None = None) -> DataFrame:
    """n, sums, and products of the features and the target: a few dozen numbers per group, made by partial aggregation."""
    x = [F.col(c) for c in features or FEATURES]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]
    products = [F.sum(a * x[j]).alias(f"p{i}_{j}") for i, a in enumerate(x) for j in range(i, len(x))]
    cross = [F.sum(a * target).alias(f"t{i}") for i, a in enumerate(x)]
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.sum(target).alias("t"), *sums, *products, *cross)


def solve(m, alpha: float, fills: list[float], size: int = len(FEATURES)) -> Model:
    """The model from one row of moments: features standardised by their population deviation, intercept not penalised."""
    n = m["n"]
    if not n:
        raise ValueError("there are no rows to fit")
    mean = np.array([m[f"s{i}"] for i in range(size)]) / n
    second = np.array([[m[f"p{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
    centred = second - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(centred) / n, 0.0))
    scale = np.where(scale > 10 * np.finfo(float).eps * np.maximum(np.abs(mean), 1e-300), scale, 1.0)
    y = m["t"] / n
    cross = (np.array([m[f"t{i}"] for i in range(size)]) - n * mean * y) / scale
    w = np.linalg.solve(centred / np.outer(scale, scale) + alpha * np.eye(size), cross)
    raw = w / scale
    return Model(float(y - raw @ mean), tuple(map(float, raw)), tuple(fills), tuple(map(float, mean)), tuple(map(float, scale)), float(y), tuple(map(float, w)))


def fit(rows: DataFrame, alpha: float = 1.0, target: str = "speedup", features: list[str] | None = None) -> Model:
    """The model of the log of the target."""
    fills = medians(rows, features)
    return solve(moments(filled(rows, fills, features), F.ln(target), None, features).first(), alpha, fills, len(features or FEATURES))


def fit_groups(rows: DataFrame, by: list[str], alpha: float = 1.0, target: str = "speedup") -> dict[tuple, Model]:
    """A model for each group, for a bounded number of groups (folds, variants, kernels), from one aggregation."""
    fills = medians(rows)
    return {tuple(m[c] for c in by): solve(m, alpha, fills) for m in moments(filled(rows, fills), F.ln(target), by).collect()}


def cross_validated(rows: DataFrame, count: int = 5, alpha: float = 1.0, experiment: str = "grouped_cv") -> DataFrame:
    """Predictions of each row by the model that hasn't seen its group.

    The moments of all folds come from one aggregation; a fold's training moments are the total less its own.
    """
    dealt = folds(rows, count)
    fills = medians(rows)
    # features are worked out once; everything after that reads them
    rows = written(filled(rows, fills).join(dealt, "base_graph"), "ridge-rows")
    by_fold = {m["fold"]: m.asDict() for m in moments(rows, F.ln("speedup"), ["fold"]).collect()}
    found = None
    for fold in sorted(by_fold):
        train = {k: sum((m[k] for f, m in by_fold.items() if f != fold), 0) for k in by_fold[fold] if k != "fold"}
        if train["n"]:
            one = log_speedup(solve(train, alpha, fills))
            found = F.when(F.col("fold") == fold, one) if found is None else found.when(F.col("fold") == fold, one)
    if found is None:
        raise ValueError("cross-validation needs two groups")
    return predictions(rows, found, experiment, "fold").where(F.col("pred_log_speedup").isNotNull())


def covered_once(frame: DataFrame, rows: DataFrame) -> None:
    """Fails unless each row was predicted once."""
    a, b, d = frame.count(), rows.count(), frame.select("graph_id").distinct().count()
    if not a == b == d:
        raise ValueError(f"{b} rows, {a} predictions of {d} graphs")


def held_out(train: DataFrame, test: DataFrame, alpha: float = 1.0, experiment: str = "held_out") -> DataFrame:
    """Predictions of one table by the model of another, which shares no group with it."""
    shared = train.select("base_graph").distinct().join(test.select("base_graph").distinct(), "base_graph", "left_semi")
    if experiment == "held_out" and not shared.isEmpty():
        raise ValueError("training and test tables share graphs")
    model = fit(train, alpha)
    return predictions(filled(test, list(model.medians)), log_speedup(model), experiment)


def experiments(train: DataFrame, sparse: DataFrame, external: DataFrame, count: int = 5, alpha: float = 1.0) -> dict[str, DataFrame]:
    """The four evaluations: grouped cross-validation, the same graphs unperturbed, held-out graphs by fold, another family."""
    out = {"A_grouped_cv": cross_validated(train, count, alpha, "A_grouped_cv"), "B_same_graphs": held_out(train, sparse, alpha, "B_same_graphs")}
    common = train.select("base_graph").distinct().join(sparse.select("base_graph").distinct(), "base_graph", "left_semi")
    dealt = folds(common, count)
    parts = None
    for fold in range(count):
        a, b = train.join(dealt.where(F.col("fold") != fold), "base_graph", "left_semi"), sparse.join(dealt.where(F.col("fold") == fold), "base_graph", "left_semi")
        if a.isEmpty() or b.isEmpty():
            continue
        model = fit(a, alpha)
        part = predictions(filled(b, list(model.medians)), log_speedup(model), "C_held_out", fold)
        parts = part if parts is None else parts.unionByName(part)
    if parts is not None:
        out["C_held_out"] = parts
    out["D_external"] = held_out(train, external, alpha, "D_external")
    return out


def coefficients(spark, model: Model) -> DataFrame:
    """feature, raw and standardised coefficient, by the size of the latter."""
    rows = [(f, float(r), float(s)) for f, r, s in zip(FEATURES, model.coefficients, model.scaled_coefficients, strict=True)]
    return spark.createDataFrame(rows, "feature string, raw double, standardised double").orderBy(F.desc(F.abs("standardised")), "feature")


def cross_inputs(models: dict[str, Model], inputs: dict[str, DataFrame]) -> DataFrame:
    """Metrics of each model on each table: trained_on, applied_to, and those of `regression`."""
    out = None
    for name, model in models.items():
        for other, rows in inputs.items():
            frame = predictions(filled(rows, list(model.medians)), log_speedup(model), f"{name}_{other}")
            part = regression(frame).withColumns({"trained_on": F.lit(name), "applied_to": F.lit(other)})
            out = part if out is None else out.unionByName(part)
    return out
