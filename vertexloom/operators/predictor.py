"""The speedup predictor: a linear model of the log speedup over ten reuse-distance probabilities."""

from __future__ import annotations

import json
from dataclasses import dataclass
from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 10


@dataclass(frozen=True)
class Model:
    """Raw intercept and coefficients, and for inputs with gaps the medians, means, scales and scaled parameters."""

    intercept: float
    coefficients: tuple[float, ...]
    medians: tuple[float, ...] = ()
    means: tuple[float, ...] = ()
    scales: tuple[float, ...] = ()
    scaled_intercept: float = 0.0
    scaled_coefficients: tuple[float, ...] = ()


# fixed values: the deployed model over sampled features of the merge-path kernel
DEPLOYED = Model(
    0.26649956401604796,
    (-0.3362573716950983, -0.2557862191260704, -0.24248079087236038, -0.0603012191232085, 0.28053687310764397, -0.016399984212930544, -0.04634379957053418, -0.30165791361557115, 2.754071221226108, 2.3042879761742348),
)


def log_speedup(model: Model, features: list[str] | None = None) -> Column:
    """b + sum of coefficient times feature, over the raw features."""
    names = features or [f"r{i}" for i in range(1, len(model.coefficients) + 1)]
    return sum((F.col(n) * F.lit(c) for n, c in zip(names, model.coefficients, strict=True)), F.lit(model.intercept))


def speedup(model: Model = DEPLOYED, features: list[str] | None = None) -> Column:
    return F.exp(log_speedup(model, features))


def speedup_with_gaps(model: Model, features: list[str] | None = None) -> Column:
    """With missing features at their medians, standardised, over the scaled parameters."""
    names = features or [f"r{i}" for i in range(1, len(model.scaled_coefficients) + 1)]
    terms = []
    for name, median, mean, scale, c in zip(names, model.medians, model.means, model.scales, model.scaled_coefficients, strict=True):
        value = F.when(F.isnan(name), None).otherwise(F.col(name))
        terms.append((F.coalesce(value, F.lit(median)) - mean) / scale * c)
    return F.exp(sum(terms, F.lit(model.scaled_intercept)))


def checked(predicted: DataFrame, column: str = "predicted_speedup") -> DataFrame:
    """The rows; a query over them fails where a prediction isn't a finite number above 0."""
    good = F.col(column).isNotNull() & ~F.isnan(column) & (F.col(column) > 0) & (F.col(column) != float("inf"))
    return predicted.withColumn(column, F.when(good, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("no valid prediction: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))))


def predict(features: DataFrame, model: Model = DEPLOYED, name: str = "predicted_speedup") -> DataFrame:
    return checked(features.withColumn(name, speedup(model)), name)


def to_sql(model: Model = DEPLOYED) -> str:
    """The raw formula as SQL text, for engines that have no model format."""
    return "exp(" + " + ".join([repr(model.intercept), *(f"({c!r}) * r{i}" for i, c in enumerate(model.coefficients, 1))]) + ")"


def from_json(text: str) -> Model:
    d = json.loads(text)
    pre, raw, scaled = d["preprocessing"], d["ridge_raw_finite_features"], d["ridge_standardized"]
    return Model(raw["intercept"], tuple(raw["coefficients"]), tuple(pre["imputer_statistics"]), tuple(pre["standard_scaler_mean"]), tuple(pre["standard_scaler_scale"]), scaled["intercept"], tuple(scaled["coefficients"]))


def to_json(model: Model, **about) -> str:
    names = [f"r{i}" for i in range(1, len(model.coefficients) + 1)]
    pre = {"imputer_strategy": "median", "imputer_statistics": model.medians, "standard_scaler_mean": model.means, "standard_scaler_scale": model.scales}
    raw = {"intercept": model.intercept, "coefficients": model.coefficients, "formula": "exp(intercept + sum(coefficient * feature))"}
    return json.dumps(about | {"canonical_feature_order": names, "model_type": "ridge", "preprocessing": pre, "ridge_standardized": {"intercept": model.scaled_intercept, "coefficients": model.scaled_coefficients}, "ridge_raw_finite_features": raw}, indent=2)


def verify(rows: DataFrame, model: Model, expected: str, tolerance: float = 1e-10) -> float:
    """The largest difference between log_speedup and a column; fails above the tolerance."""
    worst = rows.agg(F.max(F.abs(log_speedup(model) - F.col(expected))).alias("d")).first()["d"] or 0.0
    if not worst <= tolerance:
        raise ValueError(f"exported model differs by {worst}")
    return worst


def parameters(spark, model: Model) -> DataFrame:
    """A row for each feature, in order, and one for the intercept: the model as a table."""
    gaps = lambda values, i: float(values[i]) if i < len(values) else None
    rows = [(i, f"r{i + 1}", c, gaps(model.scaled_coefficients, i), gaps(model.medians, i), gaps(model.means, i), gaps(model.scales, i)) for i, c in enumerate(model.coefficients)]
    rows.append((len(rows), "intercept", model.intercept, model.scaled_intercept, None, None, None))
    return spark.createDataFrame(rows, "place int, feature string, raw double, standardised double, median double, mean double, scale double")


def export(rows: DataFrame, model: Model, folder: str, expected: str, tolerance: float = 1e-10, **about) -> None:
    """The model as model.json, model.sql and model.csv, after the formula has been held against a column of its values."""
    from ..storage import write_bytes

    verify(rows, model, expected, tolerance)
    spark = rows.sparkSession
    write_bytes(spark, f"{folder}/model.json", [to_json(model, **about).encode()])
    write_bytes(spark, f"{folder}/model.sql", [to_sql(model).encode()])
    parameters(spark, model).orderBy("place").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/model.csv")


def local_speedup(model: Model, features) -> float:
    return exp(model.intercept + sum(c * r for c, r in zip(model.coefficients, features, strict=True)))
