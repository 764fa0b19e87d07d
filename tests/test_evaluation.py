import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.functions.scalars import base_graph, bin_of, natural_order
from vertexloom.operators.evaluation import dataset, metrics, ridge
from vertexloom.operators.predictor import log_speedup


def table(spark, n=60, seed=0, prefix="", per=1):
    """Features that sum to 1, and a log speedup that is linear in them but for a little noise."""
    rng = np.random.default_rng(seed)
    exact = rng.dirichlet(np.ones(10), n)
    sampled = np.abs(exact + rng.normal(0, 0.003, exact.shape))
    sampled /= sampled.sum(1, keepdims=True)
    speedup = np.exp(sampled @ np.linspace(-0.5, 0.5, 10) + rng.normal(0, 0.01, n))
    rows = [(f"{prefix}{i // per}" + (f"_0.1_64_{i % per}" if per > 1 else ""), *map(float, e), 100.0, *map(float, s), 10.0, float(y)) for i, (e, s, y) in enumerate(zip(exact, sampled, speedup, strict=True))]
    return spark.createDataFrame(rows, ", ".join(["graph_id string", *(f"{c} double" for c in dataset.NUMERIC)]))


def test_names_and_bins(spark):
    names = ["1_0.1_64_256", "belgium_osm_0.1_64_256", "7", "road", "12_0.5", "a_b_c_d", "3_0.1_64_x"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(base_graph(F.col("n")).alias("b")).collect()
    assert [r["b"] for r in rows] == ["1", "belgium_osm", "7", "road", "12", "a_b_c_d", "3"]
    order = spark.createDataFrame([(x,) for x in ["b", "10", "9", "a", "100"]], "n string").orderBy(*natural_order(F.col("n")))
    assert [r["n"] for r in order.collect()] == ["9", "10", "100", "a", "b"]
    bins = spark.createDataFrame([(d,) for d in (0, 1, 111, 112, 589823, 589824)], "d long").select(bin_of(F.col("d")).alias("b")).collect()
    assert [r["b"] for r in bins] == [1, 2, 2, 3, 9, 10]


def test_loading(spark):
    rows = table(spark, 20)
    loaded = dataset.load(rows.toDF(*[f" {c.upper()} " for c in rows.columns]), "tiles", "sparse")
    assert loaded.count() == 20 and loaded.where("sum_warning").count() == 0 and loaded.first()["kernel"] == "tiles"
    text = rows.withColumn("speedup", F.when(F.col("graph_id") == "3", "x").otherwise(F.col("speedup").cast("string")))
    for bad, what in ((text, "unreadable"), (rows.unionByName(rows), "repeated"), (rows.withColumn("speedup", F.lit(0.0)), "above 0"), (rows.withColumn("exact_r1", F.lit(-0.5)), "negative"), (rows.withColumn("speedup", F.lit(float("inf"))), "finite")):
        with pytest.raises(dataset.BadData, match=what):
            dataset.load(bad, "tiles", "sparse")
    with pytest.raises(ValueError, match="speedup"):
        dataset.load(rows.drop("speedup"), "tiles", "sparse")
    assert dataset.load(rows.withColumn("exact_r1", F.col("exact_r1") + 0.5), "k", "d").where("sum_warning").count() == 20


def test_groups_and_folds(spark):
    rows = dataset.load(table(spark, 45, per=9), "tiles", "train", perturbed=True)
    assert dataset.group_sizes(rows, 9).count() == 5
    with pytest.raises(dataset.BadData):
        dataset.group_sizes(rows, 8)
    dealt = dataset.folds(rows, 5)
    assert sorted(r["fold"] for r in dealt.collect()) == [0, 1, 2, 3, 4]
    train, test = dataset.split(rows, dealt, 2)
    assert (train.count(), test.count()) == (36, 9) and train.join(test, "base_graph").isEmpty()
    sides = dataset.common_graphs(rows, rows.where("base_graph <> '0'"))
    assert {r["base_graph"]: r["side"] for r in sides.collect()}["0"] == "left_only"


def test_ranks_and_correlations(spark):
    x, y = [3.0, 1.0, 3.0, 2.0, 9.0], [1.0, 2.0, 2.0, 0.0, 7.0]
    rows = spark.createDataFrame(list(zip(x, y, strict=True)), "x double, y double")
    assert sorted((r["x"], r["rk"]) for r in metrics.with_rank(rows, "x", "rk").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5), (9.0, 5.0)]
    ranks = [np.array([3.5, 1, 3.5, 2, 5]), np.array([2, 3.5, 3.5, 1, 5])]
    assert metrics.spearman(rows, "x", "y").first()[0] == pytest.approx(np.corrcoef(*ranks)[0, 1])
    assert metrics.pearson(rows, "x", "y").first()[0] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert metrics.pearson(rows.withColumn("x", F.lit(1.0)), "x", "y").first()[0] is None
    assert metrics.spearman(rows.limit(1), "x", "y").first()[0] is None


def test_approximation(spark):
    rows = table(spark, 30)
    r = metrics.approximation_rows(rows).collect()
    data = {x["graph_id"]: x for x in rows.collect()}
    for x in r:
        e, s = (np.array([data[x["graph_id"]][f"{v}_r{i}"] for i in range(1, 11)]) for v in dataset.VARIANTS)
        assert x["tv"] == pytest.approx(np.abs(e - s).sum() / 2) and x["cosine"] == pytest.approx(e @ s / np.linalg.norm(e) / np.linalg.norm(s)) and x["time_ratio"] == 10
    total = metrics.approximation_summary(rows).first()
    assert total["tv_p90"] == pytest.approx(np.quantile([x["tv"] for x in r], 0.9)) and total["time_ratio_geomean"] == pytest.approx(10)
    assert metrics.approximation_by_bin(rows).count() == 10


def test_ridge_against_normal_equations(spark):
    rows = dataset.feature_view(table(spark, 80), "sampled")
    model = ridge.fit(rows, 1.0)
    data = rows.collect()
    x, y = np.array([[r[f"r{i}"] for i in range(1, 11)] for r in data]), np.log([r["speedup"] for r in data])
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(10), z.T @ (y - y.mean()))
    assert np.allclose(model.scaled_coefficients, w, atol=1e-9) and model.scaled_intercept == pytest.approx(y.mean())
    assert np.allclose(model.coefficients, w / x.std(0), atol=1e-8)
    expected = rows.withColumn("expected", log_speedup(model))
    from vertexloom.operators.predictor import verify

    assert verify(expected, model, "expected") <= 1e-10
    with pytest.raises(ValueError):
        verify(expected.withColumn("expected", F.col("expected") + 1), model, "expected")
    groups = ridge.fit_groups(rows.withColumn("g", F.lit(1)), ["g"])
    assert np.allclose(groups[(1,)].coefficients, model.coefficients)


def test_cross_validation(spark):
    rows = dataset.feature_view(dataset.load(table(spark, 60, per=3), "tiles", "train", perturbed=True), "sampled")
    frame = ridge.cross_validated(rows)
    ridge.covered_once(frame, rows)
    assert metrics.regression(frame).first()["mae_log"] < 0.1
    data = rows.join(dataset.folds(rows), "base_graph").collect()
    keep = [r for r in data if r["fold"] != 0]
    x, y = np.array([[r[f"r{i}"] for i in range(1, 11)] for r in keep]), np.log([r["speedup"] for r in keep])
    z, held = (x - x.mean(0)) / x.std(0), next(r for r in data if r["fold"] == 0)
    w = np.linalg.solve(z.T @ z + np.eye(10), z.T @ (y - y.mean()))
    expected = y.mean() + ((np.array([held[f"r{i}"] for i in range(1, 11)]) - x.mean(0)) / x.std(0)) @ w
    assert frame.where(F.col("graph_id") == held["graph_id"]).first()["pred_log_speedup"] == pytest.approx(expected, abs=1e-9)
    summary = metrics.fold_summary(metrics.regression(frame, ["fold"])).first()
    assert summary["mae_log_std"] > 0


def test_experiments(spark):
    train = dataset.feature_view(dataset.load(table(spark, 60, 1, per=3), "tiles", "train", perturbed=True), "sampled")
    sparse = dataset.feature_view(dataset.load(table(spark, 20, 2), "tiles", "sparse"), "sampled")
    rmat = dataset.feature_view(dataset.load(table(spark, 15, 3, "rmat_"), "tiles", "rmat"), "sampled")
    found = ridge.experiments(train, sparse, rmat)
    assert {k: v.count() for k, v in found.items()} == {"A_grouped_cv": 60, "B_same_graphs": 20, "C_held_out": 20, "D_external": 15}
    with pytest.raises(ValueError):
        ridge.held_out(train, sparse)
    assert ridge.coefficients(spark, ridge.fit(train)).count() == 10


def test_gates(spark):
    rows = spark.createDataFrame([(1.2, 1.1), (0.9, 1.02), (0.8, 0.9), (1.1, 0.97), (1.0, 1.01)], "speedup double, pred_speedup double").withColumn("true_beneficial", F.col("speedup") > 1)
    g = metrics.band_gate(rows, [(0.97, 1.02)]).first()
    assert (g["tp"], g["fp"], g["tn"], g["fn"], g["uncertain"]) == (1, 1, 1, 1, 1) and g["coverage"] == 0.8 and g["precision"] == 0.5
    empty = metrics.band_gate(rows, [(0.1, 9.0)]).first()
    assert empty["accuracy"] is None and empty["coverage"] == 0
    c = metrics.conservative_gate(rows, (1.01,)).first()
    assert c["selected"] == 3 and c["bad"] == 2 and c["mean"] == pytest.approx((1.2 + 0.9 + 1 + 1 + 1) / 5) and c["geomean"] == pytest.approx(math.exp((math.log(1.2) + math.log(0.9)) / 5))


def test_pairs(spark):
    rows = table(spark, 12)
    frames = [metrics.predictions(dataset.feature_view(rows, v), F.col("r1") - F.col("r2")) for v in dataset.VARIANTS]
    pairs = metrics.paired(*frames, ["graph_id"])
    assert pairs.count() == 12 and metrics.agreement(pairs, "exact_pred", "sampled_pred").first()["pearson"] > 0.9
    assert metrics.disagreement(pairs, "exact_pred", "exact_pred").agg(F.sum("differ")).first()[0] == 0
    with pytest.raises(ValueError, match="keys differ"):
        metrics.paired(frames[0], frames[1].limit(5), ["graph_id"])
    with pytest.raises(ValueError, match="repeated"):
        metrics.paired(frames[0].unionByName(frames[0]), frames[1], ["graph_id"])


def test_alignment(spark):
    a, b = (spark.createDataFrame(x, "k int, v double") for x in ([(1, 1.0), (2, 2.0)], [(2, 2.0), (3, 3.0)]))
    r = dataset.aligned(a, b, ["k"], ["v"]).first()
    assert (r["both"], r["left_only"], r["right_only"], r["max_abs_diff"], r["within"]) == (1, 1, 1, 0.0, False)
    assert dataset.aligned(a, a, ["k"], ["v"]).first()["within"]


def test_comparison(spark):
    rows = spark.createDataFrame([("exact", 1.0, 2.0), ("sampled", 1.5, 1.0)], "kind string, mae double, mape double")
    assert {r["metric"]: r["delta"] for r in metrics.compared(rows, "kind", "exact", "sampled", ["mae", "mape"]).collect()} == {"mae": 0.5, "mape": -1.0}
