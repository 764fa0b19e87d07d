import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.functions import hashing
from vertexloom.operators import predictor, reuse
from vertexloom.operators.graph import from_arrays
from vertexloom.sources.generators import random_graph

STREAM = [0, 1, 2, 0, 3, 4, 5, 0, 1, 2, 3, 4, 0, 6, 7, 8, 0]


def brute(ids):
    last, out = {}, []
    for k, s in enumerate(ids):
        if s in last:
            out.append((k, len(set(ids[last[s] + 1 : k]))))
        last[s] = k
    return out


def stream_of(spark, ids):
    return spark.createDataFrame([(k, int(s)) for k, s in enumerate(ids)], "k long, sector int")


def found(stream, block):
    return sorted((r["k"], r["rd"]) for r in reuse.reuse_distances(stream, block).collect())


@pytest.mark.parametrize("block", [3, 8, 1000])
def test_known_stream(spark, block):
    assert found(stream_of(spark, STREAM), block) == [(3, 2), (7, 3), (8, 5), (9, 5), (10, 5), (11, 5), (12, 4), (16, 3)]
    assert found(stream_of(spark, [s // 2 for s in STREAM]), block) == [(1, 0), (3, 1), (4, 1), (6, 0), (7, 2), (8, 0), (9, 2), (10, 0), (11, 2), (12, 2), (14, 0), (16, 2)]
    assert found(stream_of(spark, [s // 8 for s in STREAM]), block) == [*((k, 0) for k in range(1, 15)), (16, 1)]


def test_random_and_hot_streams(spark):
    rng = np.random.default_rng(1)
    ids = np.where(rng.random(1500) < 0.35, 3, rng.integers(0, 90, 1500)).tolist()
    for block in (64, 400):
        assert found(stream_of(spark, ids), block) == brute(ids)


def test_counted_below():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 64, 130):
        order, values = rng.permutation(n), rng.integers(-1, max(1, n // 2), n)
        expected = [sum(order[j] < order[i] and values[j] < values[i] for j in range(n)) for i in range(n)]
        assert reuse.counted_below(order, values).tolist() == expected


def test_histogram(spark):
    g = random_graph(spark, 400, 3000, 5)
    rows = reuse.exact_histogram(g, 4, (1, 5, 20, 50)).orderBy("bin").collect()
    assert [r["bin"] for r in rows] == [1, 2, 3, 4, 5] and sum(r["prob"] for r in rows) == pytest.approx(1)
    sectors = reuse.access_stream(g, 4).select("sector").distinct().count()
    assert sum(r["cnt"] for r in rows) == 3000 - sectors
    empty = reuse.histogram(reuse.reuse_distances(stream_of(spark, [1, 2, 3])), (1, 2))
    assert [r["prob"] for r in empty.collect()] == [0.0, 0.0, 0.0]


def test_mixer_and_registers(spark):
    assert hashing.mix32_array(np.array([0, 1, 2, 31])).tolist() == [0, 1753845952, 3507691905, 1107441205]
    values = np.concatenate([np.arange(500), np.random.default_rng(0).integers(0, 2**32, 500)])
    rows = spark.createDataFrame([(int(v),) for v in values], "v long")
    h = hashing.mix32(F.col("v"))
    out = rows.select("v", h.alias("h"), hashing.register_of(h, 12).alias("i"), hashing.rank_of(h, 12).alias("r")).collect()
    expected = hashing.mix32_array(values.astype(np.uint32))
    assert [r["h"] for r in out] == expected.tolist()
    assert [r["r"] for r in out] == hashing.rank_array(expected, 12).tolist() and all(0 < r["r"] <= 21 for r in out)


def test_estimate():
    for n in (10, 1000, 30_000, 200_000):
        assert float(hashing.estimate(hashing.registers(np.arange(n), 12))) == pytest.approx(n, rel=0.06)


def test_sampled_against_exact(spark):
    g = random_graph(spark, 3000, 12_000, 7)
    edges = (1, 100, 400, 800, 1600)
    exact = {r["bin"]: r["prob"] for r in reuse.exact_histogram(g, 1, edges).collect()}
    rows = reuse.sampled_distances(g, sector=1, samples=3000, block=512).cache()
    counts = reuse.status_counts(rows).first()
    assert sum(counts) == 3000 and counts["unresolved"] == 0
    sampled = {r["bin"]: r["prob"] for r in reuse.sampled_histogram(rows, edges).collect()}
    assert sum(abs(exact[b] - sampled[b]) for b in exact) / 2 < 0.05
    assert reuse.sampled_distances(g, samples=0).count() == 0
    with pytest.raises(ValueError):
        reuse.access_stream(g, 0)


def test_three_bins(spark):
    rows = {r["class"]: r for r in reuse.three_bins(stream_of(spark, STREAM)).collect()}
    assert rows["tile"]["prob"] == 1.0 and rows["mid"]["cnt"] == 0 and rows["tile"]["total_reuse_cnt"] == 8



def test_predictor(spark):
    m = predictor.DEPLOYED
    features = [0.1 * i for i in (1, 2, 3, 4)] + [0.0] * 6
    assert predictor.local_speedup(m, features) == pytest.approx(np.exp(m.intercept + sum(c * r for c, r in zip(m.coefficients, features, strict=True))))
    rows = spark.createDataFrame([tuple(features)], ", ".join(f"r{i} double" for i in range(1, 11)))
    assert predictor.predict(rows).first()["predicted_speedup"] == pytest.approx(predictor.local_speedup(m, features), abs=1e-12)
    assert rows.selectExpr(f"{predictor.to_sql()} as p").first()["p"] == pytest.approx(predictor.local_speedup(m, features), abs=1e-12)
    with pytest.raises(Exception, match="no valid prediction"):
        predictor.predict(rows.withColumn("r1", F.lit(None).cast("double"))).collect()
    scaled = predictor.Model(1.0, (1.0,) * 10, (0.5,) * 10, (0.0,) * 10, (1.0,) * 10, 1.0, (1.0,) * 10)
    gaps = rows.withColumn("r1", F.lit(float("nan")))
    assert gaps.select(predictor.speedup_with_gaps(scaled).alias("p")).first()["p"] == pytest.approx(np.exp(1 + 0.5 + sum(features[1:])))
    assert predictor.from_json(predictor.to_json(scaled)) == scaled


def test_place_of_reuse_across_blocks(spark):
    g = from_arrays(spark, [0, 0, 0, 1, 0], [0, 1, 2, 2, 3], 4)
    gaps = {r["k"]: r["prev"] for r in reuse.reuse_gaps(reuse.access_stream(g, 1), 2).collect()}
    assert gaps == {0: None, 1: 0, 2: 1, 3: None, 4: 2}


def test_registered_samples(spark, sf_dir):
    """The registered query takes the operator's own number of samples."""
    from vertexloom.plans import registry

    g = registry.part_graph(spark, sf_dir)
    expected = {tuple(r) for r in reuse.status_counts(reuse.sampled_distances(g)).collect()}
    out = registry.QUERIES["rd_sampled"](spark, sf_dir)
    names = reuse.status_counts(reuse.sampled_distances(g)).columns
    assert {tuple(r) for r in out.select(*names).distinct().collect()} == expected
