"""A small graph with known answers: vertex 0 is isolated, 2 -> 2 is a loop."""

import pytest
from pyspark.sql import functions as F

from vertexloom.operators import components as cc
from vertexloom.operators import graph as gr
from vertexloom.operators import spmv, stats
from vertexloom.operators.orders import banded, simple
from vertexloom.operators.reuse import access_stream
from vertexloom.storage import written

ROWS, COLS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11], [2, 2, 4, 5, 5, 2, 8, 9, 10, 8, 1]


@pytest.fixture(scope="module")
def toy(spark):
    return gr.from_arrays(spark, ROWS, COLS, 12)


def column(df, name, by):
    return [r[name] for r in df.orderBy(by).collect()]


def test_degrees_and_product(toy):
    assert column(gr.degrees(toy, gr.IN), "deg", "id") == [0, 1, 3, 0, 1, 2, 0, 0, 2, 1, 1, 0]
    assert column(gr.degrees(toy, gr.OUT), "deg", "id") == [0] + [1] * 11
    assert column(spmv.multiply(toy), "val", "idx") == [0, 1, 3, 0, 1, 2, 0, 0, 2, 1, 1, 0]
    both = gr.both_degrees(toy)
    assert column(both, "indeg", "id") == column(gr.degrees(toy, gr.IN), "deg", "id")


def test_offsets_and_neighbours(toy):
    assert column(gr.offsets(toy, gr.IN), "start", "id") == [0, 0, 1, 4, 4, 5, 7, 7, 7, 9, 10, 11]
    assert [r["id"] for r in gr.neighbours(toy, 2, 1, gr.IN).collect()] == [2, 6]
    assert {r["id"]: r["neighbours"] for r in gr.adjacency(toy, gr.IN).collect()}[2] == [1, 2, 6]


def test_stream_and_orders(toy):
    stream = access_stream(toy, 1)
    assert column(stream, "sector", "k") == [11, 1, 2, 6, 3, 4, 5, 7, 10, 8, 9]
    for perm in (simple.degree_order(toy), simple.grouped_order(toy)):
        assert column(perm, "old_id", "new_id") == [*range(1, 12), 0]
    assert column(banded.banded(toy), "old_id", "new_id") == [10, 9, 8, 7, 11, 1, 2, 6, 5, 4, 3, 0]


def test_components(toy):
    assert column(cc.components(toy.vertices(), toy.edges), "comp", "id") == [0, 1, 1, 3, 3, 3, 1, 7, 7, 7, 7, 1]
    assert cc.largest(cc.components(toy.vertices(), toy.edges)).first().asDict() == {"comp": 1, "size": 4}


def test_components_of_a_path(spark):
    n = 300
    g = gr.from_arrays(spark, range(n - 1), range(1, n), n)
    assert cc.components(g.vertices(), g.edges).select("comp").distinct().count() == 1


def test_tiles_and_score(toy):
    assert [(r["x"], r["y"]) for r in stats.lane_coordinates(toy).orderBy("diag").collect()] == [(0, 0), (7, 7)]
    assert stats.gscore(toy, 2).first()["score"] == 0
    assert sum(r["row_ends"] for r in stats.lane_bits(toy).collect()) == 12


def test_degree_distribution(toy):
    rows = {r["degree"]: r for r in stats.degree_cdf(toy).collect()}
    assert rows[0]["rows_in"] == pytest.approx(5 / 12) and rows[3]["rows_in"] == 1 and rows[3]["nnz_in"] == 1
    assert rows[1]["rows_out"] == 1 and rows[1]["nnz_out"] == 1


def test_cleaning(spark):
    g = gr.from_arrays(spark, [0, 0, 1, 2, 2], [1, 1, 0, 2, 0], 3)
    assert sorted(map(tuple, gr.without_loops_and_repeats(g).edges.select("row", "col").collect())) == [(0, 1), (1, 0), (2, 0)]
    assert gr.symmetrised(g).edges.count() == 10
    assert gr.symmetrised(g, only_missing=True).edges.count() == 5
    assert {(r["row"], r["col"]): r["weight"] for r in gr.undirected_weights(g).collect()}[(0, 1)] == 3
    assert gr.pick_source(g, 1) in (0, 1, 2) and gr.largest_id(g.edges) == 2


def test_empty_graph(spark):
    g = gr.Graph(spark.createDataFrame([], "row int, col int, val double"), 0)
    assert spmv.multiply(g).count() == 0 and stats.degree_cdf(g).count() == 0 and gr.largest_id(g.edges) == -1
    assert stats.is_permutation(simple.degree_order(g), 0).first()["ok"]
    assert cc.components(g.vertices(), g.edges).count() == 0
    assert banded.banded(g).count() == 0


def test_hub_is_shared_by_tasks(spark):
    """A vertex with a third of all edges: sums and neighbours come out the same."""
    n = 900
    rows, cols = [*range(300), *([7] * 300), *range(300)], [*range(1, 301), *range(300, 600), *range(2, 302)]
    g = gr.from_arrays(spark, rows, cols, n)
    assert gr.degrees(g).where("id = 7").first()["deg"] == 302
    assert stats.gscore(g, 3).first()["score"] == sum(1 for i in range(len(rows)) for j in range(len(rows)) if rows[i] == rows[j] and 0 < cols[j] - cols[i] <= 3)


def test_density_picture(toy):
    from vertexloom.sources.graphs import density_picture

    assert density_picture(toy, 4)[:8] == b"\x89PNG\r\n\x1a\n"
    grid = stats.colours(stats.density_grid(toy, 4))
    assert grid.agg(F.sum("cnt")).first()[0] == 11
    assert stats.ordering_width(2000, 44965) == 1024


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    n, tables = 400, []
    monkeypatch.setattr(cc, "written", lambda df, label, *old: tables.append(label) or written(df, label, *old))
    chain = spark.range(n - 1).select(F.col("id").cast("int").alias("row"), (F.col("id") + 1).cast("int").alias("col"))
    labels = cc.components(spark.range(n).select(F.col("id").cast("int").alias("id")), chain)
    assert labels.agg(F.count("*"), F.max("comp")).first() == (n, 0) and len(tables) < 30
