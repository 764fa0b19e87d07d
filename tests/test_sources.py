import struct

import pytest
from pyspark.sql import functions as F

from vertexloom.operators.evaluation import dataset
from vertexloom.operators.graph import from_arrays
from vertexloom.sources import graphs, matrix_market, tables
from vertexloom.sources.generators import with_weights


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return f"file://{path}"


def edges(g, values=False):
    return sorted(tuple(r) for r in g.edges.select("row", "col", *(["val"] if values else [])).collect())


def test_plain_matrix(spark, tmp_path):
    g = matrix_market.read_graph(spark, put(tmp_path, "a.mtx", "%%MatrixMarket matrix coordinate real symmetric\n% note\n\n3 3 2\n1 1 5\n3 1 0.5\n"))
    # the diagonal entry is mirrored too
    assert g.n == 3 and edges(g, True) == [(0, 0, 1.0), (0, 0, 1.0), (0, 2, 1.0), (2, 0, 1.0)]
    g = matrix_market.read_graph(spark, put(tmp_path, "b.mtx", "%%MatrixMarket matrix coordinate pattern general basezero\n2 2 1\n0 1\n"))
    assert edges(g) == [(0, 1)]


def test_strict_matrix(spark, tmp_path):
    g = matrix_market.read_graph(spark, put(tmp_path, "a.mtx", "%%MatrixMarket matrix coordinate real skew-symmetric\n3 3 2\n1 1 5\n3 1 0.5\n"), strict=True, weighted=True)
    assert edges(g, True) == [(0, 0, 5.0), (0, 2, -0.5), (2, 0, 0.5)]
    for text, code in (("%%MatrixMarket matrix coordinate complex general\n1 1 0\n", "unsupported_type"), ("%%MatrixMarket matrix coordinate real general\n2 3 0\n", "bad_size"), ("nothing\n1 1 1\n", "no_header"), ("%%MatrixMarket matrix\n1 1 1\n", "premature_eof"), ("%%MatrixMarket matrix array pattern general\n1 1\n", "unsupported_type")):
        with pytest.raises(matrix_market.BadHeader) as e:
            matrix_market.read_graph(spark, put(tmp_path, "bad.mtx", text), strict=True)
        assert e.value.code == code
    assert not matrix_market.Header("coordinate", "real", "hermitian").valid()
    assert matrix_market.Header("coordinate", "complex", "hermitian").valid()
    assert matrix_market.parse_size("3 4", "array") == (3, 4, 12)


def test_entries(spark, tmp_path):
    header, rows = matrix_market.read_entries(spark, put(tmp_path, "c.mtx", "%%MatrixMarket matrix coordinate complex general\n2 2 1\n2 1 1.5 -2\n"))
    assert (header.rows, header.entries) == (2, 1) and tuple(rows.first()) == (1, 0, 1.5, -2.0)
    with pytest.raises(matrix_market.BadHeader):
        matrix_market.read_unsymmetric(spark, put(tmp_path, "d.mtx", "%%MatrixMarket matrix coordinate real symmetric\n1 1 0\n"))


def test_matrix_round_trip(spark, tmp_path):
    g = from_arrays(spark, [0, 2, 1], [1, 0, 1], 3)
    matrix_market.write_coordinate(g, f"file://{tmp_path}/out.mtx")
    assert matrix_market.read_header(spark, f"file://{tmp_path}/out.mtx").entries == 3
    assert edges(graphs.load_graph(spark, f"file://{tmp_path}/out.mtx")) == edges(g)


def test_lists(spark, tmp_path):
    assert edges(graphs.load_graph(spark, put(tmp_path, "a.el", "0 1\n\n2\t0\n"))) == [(0, 1), (2, 0)]
    assert edges(graphs.load_graph(spark, put(tmp_path, "a.wel", "0 1 2.5\n")), True) == [(0, 1, 2.5)]
    g = graphs.load_graph(spark, put(tmp_path, "a.gr", "c note\np sp 3 2\na 1 2 7\na 3 1 4\n"))
    assert g.n == 3 and edges(g, True) == [(0, 1, 7.0), (2, 0, 4.0)]
    with pytest.raises(ValueError):
        graphs.load_graph(spark, "a.xyz")


def test_metis(spark, tmp_path):
    g = graphs.load_graph(spark, put(tmp_path, "a.graph", "% note\n4 2\n2 3\n1\n% note\n1\n\n"))
    assert g.n == 4 and edges(g) == [(0, 1), (0, 2), (1, 0), (2, 0)]
    g = graphs.load_graph(spark, put(tmp_path, "b.graph", "2 1 1\n2 9\n1 9\n"))
    assert edges(g, True) == [(0, 1, 9.0), (1, 0, 9.0)]
    with pytest.raises(matrix_market.BadHeader):
        graphs.load_graph(spark, put(tmp_path, "c.graph", "2 1 11\n2\n1\n"))


def test_serialised(spark, tmp_path):
    content = struct.pack("<?qq", True, 3, 3) + struct.pack("<4q", 0, 2, 2, 3) + struct.pack("<3i", 1, 2, 0)
    g = graphs.load_graph(spark, put(tmp_path, "a.sg", content))
    assert g.n == 3 and edges(g) == [(0, 1), (0, 2), (2, 0)]
    # a directed graph's file goes on with the other direction
    inverse = struct.pack("<4q", 0, 1, 2, 3) + struct.pack("<3i", 2, 0, 0)
    graphs.write_serialised(g, f"{tmp_path}/b.sg")
    assert (tmp_path / "b.sg").read_bytes() == content + inverse
    graphs.write_serialised(g, f"{tmp_path}/c.sg", directed=False)
    assert (tmp_path / "c.sg").read_bytes() == b"\0" + content[1:]
    assert edges(graphs.load_graph(spark, f"{tmp_path}/b.sg")) == edges(g)


def test_catalogue_and_permutation(spark, tmp_path):
    catalog = put(tmp_path, "config.txt", "1 /data/a.mtx 10 10 5\n2\t/data/b.mtx\n")
    assert graphs.catalog_path(spark, catalog, 2) == "/data/b.mtx"
    with pytest.raises(KeyError):
        graphs.catalog_path(spark, catalog, 3)
    perm = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "old_id int, new_id int")
    graphs.write_permutation(perm, 3, 5, f"file://{tmp_path}/perm")
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/perm").collect()] == ["3", "5", "0 2", "1 0", "2 1"]
    assert sorted(map(tuple, graphs.read_permutation(spark, f"file://{tmp_path}/perm").collect())) == [(0, 2), (1, 0), (2, 1)]
    g = from_arrays(spark, [0, 1], [1, 2], 3)
    graphs.write_relabelled(g, perm, f"file://{tmp_path}/new")
    assert sorted(r["value"] for r in spark.read.text(f"file://{tmp_path}/new").collect()) == ["0 1", "2 0"]


def test_parquet_and_weights(spark, tmp_path):
    g = with_weights(from_arrays(spark, [0, 1, 2], [1, 0, 0], 3), 4)
    graphs.write_parquet(g, f"file://{tmp_path}/g.parquet")
    back = edges(graphs.load_graph(spark, f"file://{tmp_path}/g.parquet"), True)
    assert back == edges(g, True) and all(1 <= w <= 255 for *_, w in back) and back[0][2] == back[1][2]


def test_logs(spark, tmp_path):
    line = "7&origin&&&&" + "&".join(["0.1"] * 10) + "&1.5&2.5\n7&gorder1&5&10&0.5&" + "&".join(["0.1"] * 10) + "&1.5&2\n"
    log = tables.read_log(spark, put(tmp_path, "log.txt", line), tables.RUN_LOG)
    first = log.where("method = 'origin'").first()
    assert first["graph_id"] == 7 and first["param"] is None and first["t_order_ms"] is None and first["r10"] == 0.1 and first["t_spmv_ms"] == 2.5
    assert tables.speedups(log).first()["speedup"] == 1.25
    assert len(tables.DUAL_LOG.split(", ")) == 35 and len(tables.CDF_LOG.split(", ")) == 6


def test_command_line(spark, tmp_path):
    from vertexloom.__main__ import main

    out = f"{tmp_path}/g.el"
    assert main(["convert", "-g", "5", "-k", "3", "-o", f"file://{out}"]) == 0
    assert spark.read.text(f"file://{out}").count() == 96
    assert main(["run", "-f", f"file://{out}", "--method", "degree", "--exact", "--log", f"file://{tmp_path}/log"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 1
    with pytest.raises(SystemExit):
        main(["stats"])


def test_faults_are_told_whatever_the_table_holds(spark):
    """Without rows, and with rows that have faults of their own."""
    from vertexloom.plans import file_queries

    names = [c for c in dataset.COLUMNS if c != "graph_id"]
    rows = spark.range(3).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("graph_id"), *[F.when((F.col("id") < 2) | F.lit(c != "speedup"), 0.1).alias(c) for c in names], F.lit("1").alias("base_graph"))
    for table in (rows, rows.where("id < 0")):
        found = dict(map(tuple, file_queries.rejected_csv(table).collect()))
        assert found == {
            "a cell that is no number": "missing or unreadable numbers", "an id twice": "repeated graph ids", "a column less": "columns are missing", "a speedup of 0": "speedups or times that aren't above 0",
            "an infinite time": "numbers that aren't finite", "a negative share": "negative probabilities", "nothing": "accepted",
        }
