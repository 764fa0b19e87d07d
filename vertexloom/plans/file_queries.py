"""Queries through files: a graph or table is written in a form, read again, and compared with SQL over the tables."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import predictor, stats
from ..operators.evaluation import dataset
from ..operators.orders import simple
from ..sources import graphs, matrix_market, tables
from ..storage import fresh_path, write_bytes, write_lines, written
from .registry import feature_query, graph_query, query

EDGES = "select src as row, dst as col from edge"


def _path(spark, suffix: str) -> str:
    return f"{fresh_path(spark, 'file')}.{suffix}"


def _pairs(g):
    return g.edges.select("row", "col")


def _again(g, suffix: str, write) -> gr.Graph:
    """The graph as it is read from the file that `write` makes."""
    path = _path(g.spark, suffix)
    write(path)
    return graphs.load_graph(g.spark, path)


def _valued(g):
    """Edges with whole values, which follow from their ends."""
    return g.with_edges(g.edges.withColumn("val", (F.col("row") * 3 + F.col("col") * 5) % 11 + 1.0))


VALUED = "select src as row, dst as col, cast((src * 3 + dst * 5) % 11 + 1 as double) as val from edge"


# Matrix Market


@graph_query(EDGES)
def mtx_general(g):
    return _pairs(_again(g, "mtx", lambda p: matrix_market.write_coordinate(g, p)))


@graph_query("with low as (select src, dst from edge where src >= dst) select src as row, dst as col from low union all select dst, src from low")
def mtx_symmetric(g):
    """The plain reading of a symmetric file, where a diagonal entry is there twice."""
    low = g.with_edges(g.edges.where("row >= col"))
    return _pairs(_again(g, "mtx", lambda p: matrix_market.write_coordinate(low, p, symmetry="symmetric")))


@graph_query("with low as (select src, dst, cast((src * 3 + dst * 5) % 11 + 1 as double) as val from edge where src >= dst) select src as row, dst as col, val from low union all select dst, src, val from low where src <> dst")
def mtx_strict_symmetric(g):
    """The strict reading, with values, where a diagonal entry is there once."""
    path = _path(g.spark, "mtx")
    low = _valued(g)
    matrix_market.write_coordinate(low.with_edges(low.edges.where("row >= col")), path, "integer", "symmetric")
    return matrix_market.read_graph(g.spark, path, strict=True, weighted=True).edges


@graph_query("with low as (select src, dst, cast((src * 3 + dst * 5) % 11 + 1 as double) as val from edge where src > dst) select src as row, dst as col, val from low union all select dst, src, -val from low")
def mtx_strict_skew(g):
    path = _path(g.spark, "mtx")
    low = _valued(g)
    matrix_market.write_coordinate(low.with_edges(low.edges.where("row > col")), path, "real", "skew-symmetric")
    return matrix_market.read_graph(g.spark, path, strict=True, weighted=True).edges


@graph_query(EDGES)
def mtx_zero_based(g):
    """A file whose first line says basezero, with comments and blank lines."""
    path = _path(g.spark, "mtx")
    top = g.spark.createDataFrame([(0, 0, 0, "%%MatrixMarket matrix coordinate pattern general basezero"), (1, 0, 0, "% a note"), (1, 0, 1, ""), (2, 0, 0, f"{g.n} {g.n} {g.nnz()}")], "part int, row int, col int, value string")
    body = g.edges.select(F.lit(3).alias("part"), "row", "col", F.concat_ws(" ", "row", "col").alias("value"))
    write_lines(top.unionByName(body), path, "part", "row", "col")
    return _pairs(graphs.load_graph(g.spark, path))


@graph_query("select 'matrix coordinate real general' as type, (select count(*) from v) as rows, (select count(*) from v) as cols, count(*) as entries from edge")
def mtx_header(g):
    path = _path(g.spark, "mtx")
    matrix_market.write_coordinate(_valued(g), path, "real")
    h = matrix_market.read_header(g.spark, path)
    return g.spark.createDataFrame([(h.type_name(), h.rows, h.cols, h.entries)], "type string, rows long, cols long, entries long")


@graph_query("select src as i, dst as j, cast((src * 3 + dst * 5) % 11 + 1 as double) as re from edge")
def mtx_unsymmetric(g):
    path = _path(g.spark, "mtx")
    matrix_market.write_coordinate(_valued(g), path, "real")
    return matrix_market.read_unsymmetric(g.spark, path)[1]


@graph_query("select src as i, dst as j, cast(src % 7 as double) as re, cast(0 - dst % 5 as double) as im from edge")
def mtx_complex_entries(g):
    path = _path(g.spark, "mtx")
    top = g.spark.createDataFrame([(0, 0, 0, "%%MatrixMarket matrix coordinate complex general"), (1, 0, 0, f"{g.n} {g.n} {g.nnz()}")], "part int, row int, col int, value string")
    body = g.edges.select(F.lit(2).alias("part"), "row", "col", F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, F.col("row") % 7, 0 - F.col("col") % 5).alias("value"))
    write_lines(top.unionByName(body), path, "part", "row", "col")
    return matrix_market.read_entries(g.spark, path)[1]


@graph_query("with c as (select cast(src % 16 as int) as i, cast(dst % 12 as int) as j, count(*) as n from edge group by 1, 2), cells as (select cast(a.i as int) as i, cast(b.j as int) as j from (select unnest(range(16)) as i) a, (select unnest(range(12)) as j) b) select cells.i, cells.j, cast(coalesce(n, 0) as double) as re from cells left join c on c.i = cells.i and c.j = cells.j")
def mtx_array(g):
    """A dense matrix of how many edges lead from one class of vertices to another."""
    path = _path(g.spark, "mtx")
    counted = g.edges.groupBy((F.col("row") % 16).alias("i"), (F.col("col") % 12).alias("j")).agg(F.count("*").cast("double").alias("re"))
    matrix_market.write_array(counted, 16, 12, path)
    return matrix_market.read_array(g.spark, path)[1]


@query("""with f as (select unnest(['coordinate', 'array']) as form), d as (select unnest(['real', 'double', 'integer', 'complex', 'pattern']) as field), y as (select unnest(['general', 'symmetric', 'hermitian', 'skew-symmetric']) as symmetry)
select form, field, symmetry, not (form = 'array' and field = 'pattern') and not (field in ('real', 'double', 'integer') and symmetry = 'hermitian') and not (field = 'pattern' and symmetry in ('hermitian', 'skew-symmetric')) as valid from f, d, y""")
def mtx_valid_types(spark, sf_dir):
    """Which first lines are accepted."""
    rows = []
    for form, field, symmetry in product(matrix_market.FORMATS, matrix_market.FIELDS, matrix_market.SYMMETRIES):
        try:
            matrix_market.parse_banner(f"%%MatrixMarket MATRIX {form} {field.upper()} {symmetry}")
            rows.append((form, field, symmetry, True))
        except matrix_market.BadHeader:
            rows.append((form, field, symmetry, False))
    return spark.createDataFrame(rows, "form string, field string, symmetry string, valid boolean")


# other forms of graphs


@graph_query(EDGES)
def edge_list_file(g):
    return _pairs(_again(g, "el", lambda p: graphs.write_edge_list(g, p)))


@graph_query(VALUED)
def weighted_edge_list_file(g):
    return _again(g, "wel", lambda p: graphs.write_edge_list(_valued(g), p, weighted=True)).edges


@graph_query(VALUED)
def dimacs_file(g):
    return _again(g, "gr", lambda p: graphs.write_dimacs(_valued(g), p)).edges


@graph_query("select src as row, dst as col, (select count(*) from v) as n from edge where src % 5 <> 0")
def metis_file(g):
    """A fifth of the vertices have no neighbours: blank lines, which count."""
    some = g.with_edges(g.edges.where("row % 5 <> 0"))
    found = _again(g, "graph", lambda p: graphs.write_metis(some, p))
    return _pairs(found).withColumn("n", F.lit(found.n).cast("long"))


@graph_query("select src as row, dst as col, (select count(*) from v) as n from edge")
def binary_file(g):
    found = _again(g, "sg", lambda p: graphs.write_serialised(g, p))
    return _pairs(found).withColumn("n", F.lit(found.n).cast("long"))


@graph_query(VALUED)
def weighted_binary_file(g):
    return _again(g, "wsg", lambda p: graphs.write_serialised(_valued(g), p, weighted=True)).edges


@graph_query("select 17 + 2 * (8 * ((select count(*) from v) + 1) + 4 * count(*)) as bytes from edge")
def binary_file_size(g):
    """Both directions of a directed graph are in its binary form."""
    path = _path(g.spark, "sg")
    graphs.write_serialised(g, path)
    return g.spark.read.format("binaryFile").load(path).select(F.col("length").alias("bytes"))


@graph_query(VALUED)
def parquet_graph(g):
    return _again(g, "parquet", lambda p: graphs.write_parquet(_valued(g), p)).edges


@graph_query("select id, cast(path as varchar) as path, n as nrow, n as ncol, m as nnz from (select (select count(*) from v) as n, (select count(*) from edge) as m), (values ('1', '/data/a.mtx'), ('7', '/data/part.mtx')) c(id, path) where id = '7'")
def catalog_lookup(g):
    path = _path(g.spark, "txt")
    m = g.nnz()
    write_bytes(g.spark, path, [f"1 /data/a.mtx {g.n} {g.n} {m}\n7\t/data/part.mtx  {g.n} {g.n} {m}\n\n".encode()])
    return graphs.read_catalog(g.spark, path).where(F.col("path") == graphs.catalog_path(g.spark, path, "7"))


@graph_query("with d as (select id, count(src) as c from v left join edge on id = src group by id) select id as old_id, cast(row_number() over (order by c desc, id) - 1 as int) as new_id from d")
def permutation_file(g):
    path = _path(g.spark, "perm")
    graphs.write_permutation(simple.degree_order(g), g.n, g.nnz(), path)
    return graphs.read_permutation(g.spark, path)


@graph_query("""with d as (select id, count(src) as c from v left join edge on id = src group by id), p as (select id as old_id, cast(row_number() over (order by c desc, id) - 1 as int) as new_id from d)
select a.new_id as row, b.new_id as col from edge join p a on src = a.old_id join p b on dst = b.old_id""")
def relabelled_file(g):
    path = _path(g.spark, "el")
    graphs.write_relabelled(g, simple.degree_order(g), path)
    return _pairs(graphs.load_graph(g.spark, path))


@graph_query("select dst as idx, cast(count(*) as double) as val from edge group by dst union all select id, 0.0 from v where id not in (select dst from edge)")
def graph_from_file(g):
    """Found in a catalogue, read and multiplied, as one call does for a whole run."""
    from ..operators import spmv

    at, catalog = _path(g.spark, "mtx"), _path(g.spark, "txt")
    matrix_market.write_coordinate(g, at)
    write_bytes(g.spark, catalog, [f"3 {at}\n".encode()])
    return spmv.multiply(graphs.load_graph(g.spark, graphs.catalog_path(g.spark, catalog, "3")))


@graph_query("select src as row, dst as col from edge where src < 40 and dst < 40")
def graph_from_arrays(g):
    rows = g.edges.where("row < 40 and col < 40").toPandas()
    return _pairs(gr.from_arrays(g.spark, rows["row"], rows["col"], 40))


# logs and tables


@graph_query("""with o as (select id, count(src) d from v left join edge on id = src group by id), i as (select id, count(dst) d from v left join edge on id = dst group by id),
h as (select coalesce(a.d, b.d) as degree, coalesce(a.c, 0) as hin, coalesce(b.c, 0) as hout from (select d, count(*) c from i group by d) a full join (select d, count(*) c from o group by d) b on a.d = b.d),
t as (select (select count(*) from v) as n, (select count(*) from edge) as m)
select 5 as graph_id, cast(degree as int) as degree, round(cast(sum(hin) over w as double) / n, 6) as rows_in, round(cast(sum(hin * degree) over w as double) / m, 6) as nnz_in, round(cast(sum(hout) over w as double) / n, 6) as rows_out, round(cast(sum(hout * degree) over w as double) / m, 6) as nnz_out
from h, t window w as (order by degree rows unbounded preceding)""")
def cdf_log(g):
    path = _path(g.spark, "log")
    tables.append_cdf(stats.degree_cdf(g), 5, path)
    found = tables.read_log(g.spark, path, tables.CDF_LOG)
    return found.select("graph_id", "degree", *[F.round(c, 6).alias(c) for c in ("rows_in", "nnz_in", "rows_out", "nnz_out")])


RUNS = "select cast(o_orderkey as int) as graph_id, m.method, case when m.method = 'origin' then null else '5' end as param, cast(m.k * cast(1 + o_custkey % 9 as double) / 4 as double) as t_spmv_ms from orders, (values ('origin', 4), ('gorder1', 2)) m(method, k)"


def _run_log(spark, sf_dir):
    """Two runs of each order: the base, and one after an ordering."""
    from .derived import table

    each = (1 + F.col("o_custkey") % 9).cast("double")
    runs = spark.createDataFrame([("origin", 4), ("gorder1", 2)], "method string, k int")
    rows = table(spark, sf_dir, "orders").join(F.broadcast(runs))  # two rows
    columns = {"graph_id": F.col("o_orderkey").cast("int"), "method": F.col("method"), "param": F.when(F.col("method") != "origin", "5"), "t_spmv_ms": F.col("k") * each / 4}
    names = [f.split()[0] for f in tables.RUN_LOG.split(", ")]
    path = _path(spark, "log")
    tables.append_log(rows.select(*[columns.get(n, F.lit(None).cast("double")).alias(n) for n in names]), path)
    return tables.read_log(spark, path, tables.RUN_LOG)


@query(RUNS)
def run_log(spark, sf_dir):
    return _run_log(spark, sf_dir).select("graph_id", "method", "param", "t_spmv_ms")


@query(f"with r as ({RUNS}) select a.graph_id, a.t_spmv_ms / b.t_spmv_ms as speedup from r a join r b on a.graph_id = b.graph_id and a.method = 'origin' and b.method = 'gorder1'")
def speedups_from_log(spark, sf_dir):
    return tables.speedups(_run_log(spark, sf_dir))


def _feature_file(rows):
    """The feature table as CSV with untidy headers, read and checked again."""
    path = _path(rows.sparkSession, "csv")
    kept = rows.drop("base_graph")
    tables.write_csv(kept.toDF(*[f" {c.upper()} " for c in kept.columns]), path)
    return tables.read_csv(rows.sparkSession, path)


_SUMS = " or ".join("abs(" + " + ".join(f"{v}_r{i}" for i in range(1, 11)) + " - 1) > 0.001" for v in ("exact", "sampled"))


@feature_query(f"select graph_id, graph_id as base_graph, 'merge' as kernel, 'parts' as dataset, round(speedup, 9) as speedup, round(exact_r1, 9) as exact_r1, round(sampled_r10, 9) as sampled_r10, {_SUMS} as sum_warning from f")
def checked_csv(rows):
    """Headers normalised, columns required, numbers coerced, ids unique, ranges held, names of base graphs made."""
    found = dataset.load(_feature_file(rows), "merge", "parts")
    return found.select("graph_id", "base_graph", "kernel", "dataset", *[F.round(c, 9).alias(c) for c in ("speedup", "exact_r1", "sampled_r10")], "sum_warning")


@feature_query("""select * from (values ('a cell that is no number', 'missing or unreadable numbers'), ('an id twice', 'repeated graph ids'), ('a column less', 'columns are missing'), ('a speedup of 0', 'speedups or times that aren''t above 0'),
('an infinite time', 'numbers that aren''t finite'), ('a negative share', 'negative probabilities'), ('nothing', 'accepted')) t("case", verdict)""")
def rejected_csv(rows):
    """What a feature table with one fault is rejected for: all rows without a fault of their own, and one row that gets it."""
    spark = rows.sparkSession
    names = [c for c in rows.columns if c != "base_graph"]
    sound = rows.dropna(subset=names).where("speedup > 0").select(*[F.col(c).cast("string").alias(c) for c in names])
    own = {"graph_id": "faulty", "speedup": "1.0", "exact_time_ms": "1.0", "sampled_time_ms": "1.0"}
    row = spark.createDataFrame([tuple(own.get(c, "0.1") for c in names)], ", ".join(f"{c} string" for c in names))
    # written once: each case looks at the same rows
    good = written(sound.unionByName(row), "features")
    one = F.col("graph_id") == "faulty"
    cases = {
        "a cell that is no number": good.withColumn("exact_r3", F.when(one, "x").otherwise(F.col("exact_r3"))),
        "an id twice": good.unionByName(good.where(one)),
        "a column less": good.drop("sampled_r4"),
        "a speedup of 0": good.withColumn("speedup", F.when(one, "0").otherwise(F.col("speedup"))),
        "an infinite time": good.withColumn("exact_time_ms", F.when(one, "Infinity").otherwise(F.col("exact_time_ms"))),
        "a negative share": good.withColumn("sampled_r2", F.when(one, "-0.5").otherwise(F.col("sampled_r2"))),
        "nothing": good,
    }
    out = []
    for name, table in cases.items():
        try:
            dataset.load(table, "merge", "parts")
            out.append((name, "accepted"))
        except ValueError as e:
            out.append((name, str(e).split(":")[0]))
    return spark.createDataFrame(out, "case string, verdict string")


@feature_query("select cast(place as int) as place, feature, value from (values " + ", ".join(f"({i}, 'r{i + 1}', {c!r}::double)" for i, c in enumerate(predictor.DEPLOYED.coefficients)) + f", (10, 'intercept', {predictor.DEPLOYED.intercept!r}::double)) t(place, feature, value)")
def exported_model(rows):
    """The deployed model, verified against its own predictions, written, and read from its table; JSON and SQL must agree."""
    spark, folder, model = rows.sparkSession, _path(rows.sparkSession, "model"), predictor.DEPLOYED
    view = dataset.feature_view(rows, "sampled")
    scored = view.withColumn("expected", predictor.log_speedup(model))
    predictor.export(scored, model, folder, "expected")
    text = "\n".join(r["value"] for r in spark.read.text(f"{folder}/model.json").collect())
    again = predictor.from_json(text)
    if again.coefficients != model.coefficients or again.intercept != model.intercept:
        raise ValueError("the exported JSON is another model")
    return spark.read.option("header", True).csv(f"{folder}/model.csv").select(F.col("place").cast("int").alias("place"), "feature", F.col("raw").cast("double").alias("value"))
