"""Queries by name, each over the whole tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, scalars
from ..operators import components as cc
from ..operators import graph as gr
from ..operators import predictor, reuse, spmv, stats
from ..operators.evaluation import dataset, metrics, ridge
from ..operators.orders import banded, burning, communities, greedy, simple
from ..sources import generators
from . import workflow
from .derived import EDGE_SQL, FEATURE_SQL, feature_table, part_graph, supply_graph, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, edges: bool = False, features: bool = False):
    """Registers a function under its name; sql may use edge(src, dst) and v(id), or f, the feature table."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = [EDGE_SQL] * edges + [FEATURE_SQL] * features
            body = sql.strip()
            if parts:
                body = f"with {', '.join(parts)}" + (f", {body[5:]}" if body.startswith("with ") else f" {body}")
            ORACLE_SQL[f.__name__] = body
        return f

    return add


def graph_query(sql: str | None = None):
    """A query over the part graph."""

    def add(f):
        def run(spark, sf_dir):
            return f(part_graph(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        query(sql, edges=True)(run)
        return f

    return add


def feature_query(sql: str | None = None):
    """A query over the feature table."""

    def add(f):
        def run(spark, sf_dir):
            return f(feature_table(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        query(sql, features=True)(run)
        return f

    return add


# graphs


@graph_query("select src as row, dst as col from edge")
def edges(g):
    return g.edges.select("row", "col")


@graph_query("select id, count(src) as deg from v left join edge on id = src group by id")
def out_degree(g):
    return gr.degrees(g, gr.OUT)


@graph_query("select id, count(dst) as deg from v left join edge on id = dst group by id")
def in_degree(g):
    return gr.degrees(g, gr.IN)


@graph_query("with o as (select src as id, count(*) as c from edge group by src), i as (select dst as id, count(*) as c from edge group by dst) select v.id, coalesce(o.c, 0) as outdeg, coalesce(i.c, 0) as indeg from v left join o on v.id = o.id left join i on v.id = i.id")
def both_degrees(g):
    return gr.both_degrees(g)


@graph_query("""with o as (select id, count(src) d from v left join edge on id = src group by id), i as (select id, count(dst) d from v left join edge on id = dst group by id),
h as (select coalesce(a.d, b.d) as degree, coalesce(a.c, 0) as hin, coalesce(b.c, 0) as hout from (select d, count(*) c from i group by d) a full join (select d, count(*) c from o group by d) b on a.d = b.d),
t as (select (select count(*) from v) as n, (select count(*) from edge) as m)
select degree, round(cast(sum(hin) over w as double) / n, 9) as rows_in, round(cast(sum(hin * degree) over w as double) / m, 9) as nnz_in, round(cast(sum(hout) over w as double) / n, 9) as rows_out, round(cast(sum(hout * degree) over w as double) / m, 9) as nnz_out
from h, t window w as (order by degree rows unbounded preceding)""")
def degree_cdf(g):
    out = stats.degree_cdf(g)
    return out.select("degree", *[F.round(c, 9).alias(c) for c in ("rows_in", "nnz_in", "rows_out", "nnz_out")])


@graph_query("select id from v where id not in (select src from edge)")
def dangling_vertices(g):
    return stats.dangling(g)


@graph_query("""with b as (select cast(ceil(count(*) / 64.0) as int) as size from v)
select src // size as cell_row, dst // size as cell_col, count(*) as cnt, round(least(1.0, cast(count(*) as double) / size), 9) as density from edge, b group by src // size, dst // size, size""")
def density_grid(g):
    return stats.density_grid(g, 64).select(F.col("cell_row").cast("int").alias("cell_row"), F.col("cell_col").cast("int").alias("cell_col"), "cnt", F.round("density", 9).alias("density"))


@graph_query("select count(*) as score from edge a join edge b on a.src = b.src and b.dst - a.dst between 1 and 5")
def gscore_w5(g):
    return stats.gscore(g, 5)


@graph_query("with d as (select id, count(src) as c from v left join edge on id = src group by id) select id, cast(sum(c) over (order by id) - c as bigint) as start, cast(sum(c) over (order by id) as bigint) as \"end\" from d")
def csr_offsets_out(g):
    return gr.offsets(g, gr.OUT)


@graph_query("with d as (select id, count(dst) as c from v left join edge on id = dst group by id) select id, cast(sum(c) over (order by id) - c as bigint) as start, cast(sum(c) over (order by id) as bigint) as \"end\" from d")
def csr_offsets_in(g):
    return gr.offsets(g, gr.IN)


@graph_query("select src as id, string_agg(cast(dst as varchar), ',' order by dst) as neighbours from edge group by src")
def adjacency_lists(g):
    return gr.adjacency(g).select("id", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@graph_query("select dst as id from edge where src = 7 order by dst offset 2")
def neighbours_from(g):
    return gr.neighbours(g, 7, 2)


@query("select cast(l_suppkey as int) as row, cast(l_partkey as int) as col, 1.0::double as val from lineitem where l_suppkey <> l_partkey group by all")
def dedup_no_loops(spark, sf_dir):
    return gr.without_loops_and_repeats(supply_graph(spark, sf_dir)).edges


@graph_query("select src as row, dst as col from edge union all select dst, src from edge")
def symmetrize(g):
    return gr.symmetrised(g).edges.select("row", "col")


@graph_query("select src as row, dst as col from edge union select dst, src from edge")
def symmetrize_missing(g):
    return gr.symmetrised(g, only_missing=True).edges.select("row", "col")


@query("""with e as (select cast(l_suppkey as int) a, cast(l_partkey as int) b from lineitem where l_suppkey <> l_partkey) select a as row, b as col, cast(count(*) as double) as weight from (select a, b from e union all select b, a from e) group by a, b""")
def undirected_weights(spark, sf_dir):
    return gr.undirected_weights(supply_graph(spark, sf_dir))


@graph_query("select dst as row, src as col from edge")
def transpose(g):
    return gr.transposed(g).edges.select("row", "col")


@graph_query("select greatest(max(src), max(dst)) as max_id from edge")
def max_node_id(g):
    return g.edges.agg(F.greatest(F.max("row"), F.max("col")).alias("max_id"))


@graph_query("select id, count(src) as deg from v left join edge on id = src group by id order by deg desc, id desc limit 25")
def topk_degree(g):
    return gr.top_k(gr.degrees(g), "id", "deg", 25)


@graph_query("with d as (select id, count(src) as c from v left join edge on id = src group by id) select id as old_id, cast(row_number() over (order by c desc, id desc) - 1 as int) as new_id from d")
def relabel_by_degree(g):
    return gr.relabel_by_degree(g)


@graph_query("""with deg as (select id, count(dst) d from v left join edge on id = dst group by id), re as (select id, sum(d) over (order by id rows unbounded preceding) + id + 1 as key from deg),
t as (select (select count(*) from v) as n, (select count(*) from edge) as m), lanes as (select unnest(range(0, (n + m + 13) // 14)) * 14 as diag from t)
select diag, diag - count(key) as x, count(key) as y from lanes left join re on key <= diag group by diag""")
def tile_coords(g):
    return stats.lane_coordinates(g)


@graph_query("""with deg as (select id, count(dst) d from v left join edge on id = dst group by id), re as (select id, sum(d) over (order by id rows unbounded preceding) + id + 1 as key from deg),
t as (select (select count(*) from v) as n, (select count(*) from edge) as m), tile as (select unnest(range(0, (n + m + 447) // 448)) as tile_id, n, m from t),
c as (select tile_id, n, m, 448 * tile_id - count(key) as x, count(key) as y from tile left join re on key <= 448 * tile_id group by tile_id, n, m),
e as (select *, coalesce(lead(x) over (order by tile_id), m) as x2, coalesce(lead(y) over (order by tile_id), n) as y2 from c)
select count(*) as tiles, count(*) filter (y2 = y) as fast_tiles, count(*) filter (x2 = x) as empty_tiles from e""")
def tile_stats(g):
    return stats.tile_summary(g)


@graph_query("""with deg as (select id, count(dst) d from v left join edge on id = dst group by id), re as (select sum(d) over (order by id rows unbounded preceding) + id as pos from deg),
t as (select (select count(*) from v) as n, (select count(*) from edge) as m), lanes as (select unnest(range(0, (n + m + 13) // 14)) as lane from t)
select lane, cast(coalesce(bit_or(cast(1 << cast(pos % 14 as int) as int)), 0) as int) as bits, count(pos) as row_ends from lanes left join re on pos // 14 = lane group by lane""")
def lane_bits(g):
    return stats.lane_bits(g).select("lane", F.col("bits").cast("int").alias("bits"), "row_ends")


# locality

STREAM_SQL = "with k as (select row_number() over (order by dst, src) - 1 as k, cast(src // 32 as int) as sector from edge)"


@graph_query(f"{STREAM_SQL} select k, sector from k")
def access_stream(g):
    return reuse.access_stream(g)


@graph_query(f"{STREAM_SQL} select k, sector, lag(k) over (partition by sector order by k) as prev from k")
def reuse_gaps(g):
    return reuse.reuse_gaps(reuse.access_stream(g))


RD_SQL = STREAM_SQL + """, l as (select k, sector, lag(k) over w as prev, lead(k) over w as next from k window w as (partition by sector order by k)),
d as (select a.k, a.sector, a.prev, count(j.k) as rd from l a left join l j on j.k > a.prev and j.k < a.k and (j.next > a.k or j.next is null) where a.prev is not null group by all)"""


@graph_query(f"{RD_SQL} select k, sector, prev, rd from d")
def rd_exact_events(g):
    return reuse.reuse_distances(reuse.access_stream(g))


def _bins_sql(edges) -> str:
    return "case " + " ".join(f"when rd >= {e} then {i + 2}" for i, e in reversed(list(enumerate(edges)))) + " else 1 end"


FINE = (1, 4, 8, 16, 24, 32, 40, 48, 56)


@graph_query(f"""{RD_SQL}, c as (select {_bins_sql(FINE)} as bin, count(*) as cnt from d group by 1), b as (select unnest(range(1, 11)) as bin)
select cast(b.bin as int) as bin, coalesce(cnt, 0) as cnt, round(coalesce(cnt, 0) / (select count(*) from d), 9) as prob from b left join c on b.bin = c.bin""")
def rd_exact_hist(g):
    return reuse.exact_histogram(g, edges=FINE).withColumn("prob", F.round("prob", 9))


@graph_query(f"""{RD_SQL}, n as (select unnest(['tile', 'mid', 'far']) as class), c as (select case when rd <= 16 then 'tile' when rd <= 48 then 'mid' else 'far' end as class, count(*) as cnt from d group by 1), t as (select count(*) as total from d)
select n.class, coalesce(cnt, 0) as cnt, total as sampled_cnt, total as total_reuse_cnt, round(coalesce(cnt, 0) / total, 9) as prob from n left join c on n.class = c.class, t""")
def rd_3bin(g):
    return reuse.three_bins(reuse.access_stream(g), 1.0, limits=(16, 48)).withColumn("prob", F.round("prob", 9))


@graph_query(f"""{RD_SQL}, t as (select count(*) as total from d), r as (select {', '.join(f"count(*) filter ({_bins_sql(scalars.EDGES)} = {i}) / (select total from t) as r{i}" for i in range(1, 11))} from d)
select {', '.join(f"round(r{i}, 9) as r{i}" for i in range(1, 11))}, round({predictor.to_sql()}, 9) as predicted_speedup from r""")
def predict_speedup(g):
    out = predictor.predict(reuse.wide(reuse.exact_histogram(g)))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@graph_query()
def rd_sampled(g):
    """The sampled histogram beside the exact one, and how the samples ended."""
    found = reuse.sampled_distances(g)
    return reuse.sampled_histogram(found, FINE).crossJoin(F.broadcast(reuse.status_counts(found)))


@graph_query()
def rd_tv_distance(g):
    """The total variation between the exact and the sampled histogram."""
    exact, sampled = reuse.exact_histogram(g), reuse.sampled_histogram(reuse.sampled_distances(g))
    both = exact.join(sampled.select("bin", F.col("prob").alias("other")), "bin")
    return both.agg((F.sum(F.abs(F.col("prob") - F.col("other"))) / 2).alias("tv"))


# the oracle multiplies in 16-bit halves too, so that nothing overflows
_MUL = lambda x, f: f"((((({x}) * {f >> 16}) & 65535) << 16) + ({x}) * {f & 65535}) & 4294967295"


@graph_query(f"""with a as (select cast(id as bigint) as id, xor(cast(id as bigint), cast(id as bigint) >> 16) as x from v), b as (select id, {_MUL('x', hashing.MULTIPLIERS[0])} as x from a), c as (select id, xor(x, x >> 15) as x from b), d as (select id, {_MUL('x', hashing.MULTIPLIERS[1])} as x from c)
select cast(id as int) as id, xor(x, x >> 16) as h, cast(xor(x, x >> 16) & 4095 as bigint) as register from d""")
def mixer(g):
    h = hashing.mix32(F.col("id"))
    return g.vertices().select("id", h.alias("h"), hashing.register_of(h, 12).alias("register"))


# orderings

SPMV_SQL = "select id as idx, cast(count(dst) as double) as val from v left join edge on id = dst group by id"


@graph_query("with d as (select id, count(src) as c from v left join edge on id = src group by id) select id as old_id, cast(row_number() over (order by c desc, id) - 1 as int) as new_id from d")
def order_degree(g):
    return simple.degree_order(g)


@graph_query("with d as (select id, count(src) as c from v left join edge on id = src group by id) select id as old_id, cast(row_number() over (order by cast(ceil(log2(c + 1) - 1e-9) as int) desc, id) - 1 as int) as new_id from d")
def order_dbg(g):
    return simple.grouped_order(g)


@graph_query("""with d as (select id, count(src) as c from v left join edge on id = src group by id), p as (select id as old_id, cast(row_number() over (order by c desc, id) - 1 as int) as new_id from d)
select a.new_id as row, b.new_id as col from edge join p a on src = a.old_id join p b on dst = b.old_id""")
def relabel_edges(g):
    return simple.relabel(g, simple.degree_order(g)).edges.select("row", "col")


@graph_query("select true as ok, count(*) as rows, count(*) as distinct_ids from v")
def check_perm(g):
    return stats.is_permutation(simple.random_order(g, 3), g.n)


@graph_query("""with b0 as (select id from (select id, count(dst) d from v left join edge on id = dst group by id) order by d desc, id limit 32)
select b.dst as id, count(*) as score from b0 join edge a on a.dst = b0.id join edge b on b.src = a.src where b.dst not in (select id from b0) group by b.dst""")
def two_hop_scores(g):
    """How many paths lead from the first batch of the deployed ordering to each other vertex."""
    first = gr.degrees(g, gr.IN).orderBy(F.desc("deg"), "id").limit(32).select(F.col("id").alias("col"))
    paths = g.edges.join(first, "col").select("row").join(g.edges.select("row", F.col("col").alias("id")), "row")
    return paths.join(first.select(F.col("col").alias("id")), "id", "left_anti").groupBy("id").agg(F.count("*").alias("score"))


@graph_query("""with b0 as (select id, row_number() over (order by d desc, id) - 1 as place from (select id, count(dst) d from v left join edge on id = dst group by id) order by d desc, id limit 32),
sc as (select b.dst w, count(*) s from b0 join edge a on a.dst = b0.id join edge b on b.src = a.src where b.dst not in (select id from b0) group by b.dst),
b1 as (select v.id, row_number() over (order by coalesce(s, 0) desc, v.id) + 31 as place from v left join sc on w = v.id where v.id not in (select id from b0) order by place limit 32)
select id, cast(place as int) as place from (select * from b0 union all select * from b1)""")
def growing_batches(g):
    return greedy.batches(g, greedy.growing_steps(g.n, 1024)[:2]).select("id", "place")


@graph_query()
def order_random(g):
    return simple.random_order(g, 1)


@graph_query(SPMV_SQL)
def spmv_plain(g):
    return spmv.multiply(g)


@graph_query("select v.id as idx, cast(coalesce(sum(src % 7), 0) as double) as val from v left join edge on v.id = dst group by v.id")
def spmv_vector(g):
    return spmv.multiply(g, g.vertices("idx").withColumn("val", (F.col("idx") % 7).cast("double")))


def _after(name: str, order) -> None:
    """The vector after an ordering, in old numbers, must be the plain one, whatever the ordering."""

    def run(spark, sf_dir):
        g = part_graph(spark, sf_dir)
        g = g.with_edges(workflow.written(g.edges, "graph"))  # orderings read them several times
        perm = workflow.written(order(g), "perm")
        return spmv.unpermuted(spmv.multiply(simple.relabel(g, perm)), perm)

    run.__name__, run.__doc__ = f"spmv_after_{name}", _after.__doc__
    query(SPMV_SQL, edges=True)(run)


for _name, _order in {
    "degree": simple.degree_order,
    "dbg": simple.grouped_order,
    "rcm": banded.banded,
    "rabbit": communities.merged,
    "rabbit_rounds": lambda g: communities.merged_in_rounds(g, 6),
    "slashburn": lambda g: burning.burned(g, 0.2),
    "gorder1": lambda g: greedy.sliding(g, 5),
    "gorder2": lambda g: greedy.batch_greedy(g, max(1, g.n // 3), 1),
    "gorder3": lambda g: greedy.batch_greedy_refined(g, max(1, g.n // 3), 1, 5),
    "gorder4": lambda g: greedy.block_refined(g, max(1, g.n // 8), 5),
    "gorder5": lambda g: greedy.batch_greedy_refined(g, max(1, g.n // 3), 1, 5, "row", None),
    "gorder6": lambda g: greedy.growing(g, 1024, refine_from=3),
    "tile_order": lambda g: greedy.tiled(g, 448, 64),
    "local_swap": lambda g: simple.perturbed(g, 0.2, 16, 256, 1)[1],
    "block_shuffle": lambda g: simple.block_shuffle(g, 0.5, 64, 1),
}.items():
    _after(_name, _order)


@graph_query("select cast(0 as bigint) as mismatched, 0.0::double as total_difference")
def spmv_check(g):
    """Relabelled by groups of degrees, multiplied, put back: no element may differ from the plain product."""
    perm = simple.grouped_order(g)
    return spmv.difference(spmv.multiply(g), spmv.unpermuted(spmv.multiply(simple.relabel(g, perm)), perm))


@query("""with recursive e as (select cast(l_suppkey as int) as a, cast(l_suppkey + 1000000 + l_linenumber as int) as b from lineitem group by all), u as (select a, b from e union select b, a from e),
r(id, comp) as (select a, a from u union select u.b, r.comp from r join u on r.id = u.a where r.comp < u.b)
select id, min(comp) as comp from r group by id""")
def components(spark, sf_dir):
    """Suppliers and the line numbers they are on: stars."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("int").alias("row"), (F.col("l_suppkey") + 1000000 + F.col("l_linenumber")).cast("int").alias("col")).distinct()
    ids = lines.select(F.explode(F.array("row", "col")).alias("id")).distinct()
    return cc.components(ids, lines)


@graph_query("select cast(0 as int) as comp, count(*) as size from v")
def component_sizes(g):
    """The part graph is connected at the sizes it is tested at."""
    return cc.sizes(cc.components(g.vertices(), g.edges))


@graph_query("with d as (select a as id, count(*) as deg from (select distinct src a, dst b from edge where src <> dst union select distinct dst, src from edge where src <> dst) group by a) select id, deg from d order by deg desc, id limit 10")
def slashburn_hubs(g):
    u = gr.symmetrised(gr.without_loops_and_repeats(g), only_missing=True)
    return burning.hubs_of(gr.degrees(u), 10).select("id", "deg")


@query()
def rmat_degrees(spark, sf_dir):
    """The degree distribution of a generated graph."""
    return stats.degree_cdf(generators.rmat(spark, 10, 8, 1))


# evaluation


def _rounded(rows: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    return rows.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in rows.dtypes])


E_MODEL = predictor.log_speedup


def _logs(variant: str) -> str:
    m = predictor.DEPLOYED
    return "(" + " + ".join([repr(m.intercept), *(f"({c!r}) * {variant}_r{i}" for i, c in enumerate(m.coefficients, 1))]) + ")"


def _frame(rows: DataFrame, variant: str = "sampled") -> DataFrame:
    view = dataset.feature_view(rows, variant)
    return metrics.predictions(view, E_MODEL(predictor.DEPLOYED), "deployed")


P_SQL = f"with p as (select *, ln(speedup) as t, {_logs('sampled')} as q, exp({_logs('sampled')}) as ps, exp({_logs('exact')}) as pe from f)"


@feature_query(f"select graph_id, base_graph, round(speedup, 9) as speedup, {', '.join(f'round({v}_r{i}, 9) as {v}_r{i}' for v in ('exact', 'sampled') for i in range(1, 11))} from f")
def features(rows):
    return _rounded(rows.select("graph_id", "base_graph", "speedup", *[f"{v}_r{i}" for v in ("exact", "sampled") for i in range(1, 11)]), 9)


@feature_query("""select count(*) as rows, count(distinct base_graph) as base_graphs, round(avg(speedup), 6) as speedup_mean, round(median(speedup), 6) as speedup_median, round(min(speedup), 6) as speedup_min, round(max(speedup), 6) as speedup_max, count(*) filter (speedup > 1) as beneficial,
round(median(exact_time_ms), 6) as exact_time_median, round(median(sampled_time_ms), 6) as sampled_time_median, round(quantile_cont(exact_time_ms, 0.9), 6) as exact_time_p90, round(quantile_cont(sampled_time_ms, 0.9), 6) as sampled_time_p90 from f""")
def dataset_profile(rows):
    return _rounded(dataset.profile(rows))


_GAPS = ", ".join(f"abs(exact_r{i} - sampled_r{i})" for i in range(1, 11))
_SUM = " + ".join(f"abs(exact_r{i} - sampled_r{i})" for i in range(1, 11))
_SQ = lambda v: " + ".join(f"{v}_r{i} * {v}_r{i}" for i in range(1, 11))
_DOT = " + ".join(f"exact_r{i} * sampled_r{i}" for i in range(1, 11))
_L2 = " + ".join(f"(exact_r{i} - sampled_r{i}) * (exact_r{i} - sampled_r{i})" for i in range(1, 11))
A_SQL = f"with a as (select graph_id, {_SUM} as l1, ({_SUM}) / 2 as tv, sqrt({_L2}) as l2, case when sqrt({_SQ('exact')}) > 1e-12 and sqrt({_SQ('sampled')}) > 1e-12 then ({_DOT}) / (sqrt({_SQ('exact')}) * sqrt({_SQ('sampled')})) end as cosine, greatest({_GAPS}) as max_abs, exact_time_ms / sampled_time_ms as time_ratio from f)"


@feature_query(f"{A_SQL} select graph_id, round(l1, 6) as l1, round(tv, 6) as tv, round(l2, 6) as l2, round(cosine, 6) as cosine, round(max_abs, 6) as max_abs, round(time_ratio, 6) as time_ratio from a")
def approximation_rows(rows):
    return _rounded(metrics.approximation_rows(rows))


@feature_query(f"""{A_SQL} select count(*) as rows, round(avg(l1), 6) as l1_mean, round(avg(tv), 6) as tv_mean, round(median(tv), 6) as tv_median, round(quantile_cont(tv, 0.9), 6) as tv_p90, round(quantile_cont(tv, 0.95), 6) as tv_p95, round(max(tv), 6) as tv_max, round(avg(l2), 6) as l2_mean,
round(avg(cosine), 6) as cosine_mean, round(quantile_cont(cosine, 0.1), 6) as cosine_p10, round(avg(max_abs), 6) as max_abs_mean, round(max(max_abs), 6) as max_abs_max, round(exp(avg(ln(time_ratio))), 6) as time_ratio_geomean, round(median(time_ratio), 6) as time_ratio_median from a""")
def approximation_summary(rows):
    return _rounded(metrics.approximation_summary(rows))


_LONG = " union all ".join(f"select 'r{i}' as feature, exact_r{i} as e, sampled_r{i} as s from f" for i in range(1, 11))


@feature_query(f"""with x as ({_LONG}), k as (select *, rank() over (partition by feature order by e) + (count(*) over (partition by feature, e) - 1) / 2.0 as re, rank() over (partition by feature order by s) + (count(*) over (partition by feature, s) - 1) / 2.0 as rs from x)
select feature, round(avg(s - e), 6) as bias, round(avg(abs(s - e)), 6) as mae, round(sqrt(avg((s - e) * (s - e))), 6) as rmse, round(max(abs(s - e)), 6) as max_abs, round(corr(e, s), 6) as pearson, round(corr(re, rs), 6) as spearman from k group by feature""")
def approximation_by_bin(rows):
    return _rounded(metrics.approximation_by_bin(rows))


@feature_query(f"""{P_SQL}, k as (select *, rank() over (order by t) + (count(*) over (partition by t) - 1) / 2.0 as rt, rank() over (order by q) + (count(*) over (partition by q) - 1) / 2.0 as rq from p)
select count(*) as rows, round(avg(abs(t - q)), 6) as mae_log, round(sqrt(avg((t - q) * (t - q))), 6) as rmse_log, round(1 - sum((t - q) * (t - q)) / (var_pop(t) * count(*)), 6) as r2_log, round(corr(t, q), 6) as pearson, round(avg(abs(speedup - ps)), 6) as mae_speedup,
round(sqrt(avg((speedup - ps) * (speedup - ps))), 6) as rmse_speedup, round(avg(abs(speedup - ps) / speedup), 6) as mape, round(avg(2 * abs(speedup - ps) / (speedup + ps)), 6) as smape, round(corr(rt, rq), 6) as spearman from k""")
def metrics_regression(rows):
    return _rounded(metrics.regression(_frame(rows)))


@feature_query(f"""{P_SQL}, b(low, high) as (values {', '.join(f'({a}::double, {b}::double)' for a, b in metrics.BANDS)}), c as (select low, high, count(*) as rows, count(*) filter (ps >= high and speedup > 1) as tp, count(*) filter (ps >= high and speedup <= 1) as fp, count(*) filter (ps <= low and speedup <= 1) as tn, count(*) filter (ps <= low and speedup > 1) as fn from p, b group by low, high)
select low, high, rows, tp, fp, tn, fn, rows - tp - fp - tn - fn as uncertain, round((tp + fp + tn + fn) / rows, 6) as coverage, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) as accuracy, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(tn / nullif(tn + fp, 0), 6) as specificity from c""")
def gate_band(rows):
    return _rounded(metrics.band_gate(_frame(rows)), keep=("low", "high"))


@feature_query(f"""{P_SQL}, b(tau) as (values (1.0::double), (1.01::double), (1.02::double), (1.03::double), (1.05::double), (1.1::double)), c as (select *, case when ps >= tau then speedup else 1.0 end as got from p, b)
select tau, count(*) as rows, count(*) filter (ps >= tau) as selected, count(*) filter (ps >= tau and speedup <= 1) as bad, round(avg(got), 6) as mean, round(median(got), 6) as median, round(exp(avg(ln(got))), 6) as geomean, round(avg(greatest(speedup, 1.0)), 6) as oracle_mean, round(avg(speedup), 6) as always_mean from c group by tau""")
def gate_conservative(rows):
    return _rounded(metrics.conservative_gate(_frame(rows)), keep=("tau",))


@feature_query(f"{P_SQL} select graph_id, round(speedup, 6) as speedup, round(pe, 6) as exact_pred, round(ps, 6) as sampled_pred from p")
def paired_predictions(rows):
    return _rounded(metrics.paired(_frame(rows, "exact"), _frame(rows, "sampled"), ["graph_id"]))


@feature_query(f"""{P_SQL}, b(tau) as (values (1.0::double), (1.01::double), (1.02::double), (1.03::double), (1.05::double), (1.1::double)), c as (select tau, pe >= tau as x, ps >= tau as y, speedup <= 1 as bad from p, b)
select tau, count(*) as rows, count(*) filter (x <> y) as differ, count(*) filter (x and not y) as first_only, count(*) filter (y and not x) as second_only, count(*) filter (x and not y and bad) as first_only_bad, count(*) filter (y and not x and bad) as second_only_bad, round(avg(cast(x <> y as int)), 6) as rate from c group by tau""")
def gate_disagreement(rows):
    pairs = metrics.paired(_frame(rows, "exact"), _frame(rows, "sampled"), ["graph_id"])
    return _rounded(metrics.disagreement(pairs, "exact_pred", "sampled_pred"), keep=("tau",))


@feature_query(f"""{P_SQL}, k as (select *, rank() over (order by pe) + (count(*) over (partition by pe) - 1) / 2.0 as ra, rank() over (order by ps) + (count(*) over (partition by ps) - 1) / 2.0 as rb from p)
select count(*) as rows, round(avg(abs(pe - ps)), 6) as mean_abs, round(quantile_cont(abs(pe - ps), 0.95), 6) as p95_abs, round(max(abs(pe - ps)), 6) as max_abs, round(corr(pe, ps), 6) as pearson, round(corr(ra, rb), 6) as spearman from k""")
def prediction_agreement(rows):
    pairs = metrics.paired(_frame(rows, "exact"), _frame(rows, "sampled"), ["graph_id"])
    return _rounded(metrics.agreement(pairs, "exact_pred", "sampled_pred"))


@feature_query("with g as (select distinct base_graph from f) select base_graph, cast((row_number() over (order by try_cast(base_graph as bigint), base_graph) - 1) % 5 as int) as fold from g")
def group_folds(rows):
    return dataset.folds(rows, 5)


@feature_query("select base_graph, count(*) as rows from f group by base_graph")
def group_sizes(rows):
    return dataset.group_sizes(rows)


@feature_query("with a as (select distinct base_graph from f where speedup > 1.05), b as (select distinct base_graph from f where speedup < 0.95) select coalesce(a.base_graph, b.base_graph) as base_graph, case when a.base_graph is null then 'right_only' when b.base_graph is null then 'left_only' else 'both' end as side from a full join b on a.base_graph = b.base_graph")
def setops_graph_ids(rows):
    return dataset.common_graphs(rows.where("speedup > 1.05"), rows.where("speedup < 0.95"))


_ALIGN = " union all ".join(f"select '{c}' as \"column\", side, d{i} as diff from j" for i, c in enumerate(("exact_r1", "exact_r2", "speedup")))


@feature_query(f"""with a as (select * from f where exact_time_ms > 20), b as (select graph_id, exact_r1, exact_r2, speedup + 0.25 as speedup from f where exact_time_ms <= 45),
j as (select case when a.graph_id is null then 'right_only' when b.graph_id is null then 'left_only' else 'both' end as side, abs(a.exact_r1 - b.exact_r1) as d0, abs(a.exact_r2 - b.exact_r2) as d1, abs(a.speedup - b.speedup) as d2 from a full join b on a.graph_id = b.graph_id), x as ({_ALIGN})
select "column", count(*) filter (side = 'both') as "both", count(*) filter (side = 'left_only') as left_only, count(*) filter (side = 'right_only') as right_only, round(max(diff), 6) as max_abs_diff,
coalesce(max(diff), 0) <= 1e-12 and count(*) filter (side = 'left_only') = 0 and count(*) filter (side = 'right_only') = 0 as within from x group by "column\"""")
def full_outer_align(rows):
    two = rows.where("exact_time_ms <= 45").withColumn("speedup", F.col("speedup") + 0.25)
    return _rounded(dataset.aligned(rows.where("exact_time_ms > 20"), two, ["graph_id"], ["exact_r1", "exact_r2", "speedup"]))


@query("""with n as (select distinct case when o_custkey % 3 = 0 then concat(o_custkey, '_0.1_64_256') when o_custkey % 3 = 1 then concat('net_', o_custkey, '_0.30_64_', o_orderkey) else concat(o_custkey, '_x') end as name, o_custkey from orders)
select name, case when o_custkey % 3 = 0 then cast(o_custkey as varchar) when o_custkey % 3 = 1 then concat('net_', o_custkey) else name end as base from n""")
def base_graph_names(spark, sf_dir):
    key, order = F.col("o_custkey"), F.col("o_orderkey").cast("string")
    name = F.when(key % 3 == 0, F.concat(key.cast("string"), F.lit("_0.1_64_256"))).when(key % 3 == 1, F.concat(F.lit("net_"), key.cast("string"), F.lit("_0.30_64_"), order)).otherwise(F.concat(key.cast("string"), F.lit("_x")))
    return table(spark, sf_dir, "orders").select(name.alias("name")).distinct().select("name", scalars.base_graph(F.col("name")).alias("base"))


@feature_query()
def ridge_cv(rows):
    """Errors of each fold of the grouped cross-validation, by variant."""
    out = None
    for variant in dataset.VARIANTS:
        part = metrics.regression(ridge.cross_validated(dataset.feature_view(rows, variant)), ["fold"]).withColumn("feature_variant", F.lit(variant))
        out = part if out is None else out.unionByName(part)
    return _rounded(out)


@feature_query()
def ridge_coefficients(rows):
    model = ridge.fit(dataset.feature_view(rows, "sampled"))
    return ridge.coefficients(rows.sparkSession, model)


@feature_query()
def cross_inputs(rows):
    """Models of either variant on the features of either."""
    views = {v: dataset.feature_view(rows, v) for v in dataset.VARIANTS}
    return _rounded(ridge.cross_inputs({v: ridge.fit(x) for v, x in views.items()}, views))


# the other queries register themselves with the decorators above
from . import file_queries, order_queries  # noqa: E402, F401
