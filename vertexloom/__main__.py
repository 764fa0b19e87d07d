"""Command line: `python -m vertexloom <command>`.

    run       predict, order, multiply and verify a graph, and append the record to a log
    convert   read a graph in any known form and write it in another
    order     write an ordering as a permutation
    stats     print a graph's statistics
    picture   write the density grid as a PNG
    evaluate  fit and evaluate the predictor on feature tables
"""

from __future__ import annotations

import argparse
import json
import os


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vertexloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--master", default=None, help="Spark's master, if not set elsewhere")
    sub = p.add_subparsers(dest="command", required=True)

    def graph(name, text):
        c = sub.add_parser(name, help=text)
        c.add_argument("-f", "--file", help="the graph's file")
        c.add_argument("--catalog", help="a catalogue, with --id")
        c.add_argument("--id", help="the graph's id in the catalogue")
        c.add_argument("-g", "--rmat", type=int, metavar="SCALE", help="a generated graph of 2**SCALE vertices instead")
        c.add_argument("-u", "--uniform", type=int, metavar="SCALE", help="one with independent ends instead")
        c.add_argument("-k", "--degree", type=int, default=16, help="mean degree of generated graphs")
        c.add_argument("-s", "--symmetrize", action="store_true", help="add inverse edges")
        return c

    run = graph("run", "predict, order, multiply, verify")
    run.add_argument("--method", default="gorder6")
    run.add_argument("--tau", type=float, default=None, help="order only where the prediction reaches this")
    run.add_argument("-a", type=float, default=0, help="first number of the ordering")
    run.add_argument("-b", type=float, default=0, help="second number of the ordering")
    run.add_argument("--exact", action="store_true", help="predict from exact reuse distances")
    run.add_argument("--log", help="folder of the run log")
    convert = graph("convert", "write a graph in another form")
    convert.add_argument("-o", "--out", required=True, help="ends in .mtx, .el, .wel or .parquet")
    order = graph("order", "write an ordering")
    order.add_argument("--method", default="gorder6")
    order.add_argument("-a", type=float, default=0)
    order.add_argument("-b", type=float, default=0)
    order.add_argument("-o", "--out", required=True)
    graph("stats", "print statistics")
    picture = graph("picture", "write the density grid")
    picture.add_argument("-o", "--out", required=True)
    picture.add_argument("--cells", type=int, default=1024)
    ev = sub.add_parser("evaluate", help="fit and evaluate the predictor")
    ev.add_argument("--train", required=True)
    ev.add_argument("--sparse", required=True)
    ev.add_argument("--external", required=True)
    ev.add_argument("--kernels", default="tiles")
    ev.add_argument("--ridge-alpha", type=float, default=1.0)
    ev.add_argument("--cv-folds", type=int, default=5)
    ev.add_argument("-o", "--out", required=True)
    return p


def load(spark, a):
    from .operators.graph import symmetrised
    from .sources import generators, graphs

    if a.rmat is not None:
        g = generators.rmat(spark, a.rmat, a.degree)
    elif a.uniform is not None:
        g = generators.random_graph(spark, 1 << a.uniform, a.degree << a.uniform)
    elif a.file or a.catalog and a.id:
        g = graphs.load_graph(spark, a.file or graphs.catalog_path(spark, a.catalog, a.id))
    else:
        raise SystemExit("give a file, a catalogue and an id, or a generator")
    return symmetrised(g) if a.symmetrize else g


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("vertexloom")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    from .operators import stats
    from .operators.evaluation import dataset, metrics, ridge
    from .operators.graph import summary
    from .operators.predictor import to_json
    from .plans import workflow
    from .sources import graphs, matrix_market, tables

    if a.command == "run":
        found = workflow.optimise(load(spark, a), a.method, a.tau, a.a, a.b, not a.exact)
        print(json.dumps(found.record | {"reordered": found.reordered, "mismatched": found.mismatched}))
        if a.log:
            tables.append_records(spark.createDataFrame([{"graph_id": a.id or a.file or "generated", **found.record}]), a.log)
        return int(found.mismatched > 0)
    if a.command == "convert":
        g, kind = load(spark, a), a.out.rsplit(".", 1)[-1]
        writers = {"mtx": lambda: matrix_market.write_coordinate(g, a.out), "el": lambda: graphs.write_edge_list(g, a.out), "wel": lambda: graphs.write_edge_list(g, a.out, True), "parquet": lambda: graphs.write_parquet(g, a.out)}
        if kind not in writers:
            raise SystemExit(f"no writer for .{kind}")
        writers[kind]()
    elif a.command == "order":
        g = load(spark, a)
        graphs.write_permutation(workflow.order(g, a.method, a.a, a.b), g.n, g.nnz(), a.out)
    elif a.command == "stats":
        g = load(spark, a)
        print(json.dumps(summary(g) | stats.tile_summary(g).first().asDict() | stats.gscore(g, 5).first().asDict()))
        stats.degree_cdf(g).orderBy("degree").show(40)
    elif a.command == "picture":
        with open(a.out, "wb") as f:
            f.write(graphs.density_picture(load(spark, a), a.cells))
    else:
        os.makedirs(a.out, exist_ok=True)
        for kernel in a.kernels.split(","):
            train, sparse, external = (dataset.load(tables.read_csv(spark, p.format(kernel=kernel)), kernel, n, n == "train") for n, p in (("train", a.train), ("sparse", a.sparse), ("external", a.external)))
            for variant in dataset.VARIANTS:
                views = [dataset.feature_view(x, variant) for x in (train, sparse, external)]
                for name, frame in ridge.experiments(*views, a.cv_folds, a.ridge_alpha).items():
                    tables.write_csv(metrics.regression(frame), f"{a.out}/{kernel}/{variant}/{name}_metrics")
                    tables.write_csv(metrics.band_gate(frame), f"{a.out}/{kernel}/{variant}/{name}_band_gate")
                    tables.write_csv(metrics.conservative_gate(frame), f"{a.out}/{kernel}/{variant}/{name}_conservative_gate")
                model = ridge.fit(views[0], a.ridge_alpha)
                with open(f"{a.out}/{kernel}_{variant}_model.json", "w", encoding="utf-8") as f:
                    f.write(to_json(model, kernel=kernel, feature_variant=variant, ridge_alpha=a.ridge_alpha))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
