"""Command line: python -m basaltry {svd,linear,krr,admm,predict,community,embed,convert} ...

Under spark-submit the session's master and settings hold.
"""

from __future__ import annotations

import argparse
import json
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import admm, coding, graph, kernels, krr, matrix, models, regression, sketch, svd
from .sources import text_formats


def _read(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """row_id, features and label (first target) from LIBSVM text or a Parquet twin."""
    kw = {"min_d": a.min_d, "max_n": getattr(a, "partial", None)} if a.format.startswith("libsvm") else {}
    df = text_formats.read(spark, a.input, a.format, **kw)
    return df if "label" in df.columns or "labels" not in df.columns else df.withColumn("label", F.get("labels", F.lit(0)))


def _sampled(rows: DataFrame, a: argparse.Namespace) -> DataFrame:
    return sketch.sample_rows(rows, "row_id", a.sample, a.seed) if a.sample else rows


def _small(path: str, a: np.ndarray) -> None:
    fs, p = models._fs(path)
    with fs.open_output_stream(p) as f:
        np.savetxt(f, np.atleast_2d(a))


def run_svd(spark, a):
    p = svd.SVDParams(a.oversampling_ratio, a.oversampling_additive, a.powerits)
    if a.symmetric:
        coords = text_formats.read_arc_list(spark, a.input) if a.format == "arc_list" else matrix.to_coords(_read(spark, a))
        n = max(matrix.height(coords), matrix.height(matrix.transpose(coords)))
        v, s = svd.approximate_symmetric_svd(coords, n, a.rank, p, a.seed, a.lower)
    elif a.format in ("libsvm_sparse", "parquet_sparse", "arc_list"):  # both sides stay distributed
        coords = text_formats.read_arc_list(spark, a.input) if a.format == "arc_list" else matrix.to_coords(_read(spark, a))
        u, s, v = svd.sparse_svd(coords, matrix.height(coords), matrix.height(matrix.transpose(coords)), a.rank, p, a.seed)
        text_formats.write_matrix(u, f"{a.prefix}.U", a.text)
        text_formats.write_matrix(v, f"{a.prefix}.V", a.text)
        _small(f"{a.prefix}.S", s)
        return
    else:
        u, s, v = svd.approximate_svd(_read(spark, a).select("row_id", "features"), a.rank, p, a.seed)
        text_formats.write_matrix(u, f"{a.prefix}.U", a.text)
    _small(f"{a.prefix}.S", s)
    _small(f"{a.prefix}.V", v)


def run_linear(spark, a):
    rows = _read(spark, a)
    solve = regression.faster_least_squares if a.high_precision else regression.approximate_least_squares
    _small(f"{a.prefix}.x", solve(rows, "label", a.seed))


def _kernel(a: argparse.Namespace, d: int) -> kernels.Kernel | None:
    if a.kernel == "linear":
        return kernels.Linear(d)
    if a.kernel == "polynomial":
        return kernels.Polynomial(d, a.degree, a.offset, a.bandwidth)
    if a.kernel == "expsemigroup":
        return kernels.ExpSemigroup(d, a.bandwidth)
    if a.kernel == "matern":
        return kernels.Matern(d, a.nu, a.bandwidth)
    return kernels.KERNELS[a.kernel](d, a.bandwidth)


def _tell(model: models.Model, rows: DataFrame) -> None:
    out = model.predict(rows)
    measure = coding.relative_error(out, "prediction", "label") if model.labels is None else coding.accuracy(out, "prediction", "label")
    print(json.dumps(measure.first().asDict()))


def run_krr(spark, a):
    rows = _sampled(_read(spark, a), a)
    kernel = _kernel(a, matrix.width_of(rows))
    tolerance, limit = a.tolerance or (1e-1 if a.algorithm == "large" else 1e-3), a.iterations or (20 if a.algorithm == "large" else 1000)
    p = krr.KRRParams(tolerance, limit, a.seed, a.features_kind, a.max_split, a.sketch_rows)
    kw = {} if a.algorithm == "exact" else {"s": a.features, "params": p}
    if a.regression:
        model = krr.SOLVERS[a.algorithm](rows, "label", kernel, a.lam, **kw)
    else:
        model = krr.rlsc(rows, "label", kernel, a.lam, a.algorithm, **kw)
    models.save(model, a.model)
    if a.test:
        _tell(model, _read(spark, argparse.Namespace(**{**vars(a), "input": a.test, "min_d": kernel.N})))


def run_admm(spark, a):
    rows = _read(spark, a)
    labels = None if a.loss in ("squared", "lad") and a.regression else sorted(coding.label_order(rows, "label", "row_id"))
    if labels and len(labels) == 2:
        rows = rows.withColumn("label", F.when(F.col("label") == labels[1], 1.0).otherwise(-1.0))
    elif labels:
        rows = rows.withColumn("label", F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1)
    kernel = None if a.kernel == "none" else _kernel(a, matrix.width_of(rows))
    p = admm.ADMMParams(a.loss, a.regularizer, a.lam, a.rho, a.iterations or 20, a.feature_blocks, seed=a.seed, tolerance=a.tolerance)
    held_out = None
    if a.validation:
        held_out = _read(spark, argparse.Namespace(**{**vars(a), "input": a.validation, "min_d": matrix.width_of(rows)}))
    model, history = admm.train(rows, "label", kernel, a.features, p, labels, held_out)
    models.save(model, a.model)
    print(json.dumps({"objective": history} if held_out is None else {"objective": [x[0] for x in history], "validation": [x[1] for x in history]}))


def run_predict(spark, a):
    model = models.load(a.model)
    if a.input == "-":  # one LIBSVM line after another from standard input
        d = model.maps[0].N if getattr(model, "maps", None) else model.kernel.N if hasattr(model, "kernel") else len(model.weights[0])
        for line in sys.stdin:
            pairs = [t.split(":") for t in line.split() if ":" in t]
            x = np.zeros((1, d))
            for j, v in pairs:
                x[0, int(j) - 1] = float(v)
            scores = model.decision(x)[0]
            answer = scores.tolist() if a.decisions or model.labels is None else model.labels[int(scores.argmax()) if len(scores) > 1 else int(scores[0] >= 0)]
            print(json.dumps(answer), flush=True)
        return
    rows = _read(spark, a)
    (model.decisions(rows) if a.decisions else model.predict(rows)).write.parquet(a.output)
    if "label" in rows.columns and not a.decisions:
        _tell(model, rows)


def run_community(spark, a):
    edges = text_formats.read_graph(spark, a.input, a.numeric).persist()
    p = graph.PPRParams(a.alpha, a.gamma, a.epsilon)
    names = dict(text_formats.read_index(spark, a.index).collect()) if a.index else {}
    if a.all:
        for r in graph.communities(edges, None, p, a.recursive).toLocalIterator():
            print(json.dumps({"seeds": [r["seed"]], "cluster": r["cluster"], "conductance": r["conductance"]}))
        return

    def vertex(name: str):
        return names.get(name, int(name) if a.numeric else name)

    lines = ([a.seeds] if a.seeds else []) if not a.interactive else (line.split() for line in sys.stdin)
    for line in lines:
        seeds = [vertex(s) for s in line]
        if seeds:
            cluster, conductance = graph.local_cluster(edges, seeds, p, a.recursive)
            print(json.dumps({"seeds": seeds, "cluster": sorted(cluster), "conductance": conductance}), flush=True)


def run_compare(spark, a):
    """Every least-squares solver on the same rows: seconds and residual."""
    rows = _read(spark, a).persist()
    for name, seconds, residual in regression.compare(rows, "label"):
        print(json.dumps({"solver": name, "seconds": round(seconds, 3), "residual": residual}))


def run_embed(spark, a):
    x, values = graph.spectral_embedding(text_formats.read_graph(spark, a.input, a.numeric), a.rank, a.powerits, a.seed)
    x.write.parquet(f"{a.prefix}.vec")
    _small(f"{a.prefix}.S", values)


def run_convert(spark, a):
    text_formats.convert_libsvm(spark, a.input, a.output, a.sparse, a.min_d)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="basaltry")
    sub = top.add_subparsers(required=True)

    def add(name: str, run, data: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("input")
        p.add_argument("--seed", type=int, default=38734)
        if data:
            p.add_argument("--format", default="libsvm_dense")
            p.add_argument("--min-d", type=int, default=0)
        return p

    def learner(p: argparse.ArgumentParser) -> None:
        p.add_argument("--model", required=True)
        p.add_argument("--kernel", default="gaussian", choices=[*kernels.KERNELS, "none"])
        p.add_argument("--bandwidth", "-g", type=float, default=10.0)
        p.add_argument("--degree", type=int, default=2)
        p.add_argument("--offset", type=float, default=1.0)
        p.add_argument("--nu", type=float, default=1.5)
        p.add_argument("--lam", type=float, default=0.01)
        p.add_argument("--features", "-f", type=int, default=2000)
        p.add_argument("--tolerance", type=float)
        p.add_argument("--iterations", type=int)
        p.add_argument("--regression", action="store_true")

    p = add("svd", run_svd)
    p.add_argument("--rank", type=int, default=6)
    p.add_argument("--powerits", type=int, default=2)
    p.add_argument("--oversampling-ratio", type=int, default=2)
    p.add_argument("--oversampling-additive", type=int, default=0)
    p.add_argument("--symmetric", action="store_true")
    p.add_argument("--lower", action="store_true")
    p.add_argument("--text", action="store_true")
    p.add_argument("--prefix", default="out")
    p = add("linear", run_linear)
    p.add_argument("--high-precision", "-p", action="store_true")
    p.add_argument("--prefix", default="out")
    add("compare", run_compare)
    p = add("krr", run_krr)
    learner(p)
    p.add_argument("--algorithm", default="faster", choices=list(krr.SOLVERS))
    p.add_argument("--features-kind", default="regular", choices=["regular", "fast", "quasi", "sparse"])
    p.add_argument("--max-split", type=int, default=0)
    p.add_argument("--sample", type=int)
    p.add_argument("--partial", type=int, help="read only so many rows")
    p.add_argument("--sketch-rows", action="store_true")
    p.add_argument("--test")
    p = add("admm", run_admm)
    learner(p)
    p.add_argument("--loss", default="squared", choices=["squared", "lad", "hinge", "logistic"])
    p.add_argument("--regularizer", default="none", choices=["none", "l2", "l1"])
    p.add_argument("--rho", type=float, default=1.0)
    p.add_argument("--validation")
    p.add_argument("--feature-blocks", type=int, default=1)
    p = add("predict", run_predict)
    p.add_argument("--model", required=True)
    p.add_argument("--output", help="not needed with input -, which reads lines and prints answers")
    p.add_argument("--decisions", action="store_true")
    p = add("community", run_community, data=False)
    p.add_argument("--seeds", nargs="*", default=[])
    p.add_argument("--all", action="store_true")
    p.add_argument("--interactive", action="store_true", help="a line of seeds after another from standard input")
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--numeric", action="store_true")
    p.add_argument("--index")
    p.add_argument("--gamma", type=float, default=5.0)
    p.add_argument("--alpha", type=float, default=0.85)
    p.add_argument("--epsilon", type=float, default=1e-3)
    p = add("embed", run_embed, data=False)
    p.add_argument("--rank", type=int, default=10)
    p.add_argument("--powerits", type=int, default=2)
    p.add_argument("--numeric", action="store_true")
    p.add_argument("--prefix", default="out")
    p = add("convert", run_convert, data=False)
    p.add_argument("output")
    p.add_argument("--sparse", action="store_true")
    p.add_argument("--min-d", type=int, default=0)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(spark or SparkSession.builder.appName("basaltry").getOrCreate(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
