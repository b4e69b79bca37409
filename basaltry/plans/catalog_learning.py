"""Registered queries of the learners, with closed forms for two features in SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..operators import admm, coding, kernels, krr, matrix, models, regression, sketch
from ..sources.tables import fresh_path
from ..streaming import scoring
from .catalog import ORACLE_SQL as QUERY_SQL
from .catalog import D, P, X, _orders, _stream, labelled, query, r, table, vectors

LAM = 0.1


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two columns of the vectors."""
    return labelled(spark, sf_dir).withColumn("features", F.slice("features", 1, 2)).withColumn("y", F.col("label").cast("double"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).withColumn("y", F.col("label").cast("double"))


# z: two features of each row
_PLAIN = "z AS (SELECT vec_id AS i, CAST(embedding[1] AS DOUBLE) AS z0, CAST(embedding[2] AS DOUBLE) AS z1 FROM embeddings)"
_JLT = f"p AS (SELECT vec_id AS i, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings), z AS (SELECT i, (a * {rng.sql_normal(61, '0')} + b * {rng.sql_normal(61, '2')}) / sqrt(2) AS z0, (a * {rng.sql_normal(61, '1')} + b * {rng.sql_normal(61, '3')}) / sqrt(2) AS z1 FROM p)"
_SPLIT = f"p AS (SELECT vec_id AS i, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings), z AS (SELECT i, (a * {rng.sql_normal(61, '0')} + b * {rng.sql_normal(61, '1')}) * sqrt(0.5) AS z0, (a * {rng.sql_normal(1061, '0')} + b * {rng.sql_normal(1061, '1')}) * sqrt(0.5) AS z1 FROM p)"


def _cosine(seed: int) -> str:
    """Two random features of a Gaussian kernel of width 1 on all columns."""
    return f"""{X}, q AS (SELECT i, s, cos(sum(v * {rng.sql_normal(seed, '(j * 2 + s)')}) + {2 * math.pi!r} * {rng.sql_uniform(seed, f'({8 * D} + any_value(s))')}) AS z FROM x, range(2) t(s) GROUP BY i, s),
z AS (SELECT i, max(z) FILTER (s = 0) AS z0, max(z) FILTER (s = 1) AS z1 FROM q GROUP BY i)"""


_VALUES = "y AS (SELECT vec_id AS i, 0 AS c, CAST(label AS DOUBLE) AS t FROM embeddings)"
_CLASSES = """o AS (SELECT label, row_number() OVER (ORDER BY min(vec_id), label) - 1 AS c FROM embeddings GROUP BY label),
y AS (SELECT vec_id AS i, o.c, CASE WHEN e.label = o.label THEN 1.0 ELSE -1.0 END AS t FROM embeddings e CROSS JOIN o)"""
_ROWS = "f AS (SELECT i, c, z0, z1, t FROM z JOIN y USING (i))"
_SKETCHED_ROWS = f"f AS (SELECT {rng.sql_bucket('62h0', 'i', 8)} AS i, c, sum(z0 * {rng.sql_sign('62v0', 'i')}) AS z0, sum(z1 * {rng.sql_sign('62v0', 'i')}) AS z1, sum(t * {rng.sql_sign('62v0', 'i')}) AS t FROM z JOIN y USING (i) GROUP BY ALL)"


def _ridge(z: str, targets: str, rows: str = _ROWS, penalty: tuple[str, str, str] | None = None) -> str:
    """Ridge regression on two features; penalty: what is added to the square matrix's three numbers."""
    p = penalty or (f"{LAM}", "0", f"{LAM}")
    return f"""WITH {z}, {targets}, {rows}, m AS (SELECT sum(z0 * z0) + {p[0]} AS a, sum(z0 * z1) + {p[1]} AS b, sum(z1 * z1) + {p[2]} AS d FROM f WHERE c = 0),
g AS (SELECT c, sum(z0 * t) AS p, sum(z1 * t) AS q FROM f GROUP BY c),
w AS (SELECT c, (p * d - b * q) / (a * d - b * b) AS w0, (a * q - b * p) / (a * d - b * b) AS w1 FROM g, m), {_SCORES}"""


_SCORES = "scores AS (SELECT i, c, z0 * w0 + z1 * w1 AS s FROM z, w)"
_VALUE = " SELECT i, round(s, 4) + 0.0 AS prediction FROM scores"
_BEST = " SELECT i, label AS prediction FROM (SELECT i, c, row_number() OVER (PARTITION BY i ORDER BY s DESC, c) AS place FROM scores) JOIN o USING (c) WHERE place = 1"

_LINEAR, _GAUSS = kernels.Linear(2), kernels.Gaussian(D, 1.0)
_SOLVERS = {
    "exact": (_two, _LINEAR, {}, _PLAIN, _ROWS),
    "faster": (_two, _LINEAR, {"s": 8, "params": krr.KRRParams(1e-13)}, _PLAIN, _ROWS),
    "approximate": (_wide, _GAUSS, {"s": 2, "params": krr.KRRParams(seed=63, **P)}, _cosine(63), _ROWS),
    "row_sketched": (_two, _LINEAR, {"s": 2, "params": krr.KRRParams(seed=61, sketch_rows=True, **P)}, _JLT, _SKETCHED_ROWS),
    "sketched": (_two, _LINEAR, {"s": 2, "params": krr.KRRParams(seed=61, **P)}, _JLT, _SKETCHED_ROWS),
    "large": (_two, _LINEAR, {"s": 2, "params": krr.KRRParams(1e-9, 100, 61, max_split=2, **P)}, _SPLIT, _ROWS),
}

for _name, (_data, _kernel, _kw, _z, _f) in _SOLVERS.items():
    _method = "approximate" if _name == "row_sketched" else _name

    @query(f"krr_{_name}", _ridge(_z, _VALUES, _f) + _VALUE)
    def _regress(spark, sf_dir, data=_data, kernel=_kernel, kw=_kw, method=_method):
        rows = data(spark, sf_dir)
        return krr.SOLVERS[method](rows, "y", kernel, LAM, **kw).predict(rows).select(F.col("row_id").alias("i"), r("prediction", 4).alias("prediction"))

    @query(f"rlsc_{_name}", _ridge(_z, _CLASSES, _f) + _BEST)
    def _classify(spark, sf_dir, data=_data, kernel=_kernel, kw=_kw, method=_method):
        rows = data(spark, sf_dir)
        return krr.rlsc(rows, "label", kernel, LAM, method, **kw).predict(rows).select(F.col("row_id").alias("i"), "prediction")


@query("sketch_rls", _ridge(_cosine(64), _CLASSES) + _BEST)
def sketch_rls(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return krr.sketch_rls(rows, "label", 1.0, LAM, 2, 64, **P).predict(rows).select(F.col("row_id").alias("i"), "prediction")


_LANDMARKS = f"""e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), l AS (SELECT x, row_number() OVER (ORDER BY {rng.sql_word(65, 'i')}, i) - 1 AS s FROM e QUALIFY s < 2),
k AS (SELECT e.i, l.s, exp(-greatest(list_dot_product(e.x, e.x) + list_dot_product(l.x, l.x) - 2 * list_dot_product(e.x, l.x), 0) / 2) AS v FROM e CROSS JOIN l),
u AS (SELECT exp(-greatest(list_dot_product(a.x, a.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(a.x, b.x), 0) / 2) AS v FROM l a, l b WHERE a.s = 0 AND b.s = 1),
z AS (SELECT i, max(v) FILTER (s = 0) AS z0, max(v) FILTER (s = 1) AS z1 FROM k GROUP BY i)"""


@query("nystrom_rls", _ridge(_LANDMARKS, _CLASSES, penalty=("0.01", "0.01 * (SELECT v FROM u)", "0.01")) + _BEST)
def nystrom_rls(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return krr.nystrom_rls(rows, "label", 1.0, 0.01, 2, 65).predict(rows).select(F.col("row_id").alias("i"), "prediction")


@query("nystrom_leverage")
def nystrom_leverage(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return krr.nystrom_rls(rows, "label", 1.0, 0.01, 64, 65, "leverage").predict(rows).select(F.col("row_id").alias("i"), "prediction")


@query("sketch_pcr", f"""WITH {_cosine(66)}, {_CLASSES}, {_ROWS}, m AS (SELECT sum(z0 * z0) AS a, sum(z0 * z1) AS b, sum(z1 * z1) AS d FROM f WHERE c = 0),
g AS (SELECT c, sum(z0 * t) AS p, sum(z1 * t) AS q FROM f GROUP BY c),
v AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS high, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) AS low FROM m),
w AS (SELECT c, ((a - low) * p + b * q) / (high - low) / high AS w0, (b * p + (d - low) * q) / (high - low) / high AS w1 FROM g, v), {_SCORES}""" + _BEST)
def sketch_pcr(spark, sf_dir):
    """Least squares within the leading one of two directions."""
    rows = labelled(spark, sf_dir)
    return krr.sketch_pcr(rows, "label", 1, 1.0, 2, 66, **P).predict(rows).select(F.col("row_id").alias("i"), "prediction")


# -- ADMM ------------------------------------------------------------------------------------------------


@query("admm_squared", _ridge(_PLAIN, _VALUES, penalty=("0.5", "0", "0.5")) + " SELECT i, round(s, 3) + 0.0 AS prediction FROM scores")
def admm_squared(spark, sf_dir):
    """Forty iterations come to the ridge solution."""
    rows = _two(spark, sf_dir)
    model, _ = admm.train(rows, "y", None, 0, admm.ADMMParams("squared", "l2", 0.5, 1.0, 40))
    return model.predict(rows).select(F.col("row_id").alias("i"), r("prediction", 3).alias("prediction"))


@query("admm_hinge")
def admm_hinge(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    model, _ = admm.train(rows, "label", _GAUSS, 128, admm.ADMMParams("hinge", iterations=4, feature_blocks=2), sorted(coding.label_order(rows, "label", "row_id")), rows)
    return model.predict(rows).select(F.col("row_id").alias("i"), "prediction")


# -- models ----------------------------------------------------------------------------------------------


@query("feature_model", f"WITH {_cosine(67)} SELECT i, round(0.5 * z0 - 2.0 * z1, 5) + 0.0 AS prediction FROM z")
def feature_model(spark, sf_dir):
    """A model that was saved and read again."""
    model = models.FeatureModel([_GAUSS.features(2, "regular", 67, **P)], [np.array([[0.5], [-2.0]])])
    path = fresh_path(spark, "model")
    models.save(model, path, spark)
    return models.load(path, spark).predict(vectors(spark, sf_dir)).select(F.col("row_id").alias("i"), r("prediction", 5).alias("prediction"))


@query("feature_model_split", f"WITH {_SPLIT} SELECT i, CASE WHEN z0 - 1.5 * z1 >= 0 THEN 1 ELSE -1 END AS prediction FROM z")
def feature_model_split(spark, sf_dir):
    """Two scaled maps, classes by sign."""
    maps = [_LINEAR.features(1, "regular", 61 + 1000 * j, **P) for j in range(2)]
    model = models.FeatureModel(maps, [np.array([[1.0]]), np.array([[-1.5]])], scaled=True, labels=[-1, 1])
    return models.from_json(model.to_json()).predict(_two(spark, sf_dir)).select(F.col("row_id").alias("i"), "prediction")


@query("kernel_model", """WITH e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT a.i, round(sum(exp(-greatest(list_dot_product(a.x, a.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(a.x, b.x), 0) / 2) / (1 + b.i)), 5) AS prediction FROM e a JOIN e b ON b.i < 10 GROUP BY a.i""")
def kernel_model(spark, sf_dir):
    x = vectors(spark, sf_dir)
    support = matrix.to_numpy(x.where("row_id < 10"))
    model = models.from_json(models.KernelModel(_GAUSS, support, 1.0 / (1 + np.arange(len(support)))[:, None]).to_json())
    return model.predict(x).select(F.col("row_id").alias("i"), r("prediction", 5).alias("prediction"))


@query("indicator_coding", "SELECT vec_id, CAST(c AS BIGINT) AS c, CASE WHEN label = c THEN 1.0 ELSE 0.0 END AS v FROM embeddings, range(10) t(c)")
def indicator_coding(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(coding.indicator("label", 10, 0, 1.0, 0.0)).alias("c", "v")).select("vec_id", F.col("c").cast("long").alias("c"), "v")


@query("kernel_factory", """WITH e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT a.i, b.i AS j, round(exp(-greatest(list_dot_product(a.x, a.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(a.x, b.x), 0) / 4.5), 6) AS v FROM e a JOIN e b ON b.i <= a.i WHERE a.i < 40""")
def kernel_factory(spark, sf_dir):
    """The lower triangle of a Gram matrix, entry by entry, of a kernel made by name and through its JSON form."""
    k = kernels.from_json(kernels.kernel("gaussian", D, sigma=1.5).to_json())
    return k.symmetric_gram(vectors(spark, sf_dir).where("row_id < 40")).select("i", "j", F.round("v", 6).alias("v"))


@query("gram_blocks", """WITH e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT a.i AS place, round(sum(list_dot_product(a.x, b.x) / (1 + b.i)) + any_value(0.5 / (1 + a.i)), 5) + 0.0 AS v FROM e a CROSS JOIN e b GROUP BY a.i""")
def gram_blocks(spark, sf_dir):
    """(K + 0.5 I) v without K: blocks of it are made on executors."""
    x = matrix.to_numpy(vectors(spark, sf_dir))
    made = krr.gram_product(spark, kernels.Linear(D), x, 0.5)(1.0 / (1 + np.arange(len(x)))[:, None])
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(made[:, 0])], "place long, v double").select("place", r("v", 5).alias("v"))


# -- solvers side by side, streams --------------------------------------------------------------------------


@query("solver_comparison", """WITH o AS (SELECT o_totalprice / 1000 AS y, o_custkey / 100.0 AS x1, CAST(month(o_orderdate) AS DOUBLE) AS x2 FROM orders),
m AS (SELECT count(*) n, var_pop(y) vy, var_pop(x1) v1, var_pop(x2) v2, covar_pop(x1, x2) c12, covar_pop(x1, y) c1y, covar_pop(x2, y) c2y FROM o),
s AS (SELECT sqrt(n * (vy - (c1y * c1y * v2 - 2 * c1y * c2y * c12 + c2y * c2y * v1) / (v1 * v2 - c12 * c12))) AS v FROM m)
SELECT name AS solver, round(v, 3) AS residual FROM s, (VALUES ('normal'), ('semi_normal'), ('qr'), ('svd'), ('lsqr'), ('blendenpik'), ('lsrn')) t(name)""")
def solver_comparison(spark, sf_dir):
    """The residual of every exact solver is that of the best fit."""
    methods = [m for m in regression.SOLVERS if m != "sketch"]
    made = regression.compare(_orders(spark, sf_dir), "y", methods)
    return spark.createDataFrame([(name, float(v)) for name, _, v in made], "solver string, residual double").select("solver", F.round("residual", 3).alias("residual"))


@query("stream_scores", f"WITH {_cosine(67)} SELECT i, round(0.5 * z0 - 2.0 * z1, 5) + 0.0 AS prediction FROM z")
def stream_scores(spark, sf_dir):
    """Vectors that arrive as a stream, scored by a model."""
    model = models.FeatureModel([_GAUSS.features(2, "regular", 67, **P)], [np.array([[0.5], [-2.0]])])
    stream = _stream(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    scoring.to_memory(scoring.score_stream(stream, model), "basaltry_scores")
    return spark.table("basaltry_scores").select(F.col("row_id").alias("i"), r("prediction", 5).alias("prediction"))


@query("stream_windowed_sketch", f"SELECT time_bucket(INTERVAL '1 day', ts) AS start, {rng.sql_bucket('13h0', 'user_id', 8)} AS bucket, round(sum({rng.sql_sign('13v0', 'user_id')} * value), 3) + 0.0 AS v FROM events GROUP BY ALL")
def stream_windowed_sketch(spark, sf_dir):
    """A count sketch of each day of a stream of events."""
    sums = scoring.sketch_stream(_stream(spark, sf_dir, "events"), sketch.CWT(1 << 40, 8, 13), "user_id", "value", "ts", "1 day")
    scoring.to_memory(sums, "basaltry_day_sketch", "complete")
    return spark.table("basaltry_day_sketch").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "bucket", r("v", 3).alias("v"))


@query("block_rows", QUERY_SQL["jlt_rowwise"])
def block_rows(spark, sf_dir):
    """Dense maps a few rows at a time give the same."""
    before, matrix.TUNING.block_rows = matrix.TUNING.block_rows, 7
    try:
        made = vectors(spark, sf_dir) / sketch.JLT(D, 8, 21, **P)
    finally:
        matrix.TUNING.block_rows = before
    return matrix.to_coords(made, True).select("i", F.col("j").alias("s"), r("v").alias("v"))
