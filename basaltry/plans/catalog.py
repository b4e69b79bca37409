"""Registered queries over the driver's tables and their SQL twins.

Each query applies an operator of this engine to whole tables.  Where SQL can say the same, the twin is in
ORACLE_SQL; both round, since sums may be added up in any order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..operators import coding, graph, kernels, krylov, losses, matrix, pairs, regression, sketch, svd
from ..sources import text_formats
from ..sources.tables import written
from ..streaming import scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.row_df(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")


X = "x AS (SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
D = 64

# -- sketches ---------------------------------------------------------------------------------------------


def _hash_query(name: str, cls, S: int, sql_value: str, dimension: str, digits: int, **kw):
    t = cls(1 << 40, S, 7, **kw) if dimension == "columnwise" else cls(D, S, 7, **kw)
    k = "i" if dimension == "columnwise" else "j"
    out = "bucket, j" if k == "i" else "i, bucket"
    sql = f"WITH {X} SELECT {out}, round(sum(v), {digits}) + 0.0 AS v FROM (SELECT {rng.sql_bucket('7h0', k, S)} AS bucket, i, j, {sql_value.format(k=k)} * v AS v FROM x) GROUP BY {out}"

    @query(name, sql)
    def run(spark, sf_dir):
        made = t.coords(matrix.to_coords(vectors(spark, sf_dir), True), dimension)
        return made.select(*[F.col(c).alias("bucket" if c == k else c) for c in ("i", "j")], r("v", digits).alias("v"))


def _sql_sign(k: str) -> str:
    return rng.sql_sign("7v0", k)


_WZT = "({s} * pow(1.0 / {e}, {p!r}))"
_hash_query("countsketch_columnwise", sketch.CWT, 64, _sql_sign("{k}"), "columnwise", 6)
_hash_query("countsketch_rowwise", sketch.CWT, 16, _sql_sign("{k}"), "rowwise", 6)
_hash_query("cauchy_hash_sketch", sketch.MMT, 32, rng.sql_cauchy("7v0", "{k}"), "columnwise", 3)
_hash_query("lp_hash_sketch", sketch.WZT, 32, _WZT.format(s=_sql_sign("{k}"), e=rng.sql_exponential("7e0", "{k}"), p=1 / 1.5), "columnwise", 3, p=1.5)


# Dense sketches and feature maps take the portable stream, which SQL can follow.
P = {"stream": "portable"}


def _dense_rowwise(name: str, t: sketch.Sketch, entry: str, digits: int):
    """Sketch by features; entry is W[s, j] in SQL."""
    sql = f"WITH {X}, w AS (SELECT j, s, {entry} AS w FROM range({D}) a(j), range({t.S}) b(s)) SELECT i, s, round(sum(v * w), {digits}) + 0.0 AS v FROM x JOIN w USING (j) GROUP BY i, s"

    @query(name, sql)
    def run(spark, sf_dir):
        return matrix.to_coords(vectors(spark, sf_dir) / t, True).select("i", F.col("j").alias("s"), r("v", digits).alias("v"))


def _at(s: int) -> str:
    """The stream's place of entry (s, j)."""
    return f"(j * {s} + s)"


_dense_rowwise("jlt_rowwise", sketch.JLT(D, 8, 21, **P), f"{rng.sql_normal(21, _at(8))} / sqrt(8)", 6)
_dense_rowwise("cauchy_dense_rowwise", sketch.CT(D, 8, 22, C=2.0, **P), f"{rng.sql_cauchy(22, _at(8))} * 2.0 / 8", 4)
_dense_rowwise("sparse_jlt", sketch.create("SparseJLT", D, 16, seed=23, **P), f"CASE WHEN {rng.sql_uniform(23, _at(16))} < 1.0 / 6 THEN -1 WHEN {rng.sql_uniform(23, _at(16))} < 1.0 / 3 THEN 1 ELSE 0 END / sqrt(16 / 3.0)", 6)
_MIX = f"CASE WHEN {{k}} = 0 THEN sqrt(1.0 / {{n}}) ELSE sqrt(2.0 / {{n}}) END * cos({math.pi!r} * (2 * {{j}} + 1) * {{k}} / (2.0 * {{n}}))"
_dense_rowwise("rfut", sketch.RFUT(D, D, 24, **P), f"{rng.sql_sign(24, 'j')} * {_MIX.format(k='s', j='j', n=D)}", 6)
_dense_rowwise("rfut_hartley", sketch.RFUT(D, D, 24, transform="dht", **P), f"{rng.sql_sign(24, 'j')} * (cos({2 * math.pi!r} * j * s / {D}) + sin({2 * math.pi!r} * j * s / {D})) / sqrt({D})", 6)
_PICK = rng.sql_integer(25, f"({D} + s)", D)
_dense_rowwise("fjlt_rowwise", sketch.create("FastJLT", D, 16, seed=25, **P), f"sqrt({D} / 16.0) * {rng.sql_sign(25, 'j')} * {_MIX.format(k=_PICK, j='j', n=D)}", 6)
_dense_rowwise("nonuniform_columns", sketch.create("NonUniformSampler", D, 16, seed=26, probabilities=range(1, D + 1), **P), f"CASE WHEN j = (SELECT count(*) FROM range({D}) e(n) WHERE (n + 1) * (n + 2) / {D * (D + 1)}.0 <= {rng.sql_uniform(26, 's')}) THEN 1 ELSE 0 END", 6)
_dense_rowwise("uniform_columns", sketch.create("UniformSampler", D, 16, seed=27, **P), f"CASE WHEN j = {rng.sql_integer(27, 's', D)} THEN 1 ELSE 0 END", 6)


@query("rfut_inverse", f"WITH {X} SELECT i, j, round(v, 6) + 0.0 AS v FROM x")
def rfut_inverse(spark, sf_dir):
    """Mixing and back."""
    t = sketch.RFUT(D, D, 3)
    return matrix.to_coords(t.apply_inverse(t.apply(vectors(spark, sf_dir), "rowwise")), True).select("i", "j", r("v").alias("v"))


@query("walsh_hadamard", f"WITH {X} SELECT i, k, round(sum(v * CASE WHEN bit_count(xor(0, j & k)) % 2 = 0 THEN 1 ELSE -1 END) / sqrt({D}), 6) + 0.0 AS v FROM x, range({D}) t(k) GROUP BY i, k")
def walsh_hadamard(spark, sf_dir):
    return matrix.to_coords(matrix.map_rows(vectors(spark, sf_dir), sketch.wht), True).select("i", F.col("j").alias("k"), r("v").alias("v"))


def _columnwise(name: str, make: Callable[[int], sketch.Sketch], entry: str, S: int, digits: int):
    """Sketch by rows; entry is W[s, i] in SQL, with n the height."""
    sql = f"WITH {X}, h AS (SELECT max(vec_id) + 1 AS n FROM embeddings), w AS (SELECT i, s, {entry} AS w FROM (SELECT DISTINCT vec_id AS i FROM embeddings), h, range({S}) t(s)) SELECT s, j, round(sum(w * v), {digits}) + 0.0 AS v FROM x JOIN w USING (i) GROUP BY s, j"

    @query(name, sql)
    def run(spark, sf_dir):
        x = vectors(spark, sf_dir)
        return matrix.to_coords(make(regression._height(x)) * x, True).select(F.col("i").alias("s"), "j", r("v", digits).alias("v"))


_columnwise("jlt_columnwise", lambda n: sketch.JLT(n, 8, 31, **P), f"{rng.sql_normal(31, '(i * 8 + s)')} / sqrt(8)", 8, 5)
_columnwise("cauchy_dense_columnwise", lambda n: sketch.CT(n, 8, 32, **P), f"{rng.sql_cauchy(32, '(i * 8 + s)')} / 8", 8, 3)
_ROW = rng.sql_integer(33, "(n + s)", "n")
_columnwise("fjlt_columnwise", lambda n: sketch.FJLT(n, 32, 33, **P), f"sqrt(n / 32.0) * {rng.sql_sign(33, 'i')} * {_MIX.format(k=_ROW, j='i', n='n')}", 32, 5)


def _features(name: str, t: sketch.Features, entry: str, form: str = "cos", tables: str = "", shift: str | None = None, digits: int = 5):
    """A feature map; entry is W[s, j] in SQL."""
    shift = shift or f"{2 * math.pi!r} * {rng.sql_uniform(t.seed, f'({4 * D * t.S} + s)')}"
    z = f"sqrt(2.0 / {t.S}) * cos(sum(v * w) + any_value(b))" if form == "cos" else f"exp(-sum(abs(v) * w)) / sqrt({t.S})"
    sql = f"WITH {X}{tables}, w AS (SELECT j, s, {entry} AS w, {shift} AS b FROM range({D}) a(j), range({t.S}) c(s)) SELECT i, s, round({z}, {digits}) + 0.0 AS z FROM x JOIN w USING (j) GROUP BY i, s"

    @query(name, sql)
    def run(spark, sf_dir):
        x = vectors(spark, sf_dir)
        x = x if form == "cos" else x.withColumn("features", F.transform("features", F.abs))
        return matrix.to_coords(t.apply(x, "rowwise"), True).select("i", F.col("j").alias("s"), r("v", digits).alias("z"))


_features("gaussian_rff", sketch.create("RRT", D, 16, seed=41, sigma=1.5, **P), f"{rng.sql_normal(41, _at(16))} / 1.5")
_features("laplacian_rff", sketch.LaplacianRFT(D, 16, 42, sigma=4.0, **P), f"{rng.sql_cauchy(42, _at(16))} / 4.0")
_features("expsemigroup_rlf", sketch.ExpSemigroupRLT(D, 16, 43, beta=0.05, **P), f"{rng.sql_levy(43, _at(16))} * {0.05**2 / 2!r}", "exp")
_features("matern_rff", sketch.MaternRFT(D, 16, 44, nu=1.5, l=1.0, **P), f"{rng.sql_normal(44, _at(16))} * sqrt(3.0 / {rng.sql_chi_square(44, 3, f'({2 * D * 16} + s * 3)')})")

# leaped Halton points: coordinate d of point s is the radical inverse of n = s * leap + 1 in the prime of d
_LEAP = rng.primes(D + 2)[-1]
_HALTON = f"""primes(d, p) AS (VALUES {', '.join(f'({d}, {p})' for d, p in enumerate(rng.primes(D + 1)))}),
halton AS (SELECT s, d, sum((CAST(floor((s * {_LEAP} + 1) / pow(p, k)) AS BIGINT) % p) / pow(p, k + 1)) AS u FROM range({{S}}) a(s), primes, range(16) b(k) WHERE pow(p, k) <= s * {_LEAP} + 1 GROUP BY s, d)"""


@query("halton_points", f"WITH {_HALTON.format(S=64)} SELECT s, CAST(d AS BIGINT) AS d, round(u, 9) AS u FROM halton")
def halton_points(spark, sf_dir):
    points = matrix.from_numpy(spark, rng.halton(np.arange(64), D + 1))
    return matrix.to_coords(points, True).select(F.col("i").alias("s"), F.col("j").alias("d"), F.round("v", 9).alias("u"))


_features("laplacian_qrff", sketch.LaplacianQRFT(D, 16, 3, sigma=4.0), f"(SELECT tan({math.pi!r} * (u - 0.5)) / 4.0 FROM halton h WHERE h.s = c.s AND h.d = a.j)", tables=f", {_HALTON.format(S=16)}", shift=f"(SELECT {2 * math.pi!r} * u FROM halton h WHERE h.s = c.s AND h.d = {D})")


def _fastfood(name: str, t: sketch.FastGaussianRFT, scale: str):
    """Blocks of scale H G P H B x, each H an orthonormal cosine transform times sqrt(N)."""
    n, blocks, s = D, t.S // D, t.seed
    sql = f"""WITH {X}, h AS (SELECT k, j, {_MIX.format(k='k', j='j', n=n)} AS h FROM range({n}) a(k), range({n}) b(j)),
g AS (SELECT b, j, {rng.sql_sign(s, f'(b * {4 * n} + j)')} AS sign, {rng.sql_normal(s, f'(b * {4 * n} + {n} + j)')} AS g, {rng.sql_word(s, f'(b * {4 * n} + {2 * n} + j)')} AS word FROM range({blocks}) c(b), range({n}) d(j)),
p AS (SELECT b, j AS taken, row_number() OVER (PARTITION BY b ORDER BY word, j) - 1 AS place FROM g),
first AS (SELECT x.i, g.b, h.k, sum(h.h * x.v * g.sign) AS y FROM x JOIN g ON g.j = x.j JOIN h ON h.j = x.j GROUP BY x.i, g.b, h.k),
middle AS (SELECT f.i, f.b, p.place, f.y * g.g AS y FROM first f JOIN p ON p.b = f.b AND p.taken = f.k JOIN g ON g.b = p.b AND g.j = p.place),
last AS (SELECT m.i, m.b * {n} + h.k AS s, sum(h.h * m.y) * {n} AS y FROM middle m JOIN h ON h.j = m.place GROUP BY m.i, m.b, h.k)
SELECT i, s, round(sqrt(2.0 / {t.S}) * cos(y * {scale} + {2 * math.pi!r} * {rng.sql_uniform(s, f'({4 * n * t.S} + s)')}), 5) + 0.0 AS z FROM last"""

    @query(name, sql)
    def run(spark, sf_dir):
        return matrix.to_coords(t.apply(vectors(spark, sf_dir), "rowwise"), True).select("i", F.col("j").alias("s"), r("v", 5).alias("z"))


_fastfood("fastfood", sketch.create("Fastfood", D, 2 * D, seed=51, sigma=1.0, **P), f"(1.0 / sqrt({D}))")
_fastfood("fast_matern", sketch.create("MaternFastfood", D, 2 * D, seed=52, nu=1.5, l=1.0, **P), f"(sqrt(3.0 / {rng.sql_chi_square(52, 3, f'({10 * D} + s * 3)')}) / sqrt({D}))")


@query("tensorsketch", f"""WITH {X}, y AS (SELECT i, CAST(j AS BIGINT) AS j, v * sqrt(0.5) AS v FROM x UNION ALL SELECT DISTINCT vec_id, {D}, sqrt(2.0) FROM embeddings),
t AS (SELECT q, i, {rng.sql_integer(53, f'(q * {2 * D + 2} + j)', 32)} AS b, v * {rng.sql_sign(53, f'(q * {2 * D + 2} + {D + 1} + j)')} AS v FROM y, range(2) a(q))
SELECT a.i, (a.b + c.b) % 32 AS s, round(sum(a.v * c.v), 5) + 0.0 AS z FROM t a JOIN t c ON a.i = c.i WHERE a.q = 0 AND c.q = 1 GROUP BY a.i, (a.b + c.b) % 32""")
def tensorsketch(spark, sf_dir):
    """Terms of (x, sqrt c) with itself, hashed by the sum of two buckets."""
    t = sketch.create("TensorSketch", D, 32, seed=53, q=2, gamma=0.5, c=2.0, **P)
    z = matrix.to_coords(t.apply(vectors(spark, sf_dir), "rowwise"), True)
    return z.select("i", F.col("j").alias("s"), r("v", 5).alias("z"))


def _quantiles(t: sketch.Sketch, value: Callable[[float], float]) -> str:
    """Frequencies by quantiles of the Halton points, which SQL lacks: from the standard library's normal distribution."""
    points = np.clip(rng.halton(np.arange(t.S), D + 1), 1e-12, 1 - 1e-12)
    rows = ", ".join(f"({s}, {j}, {value(float(points[s, j]))!r})" for s in range(t.S) for j in range(D))
    return f", {_HALTON.format(S=t.S)}, quantile(s, d, w) AS (VALUES {rows})"


_INVERSE = NormalDist().inv_cdf
_FROM_QUANTILES = {"shift": f"(SELECT {2 * math.pi!r} * u FROM halton h WHERE h.s = c.s AND h.d = {D})"}
_NORMAL, _LEVY = sketch.GaussianQRFT(D, 16, 3, sigma=2.0), sketch.ExpSemigroupQRLT(D, 16, 3, beta=0.05)
_features("gaussian_qrff", _NORMAL, "(SELECT w FROM quantile z WHERE z.s = c.s AND z.d = a.j)", tables=_quantiles(_NORMAL, lambda u: _INVERSE(u) / 2.0), **_FROM_QUANTILES)
_features("expsemigroup_qrlt", _LEVY, "(SELECT w FROM quantile z WHERE z.s = c.s AND z.d = a.j)", "exp", tables=_quantiles(_LEVY, lambda u: 0.05**2 / 2 / _INVERSE(1 - u / 2) ** 2), **_FROM_QUANTILES)


@query("countsketch_dense_rowwise", ORACLE_SQL["countsketch_rowwise"])
def countsketch_dense_rowwise(spark, sf_dir):
    """The rowwise count sketch of rows that are arrays."""
    made = sketch.create("CountSketch", D, 16, seed=7).apply(vectors(spark, sf_dir), "rowwise")
    used = spark.range(D).select(sketch.CWT(D, 16, 7).bucket(F.col("id")).alias("bucket")).distinct()
    return matrix.to_coords(made, True).select("i", F.col("j").alias("bucket"), r("v").alias("v")).join(used, "bucket").select("i", "bucket", "v")


@query("sketch_json", f"WITH {X} SELECT bucket, j, round(sum(v), 6) + 0.0 AS v FROM (SELECT {rng.sql_bucket('11h0', 'i', 24)} AS bucket, j, {rng.sql_sign('11v0', 'i')} * v AS v FROM x) GROUP BY bucket, j")
def sketch_json(spark, sf_dir):
    """A sketch that went through its JSON form."""
    t = sketch.from_json(sketch.CWT(1 << 40, 24, 11).to_json())
    return t.coords(matrix.to_coords(vectors(spark, sf_dir), True)).select(F.col("i").alias("bucket"), "j", r("v").alias("v"))


# -- sampling -----------------------------------------------------------------------------------------------


@query("uniform_sample_noreplace", f"SELECT row_number() OVER (ORDER BY w, vec_id) - 1 AS k, vec_id, label FROM (SELECT vec_id, label, {rng.sql_word(5, 'vec_id')} AS w FROM embeddings) ORDER BY w, vec_id LIMIT 100")
def uniform_sample_noreplace(spark, sf_dir):
    x = labelled(spark, sf_dir)
    drawn = sketch.URST(regression._height(x), 100, 5).drawn(x)
    return x.join(drawn, "row_id").select("k", F.col("row_id").alias("vec_id"), "label")


@query("uniform_rows", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {rng.sql_word(5, 'o_orderkey')}, o_orderkey LIMIT 100")
def uniform_rows(spark, sf_dir):
    return sketch.sample_rows(table(spark, sf_dir, "orders"), "o_orderkey", 100, 5).select("o_orderkey", "o_totalprice")


@query("weighted_sample", f"""
WITH c AS (SELECT c_custkey AS key, CAST(c_acctbal AS DOUBLE) AS w, {rng.sql_word('9b', 'c_custkey')} % 256 AS block FROM customer WHERE c_acctbal > 0),
s AS (SELECT key, w, sum(w) OVER (ORDER BY block, key) AS upto, sum(w) OVER () AS total FROM c),
d AS (SELECT n AS draw, {rng.sql_uniform('9d', 'n')} AS u FROM range(200) t(n))
SELECT draw, key FROM d JOIN s ON u > (upto - w) / total AND u <= upto / total""")
def weighted_sample(spark, sf_dir):
    return sketch.weighted_sample(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", 200, 9)


@query("uniform_sample_replace", f"WITH {X}, h AS (SELECT max(vec_id) + 1 AS n FROM embeddings), d AS (SELECT s, {rng.sql_integer(5, 's', 'n')} AS i FROM range(64) t(s), h) SELECT s, j, round(v, 5) + 0.0 AS v FROM d JOIN x USING (i)")
def uniform_sample_replace(spark, sf_dir):
    x = vectors(spark, sf_dir)
    t = sketch.UST(regression._height(x), 64, 5, **P)
    return matrix.to_coords(t.apply(x, "columnwise"), True).select(F.col("i").alias("s"), "j", r("v", 5).alias("v"))


# -- distances and kernels ------------------------------------------------------------------------------


def _pair_query(name: str, what, sql_value: str):
    sql = f"""WITH e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (SELECT a.i, {sql_value} AS v FROM e a CROSS JOIN e b)
SELECT i, round(sum(v), 4) + 0.0 AS total, round(max(v), 5) + 0.0 AS largest FROM p GROUP BY i"""

    @query(name, sql)
    def run(spark, sf_dir):
        x = vectors(spark, sf_dir)
        return kernels.row_summary(x, x, what).select("i", r("total", 4).alias("total"), r("largest", 5).alias("largest"))


_EUC = "greatest(list_dot_product(a.x, a.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(a.x, b.x), 0)"
_L1 = "list_sum(list_transform(list_zip(a.x, b.x), lambda t: abs(t[1] - t[2])))"
_EXP = "list_sum(list_transform(list_zip(a.x, b.x), lambda t: sqrt(abs(t[1] + t[2]))))"
_pair_query("dist_euclidean2", "euclidean", _EUC)
_pair_query("dist_l1", "l1", _L1)
_pair_query("dist_expsemigroup", "expsemigroup", _EXP)
_pair_query("gram_linear", kernels.Linear(D), "list_dot_product(a.x, b.x)")
_pair_query("gram_gaussian", kernels.Gaussian(D, 1.5), f"exp(-{_EUC} / 4.5)")
_pair_query("gram_polynomial", kernels.Polynomial(D, 3, 1.0, 0.5), "pow(0.5 * list_dot_product(a.x, b.x) + 1, 3)")
_pair_query("gram_laplacian", kernels.Laplacian(D, 10.0), f"exp(-{_L1} / 10)")
_pair_query("gram_expsemigroup", kernels.ExpSemigroup(D, 0.05), f"exp(-0.05 * {_EXP})")
_pair_query("gram_matern", kernels.Matern(D, 1.5, 1.0), f"(1 + sqrt({_EUC} * 3)) * exp(-sqrt({_EUC} * 3))")

# -- matrix operations ----------------------------------------------------------------------------------

A = "a AS (SELECT l_suppkey AS i, CAST(l_linenumber AS BIGINT) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL HAVING sum(l_quantity) <> 0)"
B = "b AS (SELECT l_suppkey AS i, CAST(month(l_shipdate) AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY ALL)"


def _a(spark, sf_dir) -> DataFrame:
    return matrix.coo_sum(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("long").alias("j"), F.col("l_quantity").alias("v")))


def _b(spark, sf_dir) -> DataFrame:
    return matrix.coo_sum(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.month("l_shipdate").cast("long").alias("j"), F.lit(1.0).alias("v")))


query("coo_sum", f"WITH {A} SELECT i, j, round(v, 2) AS v FROM a")(lambda s, d: _a(s, d).select("i", "j", F.round("v", 2).alias("v")))
query("sparse_transpose", f"WITH {A} SELECT j AS i, i AS j, round(v, 2) AS v FROM a")(lambda s, d: matrix.transpose(_a(s, d)).select("i", "j", F.round("v", 2).alias("v")))
query("gemm_atb", f"WITH {A}, {B} SELECT a.j AS i, b.j, round(sum(a.v * b.v), 2) AS v FROM a JOIN b USING (i) GROUP BY a.j, b.j")(lambda s, d: matrix.gemm(_a(s, d), _b(s, d), trans_a=True).select("i", "j", F.round("v", 2).alias("v")))
query("gemm_scaled", f"WITH {A}, {B}, g AS (SELECT b.j AS i, a.j, -sum(a.v * b.v) AS v FROM b JOIN a USING (i) GROUP BY ALL UNION ALL SELECT j, j, 1.5 * sum(v) FROM a GROUP BY j) SELECT i, j, round(sum(v), 2) + 0.0 AS v FROM g GROUP BY i, j")(
    lambda s, d: matrix.gemm(_b(s, d), _a(s, d), -1.0, 1.5, _a(s, d).groupBy(F.col("j").alias("i"), "j").agg(F.sum("v").alias("v")), trans_a=True).select("i", "j", r("v", 2).alias("v"))
)
query("gemv", f"WITH {A} SELECT i, round(sum(v / (1 + j)), 4) AS v FROM a GROUP BY i")(lambda s, d: matrix.gemv(_a(s, d), _a(s, d).select("j").distinct().select(F.col("j").alias("i"), (1.0 / (1 + F.col("j"))).alias("v"))).select("i", F.round("v", 4).alias("v")))
query("gemv_scaled", f"WITH {A}, t AS (SELECT i, -2.0 * v / (1 + j) AS v FROM a UNION ALL SELECT i, 0.5 * i FROM (SELECT DISTINCT i FROM a)) SELECT i, round(sum(v), 4) + 0.0 AS v FROM t GROUP BY i")(
    lambda s, d: matrix.gemv(_a(s, d), _a(s, d).select("j").distinct().select(F.col("j").alias("i"), (1.0 / (1 + F.col("j"))).alias("v")), -2.0, False, 0.5, _a(s, d).select("i", F.col("i").cast("double").alias("v")).distinct()).select("i", r("v", 4).alias("v"))
)
query("symm", f"WITH {A}, {B}, g AS (SELECT a.j AS i, b.j, sum(a.v * b.v) AS v FROM a JOIN a b USING (i) GROUP BY ALL), t AS (SELECT * FROM g WHERE i >= j UNION ALL SELECT j, i, v FROM g WHERE i > j) SELECT t.i, round(sum(t.v * t.j), 2) AS v FROM t GROUP BY t.i")(
    lambda s, d: matrix.symm(matrix.gemm(_a(s, d), _a(s, d), trans_a=True), _a(s, d).select("j").distinct().select(F.col("j").alias("i"), F.lit(0).cast("long").alias("j"), F.col("j").cast("double").alias("v"))).select("i", F.round("v", 2).alias("v"))
)
query("column_norms", f"WITH {A} SELECT j, round(sqrt(sum(v * v)), 4) AS norm FROM a GROUP BY j")(lambda s, d: matrix.column_norms(_a(s, d)).select("j", F.round("norm", 4).alias("norm")))
query("column_dots", f"WITH {A}, {B} SELECT a.j, round(sum(a.v * b.v), 2) AS dot FROM a JOIN b USING (i, j) GROUP BY a.j")(lambda s, d: matrix.column_dots(_a(s, d), _b(s, d)).select("j", F.round("dot", 2).alias("dot")))
query("row_dots", f"WITH {A}, {B} SELECT a.i, round(sum(a.v * b.v), 2) AS dot FROM a JOIN b USING (i, j) GROUP BY a.i")(lambda s, d: matrix.row_dots(_a(s, d), _b(s, d)).select("i", F.round("dot", 2).alias("dot")))
query("axpy", f"WITH {A}, {B}, u AS (SELECT i, j, 2.5 * v AS v FROM a UNION ALL SELECT * FROM b) SELECT i, j, round(sum(v), 2) AS v FROM u GROUP BY i, j")(lambda s, d: matrix.axpy(2.5, _a(s, d), _b(s, d)).select("i", "j", F.round("v", 2).alias("v")))
query("axpy_columns", f"WITH {A}, {B}, u AS (SELECT i, j, j * v AS v FROM a UNION ALL SELECT * FROM b) SELECT i, j, round(sum(v), 2) AS v FROM u GROUP BY i, j")(lambda s, d: matrix.axpy(F.col("j").cast("double"), _a(s, d), _b(s, d)).select("i", "j", F.round("v", 2).alias("v")))
query("hadamard", f"WITH {A}, {B} SELECT i, j, round(a.v * b.v, 2) AS v FROM a JOIN b USING (i, j)")(lambda s, d: matrix.hadamard(_a(s, d), _b(s, d)).select("i", "j", F.round("v", 2).alias("v")))
query("symmetric_map", f"WITH {A} SELECT i, j, round(CASE WHEN i <= j THEN sqrt(v) ELSE v END, 4) AS v FROM a")(lambda s, d: matrix.symmetric_map(_a(s, d), F.sqrt).select("i", "j", F.round("v", 4).alias("v")))


@query("gemm_ata", f"WITH {X} SELECT CAST(a.j AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM x a JOIN x b USING (i) GROUP BY a.j, b.j")
def gemm_ata(spark, sf_dir):
    g = matrix.gram(vectors(spark, sf_dir))
    return matrix.to_coords(matrix.from_numpy(spark, g), True).select("i", "j", r("v", 5).alias("v"))


@query("tsqr", f"WITH {X} SELECT 'QR' AS what, i, j, round(v, 6) + 0.0 AS v FROM x UNION ALL SELECT 'Q''Q', a, b, CASE WHEN a = b THEN 1.0 ELSE 0.0 END FROM range({D}) t(a), range({D}) u(b)")
def tsqr(spark, sf_dir):
    """Q R is A, and Q'Q the identity."""
    q, t = matrix.tsqr(vectors(spark, sf_dir))
    back, square = matrix.times(q, t), matrix.from_numpy(spark, matrix.gram(q.select("features")))
    return matrix.to_coords(back, True).withColumn("what", F.lit("QR")).unionByName(matrix.to_coords(square, True).withColumn("what", F.lit("Q'Q"))).select("what", "i", "j", r("v", 6).alias("v"))


# -- least squares -----------------------------------------------------------------------------------------

OLS = """WITH o AS (SELECT o_totalprice / 1000 AS y, o_custkey / 100.0 AS x1, CAST(month(o_orderdate) AS DOUBLE) AS x2 FROM orders),
m AS (SELECT avg(y) my, avg(x1) m1, avg(x2) m2, var_pop(x1) v1, var_pop(x2) v2, covar_pop(x1, x2) c12, covar_pop(x1, y) c1y, covar_pop(x2, y) c2y FROM o),
b AS (SELECT *, (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) AS b1, (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) AS b2 FROM m)
SELECT CAST(0 AS BIGINT) AS place, round(my - b1 * m1 - b2 * m2, 4) + 0.0 AS coefficient FROM b
UNION ALL SELECT 1, round(b1, 4) + 0.0 FROM b UNION ALL SELECT 2, round(b2, 4) + 0.0 FROM b"""


def _orders(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), F.array(F.lit(1.0), F.col("o_custkey") / 100.0, F.month("o_orderdate").cast("double")).alias("features"), (F.col("o_totalprice") / 1000).alias("y"))


def _coefficients(spark: SparkSession, x: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x[:, 0])], "place long, coefficient double").select("place", r("coefficient", 4).alias("coefficient"))


for _method in ("normal", "semi_normal", "qr", "svd", "lsqr", "blendenpik", "lsrn"):
    query(f"ols_{_method}", OLS)(lambda s, d, m=_method: _coefficients(s, regression.solve(regression.Problem(_orders(s, d), "y"), m)))


@query("ols_chebyshev", OLS)
def ols_chebyshev(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    some = matrix.gram(rows.where("row_id % 4 = 0").select("features")) * 4  # of a quarter of the rows: near, not exact
    scale = np.linalg.inv(np.linalg.cholesky(some)).T
    spread = np.sqrt(np.linalg.eigvalsh(scale.T @ matrix.gram(rows.select("features")) @ scale))
    return _coefficients(spark, krylov.chebyshev_ls(rows, "y", 0.99 * spread[0], 1.01 * spread[-1], 1e-12, scale).x)


@query("ols_cg", OLS)
def ols_cg(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    b = matrix.gram(rows, "y")
    scale = np.diag(1 / np.diag(matrix.gram(rows.select("features"))))
    return _coefficients(spark, krylov.cg(krylov.NormalOperator(rows), b, krylov.Params(1e-13, 60), krylov.dense_preconditioner(scale)).x)


@query("ols_flexible_cg", OLS)
def ols_flexible_cg(spark, sf_dir):
    """Products are passes over the rows; the preconditioner is that of a sketch, and changes with every step."""
    rows = _orders(spark, sf_dir)
    b = matrix.gram(rows.select("features", "y"), "y")
    near = matrix.gram(rows.where("row_id % 4 = 0").select("features")) * 4
    sweep = lambda v: krylov.block_gauss_seidel(near, v, 3, int(abs(v).sum()) % 97, 0.0).x
    return _coefficients(spark, krylov.flexible_cg(krylov.NormalOperator(rows), b, krylov.Params(1e-13, 60), sweep).x)


@query("ols_async_cg", OLS)
def ols_async_cg(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    g, b = matrix.gram(rows.select("features")), matrix.gram(rows.select("features", "y"), "y")
    return _coefficients(spark, krylov.async_fcg(g, b, krylov.Params(1e-14, 200)).x)


@query("ols_gauss_seidel", OLS)
def ols_gauss_seidel(spark, sf_dir):
    """Coordinate steps on the normal equations, columns scaled to unit length."""
    rows = _orders(spark, sf_dir)
    g, b = matrix.gram(rows.select("features")), matrix.gram(rows.select("features", "y"), "y")
    scale = 1 / np.sqrt(np.diag(g))
    return _coefficients(spark, scale[:, None] * krylov.block_gauss_seidel(g * scale * scale[:, None], scale[:, None] * b, 5000, 3, 1e-13).x)


query("ols_blendenpik_mixed", OLS)(lambda s, d: _coefficients(s, regression.blendenpik(_orders(s, d), "y", "FJLT")))
query("faster_least_squares", OLS)(lambda s, d: _coefficients(s, regression.faster_least_squares(_orders(s, d), "y")))

# a, b, c: the columns of three unknowns in a table of sketched rows (a0, a1, a2, y); by Cramer's rule
_SOLVE = """m AS (SELECT sum(a0 * a0) a, sum(a0 * a1) b, sum(a0 * a2) c, sum(a1 * a1) d, sum(a1 * a2) e, sum(a2 * a2) f, sum(a0 * y) p, sum(a1 * y) q, sum(a2 * y) s FROM sketched),
o AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM m)
SELECT CAST(0 AS BIGINT) AS place, round((p * (d * f - e * e) - b * (q * f - e * s) + c * (q * e - d * s)) / det, 3) + 0.0 AS coefficient FROM o
UNION ALL SELECT 1, round((a * (q * f - e * s) - p * (b * f - c * e) + c * (b * s - c * q)) / det, 3) + 0.0 FROM o
UNION ALL SELECT 2, round((a * (d * s - e * q) - b * (b * s - c * q) + p * (b * e - c * d)) / det, 3) + 0.0 FROM o"""
_RAW = "raw AS (SELECT o_orderkey AS i, 1.0 AS a0, o_custkey / 100.0 AS a1, CAST(month(o_orderdate) AS DOUBLE) AS a2, o_totalprice / 1000 AS y FROM orders)"


def _rough(spark: SparkSession, x: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x[:, 0])], "place long, coefficient double").select("place", r("coefficient", 3).alias("coefficient"))


@query("sketch_and_solve", f"WITH {_RAW}, sketched AS (SELECT sum(s * a0) a0, sum(s * a1) a1, sum(s * a2) a2, sum(s * y) y FROM (SELECT *, {rng.sql_bucket('3h0', 'i', 400)} AS bucket, {rng.sql_sign('3v0', 'i')} AS s FROM raw) GROUP BY bucket), {_SOLVE}")
def sketch_and_solve(spark, sf_dir):
    return _rough(spark, regression.sketch_and_solve(_orders(spark, sf_dir), "y", 400, "CWT", 3))


@query("approximate_least_squares", f"WITH {_RAW}, h AS (SELECT max(i) + 1 AS n FROM raw), k AS (SELECT s, {rng.sql_integer(3, '(n + s)', 'n')} AS k, n FROM range(12) t(s), h), sketched AS (SELECT sum(w * a0) a0, sum(w * a1) a1, sum(w * a2) a2, sum(w * y) y FROM (SELECT raw.*, k.s AS row, {rng.sql_sign(3, 'i')} * {_MIX.format(k='k.k', j='i', n='k.n')} AS w FROM raw, k) GROUP BY row), {_SOLVE}")
def approximate_least_squares(spark, sf_dir):
    """A mixed and sampled sketch of four rows for each feature."""
    return _rough(spark, regression.approximate_least_squares(_orders(spark, sf_dir), "y", 3, stream="portable"))


_BACK = f"WITH {X} SELECT i, j, round(v, 4) + 0.0 AS v FROM x"
_SQUARE = f"WITH {X} SELECT CAST(a.j AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, round(sum(a.v * b.v), 3) + 0.0 AS v FROM x a JOIN x b USING (i) GROUP BY a.j, b.j"


@query("approximate_svd", _BACK)
def approximate_svd(spark, sf_dir):
    """U S V' at full rank is A again."""
    u, s, v = svd.approximate_svd(vectors(spark, sf_dir), D, svd.SVDParams(num_iterations=1))
    return matrix.to_coords(matrix.times(u, (v * s).T), True).select("i", "j", r("v", 4).alias("v"))


@query("approximate_svd_wide", f"WITH {X} SELECT i, j, round(v, 4) + 0.0 AS v FROM x WHERE i < 40")
def approximate_svd_wide(spark, sf_dir):
    """A matrix with fewer rows (40) than columns."""
    u, s, v = svd.approximate_svd(vectors(spark, sf_dir).where("row_id < 40"), 40, svd.SVDParams(num_iterations=1))
    return matrix.to_coords(matrix.times(u, (v * s).T), True).select("i", "j", r("v", 4).alias("v"))


def _square(spark, sf_dir) -> DataFrame:
    return matrix.to_coords(matrix.from_numpy(spark, matrix.gram(vectors(spark, sf_dir))), True)


@query("symmetric_svd", _SQUARE)
def symmetric_svd(spark, sf_dir):
    """V L V' at full rank is the matrix again."""
    v, values = svd.approximate_symmetric_svd(_square(spark, sf_dir), D, D, svd.SVDParams(num_iterations=1))
    return matrix.to_coords(matrix.from_numpy(spark, v * values @ v.T), True).select("i", "j", r("v", 3).alias("v"))


@query("svd_energy", f"WITH {X} SELECT CAST({D} AS INT) AS rank, round(sum(v * v), 4) AS energy FROM x")
def svd_energy(spark, sf_dir):
    """At full rank the squares of the singular values sum to those of the entries."""
    _, s, _ = svd.approximate_svd(vectors(spark, sf_dir), D, svd.SVDParams(num_iterations=1))
    return spark.createDataFrame([(D, float((s**2).sum()))], "rank int, energy double").select("rank", F.round("energy", 4).alias("energy"))


_POWER = f"""WITH {X}, v0 AS (SELECT CAST(j AS BIGINT) AS j, 1.0 / (1 + j) AS y FROM range({D}) t(j)),
u1 AS (SELECT i, sum(v * y) AS y FROM x JOIN v0 USING (j) GROUP BY i), v1 AS (SELECT j, sum(v * y) AS y FROM x JOIN u1 USING (i) GROUP BY j),
u2 AS (SELECT i, sum(v * y) AS y FROM x JOIN v1 USING (j) GROUP BY i), v2 AS (SELECT j, sum(v * y) AS y FROM x JOIN u2 USING (i) GROUP BY j),
u3 AS (SELECT i, sum(v * y) AS y FROM x JOIN v2 USING (j) GROUP BY i)
"""


@query("power_iteration", f"{_POWER} SELECT CAST(j AS BIGINT) AS place, round(y, 2) AS y FROM v2")
def power_iteration(spark, sf_dir):
    v = svd.power_iteration(vectors(spark, sf_dir), 1.0 / (1 + np.arange(D))[:, None], 2, False)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v[:, 0])], "place long, y double").select("place", F.round("y", 2).alias("y"))


@query("power_iteration_left", f"{_POWER} SELECT i, round(y, 2) AS y FROM u3")
def power_iteration_left(spark, sf_dir):
    """From the left to the left: A (A'A) A'u with u = A v."""
    x = vectors(spark, sf_dir)
    start = matrix.times(x, 1.0 / (1 + np.arange(D))[:, None]).select("row_id", F.col("features").alias("u"))
    y = svd.power_iteration(x.join(start, "row_id"), "u", 1, False, "left", "left")
    return y.select(F.col("row_id").alias("i"), F.round(F.col("features")[0], 2).alias("y"))


@query("symmetric_power", f"WITH {X}, g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM x a JOIN x b USING (i) GROUP BY ALL), u AS (SELECT i, sum(v / (1 + j)) AS y FROM g GROUP BY i) SELECT CAST(g.i AS BIGINT) AS place, round(sum(g.v * u.y), 2) AS y FROM g JOIN u ON g.j = u.i GROUP BY g.i")
def symmetric_power(spark, sf_dir):
    product = svd.symmetric_product(_square(spark, sf_dir), D)
    v = product(product(1.0 / (1 + np.arange(D))[:, None]))
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v[:, 0])], "place long, y double").select("place", F.round("y", 2).alias("y"))


@query("condest", """WITH m AS (SELECT sum(a * a) p, sum(a * b) q, sum(b * b) s FROM (SELECT 1.0 AS a, l_quantity / 10 AS b FROM lineitem)),
e AS (SELECT (p + s) / 2 + sqrt((p - s) * (p - s) / 4 + q * q) AS high, (p + s) / 2 - sqrt((p - s) * (p - s) / 4 + q * q) AS low FROM m)
SELECT round(sqrt(high), 0) AS sigma_max, round(sqrt(low), 0) AS sigma_min, round(sqrt(high / low), 1) AS cond FROM e""")
def condest(spark, sf_dir):
    """Two columns, whose singular values SQL can tell."""
    rows = table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("row_id"), F.array(F.lit(1.0), F.col("l_quantity") / 10).alias("features"))
    c = svd.condest(rows)
    return spark.createDataFrame([(float(c.sigma_max), float(c.sigma_min), float(c.cond))], "sigma_max double, sigma_min double, cond double").select(F.round("sigma_max", 0).alias("sigma_max"), F.round("sigma_min", 0).alias("sigma_min"), F.round("cond", 1).alias("cond"))


@query("chebyshev_matrix", f"""WITH p AS (SELECT i, cos({math.pi!r} * i / 11) AS x, CASE WHEN i IN (0, 11) THEN 2.0 ELSE 1.0 END * CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END AS c FROM range(12) t(i)),
d AS (SELECT a.i, b.i AS j, a.c / b.c / (a.x - b.x) * 2 / 5 AS v FROM p a JOIN p b ON a.i <> b.i)
SELECT i, j, round(v, 6) + 0.0 AS v FROM d UNION ALL SELECT i, i, round(-sum(v), 6) + 0.0 FROM d GROUP BY i""")
def chebyshev_matrix(spark, sf_dir):
    """The differentiation matrix on 12 Chebyshev points of [0, 5]."""
    return matrix.to_coords(matrix.from_numpy(spark, svd.chebyshev_diff(12, 0.0, 5.0)), True).select("i", "j", r("v").alias("v"))


# -- losses, regularizers, coding -----------------------------------------------------------------------

Q = "q AS (SELECT doc_id, (n_chars % 7 - 3) / 2.0 AS o, CASE WHEN quality = 1 THEN 1.0 ELSE -1.0 END AS t FROM labels JOIN documents USING (doc_id))"


def _outputs(spark, sf_dir) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select("doc_id", ((F.col("n_chars") % 7 - 3) / 2.0).alias("o"), F.when(F.col("quality") == 1, 1.0).otherwise(-1.0).alias("t"))


for _name, _sql in {"squared": "0.5 * (o - t) * (o - t)", "lad": "abs(o - t)", "hinge": "greatest(0, 1 - o * t)", "logistic": "ln(1 + exp(-o * t))"}.items():
    query(f"loss_{_name}", f"WITH {Q} SELECT count(*) AS n, round(sum({_sql}), 4) AS loss FROM q")(lambda s, d, m=_name: _outputs(s, d).agg(F.count("*").alias("n"), F.round(F.sum(losses.LOSSES[m]().column(F.col("o"), F.col("t"))), 4).alias("loss")))

for _name, _sql in {"squared": "(o + 0.7 * t) / 1.7", "lad": "t + sign(o - t) * greatest(abs(o - t) - 0.7, 0)", "hinge": "CASE WHEN o * t > 1 THEN o WHEN o * t < 0.3 THEN o + 0.7 * t ELSE t END", "logistic": None}.items():

    def _prox(spark, sf_dir, m=_name):
        rows = _outputs(spark, sf_dir).select(F.col("doc_id").alias("row_id"), F.array("o").alias("features"), "t")
        made = matrix.map_rows(rows, lambda x, t: losses.LOSSES[m]().prox(x, 0.7, t), "t")
        return made.select(F.col("row_id").alias("doc_id"), r(F.col("features")[0], 5).alias("prox"))

    _newton = f"""WITH RECURSIVE {Q}, n(k, doc_id, x, t, o) AS (SELECT 0, doc_id, o, t, o FROM q
UNION ALL SELECT k + 1, doc_id, x, t, o - (-t / (1 + exp(o * t)) + (o - x) / 0.7) / ((1 / (1 + exp(o * t))) * (1 - 1 / (1 + exp(o * t))) + 1 / 0.7) FROM n WHERE k < 40)
SELECT doc_id, round(o, 5) + 0.0 AS prox FROM n WHERE k = 40"""
    query(f"prox_{_name}", f"WITH {Q} SELECT doc_id, round({_sql}, 5) + 0.0 AS prox FROM q" if _sql else _newton)(_prox)

for _name, _value, _sql in (("l1", "sum(abs(v))", "sign(v) * greatest(abs(v) - 0.05, 0)"), ("l2", "0.5 * sum(v * v)", "v / 1.05")):

    def _reg(spark, sf_dir, m=_name):
        g = losses.REGULARIZERS[m]()
        both = matrix.map_rows(vectors(spark, sf_dir), lambda w: np.array([[g.evaluate(x[None]), g.prox(x, 0.05, np.zeros_like(x)).sum()] for x in w]))
        return both.select("row_id", r(F.col("features")[0], 5).alias("value"), r(F.col("features")[1], 5).alias("prox_sum"))

    query(f"reg_{_name}", f"WITH {X} SELECT i AS row_id, round({_value}, 5) + 0.0 AS value, round(sum({_sql}), 5) + 0.0 AS prox_sum FROM x GROUP BY i")(_reg)


@query("dummy_coding", "WITH o AS (SELECT label, row_number() OVER (ORDER BY min(vec_id)) - 1 AS k FROM embeddings GROUP BY label) SELECT vec_id, o.k, CASE WHEN e.label = o.label THEN 1.0 ELSE -1.0 END AS v FROM embeddings e CROSS JOIN o")
def dummy_coding(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    labels = coding.label_order(e, "label", "vec_id")
    return e.select("vec_id", F.posexplode(coding.dummy_coding("label", labels)).alias("k", "v")).select("vec_id", F.col("k").cast("long").alias("k"), "v")


@query("dummy_decode", "WITH e AS (SELECT vec_id, list_slice(embedding, 1, 10) AS s FROM embeddings) SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS INT) AS label FROM e")
def dummy_decode(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 10).alias("s"))
    return e.select("vec_id", coding.dummy_decode("s", list(range(10))).alias("label"))


@query("num_targets", "SELECT CAST(CASE WHEN min(label) = -1 THEN 1 ELSE max(label) + 1 END AS INT) AS targets FROM embeddings")
def num_targets(spark, sf_dir):
    return spark.createDataFrame([(coding.num_targets(table(spark, sf_dir, "embeddings"), "label"),)], "targets int")


query("accuracy", f"WITH {Q} SELECT count(*) AS n, round(100.0 * avg(CASE WHEN sign(o) = t THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM q")(lambda s, d: coding.accuracy(_outputs(s, d).withColumn("p", F.signum("o")), "p", "t").select("n", F.round("accuracy", 6).alias("accuracy")))
query("relative_error", f"WITH {Q} SELECT count(*) AS n, round(sqrt(sum((o - t) * (o - t)) / sum(t * t)), 6) AS relative_error FROM q")(lambda s, d: coding.relative_error(_outputs(s, d), "o", "t").select("n", F.round("relative_error", 6).alias("relative_error")))

# -- sources, graphs, streams ---------------------------------------------------------------------------


@query("libsvm_lines", "SELECT p_partkey AS row_id, CAST(p_partkey % 5 AS VARCHAR) || ' 1:' || CAST(CAST(p_size AS DOUBLE) AS VARCHAR) || CASE WHEN p_partkey % 3 <> 0 THEN ' 2:' || CAST(CAST(p_partkey % 3 AS DOUBLE) AS VARCHAR) ELSE '' END || ' 3:0.5' AS value FROM part WHERE p_size <> 0")
def libsvm_lines(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_size <> 0")
    rows = p.select(F.col("p_partkey").alias("row_id"), (F.col("p_partkey") % 5).alias("y"), F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 3).cast("double"), F.lit(0.5)).alias("features"))
    return text_formats.libsvm_lines(rows, "y")


@query("arc_list_symmetrized", "WITH l AS (SELECT l_partkey % 97 AS i, l_suppkey AS j, l_quantity AS v FROM lineitem), h AS (SELECT i, j, v / 2 AS v FROM l UNION ALL SELECT j, i, v / 2 FROM l) SELECT i, j, round(sum(v), 2) AS v FROM h GROUP BY i, j")
def arc_list_symmetrized(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("\t", F.col("l_partkey") % 97, "l_suppkey", "l_quantity").alias("value"))
    return text_formats.read_arc_list(spark, lines, True).select("i", "j", F.round("v", 2).alias("v"))


G = """e0 AS (SELECT l_suppkey AS a, l_partkey % 211 AS b FROM lineitem),
e AS (SELECT a AS src, b AS dst FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b)"""


def _graph(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws(" ", "l_suppkey", F.col("l_partkey") % 211).alias("value"))
    return written(text_formats.read_graph(spark, lines, numeric=True), "graph")


query("simple_graph", f"WITH {G} SELECT src, dst FROM e")(_graph)
query("degrees", f"WITH {G} SELECT src AS vertex, count(*) AS degree FROM e GROUP BY src")(lambda s, d: graph.degrees(_graph(s, d)))


@query("sweep_cut", f"""WITH {G}, d AS (SELECT src AS vertex, count(*) AS degree FROM e GROUP BY src),
k AS (SELECT vertex, degree, row_number() OVER (ORDER BY (1.0 / (1 + vertex)) / degree DESC, vertex) AS position FROM d),
i AS (SELECT k.vertex, count(o.position) AS inside FROM k JOIN e ON e.src = k.vertex JOIN k o ON o.vertex = e.dst AND o.position < k.position GROUP BY k.vertex),
s AS (SELECT position, k.vertex, CAST(sum(degree) OVER (ORDER BY position) AS BIGINT) AS volume, CAST(sum(degree - 2 * coalesce(inside, 0)) OVER (ORDER BY position) AS BIGINT) AS cut FROM k LEFT JOIN i ON k.vertex = i.vertex),
t AS (SELECT CAST(count(*) AS BIGINT) AS total FROM e)
SELECT CAST(position AS INT) AS position, vertex, volume, cut, round(CASE WHEN least(volume, total - volume) > 0 THEN cut / least(volume, total - volume) ELSE 1.0 END, 6) AS conductance FROM s CROSS JOIN t""")
def sweep_cut(spark, sf_dir):
    e = _graph(spark, sf_dir)
    y = graph.degrees(e).select("vertex", (1.0 / (1 + F.col("vertex"))).alias("y"))
    return graph.sweep(e, y).withColumn("conductance", F.round("conductance", 6))


# the diffusion u' = -(1 - alpha P) u from one seed, at time 5, by its series
_DIFFUSION = f"""WITH RECURSIVE {G}, d AS (SELECT src AS vertex, count(*) AS degree FROM e GROUP BY src),
step AS (SELECT e.src, e.dst, 0.85 / degree AS w FROM e JOIN d ON d.vertex = e.src),
terms(k, vertex, y) AS (SELECT 0, CAST(1 AS BIGINT), CAST(1.0 AS DOUBLE) UNION ALL SELECT k + 1, dst, sum(y * w * 5.0 / (k + 1)) FROM terms JOIN step ON src = vertex WHERE k < 40 GROUP BY k, dst),
u AS (SELECT vertex, exp(-5.0) * sum(y) AS y FROM terms GROUP BY vertex)"""


@query("time_dependent_ppr", f"{_DIFFUSION} SELECT vertex, round(y, 4) + 0.0 AS y FROM u WHERE abs(y) >= 0.00005")
def time_dependent_ppr(spark, sf_dir):
    y = graph.time_dependent_ppr(_graph(spark, sf_dir), {1: 1.0}, graph.PPRParams(epsilon=1e-7)).select("vertex", r(F.col("y")[0], 4).alias("y"))
    return y.where("y <> 0")


@query("adjacency_spectrum", f"WITH {G} SELECT src, dst, 1.0 AS v FROM e")
def adjacency_spectrum(spark, sf_dir):
    """V L V' of all eigenpairs (those of eigenvalue 0 add nothing) is the adjacency matrix again: the product is made by pairs of tiles of
    V's rows, which keep what does not round to 0."""
    edges = _graph(spark, sf_dir)
    index = written(graph.vertex_index(edges), "vertex-index")
    v, values = svd.symmetric_eigenpairs(graph.adjacency(edges, index)[0], index.count())
    triangle = pairs.values(v, None, lambda x, y: (x * values) @ y.T, keep=lambda x: np.abs(x) > 4e-4)
    back = matrix.mirror(triangle).select("i", "j", F.round("v", 3).alias("v")).where("v <> 0")
    names = index.select(F.col("id").alias("i"), F.col("vertex").alias("src"))
    return back.join(names, "i").join(names.toDF("j", "dst"), "j").select("src", "dst", "v")


@query("spectral_embedding")
def spectral_embedding(spark, sf_dir):
    x, _ = graph.spectral_embedding(_graph(spark, sf_dir), 4, 10, absolute=True)
    return x.select("vertex", F.posexplode("x").alias("place", "x")).select("vertex", "place", r("x", 3).alias("x"))


_LOCAL = graph.PPRParams(epsilon=1e-8)
_N = graph.collocation_size(_LOCAL)
_TIMES = ", ".join(f"({k}, {float(svd.chebyshev_points(_N, 0.0, _LOCAL.gamma)[k * _N // _LOCAL.times])!r})" for k in range(_LOCAL.times))


@query("local_cluster", f"""WITH RECURSIVE {G}, d AS (SELECT src AS vertex, count(*) AS degree FROM e GROUP BY src),
step AS (SELECT e.src, e.dst, 0.85 / degree AS w FROM e JOIN d ON d.vertex = e.src), times(t, time) AS (VALUES {_TIMES}),
terms(k, vertex, p) AS (SELECT 0, CAST(1 AS BIGINT), CAST(1.0 AS DOUBLE) UNION ALL SELECT k + 1, dst, sum(p * w) FROM terms JOIN step ON src = vertex WHERE k < 45 GROUP BY k, dst),
u AS (SELECT t, vertex, sum(p * exp(-time) * pow(time, k) / gamma(k + 1)) AS y FROM terms, times GROUP BY t, vertex),
k AS (SELECT t, u.vertex, degree, row_number() OVER (PARTITION BY t ORDER BY y / degree DESC, u.vertex) AS position FROM u JOIN d ON d.vertex = u.vertex),
i AS (SELECT k.t, k.vertex, count(*) AS inside FROM k JOIN e ON e.src = k.vertex JOIN k o ON o.t = k.t AND o.vertex = e.dst AND o.position < k.position GROUP BY k.t, k.vertex),
s AS (SELECT k.t, position, k.vertex, sum(degree) OVER w AS volume, sum(degree - 2 * coalesce(inside, 0)) OVER w AS cut FROM k LEFT JOIN i ON i.t = k.t AND i.vertex = k.vertex WINDOW w AS (PARTITION BY k.t ORDER BY position)),
c AS (SELECT t, position, vertex, CASE WHEN least(volume, total - volume) > 0 THEN cut / least(volume, total - volume) ELSE 1.0 END AS conductance FROM s, (SELECT count(*) AS total FROM e)),
best AS (SELECT t, position, conductance FROM c ORDER BY round(conductance, 9), t, position LIMIT 1)
SELECT c.vertex, round(best.conductance, 6) AS conductance FROM c JOIN best ON c.t = best.t AND c.position <= best.position""")
def local_cluster(spark, sf_dir):
    """The best sweep cut over the diffusion's times from one seed: its vertices and conductance."""
    cluster, conductance = graph.local_cluster(_graph(spark, sf_dir), [1], _LOCAL)
    return spark.createDataFrame([(v, round(conductance, 6)) for v in cluster], "vertex long, conductance double")


@query("stream_count_sketch", f"SELECT {rng.sql_bucket('13h0', 'user_id', 32)} AS bucket, round(sum({rng.sql_sign('13v0', 'user_id')} * value), 3) + 0.0 AS v FROM events GROUP BY bucket")
def stream_count_sketch(spark, sf_dir):
    """events as a stream of one batch, sketched incrementally into a table in memory."""
    sums = scoring.sketch_stream(_stream(spark, sf_dir, "events"), sketch.CWT(1 << 40, 32, 13), "user_id", "value")
    scoring.to_memory(sums, "basaltry_count_sketch", "complete")
    return spark.table("basaltry_count_sketch").select("bucket", r("v", 3).alias("v"))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.parquet(path) if _is_dir(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


# Threefry2x64-13 under key (3, 0) in whole numbers of any length
_THREEFRY = f"""WITH RECURSIVE keys AS (SELECT CAST(3 AS HUGEINT) AS k0, CAST(0 AS HUGEINT) AS k1, CAST({3 ^ rng.PARITY} AS HUGEINT) AS k2),
rounds(i, r, x0, x1) AS (SELECT i, 0, CAST(i + 3 AS HUGEINT), CAST(0 AS HUGEINT) FROM range({{n}}) t(i)
UNION ALL SELECT i, r + 1,
  (a + CASE WHEN r % 4 <> 3 THEN 0 ELSE CASE ((r + 1) // 4) % 3 WHEN 0 THEN k0 WHEN 1 THEN k1 ELSE k2 END END) % 18446744073709551616,
  (b + CASE WHEN r % 4 <> 3 THEN 0 ELSE CASE ((r + 1) // 4 + 1) % 3 WHEN 0 THEN k0 WHEN 1 THEN k1 ELSE k2 END + (r + 1) // 4 END) % 18446744073709551616
  FROM (SELECT i, r, a, xor((x1 * p) % 18446744073709551616 + x1 // (18446744073709551616 // p), a) AS b
        FROM (SELECT i, r, x1, (x0 + x1) % 18446744073709551616 AS a, CAST(pow(2, list_extract({list(rng.ROTATIONS)}, r % 8 + 1)) AS HUGEINT) AS p FROM rounds WHERE r < 13)), keys),
words AS (SELECT i, x0 FROM rounds WHERE r = 13)"""


@query("threefry_words", f"{_THREEFRY.format(n=512)} SELECT i, CAST(x0 AS VARCHAR) AS word FROM words")
def threefry_words(spark, sf_dir):
    made = rng.Context(3).words(0, np.arange(512))
    return spark.createDataFrame([(i, str(w)) for i, w in enumerate(made.tolist())], "i long, word string")


@query("random_matrix", f"{_THREEFRY.format(n=800)} SELECT i % 100 AS i, i // 100 AS j, round((x0 // 2048 + 0.5) / 9007199254740992.0, 9) AS v FROM words")
def random_matrix(spark, sf_dir):
    x = text_formats.random_matrix(spark, 100, 8, "uniform", 3)
    return matrix.to_coords(x, True).select("i", "j", F.round("v", 9).alias("v"))


from . import catalog_learning, catalog_scale, catalog_sources  # noqa: E402, F401  (they register their queries)
