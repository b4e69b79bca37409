"""Registered queries of the sources, sinks and small matrix helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matrix, regression
from ..sources import text_formats
from ..sources.tables import fresh_path
from .catalog import D, X, query, r, table, vectors

_PARTS = """p AS (SELECT p_partkey AS key, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 3 AS DOUBLE) AS b FROM part WHERE p_size <> 0),
m AS (SELECT key, 0 AS j, a AS v FROM p UNION ALL SELECT key, 1, b FROM p UNION ALL SELECT key, 2, 0.5 FROM p)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_size <> 0")
    return p.select(F.col("p_partkey").alias("row_id"), F.col("p_partkey").cast("double").alias("y"), F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 3).cast("double"), F.lit(0.5)).alias("features"))


def _text(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "libsvm")
    text_formats.write_libsvm(_parts(spark, sf_dir).repartition(4), "y", path)
    return path


def _cells(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("labels")[0].cast("long").alias("key"), F.posexplode("features").alias("j", "v"))


@query("libsvm_dense", f"WITH {_PARTS} SELECT key, CAST(j AS INT) AS j, v FROM m")
def libsvm_dense(spark, sf_dir):
    """A folder of LIBSVM text, written and read as dense rows."""
    return _cells(text_formats.read(spark, _text(spark, sf_dir), "libsvm_dense"))


@query("libsvm_sparse", f"WITH {_PARTS} SELECT key, CAST(j AS BIGINT) AS j, v FROM m WHERE v <> 0")
def libsvm_sparse(spark, sf_dir):
    """The same as coordinates."""
    rows = text_formats.read(spark, _text(spark, sf_dir), "libsvm_sparse", min_d=8)
    keys = rows.select(F.col("row_id").alias("i"), F.col("labels")[0].cast("long").alias("key"))
    return text_formats.libsvm_coords(rows).join(keys, "i").select("key", "j", "v")


@query("libsvm_numbered", f"WITH {_PARTS} SELECT key, row_number() OVER (ORDER BY key) - 1 AS place FROM p ORDER BY key LIMIT 50")
def libsvm_numbered(spark, sf_dir):
    """Rows are numbered in the order of the file, and the first 50 are read."""
    path = fresh_path(spark, "libsvm")
    text_formats.libsvm_lines(_parts(spark, sf_dir), "y").orderBy("row_id").select("value").write.text(path)
    rows = text_formats.read_libsvm(spark, path, max_n=50)
    return rows.select(F.col("labels")[0].cast("long").alias("key"), F.col("row_id").alias("place"))


@query("convert_libsvm", f"WITH {_PARTS} SELECT key, CAST(j AS INT) AS j, v FROM m")
def convert_libsvm(spark, sf_dir):
    """LIBSVM to the Parquet form and back."""
    path = fresh_path(spark, "converted")
    text_formats.convert_libsvm(spark, _text(spark, sf_dir), path)
    return _cells(text_formats.read(spark, path, "parquet_dense"))


@query("convert_libsvm_sparse", f"WITH {_PARTS} SELECT key, CAST(j AS BIGINT) AS j, v FROM m WHERE v <> 0")
def convert_libsvm_sparse(spark, sf_dir):
    path = fresh_path(spark, "converted")
    text_formats.convert_libsvm(spark, _text(spark, sf_dir), path, sparse=True)
    rows = text_formats.read(spark, path, "parquet_sparse")
    keys = rows.select(F.col("row_id").alias("i"), F.col("labels")[0].cast("long").alias("key"))
    return text_formats.libsvm_coords(rows).join(keys, "i").select("key", "j", "v")


@query("matrix_text", f"WITH {X}, o AS (SELECT vec_id AS i, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM embeddings) SELECT row, j, round(v, 9) AS v FROM x JOIN o USING (i)")
def matrix_text(spark, sf_dir):
    """Text lines of numbers, written and read again."""
    path = fresh_path(spark, "matrix")
    text_formats.write_matrix(vectors(spark, sf_dir), path, text=True)
    back = text_formats.read_model_text(spark, path)
    return matrix.to_coords(back, True).select(F.col("i").alias("row"), "j", F.round("v", 9).alias("v"))


@query("index_file", "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS id FROM nation")
def index_file(spark, sf_dir):
    lines = table(spark, sf_dir, "nation").select(F.concat_ws(" ", "n_name", "n_nationkey").alias("value"))
    return text_formats.read_index(spark, lines)


@query("graph_by_name", "WITH e AS (SELECT DISTINCT o_orderstatus AS a, o_orderpriority[1] AS b FROM orders) SELECT a AS src, b AS dst FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b")
def graph_by_name(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select(F.concat_ws("\t", "o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("value"))
    return text_formats.read_graph(spark, lines)


@query("csr_arrays", f"WITH {X} SELECT i, j, v FROM x WHERE v > 0.1 AND i < 200")
def csr_arrays(spark, sf_dir):
    """A sparse matrix to the three arrays of its rows and back."""
    some = matrix.to_coords(vectors(spark, sf_dir)).where("v > 0.1 and i < 200")
    return matrix.from_csr(spark, *matrix.to_csr(some, 200))


@query("matrix_from_function", "SELECT i, j, round(sin(i + 2 * j), 9) AS v FROM range(300) a(i), range(5) b(j)")
def matrix_from_function(spark, sf_dir):
    x = matrix.from_function(spark, 300, 5, lambda i, j: F.sin(i + 2 * j))
    return matrix.to_coords(x, True).select("i", "j", F.round("v", 9).alias("v"))


@query("gemm_dense", f"WITH {X} SELECT i, k AS j, round(sum(v / (1 + j + k)), 6) + 0.0 AS v FROM x, range(3) t(k) GROUP BY i, k")
def gemm_dense(spark, sf_dir):
    """Rows times a small matrix."""
    b = 1.0 / (1 + np.arange(D)[:, None] + np.arange(3)[None, :])
    return matrix.to_coords(matrix.times(vectors(spark, sf_dir), b), True).select("i", "j", r("v").alias("v"))


@query("gemm_computed", f"WITH {X}, c AS (SELECT i, j, sin(i + 2 * j) AS y FROM range(300) a(i), range(5) b(j)) SELECT c.j AS i, CAST(x.j AS BIGINT) AS j, round(sum(c.y * x.v), 5) + 0.0 AS v FROM c JOIN x USING (i) GROUP BY c.j, x.j")
def gemm_computed(spark, sf_dir):
    """A computed matrix, made where it is needed, times the vectors."""
    made = matrix.to_coords(matrix.from_function(spark, 300, 5, lambda i, j: F.sin(i + 2 * j)), True)
    return matrix.gemm(made, matrix.to_coords(vectors(spark, sf_dir), True), trans_a=True).select("i", "j", r("v", 5).alias("v"))


@query("views", f"WITH {X} SELECT i, j - 8 AS j, v FROM x WHERE i BETWEEN 20 AND 69 AND j BETWEEN 8 AND 15")
def views(spark, sf_dir):
    part = matrix.column_view(matrix.row_view(vectors(spark, sf_dir), 20, 50), 8, 8)
    return matrix.to_coords(part, True)


@query("shape", "SELECT max(vec_id) + 1 AS height, CAST(max(len(embedding)) AS INT) AS width FROM embeddings")
def shape(spark, sf_dir):
    x = vectors(spark, sf_dir)
    return spark.createDataFrame([(matrix.height(matrix.to_coords(x, True)), matrix.width_of(x))], "height long, width int")


@query("same_matrix", "SELECT true AS equal, false AS other")
def same_matrix(spark, sf_dir):
    a = matrix.to_coords(vectors(spark, sf_dir))
    return spark.createDataFrame([(matrix.same_matrix(matrix.transpose(matrix.transpose(a)), a), matrix.same_matrix(a, matrix.axpy(0.5, a, a)))], "equal boolean, other boolean")


@query("trsm", "SELECT i, round(1.0 / (1 + i), 9) AS v FROM range(6) t(i)")
def trsm(spark, sf_dir):
    """What a triangle makes of the solution is the right side."""
    t = 1.0 / (1 + np.arange(6)[:, None] + np.arange(6)) + 2 * np.eye(6)
    b = 1.0 / (1 + np.arange(6))
    back = np.tril(t) @ matrix.trsm(t, b, upper=False)
    return spark.createDataFrame([(i, round(float(v), 9)) for i, v in enumerate(back)], "i long, v double")


@query("triangle_condition", "SELECT round((3.0 + 1.0) * (0.5 / 3 + 1.0 / 3), 9) AS cond")
def triangle_condition(spark, sf_dir):
    """1-norm condition of [[2, 1], [0, 3]]: 4 times the largest column sum of its inverse."""
    return spark.createDataFrame([(round(regression.condition(np.array([[2.0, 1.0], [0.0, 3.0]])), 9),)], "cond double")
