"""Readers and writers: LIBSVM, arc lists, simple graphs, index files, random matrices, Parquet twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import Context
from ..operators.matrix import as_lists, coo_sum

# -- LIBSVM ----------------------------------------------------------------------------------------------


def _numbered(lines: DataFrame, kept: Column | None = None, once: bool = True) -> DataFrame:
    """Lines of a text source (those that are kept) with row_id in file order: a count of each block first, then a place within the block.

    A task reads a block's lines one after another, so their numbers follow each other and no line moves; only where a file may be read more
    than once (not once) places are counted in a window.
    """
    m = lines.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    m = (m if kept is None else m.where(kept)).withColumn("n", F.monotonically_increasing_id())
    sizes = m.groupBy("f", "b").agg(F.count("*").alias("size"), F.min("n").alias("first"))
    before = sizes.select("f", "b", "first", (F.sum("size").over(Window.orderBy("f", "b")) - F.col("size")).alias("before"))
    if not once:
        m = m.withColumn("n", F.row_number().over(Window.partitionBy("f", "b").orderBy("n")) - 1)
        before = before.withColumn("first", F.lit(0))
    return m.join(F.broadcast(before), ["f", "b"]).select((F.col("before") + F.col("n") - F.col("first")).alias("row_id"), "value")


def read_libsvm(spark: SparkSession, path: str | list[str], sparse: bool = False, min_d: int = 0, max_n: int | None = None, strict_stop: bool = False) -> DataFrame:
    """RowDF row_id, labels (array: the tokens without ':'), features; a file, folder, list or any Hadoop URI.

    Indices count from 1, in any order; duplicates add up.  Blank lines and lines that begin with # are skipped;
    with strict_stop reading ends at the first of them.  Features are as wide as the largest index, min_d at
    least.  With sparse they stay indices and values.  max_n keeps the first rows.
    """
    lines = spark.read.text(path)
    rows = _numbered(lines, once=isinstance(path, str))
    skip = F.rlike("value", F.lit(r"^\s*(#|\z)"))
    if strict_stop:
        end = rows.where(skip).agg(F.min("row_id")).first()[0]
        rows = rows if end is None else rows.where(F.col("row_id") < end)
    rows = rows.where(~skip)
    tokens = F.split("value", r"\s+").alias("t")
    index = lambda t: F.substring_index(t, ":", 1).cast("int") - 1
    pair = lambda t: F.struct(index(t).alias("j"), F.substring_index(t, ":", -1).cast("double").alias("v"))
    rows = rows.select("row_id", tokens)
    if max_n is not None:
        rows = rows.orderBy("row_id").limit(max_n)
    parsed = rows.select(
        "row_id",
        F.transform(F.filter("t", lambda t: (t != "") & ~t.contains(":")), lambda t: t.cast("double")).alias("labels"),
        F.transform(F.filter("t", lambda t: t.contains(":")), pair).alias("e"),
    )
    # the largest index: of all lines that count, no numbers of theirs are asked for
    seen = rows if strict_stop or max_n is not None else lines.where(~skip).select(tokens)
    last = seen.agg(F.max(F.array_max(F.transform(F.filter("t", lambda t: t.contains(":")), index)))).first()[0]
    d = max(min_d, 0 if last is None else last + 1)
    if sparse:
        return parsed.select("row_id", "labels", F.lit(d).alias("size"), F.transform("e", lambda p: p["j"]).alias("indices"), F.transform("e", lambda p: p["v"]).alias("values"))
    def fill(batches):
        import pyarrow as pa

        for b in batches:
            out, entries = np.zeros((b.num_rows, d)), b["e"].flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(b["e"].offsets.to_numpy()))
            np.add.at(out, (row, entries.field("j").to_numpy(zero_copy_only=False)), entries.field("v").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b["row_id"], b["labels"], as_lists(out)], names=["row_id", "labels", "features"])

    return parsed.mapInArrow(fill, "row_id long, labels array<double>, features array<double>")


def libsvm_coords(sparse_rows: DataFrame) -> DataFrame:
    return coo_sum(sparse_rows.select(F.col("row_id").alias("i"), F.explode(F.arrays_zip("indices", "values")).alias("e")).select("i", F.col("e.indices").cast("long").alias("j"), F.col("e.values").alias("v")))


def libsvm_lines(rows: DataFrame, label: str, features: str = "features") -> DataFrame:
    """(row_id, value): 'label index:value ...' with the non-zero features."""
    entries = F.filter(F.transform(features, lambda x, i: F.struct((i + 1).alias("i"), x.alias("x"))), lambda p: p["x"] != 0)
    tokens = F.transform(entries, lambda p: F.concat(p["i"].cast("string"), F.lit(":"), p["x"].cast("string")))
    return rows.select("row_id", F.array_join(F.concat(F.array(F.col(label).cast("string")), tokens), " ").alias("value"))


def write_libsvm(rows: DataFrame, label: str, path: str) -> None:
    libsvm_lines(rows, label).select("value").write.text(path)


# -- graphs -------------------------------------------------------------------------------------------


def _fields(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    lines = spark.read.text(source) if isinstance(source, str) else source
    text = F.trim(F.regexp_replace("value", r"[ \t]+", " "))
    return lines.select(text.alias("t")).where("t <> '' and not startswith(t, '#')").select(F.split("t", " ").alias("f"))


def read_arc_list(spark: SparkSession, source: str | DataFrame, symmetrize: bool = False) -> DataFrame:
    """CoordDF of lines 'from to [weight = 1]'; # lines are skipped, duplicates add up.

    With symmetrize every arc stands half each way.
    """
    arcs = _fields(spark, source).select(F.col("f")[0].cast("long").alias("i"), F.col("f")[1].cast("long").alias("j"), F.coalesce(F.get("f", F.lit(2)).cast("double"), F.lit(1.0)).alias("v"))
    if symmetrize:
        half = arcs.withColumn("v", F.col("v") / 2)
        arcs = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return coo_sum(arcs)


def read_graph(spark: SparkSession, source: str | DataFrame, numeric: bool = False) -> DataFrame:
    """EdgeDF (src, dst) of lines 'u v': both directions, no loops, distinct."""
    kind = "long" if numeric else "string"
    return simple_graph(_fields(spark, source).select(F.col("f")[0].cast(kind).alias("src"), F.col("f")[1].cast(kind).alias("dst")))


def simple_graph(edges: DataFrame) -> DataFrame:
    kept = edges.select("src", "dst").where("src <> dst")
    return kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def read_index(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """(name, id) of lines 'name id'."""
    return _fields(spark, source).select(F.col("f")[0].alias("name"), F.col("f")[1].cast("long").alias("id"))


# -- matrices -----------------------------------------------------------------------------------------


def random_matrix(spark: SparkSession, m: int, n: int, dist: str = "normal", seed: int = 0) -> DataFrame:
    """RowDF of samples, entry (i, j) being number j * m + i of the stream."""

    def run(batches):
        import pyarrow as pa

        ctx = Context(seed)
        for b in batches:
            i = b["id"].to_numpy()
            yield pa.RecordBatch.from_arrays([b["id"], as_lists(ctx.sample(dist, 0, np.arange(n)[None, :] * m + i[:, None]))], names=["row_id", "features"])

    return spark.range(m).mapInArrow(run, "row_id long, features array<double>")


def write_matrix(df: DataFrame, path: str, text: bool = False) -> None:
    """Parquet, or text lines of numbers for a RowDF."""
    if not text:
        df.write.parquet(path)
        return
    df.orderBy("row_id").select(F.array_join(F.transform("features", lambda x: x.cast("string")), " ").alias("value")).write.text(path)


def read_model_text(spark: SparkSession, path: str) -> DataFrame:
    """RowDF from text: a header '# Dimensions m n' and rows of numbers."""
    rows = _numbered(spark.read.text(path), (F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    return rows.select("row_id", F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("features"))


FORMATS = ("libsvm_dense", "libsvm_sparse", "parquet_dense", "parquet_sparse")


def read(spark: SparkSession, path: str, fileformat: str = "libsvm_dense", **kw) -> DataFrame:
    if fileformat.startswith("libsvm"):
        return read_libsvm(spark, path, sparse=fileformat.endswith("sparse"), **kw)
    if fileformat in FORMATS:
        return spark.read.parquet(path)
    if fileformat.startswith("hdf5"):
        raise ValueError("no HDF5 library is used here: keep matrices as Parquet (parquet_dense, parquet_sparse)")
    raise ValueError(f"fileformat is one of {FORMATS}")


def convert_libsvm(spark: SparkSession, source: str, target: str, sparse: bool = False, min_d: int = 0) -> None:
    read_libsvm(spark, source, sparse=sparse, min_d=min_d).write.parquet(target)
