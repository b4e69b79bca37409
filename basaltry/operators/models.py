"""Trained models: prediction is a map over rows; saving is a JSON document."""

from __future__ import annotations

import json
import math
import posixpath
from dataclasses import dataclass, field

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels, sketch
from .matrix import map_rows

HEADER = "# basaltry model\n"


@dataclass
class Model:
    """decision(block) gives scores (n, k); labels names the k classes (of one score the two classes under and from zero on), or is None
    for regression."""

    labels: list | None = field(default=None, kw_only=True)

    def decision(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def shared(self) -> Model:
        """A model of the same decisions that is small to send."""
        return self

    def decisions(self, rows: DataFrame) -> DataFrame:
        """Rows with `features` replaced by `scores`."""
        shared = rows.sparkSession.sparkContext.broadcast(self.shared())
        return map_rows(rows, lambda x: shared.value.decision(x)).withColumnRenamed("features", "scores")

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows with `features` replaced by `prediction`: a label, or the value (an array for several targets)."""
        out = self.decisions(rows)
        if self.labels is None:
            value = F.when(F.size("scores") == 1, F.col("scores")[0])
            return out.withColumn("prediction", value).drop("scores") if self._targets() == 1 else out.withColumnRenamed("scores", "prediction")
        if self._targets() == 1:
            low, high = self.labels
            return out.withColumn("prediction", F.when(F.col("scores")[0] >= 0, F.lit(high)).otherwise(F.lit(low))).drop("scores")
        best = F.array_position("scores", F.array_max("scores")).cast("int")
        return out.withColumn("prediction", F.element_at(F.array(*[F.lit(x) for x in self.labels]), best)).drop("scores")

    def _targets(self) -> int:
        raise NotImplementedError


@dataclass
class FeatureModel(Model):
    """Sum over maps of z_j(x) W_j, each scaled by sqrt(s_j / total) where scaled; no maps: linear in x.

    total is the sum of the maps' sizes, or the input dimension for models of the ADMM trainer.
    """

    maps: list[sketch.Sketch]
    weights: list[np.ndarray]
    scaled: bool = False
    total: int | None = None

    def features(self, j: int, x: np.ndarray) -> np.ndarray:
        if not self.maps:
            return x
        t = self.maps[j]
        z = t.map_block(x)
        return z * math.sqrt(t.S / (self.total or sum(m.S for m in self.maps))) if self.scaled else z

    def decision(self, x):
        return sum(self.features(j, x) @ w for j, w in enumerate(self.weights))

    def _targets(self):
        return self.weights[0].shape[1]

    def to_json(self) -> str:
        return json.dumps({"object_type": "feature-model", "maps": [m.to_json() for m in self.maps], "weights": [w.tolist() for w in self.weights], "scaled": self.scaled, "total": self.total, "labels": self.labels})


@dataclass
class KernelModel(Model):
    """K(x, support) coefficients."""

    kernel: kernels.Kernel
    support: np.ndarray
    coefficients: np.ndarray

    def decision(self, x):
        return self.kernel.times(x, self.support, self.coefficients)

    def shared(self):
        linear = isinstance(self.kernel, kernels.Linear)
        return FeatureModel([], [self.support.T @ self.coefficients]) if linear and len(self.support) else self

    def _targets(self):
        return self.coefficients.shape[1]

    def to_json(self) -> str:
        return json.dumps({"object_type": "kernel-model", "kernel": self.kernel.to_json(), "support": self.support.tolist(), "coefficients": self.coefficients.tolist(), "labels": self.labels})


def from_json(text: str) -> Model:
    d = json.loads("".join(x for x in text.splitlines(True) if not x.startswith("#")))
    if d["object_type"] == "kernel-model":
        return KernelModel(kernels.from_json(d["kernel"]), np.array(d["support"]), np.array(d["coefficients"]), labels=d["labels"])
    if d["object_type"] == "feature-model":
        return FeatureModel([sketch.from_json(m) for m in d["maps"]], [np.array(w) for w in d["weights"]], d["scaled"], d["total"], labels=d["labels"])
    raise ValueError(f"no model of kind {d['object_type']}")


def _fs(uri: str):
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def save(model: Model, uri: str, spark: SparkSession | None = None) -> None:
    """With a session through Spark's file systems, any that its readers know; folders on the way are made."""
    text = (HEADER + model.to_json() + "\n").encode()
    if spark is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        try:
            out.write(bytearray(text))
        finally:
            out.close()
        return
    fs, path = _fs(uri)
    if parent := posixpath.dirname(path):
        fs.create_dir(parent, recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(text)


def load(uri: str, spark: SparkSession | None = None) -> Model:
    if spark is not None:
        return from_json(spark.read.text(uri, wholetext=True).first()[0])
    fs, path = _fs(uri)
    with fs.open_input_stream(path) as f:
        return from_json(f.read().decode())
