"""Class labels as indicator rows, and accuracy measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_order(df: DataFrame, label: str, order: str) -> list:
    """Labels in the order of their first appearance by the order column; as many rows as classes come to the driver."""
    return [r[0] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(order).alias("o")).orderBy("o", label).select(label).collect()]


def dummy_coding(label: str, labels: list, positive: float = 1.0, negative: float = -1.0) -> Column:
    """An array with positive at the label's place and negative elsewhere."""
    return F.array(*[F.when(F.col(label) == x, positive).otherwise(negative) for x in labels])


def dummy_decode(scores: str, labels: list) -> Column:
    """The label with the largest score; ties go to the earliest."""
    place = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in labels]), place)


def indicator(label: str, classes: int, first: int = 1, positive: float = 1.0, negative: float = -1.0) -> Column:
    """Dummy coding of whole-number labels first, first + 1, ...: an array of `classes` places."""
    return F.transform(F.sequence(F.lit(first), F.lit(first + classes - 1)), lambda c: F.when(F.col(label) == c, positive).otherwise(negative))


def num_targets(df: DataFrame, label: str) -> int:
    """1 for labels -1 and 1, else the largest label + 1."""
    low, high = df.agg(F.min(label), F.max(label)).first()
    return 1 if low == -1 else int(high) + 1


def accuracy(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """Per cent of rows that agree, as (n, accuracy)."""
    hit = F.when(F.col(predicted) == F.col(label), 1).otherwise(0)
    return df.agg(F.count("*").alias("n"), (100.0 * F.sum(hit) / F.count("*")).alias("accuracy"))


def relative_error(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """|p - y| / |y| in the 2-norm."""
    d = F.col(predicted) - F.col(label)
    return df.agg(F.count("*").alias("n"), F.sqrt(F.sum(d * d) / F.sum(F.col(label) * F.col(label))).alias("relative_error"))


def code_block(y: np.ndarray, labels: list) -> np.ndarray:
    return np.where(np.asarray(y)[:, None] == np.asarray(labels)[None, :], 1.0, -1.0)
