"""Vectors as whole numbers, for operators that count exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col


def finite(v: Column) -> Column:
    """A vector that is not null and holds no null or non-finite components."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(df: DataFrame, key: str, vector: str, label: str, scale: int = 256) -> DataFrame:
    """Rows (id, label, v): components floored after scaling. Rows without a finite vector go, and those of another length than most have."""
    v = F.transform(col(vector), lambda x: x.cast("double"))
    rows = df.select(col(key).cast("long").alias("id"), col(label).alias("label"), v.alias("v")).where(finite(F.col("v")))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    n = size.n if size else 0
    return rows.where(F.size("v") == n).withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of equal length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
