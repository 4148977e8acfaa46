"""Sinks: tables as TSV, JSON and coordinate matrices, written by all tasks at once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, compressed: bool = False) -> None:
    """A folder of TSV parts with headers."""
    df.write.csv(path, sep="\t", header=True, compression="gzip" if compressed else "none")


def write_meta(spark: SparkSession, path: str, **facts: object) -> None:
    """One small JSON object."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True, default=str),)], "value string").coalesce(1).write.text(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a batch as one row, so that the task that writes them all has little to do."""
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_pydict({"value": ["\n".join(b.column(0).to_pylist())]})


def write_matrix_market(counts: DataFrame, folder: str, row: str = "feature", col: str = "barcode", value: str = "n") -> None:
    """matrix.mtx, features.tsv and barcodes.tsv: numbered by name, one file each, as readers of the format want.

    One task writes a file, but holds no more than a block of it: its lines are made by all tasks, and the counts' lines stay in no order.
    """
    from .files import materialised
    from .readers import numbered_lines

    spark = counts.sparkSession
    counts = materialised(counts.select(row, col, value), "counts")
    tables = {}
    for column, name in ((row, "features.tsv"), (col, "barcodes.tsv")):
        # The format numbers names in one file; each part of them is sorted by itself.
        names = counts.select(column).distinct().orderBy(column).coalesce(1)
        names.select(F.col(column).cast("string").alias("value")).write.text(f"{folder}/_{name}")
        tables[column] = numbered_lines(spark, f"{folder}/_{name}").select((F.col("i") + 1).alias(f"_{column}"), F.col("line").alias(column))
    n = {c: t.count() for c, t in tables.items()}
    rows = counts.join(tables[row], row).join(tables[col], col).select(F.concat_ws(" ", f"_{row}", f"_{col}", F.col(value)).alias("value"))
    head = f"%%MatrixMarket matrix coordinate real general\n{n[row]} {n[col]} {counts.count()}"

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [head]})
        yield from batches

    if n[row]:
        rows.mapInArrow(_blocks, "value string").repartition(1).mapInArrow(headed, "value string").write.text(f"{folder}/_matrix.mtx")
    else:
        spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{folder}/_matrix.mtx")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in ("matrix.mtx", "features.tsv", "barcodes.tsv"):
        part = fs.globStatus(hadoop.Path(f"{folder}/_{name}/part-*"))[0].getPath()
        fs.rename(part, hadoop.Path(f"{folder}/{name}"))
        fs.delete(hadoop.Path(f"{folder}/_{name}"), True)
