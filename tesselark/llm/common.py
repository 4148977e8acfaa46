"""Helpers that the text operators share."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows are worked on in slices of at most so many bytes of text, whatever the size of Arrow's batches.
SLICE_BYTES = 4 << 20

#: A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed and return.
WORD_RE = r"[^\x20\x09-\x0D]+"


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the text of each piece is near ``limit`` bytes; a longer single text is a piece by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        begin, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + (n or 0) > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n or 0
        yield batch.slice(begin)


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` for columns of any names (its own way to refer to them takes dots and backticks for syntax)."""
    if isinstance(schema, str):
        return df.mapInArrow(fn, schema)
    plain = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in fn(batches):
            yield pa.RecordBatch.from_arrays(made.columns, names=plain.names)

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, plain).toDF(*schema.names)


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str, column: int = 1, limit: int = SLICE_BYTES) -> DataFrame:
    """Applies ``fn`` to slices of the rows; no shuffle, memory bounded by a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, column, limit):
            yield fn(piece)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return map_rows(df, run, schema)


def col(name: str) -> Column:
    """A column by its exact name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` but those that have one of these names, in any case (Spark doesn't tell cases apart)."""
    low = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in low]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    low = {c.lower() for c in df.columns}
    while name.lower() in low:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """This application's folder among those that all machines share; deleted when the driver ends.

    It is in spark.checkpoint.dir. Only on a single machine, where that is unset, it is in the warehouse; elsewhere that is an error.
    """
    context = spark.sparkContext
    here = spark.conf.get("spark.checkpoint.dir", None)
    if not here:
        given = context._jsc.sc().getCheckpointDir()
        if given.isDefined():
            here = given.get()
        elif context.master.startswith("local"):
            here = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    path = f"{here.rstrip('/')}/tesselark-{context.applicationId}"
    if getattr(context, "_tesselark_folder", None) != path:
        where, files = _folder(spark, path)
        files.mkdirs(where)
        files.deleteOnExit(where)
        context._tesselark_folder = path
    return path


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


_names = itertools.count()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, and survives the loss of an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}-{next(_names)}"
    # The shuffles of a write are not read again: their files go when it ends, not when the driver's garbage is collected.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote; nothing may read it any more."""
    where, files = _folder(df.sparkSession, df._stored_at)
    files.delete(where, True)
