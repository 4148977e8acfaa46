"""Streams of points and samples. Counts are additive, so bins need no watermark; windows of time do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesselark.operators import grid


def bin_counts(points: DataFrame, limits: tuple[float, float, float, float], size: float) -> DataFrame:
    """Counts (gx, gy, feature, n) of a stream of points; the limits (x and y from, x and y to) are fixed, since a stream has no last point.

    The state holds one number for each bin and feature that occurs. Use with output mode update or complete.
    """
    xmin, ymin, xmax, ymax = limits
    origin = lambda low: (low // size) * size
    at = lambda c, low: (F.floor((F.col(c) - origin(low)) / size) + 1).cast("int")
    inside = grid.filter_points(points).where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))
    return inside.select(at("x", xmin).alias("gx"), at("y", ymin).alias("gy"), "feature").groupBy("gx", "gy", "feature").agg(F.count("*").alias("n"))


def sample_windows(samples: DataFrame, late: str = "10 minutes", length: str = "1 hour", by: str = "series") -> DataFrame:
    """Means and maxima of samples (ts, series, v) in windows of time; an extension beside the batch operators.

    Samples later than the watermark are left out, as a stream has to close its windows.
    """
    w = samples.withWatermark("ts", late).groupBy(F.window("ts", length), by)
    return w.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.max("v").alias("max")).select(F.col("window.start").alias("start"), by, "n", "mean", "max")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Works off what is there and writes every batch whole, under its number: a batch that is repeated overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return query


def final_state(df: DataFrame) -> DataFrame:
    """The last complete result of ``run_once``."""
    last = df.agg(F.max("batch").alias("batch"))
    return df.join(F.broadcast(last), "batch").drop("batch")
