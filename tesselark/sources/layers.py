"""A store of pair layers: one table, partitioned by level (of what the pairs are measured on) and layer (which statistic)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "a string, b string, value double, level string, layer string"


class LayerStore:
    """Layers (a, b, value) in a folder that all machines share. A layer is replaced by writing its partition again; the others stay.

    Readers name the partitions that they want, so nothing else is listed or read. Null values are kept; a layer without rows is as good as none.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def put(self, layer: DataFrame, level: str, name: str, value: str = "value") -> None:
        rows = layer.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col(value).cast("double").alias("value"))
        rows = rows.withColumn("level", F.lit(level)).withColumn("layer", F.lit(name))
        rows.write.partitionBy("level", "layer").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path)

    def table(self) -> DataFrame:
        """All layers (a, b, value, level, layer); none before the first is written."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def names(self) -> DataFrame:
        """Levels and layers that have rows."""
        return self.table().select("level", "layer").distinct()

    def get(self, level: str, *names: str) -> DataFrame:
        """The first of these layers that the level has; an error if it has none. The choice reads partition names only."""
        have = {r.layer for r in self.names().where(F.col("level") == level).collect()}
        found = next((n for n in names if n in have), None)
        if found is None:
            raise KeyError(f"no layer {' or '.join(names)} of {level}; there are {', '.join(sorted(have)) or 'none'}")
        return self.table().where((F.col("level") == level) & (F.col("layer") == found)).select("a", "b", "value")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """All layers that ``wanted`` (level, layer) names, which is a short list and broadcast; other partitions are pruned when the list is known."""
        return self.table().join(F.broadcast(wanted.select("level", "layer").distinct()), ["level", "layer"])

    def pairs(self, pairs: DataFrame, level: str, *names: str) -> DataFrame:
        """``pairs`` with the value of the layer, in either direction of a pair; null where the layer lacks it."""
        got = self.get(level, *names)
        both = got.union(got.where("a <> b").select("b", "a", "value")).groupBy("a", "b").agg(F.first("value", ignorenulls=True).alias("value"))
        return pairs.join(both, ["a", "b"], "left")
