"""Shared folders and file listings, by Hadoop's file systems, so that remote paths work like local ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder among those that all machines share; the folder goes when the driver ends.

    It is in spark.checkpoint.dir; only on a single machine, where that is unset, in the warehouse.
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
    top = f"{here.rstrip('/')}/tesselark-{context.applicationId}-tables"
    if getattr(context, "_tesselark_tables", None) != top:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        context._tesselark_tables = top
    return f"{top}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again; cuts the lineage of iterations and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a glob, sorted; none for a missing folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def platform(spark: SparkSession, folder: str) -> dict[str, str | None]:
    """Which instrument wrote a folder, and its parts' paths.

    A folder of spots has ``spatial/`` and a matrix; a folder of cells has ``transcripts.parquet``; a folder of
    fields has ``flatFiles/``; tried in this order. Anything else is an error.
    """
    first = lambda *names: next((p for n in names for p in matching(spark, f"{folder}/{n}")), None)
    matrix = first("filtered_feature_bc_matrix", "raw_feature_bc_matrix")
    if first("spatial") and matrix:
        return {
            "platform": "visium", "matrix": matrix, "positions": first("spatial/tissue_positions.csv", "spatial/tissue_positions_list.csv"),
            "scalefactors": first("spatial/scalefactors_json.json"),
        }
    if molecules := first("transcripts.parquet"):
        return {"platform": "xenium", "molecules": molecules, "cells": first("cells.parquet"), "segmentation": first("cell_boundaries.parquet"), "nuclei": first("nucleus_boundaries.parquet")}
    if flat := first("flatFiles"):
        part = lambda kind: first(f"flatFiles/*{kind}.csv", f"flatFiles/*{kind}.csv.gz", f"flatFiles/*/*{kind}.csv", f"flatFiles/*/*{kind}.csv.gz")
        return {"platform": "cosmx", "flat": flat, "molecules": part("_tx_file"), "expression": part("_exprMat_file"), "polygons": part("-polygons") or part("_polygons")}
    raise ValueError(f"no known layout of files in {folder}")


def repeats(spark: SparkSession, folder: str, name: str, first: int | None = None) -> list[tuple[int, str]]:
    """Files ``rep*/name`` by the number of the repeat; the first few of them if asked."""
    import re

    numbered = sorted((int(m[1]), p) for p in matching(spark, f"{folder}/rep*/{name}") if (m := re.search(r"/rep[^/0-9]*(\d+)/[^/]*$", p)))
    return numbered[:first]
