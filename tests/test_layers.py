"""The layer store: writeback by partition, lookups that read only what they name."""

import pytest

from tesselark.sources.files import scratch
from tesselark.sources.layers import LayerStore


def pairs(spark, *rows):
    return spark.createDataFrame(rows, "a string, b string, value double")


def test_layers(spark):
    store = LayerStore(spark, scratch(spark, "layers"))
    assert store.table().count() == 0
    with pytest.raises(KeyError, match="there are none"):
        store.get("grid", "l")
    store.put(pairs(spark, ("x", "y", 1.0), ("x", "z", None)), "grid", "l")
    store.put(pairs(spark, ("x", "y", 2.0)), "grid", "r")
    store.put(pairs(spark, ("y", "x", 3.0)), "cell", "r")
    store.put(pairs(spark, ("x", "y", 5.0)), "grid", "l")  # in place of the first; the others stay
    assert {tuple(r) for r in store.table().select("level", "layer", "a", "b", "value").collect()} == {("grid", "l", "x", "y", 5.0), ("grid", "r", "x", "y", 2.0), ("cell", "r", "y", "x", 3.0)}
    assert store.get("grid", "lee", "l").first().value == 5.0
    with pytest.raises(KeyError, match="l, r"):
        store.get("grid", "other")
    got = store.pairs(spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "w")], "a string, b string"), "cell", "r")
    assert {(r.a, r.b): r.value for r in got.collect()} == {("x", "y"): 3.0, ("y", "x"): 3.0, ("x", "w"): None}


def test_lookups_prune_partitions(spark):
    store = LayerStore(spark, scratch(spark, "layers"))
    for level in ("grid", "cell"):
        for name in ("l", "r"):
            store.put(pairs(spark, ("x", "y", 1.0)), level, name)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan(store.get("grid", "l")).replace("\n", " ")
    wanted = spark.createDataFrame([("grid", "l"), ("cell", "none")], "level string, layer string").where("level <> 'x'")
    found = store.lookup(wanted)
    assert "dynamicpruning" in plan(found).lower() and [(r.level, r.layer) for r in found.collect()] == [("grid", "l")]
