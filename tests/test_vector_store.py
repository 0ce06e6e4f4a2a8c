"""A vector store that is filled batch by batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marlspike.functions.exprs import search_tokens
from marlspike.operators import vector_store as VS
from marlspike.sources.scratch import fresh_path


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string")


def length(text):
    return F.array(F.length(text), F.lit(1))


def test_a_run_that_stopped_writes_each_vector_once(spark):
    store = VS.Store(spark, fresh_path(spark, "v"), "m", {"a": 1}, 2)
    rows = [(f"c{i}", "x" * i) for i in range(40)] + [("c3", "xxx"), ("n", None)]
    fails = lambda t: F.array(F.when(t == "x" * 17, F.raise_error(F.lit("stopped"))).otherwise(F.length(t)), F.lit(1))
    with pytest.raises(Exception, match="stopped"):
        store.build(chunks(spark, rows), fails, batch=8)
    held = store.read().count()
    assert held < 41 and len(store.batches()) < 6
    assert store.build(chunks(spark, rows), length, batch=8) == -(-(41 - held) // 8)
    got = store.read().collect()
    assert len(got) == len({r["chunk_id"] for r in got}) == 41 and all(r["vector"][0] == (0 if r["chunk_id"] == "n" else int(r["chunk_id"][1:])) for r in got)
    assert store.build(chunks(spark, rows), length) == 0


def test_changed_text_and_configuration_are_made_again(spark):
    path = fresh_path(spark, "v")
    store = VS.Store(spark, path, "m", {"a": 1, "b": 2}, 2)
    store.build(chunks(spark, [("a", "one"), ("b", "two")]), length)
    now = chunks(spark, [("a", "one"), ("b", "three"), ("c", "four")])
    assert {r["chunk_id"] for r in store.missing(now).collect()} == {"b", "c"}
    assert {r["chunk_id"]: r["vector"] is None for r in store.of(now).collect()} == {"a": False, "b": True, "c": True}
    store.build(now, length)
    assert {r["chunk_id"]: r["vector"][0] for r in store.of(now).collect()} == {"a": 3, "b": 5, "c": 4} and [r["chunk_id"] for r in store.prune(now).collect()] == ["b"]
    assert VS.Store(spark, path, "m", {"b": 2, "a": 1}, 2).print == store.print
    assert VS.Store(spark, path, "m", {"a": 1, "b": 3}, 2).read().count() == 0


def test_wrong_length_ends_the_run(spark):
    store = VS.Store(spark, fresh_path(spark, "v"), "m", {}, 3)
    with pytest.raises(Exception, match="a vector without 3 numbers: a"):
        store.build(chunks(spark, [("a", "one")]), length)
    assert store.batches() == []


def test_hashed_counts(spark):
    row = chunks(spark, [("a", "red red blue"), ("b", None)]).select("chunk_id", VS.hashed_counts(8, search_tokens)(F.col("text")).alias("v")).collect()
    assert {r["chunk_id"]: sum(r["v"]) for r in row} == {"a": 3, "b": 0} and max(row[0]["v"]) >= 2
