"""Filing ingest run by run, and records merged by key."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from marlspike.operators import filings as FL
from marlspike.operators import ingest as IG
from marlspike.plans import catalogue
from marlspike.sources.scratch import fresh_path

GOOD = "<p>Item 1. Business</p><p>We sell things. We buy things.</p>"


def filings(spark, rows):
    return spark.createDataFrame([(a, "T", "10-K", h) for a, h in rows], "accession string, ticker string, form string, html string")


def status(spark, path):
    return {r["accession"]: (r["status"], r["stage"], r["error"], r["run"]) for r in IG.state(spark, path).collect()}


def test_each_filing_has_a_status_and_only_unfinished_ones_are_taken_up(spark):
    path = fresh_path(spark, "ingest")
    first = filings(spark, [("a", GOOD), ("b", None), ("c", "<p> </p>"), ("d", "<p>no headings</p>"), ("a", GOOD)])
    assert IG.ingest(spark, path, first).count() == 4
    want = {"a": ("complete", "CHUNK", None, 0), "b": ("failed", "RAW", "EMPTY_DOCUMENT", 0), "c": ("failed", "CLEAN", "NO_TEXT", 0), "d": ("failed", "CHUNK", "NO_CHUNKS", 0)}
    assert status(spark, path) == want
    assert IG.ingest(spark, path, first).count() == 0  # nothing is new
    second = filings(spark, [("a", GOOD), ("b", GOOD), ("c", "<p> </p>"), ("e", GOOD)])
    assert {r["accession"] for r in IG.ingest(spark, path, second).collect()} == {"b", "e"}
    assert status(spark, path) == want | {"b": ("complete", "CHUNK", None, 2), "e": ("complete", "CHUNK", None, 2)}
    assert {r["accession"] for r in IG.ingest(spark, path, second, retry=True).collect()} == {"c"}
    assert IG.ingest(spark, path, filings(spark, [("a", GOOD + "<p>more</p>")])).first()["status"] == "complete"


def test_a_run_that_died_is_taken_up_again(spark, monkeypatch):
    path = fresh_path(spark, "ingest")
    monkeypatch.setattr(IG.FL, "chunk_filings", lambda d: d.withColumn("x", F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        IG.ingest(spark, path, filings(spark, [("a", GOOD)]))
    monkeypatch.undo()
    assert status(spark, path) == {}
    IG.ingest(spark, path, filings(spark, [("a", GOOD)]))
    assert status(spark, path) == {"a": ("complete", "CHUNK", None, 0)} and FL.chunk_filings is IG.FL.chunk_filings


def test_untouched_records_stay_as_they_are(spark):
    record = lambda s: F.struct(F.lit("é ☃").alias("name"), F.lit(0.1 + 0.2).alias("x"), F.struct(F.lit(s).alias("status"), F.lit(None).cast("double").alias("score")).alias("trend"))
    stored = spark.createDataFrame([("a",), ("b",), (None,)], "ticker string").select("ticker", record("old").alias("record"))
    new = spark.createDataFrame([("a",), ("z",)], "ticker string").select("ticker", F.struct(F.lit("new").alias("status"), F.lit(1.0).alias("score")).alias("value"))
    text = lambda d: {(r["artifact"], r["ticker"]): r["j"] for r in d.select("artifact", "ticker", F.to_json("record").alias("j")).collect()}
    got = text(IG.merge_nested({"one": stored, "two": stored.where("ticker = 'b'")}, new, "trend"))
    before = text(stored.withColumn("artifact", F.lit("one")))
    assert len(got) == 4 and got["one", "b"] == before["one", "b"] == got["two", "b"] and got["one", None] == before["one", None]
    assert got["one", "a"] == before["one", "a"].replace('{"status":"old"}', '{"status":"new","score":1.0}')
    gone = text(IG.merge_nested({"one": stored}, new.withColumn("value", F.lit(None).cast("struct<status:string,score:double>")), "trend"))
    assert "trend" not in gone["one", "a"]


ODD = ["12", "Page 3\n\u00a0", "\u00a0", " \t", "12\u2028", "\n".join(["Item 5. Market"] * 4), "\u3000Item 3.", "item 12\u00e9", "Item 2 " + "x" * 120, "Item 9<p>\u000b", "same\n" * 5, "Item 1. Business\n" + "We sell things. " * 1500]


def test_statuses_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    """Texts that the rules of cleaning and chunking leave nothing of, and characters that the two engines read unlike."""
    texts = [(50 * i + 7, t, "en", "s") for i, t in enumerate(ODD)] + [(50 * i + 8, "one\ntwo\n" + "We sell things. " * 1500, "en", "s") for i in range(3)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["ingest_status"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()["ingest_status"])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
