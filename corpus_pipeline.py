"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``, with any further ones they were given.

Defined cases, in every stage: a null or empty text is a document without
words; a text of any length is judged whole; columns whose names clash with
those used here or in the operators stay as they are; an empty table gives an
empty result. Rows are told apart by 128 bits of doc_id and text, so rows alike
in both share every verdict. Each stage's docstring says what it does with
nulls, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.llm import host_rules, mixing, signature_join, spaced_seeds, token_blocks
from marlspike.llm.common import handle, many_to_one, materialize
from marlspike.llm.queries import tokenizer_path

#: A list of up to so many documents (some 40 bytes each) is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000

#: SQL can't express the tokenizer stage.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a handle of id and text, and that column's name."""
    k = _free(docs, "_key")
    return docs.withColumn(k, handle("doc_id", "text")), k


def _listed(keys: DataFrame) -> DataFrame:
    keys = materialize(keys, "keys")
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows whose handle is not in ``dropped(_at)``."""
    out, k = _key(docs)
    keys = _listed(dropped.select(F.col("_at").alias(k)).distinct())
    return out.join(keys, k, "left_anti").select(*docs.columns)


def _one_of_each(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """Rows alike in id and text once each, the first by their other columns; ``counted(_at)`` has a row for each row of ``docs``."""
    keyed, k = _key(docs)
    twice = materialize(counted.groupBy("_at").count().where("count > 1").select(F.col("_at").alias(k)), "twice")
    if not twice.limit(1).count():
        return docs
    keys, row = _listed(twice), _free(docs, "_row")
    once = keyed.join(keys, k, "left_semi").groupBy(k).agg(F.min(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return keyed.join(keys, k, "left_anti").select(*docs.columns).unionByName(once)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level rules reject go, those with null or empty texts among them; null is a host of its own, a tie with the highest rate rejects, repeated rows are judged each."""
    verdict = materialize(host_rules.judge(docs).select("_at", "kept"), "verdict")
    return _without(docs, verdict.where(~F.col("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays, the one with the smallest id.

    Null ids come after all others and equal ids are ordered by handle; a pair that ties with the similarity is a group;
    of repeated rows one stays; documents without words, null texts among them, are in no group and all stay."""
    found = materialize(signature_join.near_duplicates(docs, k=5, t=80).select("doc_id", "_at", "component"), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_at")
    grouped = found.where("component is not null")
    first = materialize(grouped.groupBy("component").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).select("component", F.col("first._at").alias("first"), "c"), "first")
    gone = many_to_one(grouped, first, "component", "c").where(F.col("_at") != F.col("first")).select("_at")
    return _one_of_each(_without(docs, gone), grouped.select("_at"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a test item go; null ids and repeated rows like any other, null texts overlap nothing, three quarters of the tokens alike are enough."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed, k = _key(docs)
    hit = spaced_seeds.overlaps(keyed, items, doc_id=k).select(F.col("doc_id").alias("_at"))
    return _without(docs, hit)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null is a source of its own and the last, equal sizes are ordered by id; repeated rows are mixed each and their
    copies added up; a null text has no words, so its copies are those of its source's smallest."""
    taken = materialize(mixing.mix(docs).select("_at", "copies"), "copies")
    rows, k = _key(_one_of_each(docs, taken))
    n, nth = _free(rows, "_n"), _free(rows, "_copy")
    times = taken.groupBy("_at").agg(F.sum("copies").cast("int").alias(n)).where(F.col(n) > 0).withColumnRenamed("_at", k)
    return rows.join(_listed(times), k).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in block files, and where each document stands in them; null ids come first, equal ids by text, repeated rows each, a null text is the end id alone."""
    return token_blocks.read_files(token_blocks.write_files(docs, tokenizer_path(), text_bytes=4 << 20))  # the workers hold earlier stages' memory too


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
