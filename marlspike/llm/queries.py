"""Queries of the corpus operators over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf_toxicity, dimension_scan, hilbert, host_rules, line_chunks, mixing, ordinal_quality, packing, ppm_language, signature_join, spaced_seeds, token_blocks, turn_grammar


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    """Place of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crf_toxicity.toxicity(_documents(spark, sf_dir), _labels(spark, sf_dir))
    return out.select("doc_id", "held_out", "score", "predicted", "n_toxic_words", F.transform("spans", lambda s: s["start"]).alias("span_starts"), F.transform("spans", lambda s: s["end"]).alias("span_ends"))


def op2_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signature_join.near_duplicates(_documents(spark, sf_dir), k=3, t=90)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_language.language(_documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.quality(_documents(spark, sf_dir), _labels(spark, sf_dir)).select("doc_id", "held_out", "expected_grade", "p_ge_1", "p_ge_2", "kept")


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert.shard(_documents(spark, sf_dir), ["lang", "source", "n_chars", "doc_id"], n_shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.read_files(token_blocks.write_files(_documents(spark, sf_dir), tokenizer_path()))


def op7_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(_documents(spark, sf_dir)).select("doc_id", *host_rules.COUNTS, "base_failed", "kept")


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_lines(_documents(spark, sf_dir))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spaced_seeds.overlaps(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "item_id")  # the other columns depend on the masks, the pairs don't


def op11_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension_scan.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


def op12_turn_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_grammar.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"), damage=True)


def op13_lockstep_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = packing.compact(spark.read.parquet(f"{sf_dir}/clicks.parquet"))
    return out.withColumnsRenamed({"min_id": "min_click_id", "max_id": "max_click_id"})


QUERIES = {f.__name__: f for f in (op1_crf_toxicity, op2_signature_trees, op3_ppm_language, op4_ordinal_quality, op5_hilbert_sharding, op6_token_blocks, op7_systematic_mix, op8_host_rules, op9_line_chunks, op10_spaced_seeds, op11_dimension_scan, op12_turn_grammar, op13_lockstep_packing)}
#: The others can't be expressed in SQL and are tested against brute force, round trips or held-out rows.
ORACLE_SQL = {
    "op2_signature_trees": signature_join.oracle(3, 90),
    "op7_systematic_mix": mixing.oracle(),
    "op8_host_rules": host_rules.oracle(),
    "op10_spaced_seeds": spaced_seeds.oracle(),
}
