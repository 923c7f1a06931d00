"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import decontaminate, extract, language, licenses, lm, near, neighbours, pack, quality, repair, shard, spelling, toxicity
from tablescope.llm.labelled import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains a benchmark item, with that item."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards with counts at most one apart."""
    documents = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shard.shard(documents, ["doc_id", "text_crc32"], shards=16, slack=0.0)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _held_out(modulus: int, value: int):
    return F.coalesce(remainder("doc_id", modulus) == value, F.lit(False))


def op3_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op4_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from four fifths of the labelled ones."""
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(documents, labels, learnable=remainder("doc_id", 5) != 0)
    scored = quality.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    documents = _table(spark, sf_dir, "documents")
    model = language.train(documents, learnable=remainder("doc_id", 3) != 1)
    named = language.predict(documents.select("doc_id", "text"), model)
    return named.select("doc_id", _held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op7_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from two thirds of the labelled ones."""
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(documents, labels, learnable=remainder("doc_id", 3) != 1)
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    found = near.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_loss_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more like the documents of good quality than like all documents every document is."""
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return lm.cross_entropy_difference(documents, labels.filter("quality = 1"))


def op11_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults and its cheapest repair."""
    return repair.repair(_table(spark, sf_dir, "conversations"))


def op12_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license names and notices in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op13_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their spelling variants."""
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash_windows": op1_simhash_windows,
    "op2_ring_shards": op2_ring_shards,
    "op3_block_tree": op3_block_tree,
    "op4_byte_network": op4_byte_network,
    "op5_ftrl_language": op5_ftrl_language,
    "op6_permutation_index": op6_permutation_index,
    "op7_nb_toxicity": op7_nb_toxicity,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_differencing_pack": op9_differencing_pack,
    "op10_loss_difference": op10_loss_difference,
    "op11_grammar_repair": op11_grammar_repair,
    "op12_diagonal_licenses": op12_diagonal_licenses,
    "op13_trie_pairs": op13_trie_pairs,
}

ORACLES = {"op12_diagonal_licenses": licenses.oracle()}
