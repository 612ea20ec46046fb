"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linktm.llm import oracles
from linktm.llm.dual_tree_search import rank_documents
from linktm.llm.line_crf import THRESHOLD, classify, in_fold
from linktm.llm.line_dedup import dedup_lines
from linktm.llm.maxent_lm import score_texts
from linktm.llm.minhash_hamming import near_duplicates
from linktm.llm.mixing import taken_words
from linktm.llm.permutation_index import nearest_neighbours
from linktm.llm.piece_lattice import encode
from linktm.llm.quality_rules import quality_rules
from linktm.llm.spelling_variants import spelling_variants
from linktm.llm.token_files import read_digests, starts, token_folder, write_tokens
from linktm.llm.url_filter import filter_urls
from linktm.llm.window_packing import pack


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_piece_lattice(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    path = model or tokenizer_path("piece_bpe_32k.model")
    return encode(table(spark, sf_dir, "documents"), path)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op4_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    folder = token_folder(spark)
    index = write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer or tokenizer_path("byte_bpe_50k.json"))
    return read_digests(starts(index), folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


def op6_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "row.doc_id",
        F.coalesce(in_fold(F.col("row.doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_window_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer or tokenizer_path("word_bpe_49k.json")).drop("ids")


def op13_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_lattice": op1_piece_lattice,
    "op2_quality_rules": op2_quality_rules,
    "op3_permutation_index": op3_permutation_index,
    "op4_token_files": op4_token_files,
    "op5_mixing": op5_mixing,
    "op6_minhash_hamming": op6_minhash_hamming,
    "op7_maxent_lm": op7_maxent_lm,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_window_packing": op12_window_packing,
    "op13_dual_tree_search": op13_dual_tree_search,
}
ORACLES = oracles.ORACLES
