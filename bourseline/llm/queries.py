"""The dealt operators as queries over the whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, langid, lines, media, near_dup, oracles, packing, pii, recipes, spelling, substrings, token_store, turn_trie
from .common import fresh_path, load


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


def op3_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.learn_profiles(docs)
    rows = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.identify(rows, profiles, keep_text=False)


def op4_de_bruijn_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digest(load(spark, sf_dir, "documents"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(load(spark, sf_dir, "documents"))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.without_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return cut.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_removed_").alias("n_removed"), F.col("kept_sha256_").alias("kept_sha256"))


def op7_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, limits = pii.train(spark)
    return pii.digest(pii.find(load(spark, sf_dir, "documents"), model, limits))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_store.write_store(load(spark, sf_dir, "documents"), path)
    return token_store.read_digest(spark, path)


def op9_best_region_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    return html_text.extract_text(pages, html_text.learn_weights(pages))


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "media")
    media.write_media(load(spark, sf_dir, "documents"), path)
    return media.media_digest(spark.read.parquet(path))


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.shared_prefixes(load(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(load(spark, sf_dir, "documents"))


def op13_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_groups(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_latent_decontamination, op2_harmonic_packing, op3_rank_order_language, op4_de_bruijn_windows, op5_order_minhash, op6_fuzzy_lines, op7_boosted_pii, op8_token_store, op9_best_region_html, op10_transport_stream, op11_turn_trie, op12_spelling_variants, op13_chunk_recipes)}

ORACLE_SQL: dict[str, str] = {"op11_turn_trie": oracles.PREFIXES, "op12_spelling_variants": oracles.SPELLING, "op13_chunk_recipes": oracles.EXACT_GROUPS}
