"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import oracles
from rankloom.llm.decontaminate import find_leaks
from rankloom.llm.language import learn_any_languages, page_languages
from rankloom.llm.lines import apply_line_bitmaps, line_keep_bitmaps, lines_digest
from rankloom.llm.packing import pack_documents
from rankloom.llm.pieces import encode_and_decode, pieces_digest
from rankloom.llm.ranking import learn_ranking, ranked
from rankloom.llm.rules import judged, learn_rules
from rankloom.llm.runs import find_runs, runs_digest
from rankloom.llm.secrets import find_secrets, secrets_digest
from rankloom.llm.sharding import shards_digest, shuffle_shards
from rankloom.llm.simhash import simhash_digest, simhash_groups
from rankloom.llm.suffixes import remove_repeats, repeats_digest
from rankloom.llm.text import stored, text_stats
from rankloom.llm.variants import count_words, spelling_variants


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets_digest(find_secrets(table(spark, folder, "documents")))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shards_digest(shuffle_shards(table(spark, folder, "documents")))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return lines_digest(apply_line_bitmaps(docs, line_keep_bitmaps(docs)))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    langs, likelihoods = learn_any_languages(table(spark, folder, "documents"))
    return page_languages(table(spark, folder, "pages"), langs, likelihoods)


def op7_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats_digest(remove_repeats(table(spark, folder, "documents")))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    stats = stored(text_stats(table(spark, folder, "documents")))
    rules = learn_rules(stats, table(spark, folder, "labels"))
    return judged(stats, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_digest(simhash_groups(table(spark, folder, "documents")))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    stats = stored(text_stats(table(spark, folder, "documents")))
    return ranked(stats, learn_ranking(stats, table(spark, folder, "labels")))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(count_words(table(spark, folder, "documents"), 7, 2, planted=True))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs_digest(find_runs(table(spark, folder, "documents"), planted=True))


def op13_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces_digest(encode_and_decode(table(spark, folder, "documents"), model))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scans,
        op2_best_fit_packing,
        op3_benchmark_decontamination,
        op4_sharding,
        op5_line_dedup,
        op6_language_id,
        op7_suffix_array_dedup,
        op8_quality_rules,
        op9_simhash_near_dedup,
        op10_quality_classifier,
        op11_spelling_variants,
        op12_periodic_runs,
        op13_sentencepiece,
        pipeline,
    )
}
ORACLES: dict[str, str] = {"op1_secret_scans": oracles.SECRETS, "op5_line_dedup": oracles.LINES}
