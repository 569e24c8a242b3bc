"""A corpus for training in five stages, each of which works on all that the stage before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of documents,
and the last returns the packed pieces. run() writes the result of each stage to the shared folder and reads it again.

All stages take null texts and ids, texts of any length, repeated rows and further columns of any name (which are left
out). Without documents they return none. Without labels only the base rules judge; without benchmark nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.decontaminate import find_leaks
from rankloom.llm.lines import apply_line_bitmaps, line_keep_bitmaps
from rankloom.llm.packing import pack_documents
from rankloom.llm.queries import table
from rankloom.llm.rules import judged, learn_rules
from rankloom.llm.simhash import simhash_groups
from rankloom.llm.text import stored, text_stats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't express learned rules, SimHash with XXH64, edit matching in blocks or best-fit packing.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """Every row under a key of its own: the id (missing ids last) and a hash of the text."""
    missing = F.col("doc_id").isNull()
    key = F.struct(
        missing.alias("missing"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("variant"),
    )
    return docs.select(key.alias("key"), *COLUMNS)


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return docs.join(keys, "key", "left_anti").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned rules keep; a document without id is judged like others."""
    keyed = _keyed(docs)
    stats = stored(text_stats(keyed, "key").withColumnRenamed("doc_id", "key"))
    known = stats.filter("not key.missing").withColumn("doc_id", F.col("key.id"))
    rules = learn_rules(known, table(spark, sf_dir, "labels"))
    return _without(keyed, judged(stats, rules).filter("not kept").select("key").distinct())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; n_chars follows the text."""
    applied = apply_line_bitmaps(docs, line_keep_bitmaps(docs))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return applied.select(*[new.get(c, F.col(f"record.{c}")).alias(c) for c in COLUMNS])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id; documents without id come last."""
    keyed = _keyed(docs)
    groups = stored(simhash_groups(keyed, "key"))
    first = groups.filter(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("key"))
    first = stored(first.agg(F.count("*").alias("rows")))
    kept = keyed.join(first.select("key"), "key", "left_semi")
    if not first.filter("rows > 1").isEmpty():  # rows that repeat an id and a text: the least by their other columns
        others = [c for c in COLUMNS if c not in ("doc_id", "text")]
        least = kept.groupBy("key", "doc_id", "text").agg(F.min(F.struct(*others)).alias("least"))
        kept = least.select("doc_id", "text", *[F.col(f"least.{c}").alias(c) for c in others])
    return kept.select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Items under 24 characters don't decide: a word or a letter may be such an item, and any document may hold it.
    """
    keyed = _keyed(docs)
    leaks = find_leaks(keyed, table(spark, sf_dir, "benchmark"), "key").filter("not exact_short")
    return _without(keyed, leaks.select(F.col("doc_id").alias("key")).distinct())


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
