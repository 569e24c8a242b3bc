"""Line deduplication by range-partitioned hashes; decisions travel as bitmaps, not as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.text import SPACE_CHARS, lower_ascii, stored, whole

#: A line that is found in very many documents is first streamed in this many groups of documents.
CHUNKS = 1024
LEAST_KEY = 10


def _variant(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.hash(text)


def line_keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_key: int = LEAST_KEY,
    chunks: int = CHUNKS,
) -> DataFrame:
    """doc_id, variant and bits for each document that loses lines; bits are (word, dropped) by word.

    Bit i of word w is set if line 64 * w + i goes. Words without a set bit are left out, so the bitmap of a document
    is as long as what changes in it. A line's key is the line without outer spaces, A-Z lower-cased, as two 64-bit
    hashes. Keys of least_key code points or more stay only in the smallest doc_id that holds them.

    The hashes are range-partitioned and sorted by document and position, and the first document of each hash is the
    first row of its run. This happens twice: within chunks of documents, so that a line that a third of all documents
    share is spread over many tasks, then over the first documents of the chunks, a bounded number for each hash.

    A null text is one empty line. Rows that repeat a doc_id count as one document; variant tells their texts apart.
    Null ids are one document which comes after all others. An empty table gives no rows.
    """
    doc, hashes = F.col("doc_id"), ("h1", "h2")
    lines = (
        docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"))
        .select("doc_id", _variant(F.col("text")).alias("variant"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .select("doc_id", "variant", "at", F.btrim("line", F.lit(SPACE_CHARS)).alias("line"))
        .filter(F.char_length("line") >= least_key)
        .withColumn("key", lower_ascii(F.col("line")))
        .select(
            "doc_id",
            "variant",
            "at",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), "key").alias("h2"),
            F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"),
        )
    )

    def streamed(rows: DataFrame, *keys: str) -> DataFrame:
        order = [doc.asc_nulls_last(), F.col("at")]
        run = Window.partitionBy(*keys).orderBy(*order)
        return (
            rows.repartitionByRange(*keys)
            .sortWithinPartitions(*keys, *order)
            .withColumn("first", F.first("doc_id").over(run))
        )

    later = ~doc.eqNullSafe(F.col("first"))
    local = stored(streamed(lines, *hashes, "chunk").withColumn("later", later).drop("first", "chunk"))
    heads = streamed(local.filter(~F.col("later")).drop("later"), *hashes)
    dropped = local.filter("later").select("doc_id", "variant", "at").unionByName(
        heads.filter(later).select("doc_id", "variant", "at")
    )
    return (
        dropped.groupBy("doc_id", "variant", F.floor(F.col("at") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % 64)).alias("dropped"))
        .groupBy("doc_id", "variant")
        .agg(F.sort_array(F.collect_list(F.struct("word", "dropped"))).alias("bits"))
    )


def _dense(bits: Column) -> Column:
    """All words up to the last one, as an array of longs."""
    zero = F.lit(0).cast("long")
    return F.flatten(
        F.transform(
            bits,
            lambda x, i: F.concat(
                F.array_repeat(zero, x["word"] - F.when(i > 0, F.get(bits, i - 1)["word"] + 1).otherwise(F.lit(0))),
                F.array(x["dropped"]),
            ),
        )
    )


def apply_line_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row of docs as the struct record, with kept (its text without the dropped lines), n_lines and n_dropped."""
    rows = docs.select(F.struct("*").alias("record")).select(
        "record",
        F.col(f"record.{id_col}").alias("id"),
        whole(F.col(f"record.{text_col}")).alias("text"),
        _variant(whole(F.col(f"record.{text_col}"))).alias("of"),
    )
    marks = bitmaps.select("doc_id", "variant", _dense(F.col("bits")).alias("dense"), "bits")
    joined = rows.join(marks, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("variant")), "left")
    stays = F.filter(
        F.split("text", "\n"),
        lambda line, i: F.coalesce(
            F.call_function("shiftright", F.get("dense", F.floor(i / 64).cast("int")), i % 64).bitwiseAND(1) == 0,
            F.lit(True),
        ),
    )
    n_dropped = F.aggregate("bits", F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x["dropped"]))
    return joined.select(
        "record",
        F.when(F.col("bits").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("kept"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0)).cast("long").alias("n_dropped"),
    )


def lines_digest(applied: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return applied.select(
        F.col(f"record.{id_col}").alias("doc_id"),
        "n_lines",
        "n_dropped",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )
