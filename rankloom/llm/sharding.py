"""Sharding with a two-pass external shuffle: scatter to buckets that fit memory, then shuffle each in memory."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.text import numbered, stored

#: Names of the columns that shuffle_shards adds; the record itself is one struct, so no name can clash.
ADDED = ("shard", "slot", "grown_shard")


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the largest seeded hash of key and shard number. A further shard takes rows only into itself."""
    tickets = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.greatest(*tickets)["s"] if shards > 1 else F.lit(0)


def bucketed(
    records: DataFrame,
    shards: int,
    id_col: str,
    text_col: str,
    seed: int,
    bucket_bytes: int,
    buckets_in_task: int,
) -> tuple[DataFrame, int]:
    """(record, shard, grown_shard, order, bucket) for each record, and the tasks that the buckets are dealt to.

    A shard has as many buckets as its own bytes fill, so a shard that holds a heavy id has more of them. The bucket is
    drawn by a hash of all columns, so records of one id spread over the buckets of its shard. Equal records meet in one
    bucket; where a bucket is counted at more than twice bucket_bytes, its equal records are numbered, and all but the
    first are drawn by that number too. Which of them gets which number changes nothing, so reruns agree.
    """
    text = F.col(f"record.{text_col}")
    key = F.col(f"record.{id_col}")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    packed = records.select(F.struct("*").alias("record"))
    placed = packed.withColumn("shard", shard_of(key, shards, seed))
    held = {r["shard"]: r["bytes"] for r in placed.groupBy("shard").agg(F.sum(size).alias("bytes")).collect()}
    parts = [max(1, math.ceil(held.get(s, 0) / bucket_bytes)) for s in range(shards)]
    heads = [0, *accumulate(parts)]
    head, number = (F.get(F.array(*[F.lit(x).cast("long") for x in xs]), F.col("shard")) for xs in (heads, parts))
    scattered = (
        placed.withColumn("grown_shard", shard_of(key, shards + 1, seed))
        .withColumn("order", F.xxhash64(F.lit(seed + 1), "record"))
        .withColumn("bucket", head + F.pmod("order", number))
    )
    tasks = max(1, math.ceil(heads[-1] / buckets_in_task))
    over = stored(
        scattered.groupBy("bucket").agg(F.sum(size).alias("bytes")).filter(F.col("bytes") > 2 * bucket_bytes).select("bucket")
    )
    if over.isEmpty():
        return scattered, tasks
    full = stored(scattered.join(F.broadcast(over), "bucket", "left_semi").withColumn("place", F.monotonically_increasing_id()))
    again = head + F.pmod(F.xxhash64(F.lit(seed + 2), "order", "copy"), number)
    spread = numbered(full, "order").withColumn("bucket", F.when(F.col("copy") == 0, F.col("bucket")).otherwise(again))
    rest = scattered.join(F.broadcast(over), "bucket", "left_anti")
    return rest.unionByName(spread.select(*rest.columns)), tasks


def shuffle_shards(
    records: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 20240,
    bucket_bytes: int = 4 << 20,
    buckets_in_task: int = 8,
) -> DataFrame:
    """Every record once, with its shard, its slot there (gapless from 0) and its shard if there were one more.

    Returns (record, shard, slot, grown_shard); record is a struct of all columns of records. The law is `key`: id and
    number of shards decide the shard. Pass one scatters the records with seeded hashes into buckets of about
    bucket_bytes, numbered so that a shard's buckets follow each other (see bucketed). Pass two puts each bucket in one order (by seeded
    hash, then by the record's columns), and F.shuffle, which is a Fisher-Yates shuffle, permutes it. The number of
    partitions follows from the data alone, so a rerun and a task that is run again give the same slots.

    Bucket sizes count UTF-8 bytes of the text plus 1. A longer record makes its bucket that much longer. Null ids are
    one key and share a shard. Null texts have size 1; an empty table gives no rows.
    """
    rows, tasks = bucketed(records, shards, id_col, text_col, seed, bucket_bytes, buckets_in_task)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "bucket")
        .count()
        .select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long").alias("before"))
    )
    shuffled = (
        rows.repartition(tasks, "bucket")
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list(F.struct("order", "shard", "grown_shard", "record"))).alias("rows"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("place", "row"))
    )
    return shuffled.join(offsets, "bucket").select(
        "row.record",
        "row.shard",
        (F.col("before") + F.col("place")).alias("slot"),
        "row.grown_shard",
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder for each shard; the files of a folder, in the order of their first slot, hold its records in order."""
    (
        shuffled.select("record.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
        .sortWithinPartitions("_shard", "_slot")
        .write.mode("overwrite")
        .partitionBy("_shard")
        .parquet(path)
    )


def shards_digest(shuffled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(f"record.{text_col}"), F.lit(""))
    return shuffled.select(
        F.col(f"record.{id_col}").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        "grown_shard",
    )
