"""Joins whose plan depends on how large, or how uneven, a side can be."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

BROADCAST_BYTES = 512 * 1024 * 1024
ROW_BYTES = 32
NUMBER_BYTES = 8
TEXT_BYTES = 64
# Bits of a key in a bitmap, and bits in a block of it (what bitmap_construct_agg builds).
KEY_BITS = 16
BLOCK_BITS = 4096 * 8
# Places that the rows of a key are dealt to where they meet wanted keys in a shuffle.
SPREAD = 16
# Keys that are cut into slices, the heaviest first. A key beyond them holds less than one row in
# this many, which needs no slices.
MAX_HEAVY_KEYS = 100_000


def row_bytes(rows: DataFrame) -> int:
    """Bytes of a row of ids (texts of up to 64 bytes) and numbers."""
    width = ROW_BYTES
    for field in rows.schema.fields:
        width += NUMBER_BYTES if isinstance(field.dataType, NumericType) else TEXT_BYTES
    return width


def fits_broadcast(rows: DataFrame, max_rows: int | None) -> bool:
    """Whether ``max_rows`` rows of this schema stay below the broadcast limit."""
    return max_rows is not None and max_rows * row_bytes(rows) <= BROADCAST_BYTES


def held_size(rows: DataFrame) -> tuple[int, int]:
    """Number of rows, and the bytes they take in a broadcast. The bytes of their texts are counted."""
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, StringType)]
    fixed = ROW_BYTES + NUMBER_BYTES * (len(rows.columns) - len(texts))
    size = F.lit(fixed).cast("bigint")
    for name in texts:
        size = size + F.coalesce(F.octet_length(name), F.lit(0))
    held = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return held.n, held.bytes


def semi_join(
    rows: DataFrame, wanted: DataFrame, keys: Sequence[str], max_rows: int | None = None
) -> DataFrame:
    """Rows whose ``keys`` occur in ``wanted``; ``rows`` is read once at any number of keys.

    Where ``max_rows`` bounds the distinct keys and they fit, digests of a fixed width (SHA-256)
    are broadcast. Otherwise the keys are counted first, and broadcast as they are if they fit.
    Beyond that a hashed bitmap of them is broadcast, some two bytes a key and never more than the
    limit: it drops nearly all other rows where they are read, and what is left meets the keys in a
    shuffle. A NULL key has no match.
    """
    keys = list(keys)
    wanted = wanted.select(*keys).dropna(subset=keys).distinct()
    digests = wanted.select(_digest(wanted, keys).alias("_key"))
    if fits_broadcast(digests, max_rows):
        found = rows.withColumn("_key", _digest(rows, keys))
        return found.join(F.broadcast(digests), "_key", "left_semi").select(*rows.columns)
    held, size = held_size(wanted)
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(wanted), keys, "left_semi").select(*rows.columns)
    return exact_semi_join(maybe_in(rows, wanted, keys, held), wanted, keys)


def bitmap_bits(keys: int) -> int:
    """Bits of a bitmap for so many keys: a power of two, whole blocks, no more than may be broadcast."""
    most = 1 << max(0, (BROADCAST_BYTES * 8).bit_length() - 1)
    return max(BLOCK_BITS, min(most, 1 << (KEY_BITS * max(1, keys) - 1).bit_length()))


def key_bitmap(wanted: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """``_block`` and ``_bits``: the hashed keys as bits in blocks of 4 KB. Blocks without keys are left out."""
    place = _bit_of(keys, bits)
    placed = wanted.select(
        F.floor(place / BLOCK_BITS).cast("int").alias("_block"), (place % BLOCK_BITS).alias("_bit")
    )
    return placed.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def _bit_of(keys: Sequence[str], bits: int):
    return F.pmod(F.xxhash64(*keys), F.lit(bits).cast("bigint"))


def maybe_in(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], held: int) -> DataFrame:
    """Rows whose keys may occur in ``wanted`` (``held`` distinct keys): all that do, and few others.

    No row is shuffled. With two bytes a key about one row in sixteen of the others is left.
    """
    bits = bitmap_bits(held)
    known = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in keys])
    place = _bit_of(keys, bits)
    bit = place % BLOCK_BITS
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    set_there = F.getbit(byte.cast("bigint"), (bit % 8).cast("int")) == 1
    blocks = F.broadcast(key_bitmap(wanted, keys, bits))
    placed = rows.filter(known).withColumn("_block", F.floor(place / BLOCK_BITS).cast("int"))
    return placed.join(blocks, "_block").filter(set_there).select(*rows.columns)


def exact_semi_join(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys occur in ``wanted``, met in a shuffle; ``wanted`` holds each key once.

    Rows of a key are dealt by their content to ``SPREAD`` places, each of which has all keys, so a
    key with a large part of the rows meets them in many tasks. A row always lands in the same
    place, also when a task runs again.
    """
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    dealt = rows.withColumn("_spread", spread)
    copied = wanted.select(*keys, copies.alias("_spread")).hint("merge")
    return dealt.join(copied, [*keys, "_spread"], "left_semi").select(*rows.columns)


def _digest(rows: DataFrame, keys: Sequence[str]):
    known = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in keys])
    texts = [F.col(key).cast("string") for key in keys]
    # Lengths in front keep ("a", "bc") and ("ab", "c") apart.
    sized = [part for text in texts for part in (F.length(text).cast("string"), text)]
    return F.when(known, F.sha2(F.concat_ws("|", *sized), 256))


def spread_join(
    many: DataFrame,
    few: DataFrame | Callable[[DataFrame | None], DataFrame],
    keys: Sequence[str],
    heavy: int,
) -> DataFrame:
    """Inner join that cuts a key with more than ``heavy`` rows in ``many`` into slices.

    The rows of ``few``, a limited number for each key, are copied to every slice of such a key.
    Equal rows of ``many`` are counted before they travel, and cut into portions of ``heavy`` at
    most; each portion has a slice of its own and becomes rows again after the join. So slices do
    not depend on how alike the rows are, nor on the order they arrive in.

    ``few`` may be a function that takes a small frame of keys, or None for all, and returns the
    rows of those keys: then the work behind it is not done a second time for the other keys.
    At most ``MAX_HEAVY_KEYS`` keys are sliced, the heaviest; all other keys are joined plainly.
    Without any heavy key, Spark drops the sliced part at run time.
    """
    keys = list(keys)
    counts = many.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > heavy)
    slices = F.ceil(F.col("_rows") / heavy).cast("int").alias("_slices")
    largest = counts.orderBy(F.desc("_rows"), *keys).limit(MAX_HEAVY_KEYS)
    busy = F.broadcast(largest.select(*keys, slices))
    only = F.broadcast(largest.select(*keys))
    if callable(few):
        everyone, chosen_few = few(None), few(only)
    else:
        everyone, chosen_few = few, few.join(only, keys, "left_semi")
    light = many.join(busy, keys, "left_anti").join(everyone, keys)
    columns = many.columns
    portions = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / heavy).cast("int")),
            lambda n: F.struct(
                n.alias("number"),
                F.least(F.lit(heavy).cast("bigint"), F.col("_copies") - n * heavy).alias("times"),
            ),
        )
    ).alias("_portion")
    equal = many.join(busy, keys).groupBy(*columns, "_slices").agg(F.count("*").alias("_copies"))
    cut = equal.select(*columns, "_slices", portions)
    chosen = F.pmod(F.xxhash64(*columns) + F.col("_portion.number"), F.col("_slices"))
    cut = cut.select(*columns, F.col("_portion.times").alias("_times"), chosen.cast("int").alias("_slice"))
    # Slices are small before the join. Without a stated number of partitions and kind of join
    # they would be put together in one task, or be broadcast to the task that holds the key.
    partitions = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.repartition(partitions, *keys, "_slice").hint("merge")
    copies = F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))
    copied = chosen_few.join(busy, keys).withColumn("_slice", copies).drop("_slices")
    met = cut.join(copied, [*keys, "_slice"]).drop("_slice")
    once = F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_once")
    sliced = met.select("*", once).drop("_times", "_once")
    return light.unionByName(sliced)
