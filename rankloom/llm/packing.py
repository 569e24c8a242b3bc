"""Packing of texts into training sequences: best fit into bins of several permitted lengths."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.text import numbered, stored, whole

CAPACITIES = (1024, 2048, 4096, 8192)
#: Pieces that one group packs; groups are drawn by hash.
GROUP_PIECES = 50_000


def sequence_cost(capacity: int) -> float:
    """Cost of a sequence of this length: linear work, attention that grows with the square, and a fixed share."""
    return 64 + capacity * (1 + capacity / 65_536)


def _packed(lengths: Sequence[int], opened: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and what each bin holds; lengths descend, opened are the sizes that bins may have
    when they are opened, the cheapest a token first."""
    bins, offsets, used, sizes = [], [], [], []
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}
    for length in lengths:
        i = bisect_left(rooms, length)
        if i < len(rooms):
            room = rooms[i]
            held = by_room[room]
            b = held.pop()
            if not held:
                del rooms[i], by_room[room]
        else:
            b = len(used)
            used.append(0)
            sizes.append(next(c for c in opened if c >= length))
        bins.append(b)
        offsets.append(used[b])
        used[b] += length
        left = sizes[b] - used[b]
        if left:
            if left not in by_room:
                insort(rooms, left)
                by_room[left] = []
            by_room[left].append(b)
    return bins, offsets, used


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the capacity of each bin; lengths descend and fit the largest capacity.

    A piece goes to the open bin that it leaves least room in. Where none fits, a bin opens with the capacity that costs
    least for each token among those that hold the piece. Opening fewer sizes may leave less waste once bins are cut to
    what they hold, so the capacities are tried up to each limit and the packing of least total cost stays. In the end
    each bin gets the smallest capacity that holds its contents.
    """
    sizes = sorted(set(capacities))
    fits = np.array(sizes)
    best: tuple[float, tuple[list[int], list[int], list[int]]] | None = None
    for limit in range(1, len(sizes) + 1):
        tried = sorted(sizes[:limit], key=lambda c: (sequence_cost(c) / c, -c)) + sizes[limit:]
        bins, offsets, used = _packed(lengths, tried)
        final = fits[np.searchsorted(fits, used)].tolist()
        cost = sum(sequence_cost(c) for c in final)
        if best is None or cost < best[0]:
            best = (cost, (bins, offsets, final))
    return best[1] if best else ([], [], [])


def drawn(pieces: DataFrame, groups: int, group_pieces: int) -> DataFrame:
    """pieces with pack, the group that each is drawn into; equal pieces of an over-full group are drawn by number too."""
    rows = pieces.withColumn("pack", F.pmod("draw", F.lit(groups)).cast("int"))
    over = stored(rows.groupBy("pack").count().filter(F.col("count") > 2 * group_pieces).select("pack"))
    if over.isEmpty():
        return rows.drop("place")
    again = F.pmod(F.xxhash64("draw", "copy"), F.lit(groups)).cast("int")
    spread = numbered(rows.join(F.broadcast(over), "pack", "left_semi"), "draw")
    spread = spread.withColumn("pack", F.when(F.col("copy") == 0, F.col("pack")).otherwise(again))
    rest = rows.join(F.broadcast(over), "pack", "left_anti").drop("place")
    return rest.unionByName(spread.select(*rest.columns))


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacities: Sequence[int] = CAPACITIES,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """(doc_id, piece, start, length, pack, bin, capacity, position): where each piece of each document lies.

    Tokens are the UTF-8 bytes of the text and one end mark, so a null or empty text is one token. A document longer than
    the largest capacity is cut into pieces of that length and a rest; start is the piece's first token. pack and bin name
    a sequence, capacity is its length, position the piece's place in it. Every token of every row lies in one place.

    Pieces are drawn into groups by hash and each group is packed by itself; groups hold some group_pieces pieces, so
    what is lost against one packing of all is less than a sequence of each size for each group. Pieces of null ids and
    repeated rows have equal draws; where they would fill a group to more than twice that, each is drawn by its number too. An empty table gives no rows.
    """
    top = max(capacities)
    text = whole(F.col("text"))
    tokens = (F.octet_length(text) + 1).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", tokens.alias("tokens"), F.xxhash64("doc_id", "text").alias("draw")
    )
    pieces = stored(
        sized.select(
            "doc_id",
            "tokens",
            "draw",
            F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / top))).alias("piece"),
        ).select(
            "doc_id",
            F.col("piece").cast("int").alias("piece"),
            (F.col("piece") * top).cast("long").alias("start"),
            F.least(F.lit(top).cast("long"), F.col("tokens") - F.col("piece") * top).cast("int").alias("length"),
            F.xxhash64("draw", "piece").alias("draw"),
            F.monotonically_increasing_id().alias("place"),
        )
    )
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    sizes = tuple(capacities)

    def packed(rows: pa.Table) -> pa.Table:
        lengths = rows["length"].to_numpy()
        order = np.lexsort((rows["start"].to_numpy(), rows["draw"].to_numpy(), -lengths))
        bins, offsets, final = best_fit(lengths[order].tolist(), sizes)
        rows = rows.take(pa.array(order)).select(["doc_id", "piece", "start", "length", "pack"])
        added = {"bin": bins, "capacity": np.array(final, np.int32)[bins], "position": offsets}
        for name, values in added.items():
            rows = rows.append_column(name, pa.array(np.array(values, np.int32)))
        return rows

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return (
        drawn(pieces, groups, group_pieces)
        .groupBy("pack")
        .applyInArrow(
            packed,
            f"doc_id {kind}, piece int, start long, length int, pack int, bin int, capacity int, position int",
        )
    )
