"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The retrieval sources and their bit in a presence mask.
SOURCE_BITS = {"solr": 1, "nir": 2, "xwalk": 4, "xml": 8}


def pairs_with_key(pairs: str | Column, key: str) -> Column:
    """The entries of an array of key/value structs that carry ``key``, in array order."""
    return F.filter(pairs, lambda entry: entry["key"] == key)


def kv_lookup(pairs: str | Column, key: str, strict: bool = False) -> Column:
    """Value stored under ``key``, NULL when it is missing.

    A repeated key gives its first value, or an error when ``strict``.
    """
    hits = pairs_with_key(pairs, key)
    value = F.get(hits, F.lit(0))["value"]
    if strict:
        return F.when(F.size(hits) > 1, F.raise_error(f"key {key} occurs twice")).otherwise(value)
    return value


def nth(array: str | Column, position: int, strict: bool = False) -> Column:
    """Zero-based array element; past the end it is NULL, or an error when ``strict``."""
    array = F.col(array) if isinstance(array, str) else array
    value = F.get(array, F.lit(position))
    if strict:
        beyond = F.raise_error(f"array has no element {position}")
        return F.when(F.size(array) <= position, beyond).otherwise(value)
    return value


def ratio(part: Column, whole: Column, strict: bool = False) -> Column:
    """``part / whole`` as a double; a zero ``whole`` gives NULL, or an error when ``strict``."""
    if strict:
        whole = F.when(whole == 0, F.raise_error("division by zero")).otherwise(whole)
    return F.try_divide(part.cast("double"), whole.cast("double"))


def source_mask() -> Column:
    """Which retrieval sources returned the listing, one bit for each."""
    bits = [F.when(F.col(name).isNotNull(), bit).otherwise(0) for name, bit in SOURCE_BITS.items()]
    return sum(bits[1:], bits[0])


def page_flag(rank: str, platform: str, page_sizes: dict[str, int], pages: int = 1) -> Column:
    """1 when ``rank`` lies on the first ``pages`` pages of the platform, else 0.

    An unknown or NULL platform and a NULL rank give 0.
    """
    limit = F.lit(None).cast("int")
    for name, size in page_sizes.items():
        limit = F.when(F.col(platform) == name, F.lit(size) * F.lit(pages)).otherwise(limit)
    return F.when(F.col(rank) <= limit, 1).otherwise(0)
