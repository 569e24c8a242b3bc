"""Column expressions; all built in, none a UDF."""

from rankloom.functions.columns import (
    kv_lookup,
    nth,
    page_flag,
    pairs_with_key,
    ratio,
    source_mask,
)

__all__ = ["kv_lookup", "nth", "page_flag", "pairs_with_key", "ratio", "source_mask"]
