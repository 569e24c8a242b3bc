"""Readers, date filters and table writers."""

from rankloom.sources.sinks import TableStore
from rankloom.sources.tables import (
    on_date,
    on_dates,
    on_timestamp_dates,
    read_prefixed,
    read_table,
    since_date,
    since_timestamp_date,
    table_date,
)

__all__ = [
    "TableStore",
    "on_date",
    "on_dates",
    "on_timestamp_dates",
    "read_prefixed",
    "read_table",
    "since_date",
    "since_timestamp_date",
    "table_date",
]
