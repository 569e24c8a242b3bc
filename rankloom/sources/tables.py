"""Reading tables and restricting them to dates in a form the scan can prune with."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, source: str) -> DataFrame:
    """One table: a path of Parquet files, or the name of a catalog table or view."""
    return spark.read.parquet(source) if "/" in source else spark.table(source)


def table_date(name: str, prefix: str, pattern: str = "%Y%m%d") -> date | None:
    """The date in a table's name after ``prefix``, without an extension; None if there is none."""
    try:
        return datetime.strptime(name[len(prefix) :].split(".")[0], pattern).date()
    except ValueError:
        return None


def prefixed_names(
    names: Sequence[str],
    prefix: str,
    since: date | None = None,
    until: date | None = None,
    pattern: str = "%Y%m%d",
) -> list[str]:
    """The names that start with ``prefix``, without those whose date is out of range.

    Both bounds are included. A name without a date is kept: nothing says that it is out of range.
    """
    kept = []
    for name in sorted(names):
        if name.startswith(prefix):
            day = table_date(name, prefix, pattern)
            if day is None or ((since is None or day >= since) and (until is None or day <= until)):
                kept.append(name)
    return kept


def _entries(spark: SparkSession, folder: str) -> list[str]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [entry.getPath().getName() for entry in files.listStatus(path)]


def read_prefixed(
    spark: SparkSession,
    folder: str,
    prefix: str,
    schema: StructType | str | None = None,
    since: date | None = None,
    until: date | None = None,
    pattern: str = "%Y%m%d",
) -> DataFrame:
    """Every table in ``folder`` whose name starts with ``prefix``, as one.

    ``folder`` is a folder of Parquet tables, or the name of a catalog's database. With ``since`` or
    ``until`` the dates in the tables' names choose the tables: the others are not opened, not even
    for their schemas.

    Columns missing from a table are NULL. Pass ``schema`` for a large set: without it the footers
    of all files are read first to merge their schemas.
    """
    if "/" not in folder:
        listed = {t.name: t for t in spark.catalog.listTables(folder)}
        found = [listed[n] for n in prefixed_names(list(listed), prefix, since, until, pattern)]
        if not found:
            raise ValueError(f"no table in {folder!r} starts with {prefix!r}")
        names = [f"`{t.name}`" if t.isTemporary else f"{folder}.`{t.name}`" for t in found]
        tables = [spark.table(name) for name in names]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    reader = spark.read
    reader = reader.schema(schema) if schema is not None else reader.option("mergeSchema", "true")
    if since is None and until is None:
        return reader.parquet(f"{folder}/{prefix}*")
    names = prefixed_names(_entries(spark, folder), prefix, since, until, pattern)
    if not names:
        raise ValueError(f"no table in {folder!r} starts with {prefix!r} in these dates")
    return reader.parquet(*[f"{folder}/{name}" for name in names])


def on_dates(rows: DataFrame, dates: Sequence[date], column: str = "dt") -> DataFrame:
    """Rows of the listed dates; prunes partitions when ``column`` is a partition column."""
    return rows.filter(F.col(column).isin(list(dates)))


def on_date(rows: DataFrame, day: date, column: str = "dt") -> DataFrame:
    return rows.filter(F.col(column) == F.lit(day))


def since_date(rows: DataFrame, day: date, column: str = "dt") -> DataFrame:
    return rows.filter(F.col(column) >= F.lit(day))


def on_timestamp_dates(rows: DataFrame, dates: Sequence[date], column: str) -> DataFrame:
    """Rows whose timestamp falls on a listed date.

    The list test alone does not reach the Parquet scan, so the range it spans is stated as well.
    """
    if not dates:
        return rows.filter(F.lit(False))
    moment = rows.select(column).schema[0].dataType
    first = F.lit(min(dates)).cast(moment)
    after = F.lit(max(dates) + timedelta(days=1)).cast(moment)
    within = (F.col(column) >= first) & (F.col(column) < after)
    return rows.filter(within & F.to_date(column).isin(list(dates)))


def since_timestamp_date(rows: DataFrame, day: date, column: str) -> DataFrame:
    """Rows whose timestamp falls on ``day`` or later."""
    return rows.filter(F.to_date(column) >= F.lit(day))
