"""Writing result tables and reading them back, also in a later session."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class TableStore:
    """Named Parquet tables below one folder that all executors share, each replaced as a whole.

    A table is a folder of numbered versions; the newest complete one counts. A replacement is a
    new version, so a query that reads the table may write it, and readers of the former version
    are not disturbed. Versions before that one are removed. Another store on the same folder, in
    this session or a later one, finds the same tables; a store on another folder never does.
    One writer at a time may replace a table. Files are handled through the session's JVM, so a
    Spark Connect session cannot have a store.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._files = hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        """Numbers of all versions in order, complete or not."""
        folder = self._path(f"{self.root}/{name}")
        if not self._files.exists(folder):
            return []
        found = [entry.getPath().getName() for entry in self._files.listStatus(folder)]
        return sorted(int(text[1:]) for text in found if re.fullmatch(r"v\d+", text))

    def _folder(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version}"

    def _schema_file(self, name: str, version: int) -> str:
        return f"{self._folder(name, version)}.schema"

    def _complete(self, name: str) -> list[int]:
        return [
            version
            for version in self._versions(name)
            if self._files.exists(self._path(self._schema_file(name, version)))
        ]

    def has(self, name: str) -> bool:
        """Whether there is a complete table of this name."""
        return bool(self._complete(name))

    def replace(self, name: str, rows: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Write ``rows`` as table ``name`` and return the stored table.

        Rows are written where they are; a task writes a file for each partition value it holds.
        """
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"a table name has letters, digits and _ only: {name!r}")
        version = max(self._versions(name), default=0) + 1
        folder = self._folder(name, version)
        writer = rows.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(folder)
        # The schema comes last: a version without it was never finished.
        file = self._files.create(self._path(self._schema_file(name, version)), True)
        file.write(bytearray(rows.schema.json(), "utf-8"))
        file.close()
        for old in self._versions(name):
            if old < version - 1:
                self._files.delete(self._path(self._schema_file(name, old)), False)
                self._files.delete(self._path(self._folder(name, old)), True)
        return self.table(name)

    def replace_sorted(self, name: str, rows: DataFrame, *order: str | Column) -> DataFrame:
        """Write ``rows`` as table ``name`` in the given order and return the stored table.

        Each file holds one range of the order, sorted, and the numbers of the files follow it. A
        reader of the files one after the other has the whole order; ``sorted_table`` restores it.
        """
        return self.replace(name, rows.orderBy(*order))

    def sorted_table(self, name: str) -> DataFrame:
        """The newest version of a table that ``replace_sorted`` wrote, in the order it was written.

        Rows are put in order by the number of their file and their place in it, without a look at
        the columns that they were sorted by.
        """
        rows = self.table(name)
        number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint")
        placed = rows.select(
            "*", number.alias("_file"), F.col("_metadata.row_index").alias("_place")
        )
        return placed.orderBy("_file", "_place").select(*rows.columns)

    def table(self, name: str) -> DataFrame:
        """The newest complete version of table ``name``, its columns in the order they had."""
        complete = self._complete(name)
        if not complete:
            raise ValueError(f"no table {name!r} in {self.root}")
        folder, file = self._folder(name, complete[-1]), self._schema_file(name, complete[-1])
        text = self.spark.read.text(file, wholetext=True).first().value
        schema = StructType.fromJson(json.loads(text))
        return self.spark.read.schema(schema).parquet(folder).select(*schema.names)

    def view(self, name: str) -> str:
        """Make table ``name`` a temp view, and return the view's name, which this folder owns."""
        view = f"{name}_{uuid.uuid5(uuid.NAMESPACE_URL, self.root).hex}"
        self.table(name).createOrReplaceTempView(view)
        return view
