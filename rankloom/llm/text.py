"""Text expressions and storage that several operators share. All built-in functions, no Python on rows."""

from __future__ import annotations

import atexit
import shutil
import string
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters that separate words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
_UPPER = r"[^A-ZÀ-ÖØ-Þ]+"
_SYMBOLS = r"[^#*$%&|<>]+"
_DIGITS = r"[^0-9]+"


def whole(text: Column) -> Column:
    """The text; empty where it is null."""
    return F.coalesce(text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Texts of one byte a character take the fast path."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words_of(text: Column) -> Column:
    """The words of a text, in order; an empty array if there is none."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def _only(text: Column, others: str) -> Column:
    """Number of characters left when runs of others are taken out."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts on every whole text, one row for each row of docs: doc_id and the columns of COUNTS.

    A null or empty text has no words and counts of 0. Everything is counted inside the row, so nothing is shuffled; a
    repeated 3-word window is found by sorting the hashes of the windows of its own text.

    Store the result (see stored) before filtering on its counts: the optimizer moves a filter below the steps here and
    repeats their expressions within each other, so that planning takes very long.
    """
    three = F.lit(3)
    first = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"))
    split = first.select(
        "doc_id",
        "text",
        words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias("lines"),
    )
    counted = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[^\x20\x09-\x0D]+", "")))
        .cast("long")
        .alias("word_chars"),
        _only(F.col("text"), _SYMBOLS).alias("n_symbols"),
        _only(F.col("text"), _UPPER).alias("n_upper"),
        _only(F.col("text"), _DIGITS).alias("n_digits"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.when(
            F.size("words") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - three),
                lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("windows"),
    )
    again = counted.withColumn(
        "sorted",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
        ),
    )
    places = again.withColumn(
        "at",
        F.sort_array(
            F.transform(
                F.filter(
                    "sorted",
                    lambda x, i: (x["h"] == F.get("sorted", i - 1)["h"]) | (x["h"] == F.get("sorted", i + 1)["h"]),
                ),
                lambda x: x["at"],
            )
        ),
    )
    covered = F.transform("at", lambda p, i: F.coalesce(F.least(three, F.get("at", i + 1) - p), three))
    return places.select(
        "doc_id",
        *[c for c in COUNTS if c != "n_repeat_words"],
        F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias(
            "n_repeat_words"
        ),
    )


#: Columns of text_stats beside doc_id.
COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_upper",
    "n_digits",
    "n_lines",
    "n_dup_lines",
    "n_distinct_words",
    "n_repeat_words",
)


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)).cast("double")


def features() -> dict[str, Column]:
    """Features of a text as expressions over the columns of text_stats; all are defined for empty texts."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _ratio("word_chars", "n_words"),
        "symbols": _ratio("n_symbols", "n_words"),
        "upper": _ratio("n_upper", "word_chars"),
        "digits": _ratio("n_digits", "word_chars"),
        "dup_lines": _ratio("n_dup_lines", "n_lines"),
        "repeats": _ratio("n_repeat_words", "n_words"),
        "variety": _ratio("n_distinct_words", "n_words"),
    }


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """A folder of this process for local sessions without a setting; it is removed at exit."""
    base = tempfile.mkdtemp(prefix="rankloom-")
    atexit.register(shutil.rmtree, base, True)
    return base


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, the folder that all executors share.

    Where that is unset, a local session (as in tests) gets a folder of its own; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
        spark.sparkContext.setCheckpointDir(base)
    _MADE.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _MADE[-1]


#: Folders that this process has named.
_MADE: list[str] = []


def drop_stored(spark: SparkSession) -> int:
    """Remove the intermediate tables of all operators that ran in this process; how many there were.

    A result may still read them, so write or collect it first.
    """
    dropped = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        dropped += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return dropped


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there. Any executor can read them again."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with copy, the number of a row among those of equal key, from 0. No key's rows are brought together.

    rows are stored with a column place, written from monotonically_increasing_id(). A row's number is that of the rows
    which earlier tasks wrote, and its place among those of its own task. Where rows of equal key are equal, which of them
    gets which number changes nothing, so reruns agree, however the rows lie.
    """
    rows = rows.withColumn("task", F.shiftright("place", 33))
    before = Window.partitionBy(key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(key, "task").count()
    counts = counts.select(key, "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    own = F.row_number().over(Window.partitionBy(key, "task").orderBy("place"))
    return rows.join(counts, [key, "task"]).withColumn("copy", F.col("earlier") + own - 1).drop("task", "earlier", "place")


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, by checkpoint() into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
