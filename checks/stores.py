"""Folders for the tables the checks store."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from rankloom.sources import TableStore


def shared_root(spark: SparkSession) -> str:
    """A new folder below the shared folder of the cluster.

    A session in one process (``local``) without such a folder gets a temporary one that goes when
    Python ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        shared = tempfile.mkdtemp(prefix="rankloom-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    if shared is None:
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    return f"{shared.rstrip('/')}/rankloom-{uuid.uuid4().hex}"


def new_store(spark: SparkSession) -> TableStore:
    return TableStore(spark, shared_root(spark))
