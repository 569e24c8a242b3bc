"""Where intermediate tables go, and that they can be removed."""

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from rankloom.llm.text import drop_stored, shared_dir, stored

ALONE = """
from pyspark.sql import SparkSession
from rankloom.llm.text import cut, drop_stored, shared_dir, stored
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert stored(spark.range(5)).count() == 5 and cut(spark.range(4)).count() == 4
assert shared_dir(spark) != shared_dir(spark) and drop_stored(spark) == 1
print("well")
"""


def test_a_local_session_without_the_setting(tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}
    out = subprocess.run([sys.executable, "-c", ALONE], env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("well"), out.stderr[-2000:]


def test_a_cluster_without_the_setting_is_told_which():
    settings = {"spark.master": "spark://somewhere:7077"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_intermediate_tables_are_removed(spark):
    drop_stored(spark)
    held = stored(spark.range(7))
    (path,) = {Path(p.removeprefix("file:")).parent for p in held.inputFiles()}
    assert path.exists() and drop_stored(spark) == 1 and not path.exists()
