"""The package reaches workers that can't import it from their own folder."""

import os
import subprocess
import sys
from pathlib import Path

from .conftest import SMALL

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from barloom.functions.shipping import ship
from barloom.plans.catalog import QUERIES
ship(spark)
print("rows", QUERIES["FAC5_two_factor_ols"](spark, {sf!r}).count())
"""


def test_queries_run_from_another_folder(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    code = SCRIPT.format(root=root, sf=SMALL)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows" in done.stdout, done.stderr[-2000:]
