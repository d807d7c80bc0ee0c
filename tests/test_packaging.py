import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
print("ROWS", entry.queries()["i4_rouge1"](spark, {sf!r}).count())
"""


def test_workers_find_the_package_from_any_folder(tmp):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(root=root, sf="/root/testdata/sf0.001")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 1" in out.stdout, out.stderr[-2000:]
