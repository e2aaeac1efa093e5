"""Workers that don't have the package on their path: the operators are sent to them whole."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})  # the driver's path alone
import __spark_entry__ as entry
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
seen = spark.range(1).rdd.map(lambda _: any("marginalia" in m for m in __import__("sys").modules) or __import__("importlib").util.find_spec("marginalia") is not None).collect()
assert seen == [False], "workers have the package, so this shows nothing"
for name, f in entry.queries().items():
    if name.startswith("op"):
        f(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("done", name, flush=True)
"""


def test_operators_run_where_workers_lack_the_package(tmp_path):
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    assert out.stdout.count("done op") == 13
