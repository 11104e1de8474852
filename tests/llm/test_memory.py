"""Executors of their own, as on a cluster: what steps leave in them goes back to the system."""

import os
import subprocess
import sys

import pytest

psutil = pytest.importorskip("psutil")
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import psutil
from pyspark.sql import SparkSession, functions as F
import corpus_pipeline

spark = SparkSession.builder.master("local-cluster[1,2,2000]").config("spark.executor.memory", "1200m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", "file://{shared}").config("spark.sql.warehouse.dir", "{shared}/warehouse").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def held():
    found = [p for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline())]
    assert len(found) == 1
    return found[0].memory_info().rss >> 20

# a sort of rows makes the heap grow
spark.range(0, 3_000_000, 1, 4).select(F.sha2(F.col("id").cast("string"), 256).alias("x")).repartition(4).sortWithinPartitions("x").agg(F.count("x"), F.max("x")).collect()
before = held()
docs = spark.createDataFrame([(1, "a few words", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
corpus_pipeline.encode(spark, docs, "")
print("HELD", before, held())
spark.stop()
"""


def test_a_stage_begins_with_executors_that_hold_little(tmp_path):
    env = os.environ | {"PYTHONPATH": os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    done = subprocess.run([sys.executable, "-c", RUN.replace("{shared}", str(tmp_path))], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "HELD" in done.stdout, done.stderr[-2000:]
    before, after = map(int, done.stdout.split("HELD")[1].split())
    assert after < 0.7 * before, (before, after)


NATIVE = RUN.replace('corpus_pipeline.encode(spark, docs, "")', """
import time
spark.sql("SELECT 1L AS doc_id, 'a few words' AS text, 'en' AS lang, 's' AS source, 11L AS n_chars").write.parquet("{shared}/documents.parquet")
spark.sql("SELECT 1L AS item_id, 'no such words in it' AS text").write.parquet("{shared}/benchmark.parquet")
ran = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
earlier = ran().size()
docs = spark.read.parquet("{shared}/documents.parquet")
corpus_pipeline.drop_benchmark(spark, docs, "{shared}").write.parquet("{shared}/kept")
spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30000)
plans = [ran().apply(i).physicalPlanDescription() for i in range(earlier, ran().size())]
print("PLANS", len(plans), [w for w in ("Python", "Pandas", "Arrow") if any(w in p for p in plans)])
print("WORKERS", [p.pid for p in psutil.Process().children(recursive=True) if "pyspark.daemon" in " ".join(p.cmdline())])
# the heap is given back a moment after it was collected
from chartloom.llm import store
store.rest(spark, python=False)
time.sleep(2)
""")


def test_decontamination_begins_with_little_and_without_python(tmp_path):
    env = os.environ | {"PYTHONPATH": os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    done = subprocess.run([sys.executable, "-c", NATIVE.replace("{shared}", str(tmp_path))], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "HELD" in done.stdout, [x[:300] for x in done.stderr.splitlines() if not x.startswith("\tat ")][-40:]
    plans, found = done.stdout.split("PLANS")[1].splitlines()[0].split(maxsplit=1)
    assert int(plans) > 3 and found == "[]", found
    assert done.stdout.split("WORKERS")[1].splitlines()[0].strip() == "[]"
    before, after = map(int, done.stdout.split("HELD")[1].split())
    assert after < 0.7 * before, (before, after)
