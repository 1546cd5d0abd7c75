"""Executor loss: tasks that die on their first attempt must not change any result.

Runs in a subprocess with ``local[2,4]`` (up to 4 attempts per task); a Python
UDF upstream of each operator raises on attempt 0 of every other partition.
"""

import os
import subprocess
import sys

SCRIPT = r'''
import sys
sys.path.insert(0, ROOT)
import numpy as np
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from papyra.session import prepare
from papyra.operators.chunking import chunk_documents
from papyra.operators import vectors as VO
from papyra.operators import ingest as I

spark = (SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
prepare(spark)

@F.udf("string")
def flaky(x):
    tc = TaskContext.get()
    if tc.attemptNumber() == 0 and tc.partitionId() % 2 == 0:
        raise RuntimeError("simulated executor loss")
    return x

def run(inject):
    wrap = (lambda c: flaky(c)) if inject else (lambda c: c)
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 400 + 5))) for i in range(300)],
                                 "id long, t string").repartition(6)
    ch = chunk_documents(docs.withColumn("t", wrap(F.col("t"))), "t", ["id"], 120, 30)
    chunks = sorted(tuple(r) for r in ch.collect())
    vec = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)],
                                "id long, vector array<float>").repartition(5)
    vec = vec.withColumn("tag", wrap(F.col("id").cast("string")))
    q = spark.createDataFrame([(j, [float(x) for x in rng.normal(size=8)]) for j in range(3)],
                              "query_id long, vector array<float>")
    top = sorted(tuple(r) for r in VO.exact_topk(vec, q, 4).select("query_id", "id", "score").collect())
    names = spark.createDataFrame([(f"f{i:04d}",) for i in range(500)], "file_name string").repartition(5)
    names = names.withColumn("file_name", wrap(F.col("file_name")))
    batches = sorted(tuple(r) for r in I.assign_batches(names, ["file_name"], 64).collect())
    return chunks, top, batches

clean = run(False)
flaky_run = run(True)
assert clean == flaky_run, "results changed under task retries"
print("RETRY-OK", len(clean[0]), len(clean[1]), len(clean[2]))
'''


def test_results_survive_task_retries():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"ROOT = {root!r}\n" + SCRIPT
    r = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=900)
    assert "RETRY-OK" in r.stdout, (r.stdout[-2000:], r.stderr[-4000:])
