"""Operators on a caller's own table, in a program that starts outside the repository."""

import os
import subprocess
import sys
from pathlib import Path

PROGRAM = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six")], "doc_id long, text string")
from tankline.llm.{module} import {function}
print("ROWS", {function}(docs).count())
"""


def answers(tmp_path, module, function):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(module=module, function=function), root, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    return done.stdout.strip().split("\n")[-1], done.stderr[-2000:]


def test_operators_work_from_another_folder(tmp_path):
    for module, function in (("packing", "token_pieces"), ("jaccard_join", "jaccard_classes")):
        out, err = answers(tmp_path, module, function)
        assert out == "ROWS 2", err
