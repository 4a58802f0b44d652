"""Queries with Python kernels run from any folder; the archive holds the package."""

import os
import subprocess
import sys
import zipfile

from spikegrid.session import ship

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_runs_from_another_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate()
print('ROWS', e.queries()['fisher_p'](s, '/root/testdata/sf0.001').count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_archive(spark):
    assert "spikegrid/operators/ordered.py" in zipfile.ZipFile(ship(spark)).namelist()
