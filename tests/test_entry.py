"""The entry without the training-data package, and a session where nothing is set."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def run(code, **env):
    made = subprocess.run(
        [sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)} | env, capture_output=True, text=True, timeout=180
    )
    assert made.returncode == 0, made.stderr[-2000:]
    return made.stdout


def test_entry_loads_without_a_library_of_the_training_package():
    code = "import sys; sys.modules['zstandard'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(sorted(e.queries()))"
    names = run(code)
    assert "federated_select" in names and "pipeline" not in names


def test_local_session_has_a_shared_folder_where_none_is_set(tmp_path):
    code = (
        "from wardlake.session import local_session, written\n"
        "spark = local_session(1)\n"
        "print(written(spark.range(3), 'x').count(), spark.conf.get('spark.checkpoint.dir'))"
    )
    out = run(code, SPARK_CONF_DIR=str(tmp_path), TMPDIR=str(tmp_path)).strip().splitlines()[-1]
    assert out.startswith("3 ") and str(tmp_path) in out


def test_a_session_of_others_without_a_shared_folder(tmp_path):
    code = (
        "from pyspark.sql import SparkSession\n"
        "from wardlake.session import scratch_path, written\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert scratch_path(spark, 'a').rsplit('/', 1)[0] == scratch_path(spark, 'b').rsplit('/', 1)[0]\n"
        "print(written(spark.range(3), 'x').count(), scratch_path(spark, 'x'))"
    )
    out = run(code, SPARK_CONF_DIR=str(tmp_path), TMPDIR=str(tmp_path)).strip().splitlines()[-1]
    assert out.startswith("3 ") and str(tmp_path) in out
