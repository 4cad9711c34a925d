"""The driver contract, also without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 100


def test_entry_and_workers_in_another_folder(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {HERE!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "print('ROWS', e.entry(spark).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 50" in said.stdout, said.stderr[-2000:]


def test_the_rest_works_without_the_subpackage(tmp_path):
    """What is left when the training-data folders are deleted still imports and registers its queries."""
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(HERE, tmp_path / "repo", ignore=skip)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print('N', len(e.queries()), any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()))"], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True, timeout=120)
    assert "False" in said.stdout, said.stderr[-2000:]
