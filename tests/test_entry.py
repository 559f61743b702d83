"""The driver's entry, and that the rest stands without the language-model folder."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and "bundle_retrieval_report" in known


def test_without_llm(tmp_path):
    shutil.copytree(f"{ROOT}/leafworks", tmp_path / "leafworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'trace_rollup' in n and not any(k.startswith('op') and k[2].isdigit() for k in n) and 'pipeline' not in n; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_entry(spark):
    assert entry.entry(spark).count() > 0
