"""The rest of the repository without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import __spark_entry__ as e
names = set(e.queries())
assert names and set(e.oracle_sql()) <= names, names
assert "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names), names
import gridloom.context, gridloom.operators.geo, gridloom.streaming.windows, bench
"""


def run_without(tmp_path, *gone: str) -> None:
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    subprocess.run([sys.executable, "-c", RUN], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, check=True)


def test_without_the_folders(tmp_path):
    run_without(tmp_path, "gridloom/llm", "tests/llm")


def test_without_folders_and_pipeline(tmp_path):
    run_without(tmp_path, "gridloom/llm", "tests/llm", "corpus_pipeline.py")
