"""The rest of the library works where the training-data operators are absent."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOOK = """
import sys
import __spark_entry__ as E
assert E.queries() and set(E.oracle_sql()) <= set(E.queries())
assert not [q for q in E.queries() if q.startswith("op") or q == "pipeline"], "training-data queries without their code"
assert not [m for m in sys.modules if m.startswith("citysense.llm.") or m == "corpus_pipeline"]
"""


def copy_of_the_library(folder, *without):
    shutil.copytree(ROOT, folder, ignore=lambda at, names: {
        x for x in names if x in {".git", "__pycache__", "tests", *without} or x.endswith((".md", ".json", ".txt"))})


def test_import_without_llm(tmp_path):
    for name, without in [("all", ("llm", "corpus_pipeline.py")), ("folder", ("llm",))]:
        copy_of_the_library(tmp_path / name, *without)
        done = subprocess.run([sys.executable, "-c", LOOK], cwd=tmp_path / name, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
