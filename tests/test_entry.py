"""The registry with and without the corpus parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CORPUS = ("corpus_pipeline.py", os.path.join("seqloom", "llm"), os.path.join("tests", "llm"))
SAY = "import __spark_entry__ as e; print('NAMES', *e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("gone", [(), CORPUS, CORPUS[1:], CORPUS[:1]])
def test_names(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.md", "*.json", "*.txt"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    present = all((copy / name).exists() for name in CORPUS[:2])
    said = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True)
    names = said.stdout.rpartition("NAMES")[2].split()
    assert {"rec_size", "dist_seq", "minimizers_sliding"} <= set(names)
    assert ("pipeline" in names) == present and any(n.startswith("op1_") for n in names) == present
