"""The contract's module with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def names(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True)


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(ROOT / "fleetline", tmp_path / "fleetline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_the_rest_works_without_the_corpus_operators(copy):
    done = names(copy)
    assert done.returncode == 0 and done.stdout.split()[-1] == "False" and int(done.stdout.split()[0]) > 90


def test_other_missing_modules_are_errors(copy):
    (copy / "corpus_pipeline.py").write_text("import surely_missing_module\n")
    assert "surely_missing_module" in names(copy).stderr
