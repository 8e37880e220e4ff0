"""The engine stands without the training-data subpackage, with or without its pipeline file."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT

CODE = "import __spark_entry__ as e; q = e.queries(); assert 'row_compliance' in q and 'op1_cap_join' not in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("gone", [["certlake/llm", "tests/llm"], ["certlake/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_rest_imports_without_the_subpackage(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", *(os.path.basename(g) for g in gone)))
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
