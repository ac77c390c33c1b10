"""The driver contract without the subpackage of training-text operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("without_pipeline", [False, True])
def test_entry_imports_without_the_subpackage(tmp_path, without_pipeline):
    shutil.copytree(f"{ROOT}/pricetrace", tmp_path / "pricetrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if not without_pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; names = set(e.queries()); print(len(names), 'pipeline' in names, any(n.startswith('op1') for n in names), set(e.oracle_sql()) <= names)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
    count, *rest = done.stdout.split()
    assert int(count) >= 90 and rest == ["False", "False", "True"]
