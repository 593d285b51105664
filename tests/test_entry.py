"""The driver's contract, and that the rest stands without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "label" in df.columns


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_subpackage(tmp_path, pipeline):
    """Everything but the two folders stands in a copy, the corpus pipeline with and without."""
    skipped = {"__pycache__", "llm", ".git", ".pytest_cache"} | (set() if pipeline else {"corpus_pipeline.py"})
    shutil.copytree(REPO, tmp_path / "copy", ignore=lambda _, names: skipped & set(names))
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 90 and not any(k.startswith('op') or k == 'pipeline' for k in n); assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "copy", check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "copy")})


def test_without_a_library_of_the_subpackage():
    """A library that only the subpackage needs may be absent, too."""
    code = "import sys; sys.modules['public_tokenizers'] = sys.modules['tiktoken'] = None; import __spark_entry__ as e; assert len(e.queries()) > 90"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=REPO, check=True)


def test_nothing_imports_the_subpackage():
    for p in (REPO / "cellplan").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "llm" not in p.read_text(), p
