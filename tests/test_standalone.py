"""The library works where the corpus operators were deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_corpus_operators(tmp_path, pipeline):
    """With and without the pipeline's file, which may go or stay where the operators went."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "kinetrail", tmp_path / "kinetrail", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if pipeline and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and set(e.oracle_sql()) <= set(q) and not any(n[:2] == 'op' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
