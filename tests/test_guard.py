"""The rest stands without the subpackage of training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parent.parent


def test_without_training_data_operators(tmp_path):
    shutil.copytree(TOP / "lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_them():
    for path in [*(TOP / "lectern").rglob("*.py"), TOP / "bench.py"]:
        if "llm" not in path.relative_to(TOP).parts:
            assert "lectern.llm" not in path.read_text(), path
