"""Without the training-data subpackage the rest still imports and answers."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "lineweave", tmp_path / "lineweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "lineweave").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text()
