"""The library without the subpackage for training data and its pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import __spark_entry__ as entry
names = set(entry.queries())
assert "session_edges" in names and len(names) > 90, names
assert not any(n.startswith("op") and "_" in n and n[2].isdigit() or n == "pipeline" for n in names)
assert set(entry.oracle_sql()) <= names
import filetrail.plans.analyze, filetrail.streaming.streams
"""


def test_entry_works_when_both_folders_are_gone(tmp_path):
    shutil.copytree(ROOT / "filetrail", tmp_path / "filetrail", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for file in (ROOT / "filetrail").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert "filetrail.llm" not in file.read_text(), file
