"""The entry point without the removable parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
ASK = """
import __spark_entry__ as e
names = set(e.queries())
assert "analyze_events_exact" in names and set(e.oracle_sql()) <= names
assert not any(n.startswith("op") and "_" in n and n[2:].split("_")[0].isdigit() for n in names) and "pipeline" not in names, names
import sievelog.api, sievelog.cli, sievelog.plans.catalogue, sievelog.streaming.session
"""


@pytest.mark.parametrize("gone", [("sievelog/llm", "tests/llm"), ("sievelog/llm", "tests/llm", "corpus_pipeline.py")])
def test_everything_else_survives_the_removal(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.parquet", "spark-warehouse"))
    for part in gone:
        path = copy / part
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    asked = run("-c", ASK)
    assert asked.returncode == 0, asked.stderr
    collected = run("-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider")
    assert collected.returncode == 0, collected.stdout[-2000:]


def test_other_import_errors_are_raised(tmp_path, monkeypatch):
    import __spark_entry__

    (tmp_path / "needs_nothing_known.py").write_text("import surely_not_a_module\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__._optional("needs_nothing_known")
