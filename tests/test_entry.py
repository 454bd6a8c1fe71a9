"""The entry module: it works with and without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def names(folder, code="import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture
def bare(tmp_path):
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_without_llm(bare):
    done = names(bare)
    assert done.returncode == 0 and done.stdout.split()[1] == "False"


def test_a_missing_library_of_llm_is_warned_of(bare):
    (bare / "tessera/llm").mkdir()
    (bare / "tessera/llm/__init__.py").write_text("")
    (bare / "tessera/llm/queries.py").write_text("import no_such_module_at_all")
    done = names(bare)
    assert done.returncode == 0 and done.stdout.split()[1] == "False" and "no_such_module_at_all" in done.stderr


def test_errors_inside_llm_are_raised(bare):
    (bare / "tessera/llm").mkdir()
    (bare / "tessera/llm/__init__.py").write_text("")
    (bare / "tessera/llm/queries.py").write_text("1 / 0")
    done = names(bare)
    assert done.returncode and "ZeroDivisionError" in done.stderr


def test_nothing_else_imports_llm():
    for f in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in f.parts:
            assert "tessera.llm" not in f.read_text()
