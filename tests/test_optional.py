"""The library without its optional subpackage."""

from __future__ import annotations

import pathlib
import re
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_subpackage():
    for path in [*ROOT.glob("followgraph/**/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"followgraph\.llm|import llm|corpus_pipeline", path.read_text()), path


def test_queries_load_without_the_subpackage(tmp_path):
    ignore = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "followgraph", tmp_path / "followgraph", ignore=ignore)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.strip() == "41", done.stderr


def test_errors_inside_the_subpackage_are_not_hidden(tmp_path):
    ignore = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "followgraph", tmp_path / "followgraph", ignore=ignore)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    package = tmp_path / "followgraph" / "llm"
    package.mkdir()
    (package / "__init__.py").write_text("")
    (package / "queries.py").write_text("import a_module_that_is_not_there")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode and "a_module_that_is_not_there" in done.stderr
