"""The entry points, with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
from tests.conftest import ROOT


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 41


def test_imports_without_the_optional_parts(tmp_path):
    shutil.copytree(os.path.join(ROOT, "cellwright"), tmp_path / "cellwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'em_fit_summary' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
