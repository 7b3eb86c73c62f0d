"""The driver's contract."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _names(cwd):
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=cwd, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": cwd}).stdout.split()


def test_names_need_no_session_and_no_llm(tmp_path):
    for name in ("quillspan", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "quillspan" / "llm", ignore_errors=True)
    n, sql, pipeline = _names(str(tmp_path))
    assert int(n) > 100 and int(sql) > 100 and pipeline == "False"


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
