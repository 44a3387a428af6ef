"""The driver's entry module, with and without its optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("left_out", [(), ("corpus_pipeline.py",)])
def test_entry_without_optional_parts(tmp_path, left_out):
    from shelltrace.plans.catalog import QUERIES

    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        path = os.path.join(ROOT, name)
        if name not in left_out and os.path.exists(path):
            shutil.copy(path, tmp_path)
    shutil.copytree(
        os.path.join(ROOT, "shelltrace"),
        tmp_path / "shelltrace",
        ignore=shutil.ignore_patterns("llm", "__pycache__"),
    )
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*e.oracle_sql())"
    run = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True
    )
    names, checked = (line.split() for line in run.stdout.splitlines())
    assert names == sorted(QUERIES)
    assert set(checked) <= set(names)


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; e.queries(), e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
