"""The driver's entry points, with and without the optional folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["bill_to", "n_invoices", "total"] and df.count() > 0


def test_works_without_the_optional_folders(tmp_path):
    shutil.copytree(ROOT / "partloom", tmp_path / "partloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'D10' in q and not any(x.startswith('op') for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"}, timeout=120)
