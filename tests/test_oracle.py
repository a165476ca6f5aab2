"""Every query of the core against its SQL, over the whole small tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from compare import assert_equal, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def core():
    return sorted(n for m in entry._MODULES for n in m.SQL)


@pytest.mark.parametrize("name", core())
def test_equals_sql(spark, sf_dir, name):
    assert_equal(entry.queries()[name](spark, sf_dir), connect(sf_dir), entry.oracle_sql()[name])


def test_every_query_without_sql_runs(spark, sf_dir):
    for m in entry._MODULES:
        for name in set(m.QUERIES) - set(m.SQL):
            assert m.QUERIES[name](spark, sf_dir).count() >= 0, name


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_llm_is_optional(tmp_path):
    """Without both folders the rest imports, and lists its own queries only."""
    root = Path(__file__).resolve().parents[1]
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__")
    shutil.copytree(root, tmp_path / "repo", ignore=skip)
    code = "import sys, __spark_entry__ as e; n = e.queries(); assert 'p1_found' in n and 'p3_found' not in n; print(len(n), 'talliard.llm' in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(sum(len(m.QUERIES) for m in entry._MODULES)), "False"]
