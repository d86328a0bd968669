"""Every query of the core catalogue against its SQL, on the smallest data."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from strandflow.plans import catalogue, catalogue_more, queries  # noqa: F401

from .compare import DATA, check, duck

ROOT = Path(__file__).resolve().parent.parent
there = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data in place")


@pytest.fixture(scope="module")
def con():
    return duck()


@there
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    check(spark, con, name, queries.QUERIES[name], queries.ORACLE[name])


def test_every_query_of_the_core_has_its_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE)


def test_entry_does_without_the_optional_subpackage():
    code = "import sys; sys.modules['strandflow.llm'] = None; import __spark_entry__ as e; assert e.llm is None; q = e.queries(); assert 'p3_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_nothing_in_the_core_imports_the_optional_subpackage():
    for p in (ROOT / "strandflow").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(encoding="utf-8"), p
