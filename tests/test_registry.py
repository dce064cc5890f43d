"""Every registered query against its SQL, on the small data set."""

from __future__ import annotations

import subprocess
import sys

import pytest
from conftest import ROOT, SF_DIR
from compare import difference

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_checks_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    assert contract.entry(spark).count() > 0


def test_checks_need_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr


def test_core_queries_survive_without_a_library_of_the_optional_part():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(sorted(e.queries())[0], len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) >= 124
