"""Driver contract: entry smoke, registry/oracle coverage, and every query against its oracle."""

import pytest

from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].total_files_processed > 0
    assert df.columns == ["total_files_processed", "total_duplicates_count", "total_resumes_detected",
                          "unprocessed_documents_count"]


def test_oracles_only_for_registered_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, key, SF_SMALL, con)
    assert r["values_match"], r


@pytest.mark.parametrize("key", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_rows_only_queries_run(spark, key):
    assert E.queries()[key](spark, SF_SMALL).count() > 0


def test_import_needs_no_session():
    """The driver may import the entry module before it builds a SparkSession."""
    import subprocess
    import sys
    code = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()))"
    r = subprocess.run([sys.executable, "-c", code], cwd=E.__file__.rsplit("/", 1)[0],
                       capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr[-2000:]
