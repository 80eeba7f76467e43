"""Every registered core query against its SQL, and the driver's contract."""

import pytest

from inkdex import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(agrees, name):
    agrees(queries.QUERIES, queries.SQL, name)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_core_does_not_import_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['inkdex.llm'] = None; import __spark_entry__ as e; assert 'p3_found' in e.queries() and 'p2_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=queries.__file__.rsplit("/inkdex/", 1)[0])

