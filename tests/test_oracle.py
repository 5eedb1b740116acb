"""Every query of the library beside its SQL in DuckDB."""

import pytest

from docintake.plans import registry
from tools.compare import compare, connect

registry.load_all()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_what_sql_gives(spark, con, sf_dir, name):
    said = compare(spark, con, sf_dir, name, registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert said in ("", "no rows"), said


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
