"""Every query that has a SQL form gives the rows that DuckDB gives."""

import re

import __spark_entry__ as entry
import pytest

from tests.oracle_check import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


OWN = sorted(name for name in entry.oracle_sql() if not re.match(r"op\d+_|pipeline", name))  # the others have tests of their own


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    assert differences(entry.queries()[name](spark, SF), entry.oracle_sql()[name], con) is None


def test_loop_on_embeddings(spark):
    cycles = entry.queries()["screen_cycles"](spark, SF).collect()
    assert cycles and all(c.trained for c in cycles)
