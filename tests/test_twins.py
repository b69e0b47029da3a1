"""Every registered query against its SQL twin on the smallest data folder."""

import pytest

from photospark.checks import load_checks
from twin import ROOT, compare, connect

PATH = f"{ROOT}/sf0.001"


@pytest.fixture(scope="session")
def con():
    return connect(PATH)


@pytest.mark.parametrize("name", list(load_checks()))
def test_twin(spark, con, name):
    check = load_checks()[name]
    _, _, verdict = compare(spark, con, PATH, name, check)
    # a filter may match nothing on the smallest folder; both sides must then be empty
    if verdict == "EMPTY" and check.sql is not None:
        assert con.execute(check.sql).fetchone() is None
    else:
        assert verdict.startswith(("ok", "rows-only")) and "TYPES" not in verdict, verdict


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
