import pytest

from gleaner.plans.registry import ORACLES, QUERIES
from tests.conftest import DATA
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_twin(spark, name):
    check(spark, QUERIES[name], ORACLES[name], DATA)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
