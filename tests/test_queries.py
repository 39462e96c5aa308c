"""Every query of the plans against its SQL, or at least for rows, at the smallest scale."""

import pytest

from tests.oracle import duck, same
from tidemark.plans import PLANS

SF = "/root/testdata/sf0.001"
NAMES = [(m, k) for m in PLANS for k in m.Q]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("module,name", NAMES, ids=[k for _, k in NAMES])
def test_query(spark, con, module, name):
    got = module.Q[name](spark, SF).toPandas()
    if name in module.SQL:
        same(got, con.sql(module.SQL[name]).df())
    else:
        assert len(got.columns) > 0


def test_names_are_distinct():
    assert len({k for _, k in NAMES}) == len(NAMES)
