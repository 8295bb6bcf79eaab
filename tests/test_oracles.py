"""Every registered query of the library: against its SQL, or at least run to the end."""

import os

import pytest

from lectern import plans
from tests.compare import differences

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
#: Right without any row: an empty scope.
EMPTY = {"empty_scope_is_empty"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    df = plans.QUERIES[name](spark, SF_DIR)
    if name not in plans.ORACLES:
        df.write.format("noop").mode("overwrite").save()
        return
    ours, theirs, rows = differences(df, plans.ORACLES[name], SF_DIR)
    assert not ours and not theirs, f"{rows} rows; only here {ours[:3]}; only in SQL {theirs[:3]}"
    assert rows or name in EMPTY, "the query's result is empty"
