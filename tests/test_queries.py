"""Every query over the fixture tables against its SQL, or at least run."""

import pytest
from compare import DATA, compare

from sparkloom.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in SQL:
        compare(df, SQL[name])
    else:
        assert df.count() > 0


def test_stream_is_batch(spark):
    batch = {tuple(r) for r in QUERIES["sm2_fold"](spark, DATA).collect()}
    assert batch == {tuple(r) for r in QUERIES["stream_sm2"](spark, DATA).select("user_id", "ease", "days", "repetitions").collect()}
