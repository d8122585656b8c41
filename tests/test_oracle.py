"""Every query of the library against its SQL, over whole tables."""

import pytest

from korpora import plans
from tests.compare import same

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(name, spark, duck, sf_dir):
    df = plans.queries()[name](spark, sf_dir)
    same(df, duck.sql(SQL[name]))
