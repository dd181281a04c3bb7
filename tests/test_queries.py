"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest
from support import DATA, rows

from citeloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_rows_as_sql(spark, oracle, name):
    ours = catalog.queries()[name](spark, DATA).toPandas()
    theirs = oracle.execute(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours), "a query that finds nothing shows nothing"
    assert rows(ours) == rows(theirs)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 15
