"""All registered queries of the library against their SQL at the smallest scale factor."""

import pytest

from tripleloom.plans import catalog

NAMES = sorted(catalog.oracle_sql())
EMPTY = {"g_relation_lines"}         # the smallest tables have no supplier of this name


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    import __spark_entry__ as entry
    from oracle import compare
    state, n, _, note = compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], "/root/testdata/sf0.001")
    assert state == ("EMPTY" if name in EMPTY else "ok"), note


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
