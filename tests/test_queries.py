import pytest

from groundframe import plans

from .oracle import compare


#: Every query at one of two sizes, by turns; those whose fixture is another thing at the larger one, at both.
SIZES = [(name, ("sf0.001", "sf0.01")[k % 2]) for k, name in enumerate(sorted(plans.SQL))] + [("stage_states", "sf0.01"), ("stage_states", "sf0.001")]


@pytest.mark.parametrize(("name", "size"), sorted(set(SIZES)))
def test_query_equals_sql(spark, name, size):
    got, want = compare(spark, f"/root/testdata/{size}", plans.QUERIES[name], plans.SQL[name])
    assert len(got) == len(want)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
