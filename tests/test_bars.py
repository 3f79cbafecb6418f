"""How often lines are shuffled and read."""

from factorloom.plans.queries import _matrix
from factorloom.sources.tables import bars

SF = "/root/testdata/sf0.001"


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_lines_are_shuffled_once_in_the_order_of_windows(spark):
    """One shuffle, by supplier, and one sort, by supplier and date."""
    plan = _plan(bars(spark, SF))
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.count("Sort [") == 1


def test_the_grid_reads_lines_once(spark):
    """Fits, scores, positions and trades of all variants start from one written table."""
    found = _matrix(spark, SF)
    assert all("rows-" in _plan(t) and "lineitem" not in _plan(t) for t in (found["portfolio"], found["summary"]))
