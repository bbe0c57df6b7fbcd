"""Propagation to its end on a graph with a cycle."""

import pytest

from partloom.llm import urls


def test_propagation_ends_at_the_tolerance(spark):
    links = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, seed double")
    got = {r.host: r.score for r in urls.propagate(links, seeds).collect()}
    assert got["a"] == pytest.approx(0.15 / (1 - 0.85**2), abs=1e-5) and got["b"] == pytest.approx(0.85 * got["a"], abs=1e-5)


@pytest.mark.parametrize("per_task", [10**6, 7])
def test_a_hub_is_dealt_to_several_tasks(spark, per_task):
    """200 hosts link to one, so that its distrust has 200 edges; scores do not depend on how they are dealt."""
    links = spark.createDataFrame([(f"h{i}", "hub", 1 + i % 3) for i in range(200)] + [("hub", "h0", 2)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("distrust", "hub", 1.0), ("trust", "h3", 1.0)], "kind string, host string, seed double")
    got = {(r.kind, r.host): r.score for r in urls.propagate(links, seeds, per_task=per_task).collect()}
    total = sum(1 + i % 3 for i in range(200))
    back = 1 / total  # distrust returns from h0, which alone is linked from the hub
    hub = 0.15 / (1 - 0.85**2 * back)
    assert got["distrust", "hub"] == pytest.approx(hub, abs=1e-5) and len(got) == 204
    assert got["distrust", "h4"] == pytest.approx(0.85 * hub * 2 / total, abs=1e-5)
    assert got["trust", "hub"] == pytest.approx(0.85 * got["trust", "h3"] + 0.85 * got["trust", "h0"], abs=1e-5)
