"""Queries on ordered rows again, with slices so small that every key crosses many of them."""

import pytest

from check_queries import compare
from probeline.operators import timeline
from probeline.plans import load
from test_queries import SF_DIR, duck  # noqa: F401

QUERIES, ORACLES = load()
ORDERED = [
    "counter_delta", "gauge_delta", "health_streaks", "first_kill", "first_stable", "stalled_rise", "stalled_fall",
    "newly_failed", "pod_series", "dedupe_labels", "label_versions", "concat_steps", "assign_queue_position",
    "results_summary", "rank_sweeps", "attach_timings", "results_documents", "stream_counter_delta", "stream_watchdog",
]


@pytest.mark.parametrize("name", ORDERED)
def test_small_slices(spark, duck, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(timeline, "ROWS_PER_SLICE", 100)
    problem, _ = compare(spark, duck, QUERIES[name], ORACLES[name], SF_DIR)
    assert problem is None, problem
