"""Queries over the given tables, one or more per operator."""

from probeline.plans.registry import ORACLES, QUERIES


def load():
    """All registered queries and their SQL."""
    from probeline.plans import (  # noqa: F401
        experiment_queries,
        ledger_queries,
        report_queries,
        search_queries,
        stream_queries,
        telemetry_queries,
    )

    return dict(QUERIES), dict(ORACLES)
