"""Registered queries: each module binds operators to the given tables."""

from tidegauge.plans import (  # noqa: F401
    aggregates, audits, evaluation, joins, models, pairwise, released, scalars, splits, windows,
)
