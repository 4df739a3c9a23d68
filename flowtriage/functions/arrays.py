"""Helpers for array columns computed within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed(name: str) -> Column:
    """A computed array column as generator input.

    For a bare column an explode infers a size filter, which the optimizer
    moves below the projection that computes the array: it would be computed
    twice, and inlined into its own lambdas.  An expression is left alone.
    """
    return F.array_compact(F.col(name))
