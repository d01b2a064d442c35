"""Reductions over messages to a vertex; no message at all is the identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def up(message: Column) -> Column:
    """Any message wins; the smallest is taken, so that the result doesn't hang on the order."""
    return F.min(message)


REDUCERS = {"min": F.min, "sum": F.sum, "up": up}
