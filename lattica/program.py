"""Vertex programs as column expressions, so that Catalyst plans every round."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.reduce import REDUCERS


@dataclass(frozen=True)
class VertexProgram:
    """init, message, combine and apply of a round-based program; a null value is a vertex never reached.

    init(v, out_degree) -> (value, active)
    message(value, w) -> what an active source sends along an edge
    combine: "min", "sum" or "up", or a function from a message column to an aggregate
    apply(old, combined, out_degree, round, last) -> new value; combined is null without a message
    activate(old, new) -> whether the vertex sends in the next round
    rounds: exactly so many, or None to go on until no vertex is active
    everywhere: apply to vertices without a message too
    """

    name: str
    init: Callable[[Column, Column], tuple[Column, Column]]
    message: Callable[[Column, Column], Column]
    combine: str | Callable[[Column], Column]
    apply: Callable[[Column, Column, Column, int, bool], Column]
    activate: Callable[[Column, Column], Column]
    rounds: int | None = None
    everywhere: bool = False

    def combined(self, message: Column) -> Column:
        return REDUCERS[self.combine](message) if isinstance(self.combine, str) else self.combine(message)


def smaller(old: Column, new: Column) -> Column:
    """new improves on old (or old was never reached)."""
    return F.coalesce(new.isNotNull() & (old.isNull() | (new < old)), F.lit(False))
