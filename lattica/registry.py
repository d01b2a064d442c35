"""Graphs kept between requests."""

from __future__ import annotations

from pyspark import StorageLevel

from .operators.build import Graph

_kept: dict[str, Graph] = {}


def load(name: str, graph: Graph) -> Graph:
    """Keeps a graph's tables (memory, then disk) under a name; loading again replaces it."""
    unload(name)
    held = Graph(graph.edges.persist(StorageLevel.MEMORY_AND_DISK), graph.vertices.persist(StorageLevel.MEMORY_AND_DISK))
    held.edges.count()
    held.vertices.count()
    _kept[name] = held
    return held


def get(name: str) -> Graph:
    return _kept[name]


def unload(name: str) -> None:
    if held := _kept.pop(name, None):
        held.edges.unpersist()
        held.vertices.unpersist()


def names() -> list[str]:
    return sorted(_kept)
