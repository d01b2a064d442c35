"""A request: which algorithm on which graph, with which options."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass
class Request:
    """Options of one run. ``algorithm`` is explicit; ``root`` is a compacted id unless ``original_ids``."""

    algorithm: str = "cc"
    graph: str = "."
    output: str | None = None
    root: int = 0
    original_ids: bool = False
    iterations: int = 20
    direction: str = "auto"
    undirected: bool = False
    weight: str = "none"
    num_vertices: int | None = None
    parts: int = 0
    strategy: str = "checkerboard"
    balance_ratio: float = 1.2
    request_id: int = 0
    resume: bool = False

    def __post_init__(self):
        if self.algorithm not in ("bfs", "sssp", "cc", "pagerank"):
            raise ValueError(f"unknown algorithm {self.algorithm!r}")
        if self.direction not in ("auto", "push", "pull"):
            raise ValueError(f"unknown direction {self.direction!r}")
        if self.weight not in ("none", "synthetic", "column"):
            raise ValueError(f"unknown weight {self.weight!r}")
        if self.iterations < 0:
            raise ValueError("iterations must not be negative")

    @classmethod
    def from_json(cls, text: str) -> Request:
        """Known keys of a JSON object; others are an error."""
        given = json.loads(text)
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown keys {sorted(unknown)}")
        return cls(**given)
