"""Readers: edge lists, tables, stored graphs, results, requests, traces and logs; graphs derived from tables; R-MAT."""

from .derived import copart, copart_q40, retq
from .edges import from_table, parse_edge_lines, read_edge_list
from .generate import rmat
from .logs import parse_trace, read_worker_logs
from .requests import Request
from .stored import read_block_metadata, read_graph, read_partitioned, read_raw_results, read_results

__all__ = ["Request", "copart", "copart_q40", "from_table", "parse_edge_lines", "parse_trace", "read_block_metadata", "read_edge_list", "read_graph", "read_partitioned", "read_raw_results", "read_results", "read_worker_logs", "retq", "rmat"]
