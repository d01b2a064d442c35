"""python -m lattica.cli build | run | partition | verify | ping"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import sinks, validate
from .operators import algorithms, stats
from .operators.build import Graph, build_graph, check
from .operators.partition import STRATEGIES, laid_out
from .sources import Request, read_edge_list, read_graph, read_results


def execute(spark: SparkSession, request: Request) -> algorithms.Run:
    """Runs a request on its stored graph and writes the result where it says."""
    graph = read_graph(spark, request.graph)
    options: dict = {"direction": request.direction}
    if request.resume:
        options |= {"path": f"{request.output}.rounds", "resume": True}
    root = request.root
    if request.original_ids and request.algorithm in ("bfs", "sssp"):
        found = graph.vertices.where(graph.vertices.orig_id == root).select("v").first()
        root = -1 if found is None else found.v
    if request.algorithm == "bfs":
        out = algorithms.bfs(graph, root, **options)
    elif request.algorithm == "sssp":
        out = algorithms.sssp(graph, root, **options)
    elif request.algorithm == "cc":
        out = algorithms.cc(graph, **options)
    else:
        out = algorithms.pagerank(graph, request.iterations, **options)
    sinks.write_results(out.values(), request.output)
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lattica")
    sub = parser.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("input")
    b.add_argument("output")
    b.add_argument("--undirected", action="store_true")
    b.add_argument("--weight", choices=("none", "synthetic", "column"), default="none")
    b.add_argument("--num-vertices", type=int)
    r = sub.add_parser("run")
    r.add_argument("request", help="JSON object")
    p = sub.add_parser("partition")
    p.add_argument("graph")
    p.add_argument("output")
    p.add_argument("--strategy", choices=sorted(STRATEGIES), default="checkerboard")
    p.add_argument("--parts", type=int, required=True)
    p.add_argument("--balance-ratio", type=float, help="checkerboard only")
    v = sub.add_parser("verify")
    v.add_argument("result")
    v.add_argument("expected")
    v.add_argument("--kind", choices=("long", "double"), default="long")
    v.add_argument("--tolerance", type=float)
    sub.add_parser("ping")
    args = parser.parse_args(argv)
    if args.command == "ping":
        print("pong")
        return 0
    spark = SparkSession.builder.getOrCreate()
    if args.command == "build":
        edges = read_edge_list(spark, args.input, weighted=args.weight == "column")
        graph = build_graph(edges, compact=True, undirected=args.undirected, weight=args.weight, num_vertices=args.num_vertices)
        sinks.write_graph(graph, args.output)
        print(json.dumps(check(read_graph(spark, args.output))))
    elif args.command == "run":
        print(json.dumps(execute(spark, Request.from_json(args.request)).rounds))
    elif args.command == "partition":
        graph: Graph = read_graph(spark, args.graph)
        options = {} if args.balance_ratio is None else {"ratio": args.balance_ratio}
        blocks, edges, n = laid_out(graph.edges, args.strategy, args.parts, **options)
        sinks.write_partitioned(edges, blocks, args.output, n)
        print(json.dumps(stats.work_report(blocks).first().asDict()))
    else:
        a, z = read_results(spark, args.result, args.kind), read_results(spark, args.expected, args.kind)
        wrong = (validate.differences(a, z) if args.tolerance is None else validate.beyond(a, z, args.tolerance)).count()
        print(json.dumps({"differences": wrong}))
        return int(wrong > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
