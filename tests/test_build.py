import json

import pytest

from lattica import registry, sinks, validate
from lattica.operators import build
from lattica.sources import Request, parse_edge_lines, read_block_metadata, read_edge_list, read_graph, read_results, rmat
from lattica.sources.logs import parse_trace, parse_worker_lines
from lattica.sources.stored import range_of_result


def edges(spark, rows, kind="src long, dst long"):
    return spark.createDataFrame(rows, kind)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_parser_rules(spark):
    lines = ["# 1 2", "", "1", "a b", "1 2 3", "  4\t5", "6 7x", "8x 9", "10 11 12 13", " # 5 6"]
    got = parse_edge_lines(spark.createDataFrame([(x,) for x in lines], "value string"), weighted=True)
    assert {(r.src, r.dst, r.w) for r in got.collect()} == {(1, 2, 3), (4, 5, None), (6, 7, None), (10, 11, 12)}


def test_missing_weight(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1 2 5\n2 3\n")
    with pytest.raises(Exception, match="without a weight"):
        read_edge_list(spark, str(tmp_path / "e.txt"), weighted=True).collect()
    assert pairs(read_edge_list(spark, str(tmp_path / "e.txt"), weighted=True, missing_weight=1)) == [(1, 2, 5), (2, 3, 1)]


def test_compaction_keeps_order(spark):
    got, mapping = build.compact_ids(edges(spark, [(10, 70), (70, 500), (10, 70)]))
    assert pairs(mapping.select("orig_id", "v")) == [(10, 0), (70, 1), (500, 2)]
    assert pairs(got) == [(0, 1), (0, 1), (1, 2)]


def test_degrees_count_multiplicity_and_isolated(spark):
    graph = build.build_graph(edges(spark, [(0, 1), (0, 1), (1, 1)]), num_vertices=4)
    assert {(r.v, r.in_degree, r.out_degree) for r in graph.vertices.collect()} == {(0, 0, 2), (1, 3, 1), (2, 0, 0), (3, 0, 0)}
    assert build.check(graph)["edges"] == 3


def test_symmetrize_keeps_weights_and_doubles_loops(spark):
    got = build.symmetrize(edges(spark, [(0, 1, 5), (2, 2, 1)], "src long, dst long, w long"))
    assert pairs(got) == [(0, 1, 5), (1, 0, 5), (2, 2, 1), (2, 2, 1)]


def test_synthetic_weight_and_adjacency(spark):
    graph = build.build_graph(edges(spark, [(3, 99), (3, 1)]), weight="synthetic")
    assert [(x.id, x.w) for x in build.adjacency(graph.edges).first().nbrs] == [(1, 4), (99, 2)]
    assert pairs(build.neighbours(graph.edges, 1, "in")) == [(3, 4)]


def test_hash_and_part_order(spark):
    from pyspark.sql import functions as F

    n, p = 23, 4
    got = {r.id: r.x for r in spark.range(n).select("id", build.hash_order(F.col("id"), n, p).alias("x")).collect()}
    assert sorted(range(n), key=lambda v: (v % p, v)) == sorted(range(n), key=got.get)
    placed = build.part_order(spark.range(10).selectExpr("id as v", "id % 3 as part"), align=4)
    assert {r.v: r.new_id for r in placed.collect()} == {0: 0, 3: 1, 6: 2, 9: 3, 1: 4, 4: 5, 7: 6, 2: 8, 5: 9, 8: 10}


def test_graph_round_trip_results_and_registry(spark, tmp_path):
    graph = build.build_graph(edges(spark, [(k % 7, k % 5) for k in range(30)]))
    sinks.write_graph(graph, f"{tmp_path}/g")
    back = read_graph(spark, f"{tmp_path}/g")
    assert pairs(back.edges) == pairs(graph.edges)
    assert read_graph(spark, f"{tmp_path}/g", degrees=False).vertices.columns == ["v", "orig_id"]
    values = spark.range(50).selectExpr("id as v", "id * 2 as val")
    sinks.write_results(values, f"{tmp_path}/r")
    sinks.write_results(values, None)
    assert validate.differences(read_results(spark, f"{tmp_path}/r"), values).count() == 0
    registry.load("a", back)
    assert registry.names() == ["a"] and registry.get("a").edges.count() == 30
    registry.unload("a")
    assert registry.names() == []


def test_malformed_result_is_an_error(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1 2\n3 oops\n")
    with pytest.raises(Exception):
        read_results(spark, str(tmp_path / "x.txt")).collect()


def test_partitioned_graph_and_metadata(spark, tmp_path):
    from lattica.operators import partition as part

    e = edges(spark, [(k % 200, (k * 7) % 200) for k in range(900)])
    blocks = part.row(e, 3, 200)
    sinks.write_partitioned(e, blocks, f"{tmp_path}/p", 200)
    meta = read_block_metadata(spark, f"{tmp_path}/p/metadata/*/")
    assert {r.total_v for r in meta.collect()} == {200} and sum(r.edges for r in meta.collect()) == 900
    assert spark.read.parquet(f"{tmp_path}/p/edges").where("owner = 0").count() == blocks.where("owner = 0").first().edges


def test_validators(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "v long, val double")
    b = spark.createDataFrame([(0, 1.005), (1, 2.5)], "v long, val double")
    assert sorted(r.v for r in validate.beyond(a, b).collect()) == [1, 2]
    assert sorted(r.v for r in validate.differences(a, b).collect()) == [0, 1, 2]


def test_request(spark):
    assert Request.from_json(json.dumps({"algorithm": "bfs", "root": 3})).root == 3
    for bad in ({"algorithm": "x"}, {"iterations": -1}, {"direction": "up"}, {"nonsense": 1}):
        with pytest.raises(ValueError):
            Request.from_json(json.dumps(bad))


def test_logs_and_trace(spark):
    line = "REPORT Duration: 12.5 ms\tBilled Duration: 13 ms\tMax Memory Used: 99 MB overall_time: 2.5 s overall_idle_time: 1 s total_msg_size: 7 MB"
    r = parse_worker_lines(spark.createDataFrame([(line,)], "value string")).first()
    assert (r.duration_ms, r.billed_ms, r.memory_mb, r.message_mb, r.overall_s, r.idle_s) == (12.5, 13, 99, 7, 2.5, 1)
    trace = spark.createDataFrame([(k, f"t {k} {k * 10}") for k in range(92)], "position long, value string")
    assert [(r.minute, r.requests) for r in parse_trace(trace).orderBy("minute").collect()] == [(0, 8.8), (1, 8.9), (2, 9.0), (3, 9.1)]
    path = spark.createDataFrame([("/a/result_128_256.txt",)], "p string")
    assert path.select(range_of_result(path.p)).first()[0] == 128


def test_rmat(spark):
    e = rmat(spark, 6, 4, seed=2)
    assert e.count() == 256 and pairs(e) == pairs(rmat(spark, 6, 4, seed=2))
    assert e.agg({"src": "max", "dst": "max"}).first()[0] < 64


def test_ids_above_32_bits_and_empty_edges(spark):
    big = 1 << 40
    got, mapping = build.compact_ids(edges(spark, [(big, 5)]))
    assert pairs(got) == [(1, 0)]
    assert build.build_graph(edges(spark, [])).vertices.count() == 0
