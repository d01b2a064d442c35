import random

import oracles
import pytest

from lattica.operators import algorithms
from lattica.operators.build import build_graph

FIXTURES = {
    "chain": [(0, 1), (1, 2), (2, 3), (3, 4)],
    "star_out": [(0, k) for k in range(1, 10)],
    "star_in": [(k, 0) for k in range(1, 10)],
    "multi_edge": [(0, 1), (0, 1), (1, 0)],
    "self_loop": [(0, 0), (0, 1)],
    "directed": [(1, 0)],
    "random": [(random.Random(5).randrange(40), random.Random(k).randrange(40)) for k in range(90)],
}


def make(spark, rows, **options):
    kind = "src long, dst long, w long" if rows and len(rows[0]) == 3 else "src long, dst long"
    return build_graph(spark.createDataFrame(rows, kind), **options)


def values(run):
    return {r.v: r.val for r in run.values().collect()}


def vertices(rows):
    return sorted({x for r in rows for x in r[:2]})


@pytest.mark.parametrize("name", ["chain", "multi_edge", "self_loop", "random"])
def test_bfs_push_and_pull(spark, name):
    rows = FIXTURES[name]
    want = oracles.bfs(rows, vertices(rows), 0)
    for direction in ("push", "pull"):
        assert values(algorithms.bfs(make(spark, rows), 0, direction=direction)) == want


def test_bfs_absent_root_reaches_nothing(spark):
    assert set(values(algorithms.bfs(make(spark, FIXTURES["chain"]), 99)).values()) == {4294967295}


def test_sssp_reactivates_and_stops_on_zero_weights(spark):
    rows = [(0, 2, 10), (0, 1, 1), (1, 2, 1), (2, 0, 0), (3, 0, 5)]
    run = algorithms.sssp(make(spark, rows, weight="column"), 0)
    assert values(run) == oracles.sssp(rows, vertices(rows), 0)
    assert len(run.rounds) == 3


def test_sssp_rejects_negative_and_missing_weights(spark):
    with pytest.raises(ValueError):
        algorithms.sssp(make(spark, [(0, 1, -1)], weight="column"), 0)
    with pytest.raises(ValueError):
        algorithms.sssp(make(spark, [(0, 1)]), 0)


def test_cc_directed_and_undirected(spark):
    assert values(algorithms.cc(make(spark, FIXTURES["directed"]))) == {0: 0, 1: 1}
    rows = FIXTURES["random"]
    graph = make(spark, rows, undirected=True, num_vertices=45)
    both = rows + [(d, s) for s, d in rows]
    want = oracles.cc(both, range(45))
    assert values(algorithms.cc(graph)) == want
    assert values(algorithms.cc(graph, method="contract")) == want


def test_cc_contract_on_a_long_path(spark):
    rows = [(k, k + 1) for k in range(200)]
    assert set(values(algorithms.cc(make(spark, rows, undirected=True), method="contract")).values()) == {0}


@pytest.mark.parametrize("iterations", [0, 1, 4])
def test_pagerank(spark, iterations):
    rows = FIXTURES["random"] + FIXTURES["multi_edge"]
    got = values(algorithms.pagerank(make(spark, rows, num_vertices=42), iterations))
    want = oracles.pagerank(rows, range(42), iterations)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_resume_goes_on_from_the_last_round(spark, tmp_path):
    graph = make(spark, FIXTURES["chain"])
    path = f"{tmp_path}/run"
    whole = algorithms.bfs(graph, 0)
    part = algorithms.bfs(graph, 0, path=path, max_rounds=2)
    assert len(part.rounds) == 2
    rest = algorithms.bfs(graph, 0, path=path, resume=True)
    assert values(rest) == values(whole)
    assert [r[0] for r in rest.rounds] == list(range(1, len(whole.rounds) + 1))


def test_pagerank_resumes_its_remaining_rounds(spark, tmp_path):
    from lattica.loop import run

    graph = make(spark, FIXTURES["random"])
    program = algorithms.pagerank_program(3)
    want = values(run(graph, program))
    path = f"{tmp_path}/pr"
    run(graph, program, path=path)
    assert values(run(graph, program, path=path, resume=True)) == want


def test_a_round_exchanges_messages_only(spark):
    from lattica.loop import superstep
    from lattica.operators import algorithms, build
    from lattica.storage import partitions, save_dealt, new_path

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    e = spark.createDataFrame([(k, (k * 7) % 50) for k in range(50)], "src long, dst long").repartition(partitions(spark), "src").persist()
    state = spark.range(50).selectExpr("id as v", "if(id = 0, 0L, null) as val", "id = 0 as active", "1L as deg")
    state = save_dealt(state, new_path(spark, "test"), "v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for mode in ("push", "pull"):
            plan = superstep(state, e, algorithms.bfs_program(0), mode)._jdf.queryExecution().executedPlan().toString()
            above_cache = [x for x in plan.split("InMemoryRelation")[0].split("\n") + plan.split("Initial Plan")[-1].split("\n")[-8:] if "Exchange hashpartitioning(v" in x]
            assert len(above_cache) == 1 and "Bucketed: true" in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        e.unpersist()


def test_hubs_get_their_values_by_broadcast(spark, monkeypatch):
    from lattica import loop
    from lattica.operators import algorithms, build

    rows = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(400, 403)] + [(5, 400), (0, 7)]
    e = spark.createDataFrame(rows, "src long, dst long")
    g = build.build_graph(e, weight="synthetic")
    want = {name: sorted(map(tuple, f(g).values().collect())) for name, f in (("bfs", lambda g: algorithms.bfs(g, 0)), ("sssp", lambda g: algorithms.sssp(g, 0)), ("pr", lambda g: algorithms.pagerank(g, 3)))}
    monkeypatch.setattr(loop, "HUB_EDGES", 10)
    assert sorted(map(tuple, algorithms.bfs(g, 0).values().collect())) == want["bfs"]
    assert sorted(map(tuple, algorithms.sssp(g, 0, direction="pull").values().collect())) == want["sssp"]
    got = sorted(map(tuple, algorithms.pagerank(g, 3).values().collect()))
    assert [x[0] for x in got] == [x[0] for x in want["pr"]] and all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(got, want["pr"], strict=True))


def test_sssp_goes_on_as_long_as_distances_change(spark):
    rows = [(k, k + 1, 1) for k in range(40)] + [(0, k, 3 * k) for k in range(1, 41)]
    run = algorithms.sssp(make(spark, rows, weight="column"), 0)
    assert values(run) == oracles.sssp(rows, vertices(rows), 0) == {k: k for k in range(41)}
    assert len(run.rounds) == 41


def test_sssp_takes_a_cheaper_path_of_many_hops(spark):
    # after 25 rounds vertex 30 still has the price of the direct edge
    rows = [(k, k + 1, 0) for k in range(30)] + [(0, 30, 99), (30, 31, 1)]
    got = values(algorithms.sssp(make(spark, rows, weight="column"), 0))
    assert got == oracles.sssp(rows, vertices(rows), 0) and (got[30], got[31]) == (0, 1)


def test_bytes_of_rounds_follow_the_segment_formats(spark):
    from lattica.loop import Run

    vertices_ = 1_098_968
    bitmap = (vertices_ >> 5) + 2
    log = [(k, 1, 1, 1, "push", 0.0, n, vertices_) for k, n in enumerate((0, 100_000, 100_001, 274_466, 1_000_001))]
    got = [r.message_bytes for r in Run(spark.range(1), log).metrics().orderBy("round").collect()]
    assert got == [4 * n for n in (5, 200_005, 5 + bitmap + 100_001, 5 + bitmap + 274_466, 5 + bitmap + vertices_)]
