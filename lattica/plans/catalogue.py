"""Queries by name, as (spark, sf_dir) -> DataFrame, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry, sinks
from ..functions import segments, sets
from ..functions.reduce import REDUCERS
from ..loop import initial, superstep
from ..operators import algorithms, build, stats
from ..operators import partition as part
from ..sources import copart, copart_q40, from_table, parse_edge_lines, read_block_metadata, read_graph, read_partitioned, read_results, retq, rmat
from ..sources.logs import parse_trace, parse_worker_lines, run_metrics
from ..storage import new_path
from ..validate import beyond, differences, stale
from . import sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLES[f.__name__] = text
        return f

    return add


# -- sources and transforms ---------------------------------------------------------------


@query(sql.edges("copart"))
def edges_copart(spark, d):
    return copart(spark, d)


@query(sql.edges("copart_q40"))
def edges_copart_q40(spark, d):
    return copart_q40(spark, d)


@query(sql.edges("retq"))
def edges_retq(spark, d):
    return retq(spark, d)


@query(sql.degrees("SELECT v, out_degree FROM g"))
def degree_out(spark, d):
    return build.degrees(copart_q40(spark, d)).select("v", "out_degree")


@query(sql.degrees("SELECT v, in_degree FROM g"))
def degree_in(spark, d):
    return build.degrees(copart_q40(spark, d)).select("v", "in_degree")


@query(sql.degrees("SELECT v, in_degree, out_degree, in_degree + out_degree AS degree FROM g"))
def degree_all(spark, d):
    return build.degrees(copart_q40(spark, d)).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


@query(sql.COMPACT + "SELECT orig_id, v FROM ids")
def compact_ids(spark, d):
    return build.rank_ids(build.endpoints(copart_q40(spark, d)))


@query(sql.COMPACT + "SELECT a.v AS src, b.v AS dst FROM e JOIN ids a ON a.orig_id = src JOIN ids b ON b.orig_id = dst")
def compact_edges(spark, d):
    return build.compact_ids(copart_q40(spark, d))[0]


@query(sql.with_edges("copart_q40") + "SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e")
def symmetrize(spark, d):
    return build.symmetrize(copart_q40(spark, d))


@query(sql.with_edges("copart_q40") + "SELECT src, dst, (src + dst) % 100 AS w FROM e")
def synth_weight(spark, d):
    return build.with_synthetic_weights(copart_q40(spark, d))


@query(sql.with_edges("copart") + "SELECT src AS v, count(*) AS n, CAST(sum(dst) AS BIGINT) AS ids, min(dst) AS first FROM e GROUP BY src")
def adjacency_sizes(spark, d):
    a = build.adjacency(copart(spark, d))
    return a.select("v", F.size("nbrs").cast("long").alias("n"), F.aggregate("nbrs", F.lit(0).cast("long"), lambda s, x: s + x["id"]).alias("ids"), F.col("nbrs")[0]["id"].alias("first"))


@query(sql.with_edges("copart") + "SELECT dst AS id FROM e WHERE src = 7")
def neighbours_of(spark, d):
    return build.neighbours(copart(spark, d), 7)


@query(sql.with_edges("copart") + "SELECT src, dst FROM e WHERE src >= 64 AND src < 128 AND dst < 64")
def block_edges(spark, d):
    return build.block(copart(spark, d), (64, 128), (0, 64))


@query(sql.with_edges("copart") + ", n AS (SELECT max(greatest(src, dst)) + 1 AS n FROM e), vs AS (SELECT DISTINCT src AS v FROM e UNION SELECT dst FROM e) SELECT v, row_number() OVER (ORDER BY v % 6, v) - 1 AS new_id FROM (SELECT range AS v FROM n, range(n)) QUALIFY v IN (SELECT v FROM vs)")
def hash_ids(spark, d):
    e = copart(spark, d)
    n = part.num_vertices(e)
    return build.endpoints(e).select("v", build.hash_order(F.col("v"), n, 6).alias("new_id"))


@query(
    r"""WITH l AS (SELECT CASE WHEN l_linenumber = 1 THEN '# ' ELSE '' END || l_orderkey || ' ' || CASE WHEN l_linenumber = 2 THEN '' ELSE chr(9) || l_partkey END || CASE WHEN l_linenumber % 2 = 1 THEN ' ' || l_suppkey || ' x' ELSE '' END AS value FROM lineitem),
p AS (SELECT regexp_extract(value, '^[ \t\r\n]*([0-9]+)[ \t\r\n]+([0-9]+)(?:[ \t\r\n]+([0-9]+))?', ['a', 'b', 'c']) AS m FROM l WHERE NOT starts_with(value, '#'))
SELECT CAST(m.a AS BIGINT) AS src, CAST(m.b AS BIGINT) AS dst, TRY_CAST(m.c AS BIGINT) AS w FROM p WHERE m.a <> ''"""
)
def parse_lines(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.concat(
            F.when(F.col("l_linenumber") == 1, "# ").otherwise(""), F.col("l_orderkey").cast("string"), F.lit(" "),
            F.when(F.col("l_linenumber") == 2, "").otherwise(F.concat(F.lit("\t"), F.col("l_partkey").cast("string"))),
            F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit(" "), F.col("l_suppkey").cast("string"), F.lit(" x"))).otherwise(""),
        ).alias("value")
    )
    return parse_edge_lines(lines, weighted=True)


@query("SELECT CAST(l_orderkey AS BIGINT) AS src, CAST(l_partkey AS BIGINT) AS dst, CAST(l_quantity AS DOUBLE) AS w FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL")
def weight_column(spark, d):
    edges = from_table(spark.read.parquet(f"{d}/lineitem.parquet").withColumn("q", F.col("l_quantity").cast("double")), "l_orderkey", "l_partkey", "q")
    return build.build_graph(edges, weight="column").edges.select("src", "dst", "w")


@query(sql.with_edges("copart_q40") + "SELECT count(*) AS in_degree, count(*) AS out_degree, count(*) AS edges FROM e")
def degree_check(spark, d):
    return spark.createDataFrame([build.check(build.build_graph(copart_q40(spark, d)))]).select("in_degree", "out_degree", "edges")


@query("WITH a AS (SELECT DISTINCT CAST(p_partkey AS BIGINT) AS v, CAST(p_partkey % 3 AS INT) AS part FROM part), s AS (SELECT part, count(*) AS n FROM a GROUP BY part), t AS (SELECT part, CAST(coalesce(sum((n + 63) // 64 * 64) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM s) SELECT v, part, first + row_number() OVER (PARTITION BY part ORDER BY v) - 1 AS new_id FROM a JOIN t USING (part)")
def part_order_ids(spark, d):
    ids = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("v")).distinct()
    return build.part_order(ids.withColumn("part", (F.col("v") % 3).cast("int"))).select("v", "part", "new_id")


# -- stored and read back ------------------------------------------------------------------


def _stored_graph(spark, d):
    path = new_path(spark, "stored")
    sinks.write_graph(build.build_graph(copart_q40(spark, d), weight="synthetic"), path)
    return read_graph(spark, path)


@query(sql.with_edges("copart_q40") + "SELECT src, dst, (src + dst) % 100 AS w FROM e")
def stored_edges(spark, d):
    return _stored_graph(spark, d).edges.select("src", "dst", "w")


@query(sql.degrees("SELECT v, v AS orig_id, in_degree, out_degree FROM g"))
def stored_vertices(spark, d):
    return _stored_graph(spark, d).vertices


def _stored_parts(spark, d):
    edges, path = copart(spark, d), new_path(spark, "parts")
    sinks.write_partitioned(edges, part.cycle(edges, 4), path, part.num_vertices(edges))
    return path


@query("WITH c AS (" + sql.grid(4, "i % 2 * 2 + j % 2") + "), e AS (" + sql.edges("copart") + ") SELECT owner, src, dst FROM e JOIN c ON src >= from_source AND src < to_source AND dst >= from_dest AND dst < to_dest WHERE owner IN (1, 2)")
def stored_parts(spark, d):
    return read_partitioned(spark, _stored_parts(spark, d), [1, 2]).select("owner", "src", "dst")


@query("WITH c AS (" + sql.grid(4, "i % 2 * 2 + j % 2") + ") SELECT owner, (SELECT max(to_source) FROM c) AS total_v, (SELECT CAST(sum(edges) AS BIGINT) FROM c) AS total_e, from_source, to_source, from_dest, to_dest, edges FROM c")
def stored_metadata(spark, d):
    return read_block_metadata(spark, f"{_stored_parts(spark, d)}/metadata")


@query(sql.levels("copart_q40", sql.BUSIEST) + "SELECT v, val FROM levels")
def stored_results(spark, d):
    g, path = _q40(spark, d), new_path(spark, "results")
    sinks.write_results(algorithms.bfs(g, _busiest(g)).values(), path)
    return read_results(spark, path)


@query("SELECT CAST(8192 AS BIGINT) AS edges, true AS inside, true AS skewed")
def rmat_shape(spark, d):
    """Lines and ids as asked; the first quadrant has the most edges, the last the fewest."""
    e = rmat(spark, 10, 8, seed=3)
    quadrant = [F.count_if((F.col("src") >= 512) == F.lit(i)) for i in (False, True)]
    corner = [F.count_if(((F.col("src") >= 512) == F.lit(i)) & ((F.col("dst") >= 512) == F.lit(i))) for i in (False, True)]
    inside = (F.min(F.least("src", "dst")) >= 0) & (F.max(F.greatest("src", "dst")) < 1024)
    return e.agg(F.count("*").alias("edges"), inside.alias("inside"), ((quadrant[0] > 2 * quadrant[1]) & (corner[0] > 5 * corner[1])).alias("skewed"))


@query()
def rmat_degrees(spark, d):
    """Degree histogram of a small R-MAT graph."""
    return build.degrees(rmat(spark, 10, 8, seed=3)).groupBy("out_degree").agg(F.count("*").alias("n"))


# -- algorithms ----------------------------------------------------------------------------


def _q40(spark, d):
    return build.build_graph(copart_q40(spark, d))


def _busiest(graph) -> int:
    return graph.vertices.orderBy(F.desc("out_degree"), "v").first().v


@query(sql.levels("copart", "0") + "SELECT v, val FROM levels")
def bfs_levels(spark, d):
    return algorithms.bfs(build.build_graph(copart(spark, d)), 0).values()


@query(sql.levels("copart", "0") + "SELECT val AS level, count(*) AS n FROM levels GROUP BY val")
def bfs_histogram(spark, d):
    run = algorithms.bfs(build.build_graph(copart(spark, d)), 0)
    return run.values().groupBy(F.col("val").alias("level")).agg(F.count("*").alias("n"))


@query(sql.levels("copart_q40", sql.BUSIEST) + "SELECT v, val FROM levels")
def bfs_unreached(spark, d):
    g = _q40(spark, d)
    return algorithms.bfs(g, _busiest(g)).values()


@query(sql.distances("copart", "0") + "SELECT v, val FROM distances")
def sssp_dist(spark, d):
    return algorithms.sssp(build.build_graph(copart(spark, d), weight="synthetic"), 0).values()


@query(sql.distances("copart_q40", sql.BUSIEST) + "SELECT count(*) FILTER (val < 4294967295) AS reached, CAST(sum(val) FILTER (val < 4294967295) AS BIGINT) AS total FROM distances")
def sssp_reached(spark, d):
    g = build.build_graph(copart_q40(spark, d), weight="synthetic")
    reached = algorithms.sssp(g, _busiest(g)).values().where("val < 4294967295")
    return reached.agg(F.count("*").alias("reached"), F.sum("val").alias("total"))


def _components(spark, d):
    return algorithms.cc(build.build_graph(retq(spark, d))).values()


@query(sql.labels("retq") + "SELECT v, val FROM labels_")
def cc_labels(spark, d):
    return _components(spark, d)


@query(sql.labels("retq") + "SELECT val AS label, count(*) AS n FROM labels_ GROUP BY val")
def cc_sizes(spark, d):
    return _components(spark, d).groupBy(F.col("val").alias("label")).agg(F.count("*").alias("n"))


@query(sql.labels("retq") + "SELECT count(DISTINCT val) AS n FROM labels_")
def cc_count(spark, d):
    return _components(spark, d).agg(F.count_distinct("val").alias("n"))


@query(sql.labels("retq") + "SELECT v, val FROM labels_")
def cc_contract(spark, d):
    return algorithms.cc(build.build_graph(retq(spark, d)), method="contract").values()


@query(sql.labels("copart_q40", rounds=30) + "SELECT v, val FROM labels_")
def cc_directed(spark, d):
    return algorithms.cc(_q40(spark, d)).values()


def _ranks(spark, d, iterations, edges=copart):
    return algorithms.pagerank(build.build_graph(edges(spark, d)), iterations).values().select("v", F.round("val", 6).alias("rank"))


@query(sql.ranks("copart", 1) + "SELECT v, round(val, 6) AS rank FROM final")
def pagerank_1(spark, d):
    return _ranks(spark, d, 1)


@query(sql.ranks("copart", 10) + "SELECT v, round(val, 6) AS rank FROM final")
def pagerank_10(spark, d):
    return _ranks(spark, d, 10)


@query(sql.ranks("copart", 20) + "SELECT v, round(val, 6) AS rank FROM final")
def pagerank_20(spark, d):
    return _ranks(spark, d, 20)


@query(sql.ranks("copart_q40", 20) + "SELECT v, round(val, 6) AS rank FROM final")
def pagerank_q40(spark, d):
    return _ranks(spark, d, 20, copart_q40)


@query(sql.ranks("copart", 10) + "SELECT v, round(val, 6) AS rank FROM final ORDER BY rank DESC, v LIMIT 20")
def pagerank_topk(spark, d):
    return _ranks(spark, d, 10).orderBy(F.desc("rank"), "v").limit(20)


# -- one round, metrics, cost model ------------------------------------------------------------


def _step(spark, d, program, mode, weight="none"):
    g = build.build_graph(copart(spark, d), weight=weight)
    return superstep(initial(g, program), g.edges, program, mode).select("v", "val", "active")


@query(sql.with_vertices("copart") + "SELECT v, CASE WHEN v = 0 THEN CAST(0 AS BIGINT) WHEN v IN (SELECT dst FROM e WHERE src = 0) THEN CAST(1 AS BIGINT) END AS val, v <> 0 AND v IN (SELECT dst FROM e WHERE src = 0) AS active FROM vs")
def step_bfs(spark, d):
    return _step(spark, d, algorithms.bfs_program(0), "push")


@query(sql.with_vertices("copart") + ", m AS (SELECT dst, min((src + dst) % 100) AS w FROM e WHERE src = 0 GROUP BY dst) SELECT v, CASE WHEN v = 0 THEN 0 ELSE w END AS val, v <> 0 AND w IS NOT NULL AS active FROM vs LEFT JOIN m ON dst = v")
def step_sssp(spark, d):
    return _step(spark, d, algorithms.sssp_program(0), "pull", "synthetic")


@query(sql.with_vertices("copart") + ", m AS (SELECT dst, min(src) AS l FROM e GROUP BY dst) SELECT v, least(v, coalesce(l, v)) AS val, coalesce(l < v, false) AS active FROM vs LEFT JOIN m ON dst = v")
def step_cc(spark, d):
    return _step(spark, d, algorithms.cc_program(), "push")


@query(sql.ranks("copart", 2, middle=True) + "SELECT v, round(val, 9) AS val, true AS active FROM final")
def step_pr(spark, d):
    return _step(spark, d, algorithms.pagerank_program(2), "pull").withColumn("val", F.round("val", 9))


_ROUNDS = sql.levels("copart_q40", sql.BUSIEST) + """, r AS (SELECT unnest(range(1, (SELECT max(val) FROM levels WHERE val < 4294967295) + 2)) AS round),
od AS (SELECT src, count(*) AS n FROM e GROUP BY src),
l AS (SELECT val, count(*) AS n, CAST(coalesce(sum(od.n), 0) AS BIGINT) AS edges FROM levels LEFT JOIN od ON src = v GROUP BY val),
log AS (SELECT CAST(round AS INT) AS round, a.n AS active_in, a.edges AS active_edges, coalesce(b.n, 0) AS activated FROM r JOIN l a ON a.val = round - 1 LEFT JOIN l b ON b.val = round) """


@query(_ROUNDS + "SELECT * FROM log")
def frontier_per_round(spark, d):
    g = _q40(spark, d)
    return algorithms.bfs(g, _busiest(g)).metrics().select("round", "active_in", "active_edges", "activated")


@query(_ROUNDS + "SELECT round, CASE WHEN active_edges < (SELECT count(*) FROM e) // 20 THEN 'push' ELSE 'pull' END AS mode FROM log")
def direction_per_round(spark, d):
    g = _q40(spark, d)
    return algorithms.bfs(g, _busiest(g)).metrics().select("round", "mode")


@query(_ROUNDS + ", m AS (SELECT val + 1 AS round, count(DISTINCT dst) AS n FROM levels JOIN e ON src = v WHERE val < 4294967295 GROUP BY val), t AS (SELECT count(*) AS len FROM levels) SELECT CAST(l.round AS INT) AS round, coalesce(m.n, 0) AS messages, CAST(4 * CASE WHEN coalesce(m.n, 0) = 0 THEN 5 ELSE 5 + 2 * m.n END AS BIGINT) AS message_bytes FROM log l LEFT JOIN m ON m.round = l.round, t")
def messages_per_round(spark, d):
    g = _q40(spark, d)
    return algorithms.bfs(g, _busiest(g), direction="push").metrics().select("round", "messages", "message_bytes")


@query(sql.levels("copart_q40", sql.BUSIEST) + "SELECT v, val FROM levels")
def bfs_resumed(spark, d):
    """Two rounds, then a run that goes on from what they left."""
    g, path = _q40(spark, d), new_path(spark, "resumed")
    root = _busiest(g)
    algorithms.bfs(g, root, path=path, max_rounds=2)
    return algorithms.bfs(g, root, path=path, resume=True).values()


@query(sql.levels("copart_q40", sql.BUSIEST) + "SELECT v, val FROM levels")
def bfs_kept(spark, d):
    """On a graph that was loaded before the request."""
    name = new_path(spark, "kept")
    registry.load(name, _q40(spark, d))
    try:
        return algorithms.bfs(registry.get(name), _busiest(registry.get(name))).values()
    finally:
        registry.unload(name)


_SEGMENTS = "WITH s AS (SELECT o_orderkey AS k, o_orderkey * 37 % 1500000 AS n, 2000000 AS len FROM orders) "


def _segments(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k")).withColumn("n", F.col("k") * 37 % 1500000).withColumn("len", F.lit(2000000).cast("long"))


@query(_SEGMENTS + "SELECT k, CASE WHEN n = 0 THEN 'MAGIC' WHEN n <= 100000 THEN 'PAIR' WHEN n <= 1000000 THEN 'SPARSE' ELSE 'DENSE' END AS format FROM s")
def segment_format(spark, d):
    return _segments(spark, d).select("k", segments.segment_format(F.col("n")).alias("format"))


@query(_SEGMENTS + "SELECT k, CAST(4 * CASE WHEN n = 0 THEN 5 WHEN n <= 100000 THEN 5 + 2 * n WHEN n <= 1000000 THEN 5 + (len >> 5) + 2 + n ELSE 5 + (len >> 5) + 2 + len END AS BIGINT) AS bytes FROM s")
def segment_bytes(spark, d):
    return _segments(spark, d).select("k", segments.segment_bytes(F.col("n"), F.col("len")).alias("bytes"))


def _reduced(spark, d, name):
    return copart(spark, d).groupBy(F.col("dst").alias("v")).agg(REDUCERS[name](F.col("src")).alias("val"))


@query(sql.with_edges("copart") + "SELECT dst AS v, min(src) AS val FROM e GROUP BY dst")
def reduce_min(spark, d):
    return _reduced(spark, d, "min")


@query(sql.with_edges("copart") + "SELECT dst AS v, CAST(sum(src) AS BIGINT) AS val FROM e GROUP BY dst")
def reduce_add(spark, d):
    return _reduced(spark, d, "sum")


@query(sql.with_edges("copart") + "SELECT dst AS v, min(src) AS val FROM e GROUP BY dst")
def reduce_up(spark, d):
    return _reduced(spark, d, "up")


# -- sets ---------------------------------------------------------------------------------------


def _ends(spark, d):
    e = copart_q40(spark, d)
    return e.select(F.col("src").alias("v")), e.select(F.col("dst").alias("v"))


@query(sql.with_edges("copart_q40") + "SELECT src AS v FROM e UNION SELECT dst FROM e")
def set_or(spark, d):
    return sets.union(*_ends(spark, d))


@query(sql.with_edges("copart_q40") + "SELECT src AS v FROM e INTERSECT SELECT dst FROM e")
def set_and(spark, d):
    return sets.intersect(*_ends(spark, d))


@query(sql.with_edges("copart_q40") + "(SELECT src AS v FROM e UNION SELECT dst FROM e) EXCEPT SELECT src FROM e")
def set_not(spark, d):
    a, b = _ends(spark, d)
    return sets.complement(a, sets.union(a, b))


@query(sql.with_edges("copart_q40") + "SELECT count(DISTINCT src) AS n FROM e")
def set_count(spark, d):
    return sets.bitmap_cardinality(sets.bitmap(_ends(spark, d)[0]))


@query(sql.with_edges("copart_q40") + "SELECT DISTINCT src AS v FROM e ORDER BY v")
def set_ordered(spark, d):
    return sets.ordered(_ends(spark, d)[0])


# -- partitioning --------------------------------------------------------------------------------


@query(sql.strips("src", 4))
def part_row(spark, d):
    return part.row(copart(spark, d), 4)


@query(sql.strips("dst", 4))
def part_column(spark, d):
    return part.column(copart(spark, d), 4)


@query(sql.mondriaan("src", 2, 3))
def part_mondriaan_rc(spark, d):
    return part.mondriaan_row_column(copart(spark, d), 6)


@query(sql.mondriaan("dst", 3, 2))
def part_mondriaan_cr(spark, d):
    return part.mondriaan_column_row(copart(spark, d), 6)


@query(sql.grid(2, "i * 2 + j"))
def part_naive(spark, d):
    return part.naive(copart(spark, d), 4)


@query(sql.grid(3, None))
def grid_counts(spark, d):
    e = copart(spark, d)
    cuts = part.equal_cuts(part.num_vertices(e), 3)
    return part.grid_counts(e, cuts, cuts)


@query(sql.grid(4, "i % 2 * 2 + j % 2"))
def part_cycle(spark, d):
    return part.cycle(copart(spark, d), 4)


@query(sql.grid(4, "(i + i // 2) % 2 * 2 + j % 2"))
def part_stagger(spark, d):
    return part.stagger(copart(spark, d), 4)


@query(sql.hash_strips(3))
def part_hash(spark, d):
    return part.hash_rows(copart(spark, d), 3)


@query("WITH b AS (" + sql.grid(4, "i % 2 * 2 + j % 2") + ") SELECT round(max(edges) / avg(edges), 9) AS unbalance, count(*) FILTER (edges > 0) AS non_empty FROM b")
def part_balance(spark, d):
    return stats.balance(part.cycle(copart(spark, d), 4)).withColumn("unbalance", F.round("unbalance", 9))


@query("WITH b AS (" + sql.grid(4, "i % 2 * 2 + j % 2") + ") SELECT owner, CAST(sum(edges + 10 * (to_source - from_source + to_dest - from_dest)) AS BIGINT) AS workload FROM b GROUP BY owner")
def part_work(spark, d):
    return stats.workload(part.cycle(copart(spark, d), 4))


@query("WITH w AS (SELECT sum(edges + 10 * (to_source - from_source + to_dest - from_dest)) AS x FROM (" + sql.grid(4, "i % 2 * 2 + j % 2") + ") GROUP BY owner) SELECT CAST(sum(x) AS BIGINT) AS total, round(avg(x), 6) AS mean, CAST(max(x) AS BIGINT) AS max, CAST(min(x) AS BIGINT) AS min, round(max(x) / avg(x), 6) AS max_ratio, round(min(x) / avg(x), 6) AS min_ratio FROM w")
def part_work_report(spark, d):
    out = stats.work_report(part.cycle(copart(spark, d), 4))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "max_ratio", "min_ratio")})


@query(sql.communication(4, "i % 2 * 2 + j % 2") + "SELECT owner, CAST(n AS BIGINT) AS communication FROM comm")
def part_comm(spark, d):
    e = copart_q40(spark, d)
    return stats.communication(e, part.cycle(e, 4))


@query(sql.communication(4, "i % 2 * 2 + j % 2") + "SELECT a.owner AS a, b.owner AS b, count(*) AS gain FROM ends a JOIN ends b USING (kind, v) WHERE a.owner < b.owner GROUP BY ALL")
def pack_gain(spark, d):
    e = copart_q40(spark, d)
    return stats.pair_gain(e, part.cycle(e, 4))


@query("WITH w AS (SELECT owner, sum(edges) AS x FROM (" + sql.grid(4, "i % 2 * 2 + j % 2") + ") GROUP BY owner) SELECT round(max(x) / avg(x), 9) AS ratio FROM w")
def part_edge_ratio(spark, d):
    return stats.edge_workload_ratio(part.cycle(copart(spark, d), 4)).withColumn("ratio", F.round("ratio", 9))


@query("WITH w AS (SELECT n AS communication FROM (" + sql.communication(4, "i % 2 * 2 + j % 2") + "SELECT n FROM comm)) SELECT CAST(sum(communication) AS BIGINT) AS total, round(avg(communication), 6) AS mean, max(communication) AS max, min(communication) AS min, round(max(communication) / avg(communication), 6) AS max_ratio, round(min(communication) / avg(communication), 6) AS min_ratio FROM w")
def part_comm_report(spark, d):
    e = copart_q40(spark, d)
    return stats.communication_report(e, part.cycle(e, 4)).withColumns({c: F.round(c, 6) for c in ("mean", "max_ratio", "min_ratio")})


@query("WITH g AS (" + sql.grid(4, "i % 2 * 2 + j % 2") + "), g2 AS (SELECT * FROM g WHERE from_source < to_source AND from_dest < to_dest), f AS (SELECT owner, min(from_source * 1000000000 + from_dest) AS first FROM g2 GROUP BY owner), o AS (SELECT owner, CAST(row_number() OVER (ORDER BY first) - 1 AS INT) AS new_owner FROM f) SELECT new_owner AS owner, from_source, to_source, from_dest, to_dest, edges FROM g2 JOIN o USING (owner)")
def part_normalized(spark, d):
    blocks = part.cycle(copart(spark, d), 4).where("from_source < to_source and from_dest < to_dest")
    return part.normalize(blocks.withColumn("owner", (F.col("owner") * 7 + 3) % 11))


@query()
def part_binpack(spark, d):
    e = copart(spark, d)
    return part.bin_pack(e, part.naive(e, 16), 4, 1.3)


@query()
def part_checkerboard(spark, d):
    return part.checkerboard(copart(spark, d), 6, ratio=1.5)


_PACKED = "SELECT {owners} AS owners, CAST(count(*) AS BIGINT) AS edges, true AS within, true AS tiles FROM e"


def _packed(e, blocks, parts, ratio):
    """Owners, their edges, whether all keep the limit, and whether each edge lies in one block of its count."""
    loads = [r.workload for r in stats.workload(blocks).collect()]
    counted = stats.block_edges(e, blocks).withColumnRenamed("edges", "counted")
    out = blocks.groupBy("owner").agg(F.sum("edges").alias("edges")).join(counted, "owner", "left")
    sums = out.agg(F.count_if(F.col("edges") >= 0).cast("int").alias("owners"), F.sum("edges").alias("edges"), F.every(F.col("edges") == F.coalesce("counted", F.lit(0))).alias("tiles"))
    return sums.withColumn("within", F.lit(max(loads) <= sum(loads) / parts * ratio))


@query(sql.with_edges("copart") + _PACKED.format(owners=4))
def part_binpack_check(spark, d):
    e = copart(spark, d)
    return _packed(e, part.bin_pack(e, part.naive(e, 16), 4, 1.3), 4, 1.3)


@query(sql.with_edges("copart") + _PACKED.format(owners=6))
def part_checkerboard_check(spark, d):
    e = copart(spark, d)
    return _packed(e, part.checkerboard(e, 6, ratio=1.5), 6, 1.5)


@query("WITH b AS (" + sql.mondriaan("src", 2, 3) + "), e AS (" + sql.edges("copart") + "), s AS (SELECT x AS a, lead(x) OVER (ORDER BY x) AS z FROM (SELECT from_source AS x FROM b UNION SELECT to_source FROM b)), t AS (SELECT x AS a, lead(x) OVER (ORDER BY x) AS z FROM (SELECT from_dest AS x FROM b UNION SELECT to_dest FROM b)), c AS (SELECT owner, s.a AS from_source, s.z AS to_source, t.a AS from_dest, t.z AS to_dest FROM s, t, b WHERE s.a >= b.from_source AND s.z <= b.to_source AND t.a >= b.from_dest AND t.z <= b.to_dest) SELECT c.*, count(src) AS edges FROM c LEFT JOIN e ON src >= from_source AND src < to_source AND dst >= from_dest AND dst < to_dest GROUP BY ALL")
def part_refined(spark, d):
    e = copart(spark, d)
    return part.refine(e, part.mondriaan_row_column(e, 6))


@query()
def part_lp(spark, d):
    return part.label_propagation(copart_q40(spark, d), 4)


@query(sql.with_edges("copart") + "SELECT count(*) AS edges, (SELECT max(greatest(src, dst)) + 1 FROM e) AS vertices, true AS within, true AS no_worse FROM e")
def part_lp_tiles(spark, d):
    """All vertices have a part, no part is above its room, and no more edges are cut than between the ranges it starts from."""
    e = copart(spark, d)
    n = part.num_vertices(e)
    state = part.label_propagation(e, 4, n)
    start = spark.range(n).select(F.col("id").alias("v"), F.floor(F.col("id") * 4 / n).cast("int").alias("part"))
    cut, before = part.edge_cut(e, state).first(), part.edge_cut(e, start).first()
    sizes = state.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("v").alias("k"))
    room = int(1.05 * -(-n // 4))
    return sizes.agg(F.lit(cut.edges).alias("edges"), F.sum("k").alias("vertices"), (F.max("n") <= room).alias("within"), F.lit(cut.cut <= before.cut).alias("no_worse"))


@query(sql.with_edges("copart") + "SELECT CAST(count(*) AS BIGINT) AS edges, true AS aligned, true AS tiles FROM e")
def part_lp_strips(spark, d):
    """Vertices ordered by part: strips begin at multiples of 64 and hold all edges."""
    e = copart(spark, d)
    blocks, moved, _ = part.laid_out(e, "lp", 4)
    counted = stats.block_edges(moved, blocks).withColumnRenamed("edges", "counted")
    return blocks.join(counted, "owner", "left").agg(F.sum("edges").alias("edges"), F.every(F.col("from_source") % 64 == 0).alias("aligned"), F.every(F.col("edges") == F.coalesce("counted", F.lit(0))).alias("tiles"))


# -- checks and logs -------------------------------------------------------------------------------


@query("SELECT CAST(0 AS BIGINT) AS exact, CAST(0 AS BIGINT) AS near")
def result_check(spark, d):
    """Push and pull plans give equal levels; ranks of two directions agree within the tolerance."""
    g = _q40(spark, d)
    root = _busiest(g)
    a, b = (algorithms.bfs(g, root, direction=m).values() for m in ("push", "pull"))
    x, y = (algorithms.pagerank(g, 3, direction=m).values() for m in ("push", "pull"))
    exact = differences(a, b).agg(F.count("*").alias("exact"))
    return exact.crossJoin(beyond(x, y).agg(F.count("*").alias("near")))


@query("SELECT CAST(o_orderkey AS BIGINT) AS path FROM orders WHERE o_orderkey % 60 > 30")
def stale_files(spark, d):
    """Files older than half an hour, of files whose age is the order's number modulo 60 minutes."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("path"))
    aged = o.withColumn("modificationTime", F.current_timestamp() - F.make_dt_interval(mins=(F.col("path") % 60).cast("int")))
    return stale(aged).select("path")


_LOGS = "WITH l AS (SELECT o_custkey % 50 AS worker, o_orderkey % 997 AS ms, o_orderkey % 31 AS mb FROM orders) "


@query(_LOGS + "SELECT CAST(max(m) AS DOUBLE) AS latency_ms, CAST(sum(b) AS DOUBLE) AS billed_ms, CAST(sum(mb) AS DOUBLE) AS memory_mb FROM (SELECT worker, max(ms) AS m, max(ms + 1) AS b, max(mb) AS mb FROM l GROUP BY worker)")
def worker_log_metrics(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    ms, mb = F.col("o_orderkey") % 997, F.col("o_orderkey") % 31
    lines = o.select((F.col("o_custkey") % 50).alias("worker"), F.concat(F.lit("REPORT\tDuration: "), ms.cast("string"), F.lit(" ms\tBilled Duration: "), (ms + 1).cast("string"), F.lit(" ms\tMax Memory Used: "), mb.cast("string"), F.lit(" MB")).alias("value"))
    names = ("duration_ms", "billed_ms", "memory_mb", "message_mb", "overall_s", "idle_s")
    workers = parse_worker_lines(lines).groupBy("worker").agg(*[F.max(n).alias(n) for n in names])
    return run_metrics(workers).select("latency_ms", "billed_ms", "memory_mb")


@query("SELECT o_orderkey - 88 AS minute, o_custkey / 100.0::DOUBLE AS requests FROM orders WHERE o_orderkey >= 88")
def trace_requests(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    lines = o.select(F.col("o_orderkey").alias("position"), F.concat(F.lit("minute x  "), F.col("o_custkey").cast("string"), F.lit(" ")).alias("value"))
    return parse_trace(lines)


def queries() -> dict[str, Callable[..., DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
