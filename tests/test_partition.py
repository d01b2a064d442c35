import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.functions import segments, sets
from lattica.operators import partition as part
from lattica.operators import stats


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(rng.randrange(300), int(300 * rng.random() ** 2)) for _ in range(4000)], "src long, dst long").cache()


def tiles(spark, edges, blocks, n):
    """Every edge lies in exactly one block, and the counts are true."""
    rows = blocks.collect()
    for s, d in [(r.src, r.dst) for r in edges.distinct().collect()]:
        assert sum(b.from_source <= s < b.to_source and b.from_dest <= d < b.to_dest for b in rows) == 1
    counted = {r.owner: r.edges for r in stats.block_edges(edges, blocks).collect()}
    want: dict = {}
    for b in rows:
        want[b.owner] = want.get(b.owner, 0) + b.edges
    assert {k: v for k, v in want.items() if v} == counted


@pytest.mark.parametrize("strategy,parts", [("row", 4), ("column", 3), ("mondriaan_row_column", 6), ("mondriaan_column_row", 6), ("naive", 4), ("cycle", 4), ("stagger", 4)])
def test_blocks_tile_the_edges(spark, edges, strategy, parts):
    blocks = part.partition(edges, strategy, parts, n=300)
    tiles(spark, edges, blocks, 300)
    assert all(c % 64 == 0 or c == 300 for r in blocks.collect() for c in (r.from_source, r.to_source, r.from_dest, r.to_dest))


@given(st.lists(st.integers(0, 50), min_size=1, max_size=400), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_chunk_sweep_equals_vertex_sweep(degrees, parts):
    import numpy as np

    n, total = len(degrees), sum(degrees)
    cuts, gathered = [0], 0
    for i, d in enumerate(degrees):
        if i and i % 8 == 0 and gathered * parts >= total:
            cuts.append(i)
            gathered = 0
        gathered += d
    chunks = [sum(degrees[i : i + 8]) for i in range(0, n, 8)]
    assert part.sweep(np.array(chunks), parts, total, n, 8) == [*cuts, n]


def test_factorize_and_owners():
    assert [part.factorize(p) for p in (1, 7, 12, 16)] == [(1, 1), (1, 7), (3, 4), (4, 4)]
    assert part.cycle_owner(3, 5, 2, 3) == 5 and part.stagger_owner(3, 5, 2, 3) == 2


def test_small_graph_collapses_cuts(spark):
    e = spark.createDataFrame([(0, 9), (9, 0)], "src long, dst long")
    assert part.equal_cuts(10, 4) == [0, 0, 0, 0, 10]
    tiles(spark, e, part.naive(e, 4, 10), 10)


def test_unknown_strategy_and_no_square(edges):
    with pytest.raises(ValueError):
        part.partition(edges, "nope", 2)
    with pytest.raises(ValueError):
        part.naive(edges, 5)


def test_hash_strips_count_all(edges):
    blocks = part.hash_rows(edges, 3, 300).collect()
    assert sum(b.edges for b in blocks) == 4000 and blocks[-1].to_source == 300


def test_checkerboard_is_balanced_and_tiles(spark, edges):
    cells = part.checkerboard_cells(edges, 6, 300)
    tiles(spark, edges, cells, 300)
    cuts, limit = part.balanced_cuts(edges, 300, 3)
    for r in part.grid(edges, cuts, cuts).collect():
        assert r.edges + 10 * (r.to_source - r.from_source + r.to_dest - r.from_dest) <= limit
    packed = part.checkerboard(edges, 4, 300, ratio=2.0)
    assert {r.owner for r in packed.collect()} == {0, 1, 2, 3}
    tiles(spark, edges, packed, 300)


def test_bin_packing_limit(spark, edges):
    blocks = part.naive(edges, 9, 300)
    packed = part.bin_pack(edges, blocks, 3, 1.5)
    loads = [r.workload for r in stats.workload(packed).collect()]
    assert len(loads) == 3 and max(loads) <= sum(loads) / 3 * 1.5
    with pytest.raises(ValueError):
        part.bin_pack(edges, blocks, 2, 0.5)


def test_gain_matches_pairs(spark, edges):
    blocks = part.naive(edges, 9, 300)
    marks = part.signatures(edges, blocks)
    want = {(r.a, r.b): r.gain for r in stats.pair_gain(edges, blocks).collect()}
    for a in range(9):
        for b in range(a + 1, 9):
            assert part.gain(marks, 1 << a, 1 << b) == want.get((a, b), 0)


def test_refined_cells_keep_owner(spark, edges):
    blocks = part.mondriaan_row_column(edges, 6, 300)
    tiles(spark, edges, part.refine(edges, blocks), 300)


def test_label_propagation_is_balanced(spark, edges):
    rows = [(a, b) for base in (0, 50, 100) for a in range(base, base + 50) for b in random.Random(a).sample(range(base, base + 50), 5)]
    e = spark.createDataFrame([((a * 61) % 150, (b * 61) % 150) for a, b in rows], "src long, dst long")
    state = part.label_propagation(e, 3, 150, tolerance=0.2)
    sizes = [r["count"] for r in state.groupBy("part").count().collect()]
    assert sum(sizes) == 150 and max(sizes) <= 60
    start = spark.range(150).selectExpr("id as v", "cast(floor(id * 3 / 150) as int) as part")
    assert part.edge_cut(e, state).first().cut <= part.edge_cut(e, start).first().cut


def test_segment_costs(spark):
    df = spark.createDataFrame([(0,), (100_000,), (100_001,), (1_000_001,)], "n long")
    from pyspark.sql import functions as F

    got = df.select(segments.segment_format(F.col("n")), segments.segment_bytes(F.col("n"), F.lit(3_000_000))).collect()
    assert [tuple(r) for r in got] == [("MAGIC", 20), ("PAIR", 800_020), ("SPARSE", 4 * (5 + 93752 + 100_001)), ("DENSE", 4 * (5 + 93752 + 3_000_000))]


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "v long") for xs in ([1, 2, 2, 100_000], [2, 3]))
    ids = lambda df: sorted(r.v for r in df.collect())
    assert ids(sets.union(a, b)) == [1, 2, 3, 100_000] and ids(sets.intersect(a, b)) == [2]
    assert ids(sets.complement(a, sets.union(a, b))) == [3] and sets.bitmap_cardinality(sets.bitmap(a)).first().n == 3


FRESH = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '4').config('spark.ui.enabled', 'false').config('spark.driver.host', '127.0.0.1').getOrCreate()
e = spark.read.parquet(sys.argv[1])
from lattica.operators import partition as part, stats
from lattica import sinks, storage
storage.ship(spark)
blocks = part.naive(e, 4, 300)
assert sum(r.edges for r in stats.block_edges(e, blocks).collect()) == 4000
assert stats.pair_gain(e, blocks).count() and stats.communication_report(e, blocks).first().total
assert part.vertex_sets(e, blocks).count()
sinks.write_partitioned(e, blocks, sys.argv[2], 300)
assert spark.read.parquet(sys.argv[2] + '/edges').count() == 4000
assert part.bin_pack(e, part.naive(e, 9, 300), 3, 2.0).count() == 9
"""


def test_the_edge_table_may_be_the_first_frame_of_a_session(edges, tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    edges.write.parquet(f"{tmp_path}/e")
    subprocess.run([sys.executable, "-B", "-c", FRESH, f"{tmp_path}/e", f"{tmp_path}/out"], cwd=Path(__file__).resolve().parent.parent, check=True, timeout=300)


def test_cuts_lie_on_fine_multiples_however_many_vertices(spark, monkeypatch):
    rng = random.Random(2)
    e = spark.createDataFrame([(rng.randrange(3000), int(3000 * rng.random() ** 2)) for _ in range(20000)], "src long, dst long").cache()
    whole = part.balanced_cuts(e, 3000, 4, 16)
    monkeypatch.setattr(part, "MATRIX_CHUNKS", 16)
    cuts, limit = part.balanced_cuts(e, 3000, 4, 16)
    assert all(c % 16 == 0 for c in cuts[:-1]) and limit <= 1.05 * whole[1]
    assert any(c % 256 for c in cuts[1:-1])


def test_a_block_above_the_limit_is_refused(spark):
    e = spark.createDataFrame([(0, 0)] * 900 + [(70, 70), (130, 0)], "src long, dst long")
    with pytest.raises(ValueError, match="alone"):
        part.bin_pack(e, part.naive(e, 9, 192), 8, 1.1)


def test_parts_of_vertices_become_strips(spark, edges):
    blocks, moved, n = part.laid_out(edges, "lp", 3, 300)
    tiles(spark, moved, blocks, n)
    rows = blocks.orderBy("from_source").collect()
    assert all(r.from_source % 64 == 0 for r in rows) and {(r.from_dest, r.to_dest) for r in rows} == {(0, n)}
    assert moved.count() == 4000
    blocks, moved, n = part.laid_out(edges, "hash", 3, 300)
    tiles(spark, moved, blocks, n)


@given(st.lists(st.integers(1, 500), max_size=40, unique=True), st.integers(0, 600))
@settings(max_examples=20, deadline=None)
def test_segment_is_the_range(spark, inner, v):
    from pyspark.sql import functions as F

    cuts = [0, *sorted(inner), 501]
    got = spark.range(v, v + 1).select(part.segment(F.col("id"), cuts).alias("s")).first().s
    assert got == sum(c <= v for c in cuts[1:-1])
