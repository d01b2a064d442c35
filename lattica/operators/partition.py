"""Edge partitioning strategies: which rectangles of the adjacency matrix belong together.

Spark deals edges by itself, so a partitioning is a report (and a layout to write),
never a precondition. Vertex ids stay as they are. Cuts fall on multiples of
``align``; so a histogram over chunks of that many vertices is all that the driver
reads, V / align numbers (raise ``align`` for graphs above some 10**8 vertices).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BLOCKS
from ..storage import materialize

ALIGN = 64
#: A vertex of a block's ranges weighs as much as so many edges (a fixed value of the workload measure).
VERTEX_WEIGHT = 10
#: Chunks of an axis, at most, in the search over the chunk matrix.
MATRIX_CHUNKS = 1024

Cuts = list[int]


def factorize(p: int) -> tuple[int, int]:
    """(largest divisor <= sqrt(p), its cofactor)."""
    low = next(d for d in range(math.isqrt(p), 0, -1) if p % d == 0)
    return low, p // low


def num_vertices(edges: DataFrame, given: int | None = None) -> int:
    if given is not None:
        return given
    top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return 0 if top is None else top + 1


def _counted(df: DataFrame, *keys: Column) -> list[np.ndarray]:
    """Rows by keys, as one array for each key and one of the counts; they come to the driver as Arrow columns."""
    got = df.groupBy(*[k.cast("long").alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n")).toArrow()
    return [got.column(i).to_numpy() for i in range(got.num_columns)]


def _chunk(column: str, align: int) -> Column:
    return F.floor(F.col(column) / align)


def _histogram(edges: DataFrame, column: str, n: int, align: int) -> np.ndarray:
    out = np.zeros(-(-n // align), np.int64)
    at, counts = _counted(edges, _chunk(column, align))
    out[at] = counts
    return out


def sweep(weights: np.ndarray, parts: int, total: int, n: int, align: int = ALIGN) -> Cuts:
    """Greedy cuts: before a chunk, cut if what has gathered is at least total / parts. Includes 0 and n."""
    upto = np.concatenate(([0], np.cumsum(weights)))
    share, cuts = -(-total // parts), [0]
    while True:
        last = cuts[-1] // align
        c = max(int(np.searchsorted(upto, upto[last] + share)), last + 1)
        if c >= len(weights):
            return [*cuts, n]
        cuts.append(c * align)


def segment(v: Column, cuts: Cuts) -> Column:
    """Index of the range of ``cuts`` that holds v: a tree of comparisons, so that it may be a join key."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high + 1) // 2
        return F.when(v >= cuts[mid], search(mid, high)).otherwise(search(low, mid - 1))

    return search(0, max(len(cuts) - 2, 0))


def grid_counts(edges: DataFrame, source_cuts: Cuts, dest_cuts: Cuts) -> DataFrame:
    """Edges of each non-empty cell: row, col, edges."""
    return edges.groupBy(segment(F.col("src"), source_cuts).alias("row"), segment(F.col("dst"), dest_cuts).alias("col")).agg(F.count("*").alias("edges"))


def _frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, BLOCKS)


def _strips(edges: DataFrame, cuts: Cuts, n: int, by_source: bool) -> list[tuple]:
    column = "src" if by_source else "dst"
    counts = {r.s: r.n for r in edges.groupBy(segment(F.col(column), cuts).alias("s")).agg(F.count("*").alias("n")).collect()}
    spans = list(zip(cuts, cuts[1:], strict=False))
    return [(i, a, z, 0, n, counts.get(i, 0)) if by_source else (i, 0, n, a, z, counts.get(i, 0)) for i, (a, z) in enumerate(spans)]


def row(edges: DataFrame, parts: int, n: int | None = None, align: int = ALIGN) -> DataFrame:
    """Ranges of sources with about as many out-edges each, by all destinations."""
    n = num_vertices(edges, n)
    h = _histogram(edges, "src", n, align)
    return _frame(edges.sparkSession, _strips(edges, sweep(h, parts, int(h.sum()), n, align), n, True))


def column(edges: DataFrame, parts: int, n: int | None = None, align: int = ALIGN) -> DataFrame:
    """Ranges of destinations with about as many in-edges each, by all sources."""
    n = num_vertices(edges, n)
    h = _histogram(edges, "dst", n, align)
    return _frame(edges.sparkSession, _strips(edges, sweep(h, parts, int(h.sum()), n, align), n, False))


def _mondriaan(edges: DataFrame, parts: int, n: int | None, align: int, first: str, second: str) -> DataFrame:
    """Strips along ``first``, each cut along ``second`` by its own edges."""
    n = num_vertices(edges, n)
    r, c = factorize(parts)
    outer, inner = (r, c) if first == "src" else (c, r)
    h = _histogram(edges, first, n, align)
    cuts = sweep(h, outer, int(h.sum()), n, align)
    spans = list(zip(cuts, cuts[1:], strict=False))
    strip, chunk, counts = _counted(edges, segment(F.col(first), cuts), _chunk(second, align))
    rows = []
    for i, (a, z) in enumerate(spans):
        own = np.zeros(-(-n // align), np.int64)
        own[chunk[strip == i]] = counts[strip == i]
        sub = sweep(own, inner, int(own.sum()), n, align)
        for x, y in zip(sub, sub[1:], strict=False):
            e = int(own[x // align : -(-y // align)].sum())
            rows.append((len(rows), a, z, x, y, e) if first == "src" else (len(rows), x, y, a, z, e))
    return _frame(edges.sparkSession, rows)


def mondriaan_row_column(edges: DataFrame, parts: int, n: int | None = None, align: int = ALIGN) -> DataFrame:
    return _mondriaan(edges, parts, n, align, "src", "dst")


def mondriaan_column_row(edges: DataFrame, parts: int, n: int | None = None, align: int = ALIGN) -> DataFrame:
    """Column strips (the larger factor of ``parts``), each cut by its own sources, so blocks tile the edges."""
    return _mondriaan(edges, parts, n, align, "dst", "src")


def equal_cuts(n: int, k: int, align: int = ALIGN) -> Cuts:
    """k equal ranges, the first n % k one larger; inner cuts aligned down (for few vertices some ranges are empty)."""
    whole, extra = divmod(n, k)
    cuts = [0]
    for i in range(k):
        cuts.append(cuts[-1] + whole + (i < extra))
    return [c // align * align for c in cuts[:-1]] + [n]


def grid(edges: DataFrame, source_cuts: Cuts, dest_cuts: Cuts, owner=None) -> DataFrame:
    """All cells of the grid, row by row; owner(row, col) or the cell's number."""
    counts = {(r.row, r.col): r.edges for r in grid_counts(edges, source_cuts, dest_cuts).collect()}
    rows = []
    for i, (a, z) in enumerate(zip(source_cuts, source_cuts[1:], strict=False)):
        for j, (x, y) in enumerate(zip(dest_cuts, dest_cuts[1:], strict=False)):
            rows.append((owner(i, j) if owner else len(rows), a, z, x, y, counts.get((i, j), 0)))
    return _frame(edges.sparkSession, rows)


def naive(edges: DataFrame, parts: int, n: int | None = None, align: int = ALIGN) -> DataFrame:
    """A square grid of equal vertex ranges; parts must be a perfect square."""
    k = math.isqrt(parts)
    if k * k != parts:
        raise ValueError(f"{parts} is no perfect square")
    cuts = equal_cuts(num_vertices(edges, n), k, align)
    return grid(edges, cuts, cuts)


def cycle_owner(i: int, j: int, r: int, c: int) -> int:
    return i % r * c + j % c


def stagger_owner(i: int, j: int, r: int, c: int) -> int:
    return (i + i // r) % r * c + j % c


def _placed(edges: DataFrame, parts: int, n: int | None, align: int, owner) -> DataFrame:
    r, c = factorize(parts)
    cuts = equal_cuts(num_vertices(edges, n), parts, align)
    return grid(edges, cuts, cuts, lambda i, j: owner(i, j, r, c))


def cycle(edges: DataFrame, parts: int, n: int | None = None, align: int = ALIGN) -> DataFrame:
    """A parts x parts grid, dealt to owners in a repeating r x c pattern."""
    return _placed(edges, parts, n, align, cycle_owner)


def stagger(edges: DataFrame, parts: int, n: int | None = None, align: int = ALIGN) -> DataFrame:
    """As cycle, with the pattern shifted from one group of rows to the next."""
    return _placed(edges, parts, n, align, stagger_owner)


def hash_moved(edges: DataFrame, parts: int, n: int) -> DataFrame:
    """Edges in the ids of the order (v % parts, v)."""
    from .build import hash_order

    return edges.withColumns({c: hash_order(F.col(c), n, parts) for c in ("src", "dst")})


def hash_rows(edges: DataFrame, parts: int, n: int | None = None, align: int = ALIGN) -> DataFrame:
    """Row strips of at least ceil(n / parts) vertices in the order (v % parts, v); ranges are in that order's ids."""
    n = num_vertices(edges, n)
    target = -(-n // parts)
    step = max(-(-target // align), 1) * align  # the whole chunks that hold the target
    cuts = [*range(0, max(n, 1), step), n]
    return _frame(edges.sparkSession, _strips(hash_moved(edges, parts, n), cuts, n, True))


# -- search for a balanced symmetric grid --------------------------------------------------


def _greedy_ranges(cells: np.ndarray, size: np.ndarray, limit: int, most: int) -> list[int] | None:
    """Chunk cuts of at most ``most`` symmetric ranges, no cell above ``limit``; None if there are none. cells: 2-D prefix sums."""

    def load(a, z, x, y):
        edges = cells[z, y] - cells[a, y] - cells[z, x] + cells[a, x]
        return edges + VERTEX_WEIGHT * (size[z] - size[a] + size[y] - size[x])

    k = len(size) - 1
    cuts = [0]
    while cuts[-1] < k:
        if len(cuts) > most:
            return None
        a, reach = cuts[-1], cuts[-1]
        spans = list(zip(cuts, cuts[1:], strict=False))
        low, high = a + 1, k
        while low <= high:  # the longest range that fits: loads grow with the range
            mid = (low + high) // 2
            if load(a, mid, a, mid) <= limit and all(load(a, mid, x, y) <= limit and load(x, y, a, mid) <= limit for x, y in spans):
                reach, low = mid, mid + 1
            else:
                high = mid - 1
        if reach == a:
            return None
        cuts.append(reach)
    return cuts if len(cuts) - 1 <= most else None


def balanced_cuts(edges: DataFrame, n: int, most: int, align: int = ALIGN) -> tuple[Cuts, int]:
    """Symmetric cuts into at most ``most`` ranges with the smallest cell workload, and that limit.

    The driver holds a matrix of at most about 2 * MATRIX_CHUNKS chunks. Where that makes chunks wider than
    ``align``, the chunks on either side of each cut are divided and the search goes on, until cuts
    lie on multiples of ``align`` (each the best within the chunks that the pass before left open).
    """
    step = align
    while -(-n // step) > MATRIX_CHUNKS:
        step *= 2
    points = np.minimum(np.arange(-(-n // step) + 1) * step, n)
    while True:
        cuts, limit = _searched(edges, points, most)
        if step == align:
            return cuts, limit
        finer = max(align, step // max(2, MATRIX_CHUNKS // (2 * len(cuts)) // 2 * 2))
        finer = align * (1 << ((finer // align).bit_length() - 1))
        near = [np.arange(max(c - step, 0), min(c + step, n), finer) for c in cuts[1:-1]]
        points, step = np.unique(np.concatenate([np.array([0, n]), np.arange(0, n, step)[:: max(1, -(-n // step) // MATRIX_CHUNKS)], *near, cuts])), finer


def _searched(edges: DataFrame, points: np.ndarray, most: int) -> tuple[Cuts, int]:
    """The best cuts at the given points (0 ... n, ascending), and the largest cell."""
    k, n = len(points) - 1, int(points[-1])

    def count(batches):
        for batch in batches:
            i, j = (np.searchsorted(points, batch.column(c).to_numpy(), "right") - 1 for c in (0, 1))
            at, seen = np.unique(i * k + j, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at // k), pa.array(at % k), pa.array(seen)], names=["i", "j", "n"])

    got = edges.select("src", "dst").mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros((k + 1, k + 1), np.int64)
    matrix[got.column("i").to_numpy() + 1, got.column("j").to_numpy() + 1] = got.column("n").to_numpy()
    cells = matrix.cumsum(0).cumsum(1)
    low, high = 0, int(cells[-1, -1]) + 2 * VERTEX_WEIGHT * n
    while low < high:
        mid = (low + high) // 2
        if _greedy_ranges(cells, points, mid, most) is None:
            low = mid + 1
        else:
            high = mid
    cuts = _greedy_ranges(cells, points, high, most) or [0]
    return [int(points[c]) for c in cuts], high


def checkerboard_cells(edges: DataFrame, parts: int, n: int | None = None, align: int = ALIGN) -> DataFrame:
    """Balanced grid with at least ``parts`` non-empty cells where the graph allows; empty off-diagonal cells are dropped."""
    n = num_vertices(edges, n)
    cut, best = math.ceil(math.sqrt(parts)), None
    while True:
        cuts, _ = balanced_cuts(edges, n, cut, align)
        blocks = grid(edges, cuts, cuts).collect()
        full = [r for r in blocks if r.edges > 0]
        if len(full) >= parts or (best is not None and len(full) <= best) or cut > parts:
            break
        best, cut = len(full), cut + 1
    kept = [r for r in blocks if r.edges > 0 or (r.from_source, r.to_source) == (r.from_dest, r.to_dest)]
    return _frame(edges.sparkSession, [(i, *r[1:]) for i, r in enumerate(kept)])


def vertex_sets(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """owner, kind (recv: sources with an edge in the owner's blocks; send: destinations), v; distinct."""
    owned = with_owner(edges, blocks)
    ends = owned.select("owner", F.explode(F.create_map(F.lit("recv"), F.col("src"), F.lit("send"), F.col("dst"))).alias("kind", "v"))
    return ends.distinct()


def with_owner(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges with the owner of their block (blocks tile the matrix; their number is small, and bounded by parts squared)."""
    b = blocks.select("owner", "from_source", "to_source", "from_dest", "to_dest").collect()
    sources = sorted({x for r in b for x in (r.from_source, r.to_source)})
    dests = sorted({x for r in b for x in (r.from_dest, r.to_dest)})
    cells = []
    for r in b:
        for i in range(sources.index(r.from_source), sources.index(r.to_source)):
            cells += [(i, j, r.owner) for j in range(dests.index(r.from_dest), dests.index(r.to_dest))]
    place = edges.sparkSession.createDataFrame(cells, "_i int, _j int, owner int")
    return edges.withColumn("_i", segment(F.col("src"), sources)).withColumn("_j", segment(F.col("dst"), dests)).join(F.broadcast(place), ["_i", "_j"]).drop("_i", "_j")


def refine(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks cut along all cut points of either axis; each cell keeps its block's owner."""
    b = blocks.collect()
    sources = sorted({x for r in b for x in (r.from_source, r.to_source)})
    dests = sorted({x for r in b for x in (r.from_dest, r.to_dest)})

    def owner(i, j):
        a, x = sources[i], dests[j]
        return next((r.owner for r in b if r.from_source <= a < r.to_source and r.from_dest <= x < r.to_dest), None)

    return grid(edges, sources, dests, owner).where("owner is not null")


def signatures(edges: DataFrame, blocks: DataFrame) -> dict[str, list[tuple[int, int]]]:
    """For recv and send: (bitmap of the blocks that have a vertex, number of such vertices).

    Vertices come to the driver only as counts by the set of blocks they're in; a vertex's
    blocks share a row or a column of the grid, so there are few such sets.
    """
    numbered = {r.owner: i for i, r in enumerate(blocks.select("owner").orderBy("owner").collect())}
    sets = vertex_sets(edges, blocks).groupBy("kind", "v").agg(F.array_sort(F.collect_set("owner")).alias("o")).groupBy("kind", "o").agg(F.count("*").alias("n")).collect()
    return {k: [(sum(1 << numbered[x] for x in r.o), r.n) for r in sets if r.kind == k] for k in ("recv", "send")}


def gain(marks: dict[str, list[tuple[int, int]]], a: int, b: int) -> int:
    """Vertices that two sets of blocks (bitmaps) both receive, plus those that both send."""
    return sum(n for own in marks.values() for m, n in own if m & a and m & b)


def bin_pack(edges: DataFrame, blocks: DataFrame, parts: int, ratio: float) -> DataFrame:
    """Unites blocks to ``parts`` owners: always the two sets of largest gain whose workload stays within the limit.

    The limit is total workload / parts * ratio; ties go to the lowest (i, j). Raises if a block alone
    is above it, or if no two sets fit any more.
    """
    b = blocks.orderBy("from_source", "from_dest").collect()
    load = [r.edges + VERTEX_WEIGHT * (r.to_source - r.from_source + r.to_dest - r.from_dest) for r in b]
    marks = signatures(edges, _frame(edges.sparkSession, [(i, *r[1:]) for i, r in enumerate(b)]))
    limit = sum(load) / parts * ratio
    if load and max(load) > limit:
        raise ValueError(f"a block alone is above {ratio} times the mean workload of {parts} sets")
    sets = [(1 << i, w) for i, w in enumerate(load)]
    gains = {(i, j): gain(marks, sets[i][0], sets[j][0]) for i in range(len(sets)) for j in range(i + 1, len(sets))}
    alive = list(range(len(sets)))
    while len(alive) > parts:
        fits = [(-gains[i, j], i, j) for k, i in enumerate(alive) for j in alive[k + 1 :] if sets[i][1] + sets[j][1] <= limit]
        if not fits:
            raise ValueError(f"no plan of {parts} sets within {ratio} times the mean workload")
        _, i, j = min(fits)
        sets[i] = (sets[i][0] | sets[j][0], sets[i][1] + sets[j][1])
        alive.remove(j)
        for k in alive:
            if k != i:
                gains[min(i, k), max(i, k)] = gain(marks, sets[i][0], sets[k][0])
    owner = {x: o for o, i in enumerate(alive) for x in range(len(b)) if sets[i][0] >> x & 1}
    return normalize(_frame(edges.sparkSession, [(owner[x], *r[1:]) for x, r in enumerate(b)]))


def normalize(blocks: DataFrame) -> DataFrame:
    """Owners renumbered by their first block in the order (from_source, from_dest)."""
    rows = sorted(blocks.collect(), key=lambda r: (r.from_source, r.from_dest))
    number: dict[int, int] = {}
    return _frame(blocks.sparkSession, [(number.setdefault(r.owner, len(number)), *r[1:]) for r in rows])


def checkerboard(edges: DataFrame, parts: int, n: int | None = None, align: int = ALIGN, ratio: float = 1.2) -> DataFrame:
    """Balanced grid cells, united to ``parts`` owners where there are more."""
    cells = checkerboard_cells(edges, parts, n, align)
    return bin_pack(edges, cells, parts, ratio) if cells.count() > parts else cells


# -- parts of vertices -----------------------------------------------------------------------


def label_propagation(edges: DataFrame, parts: int, n: int | None = None, tolerance: float = 0.05, rounds: int = 5) -> DataFrame:
    """v, part: every vertex in one part of at most (1 + tolerance) * n / parts vertices, with few edges between parts.

    Starts from equal ranges; in a round each vertex asks for the part most of its
    neighbours are in, and a part takes those of largest gain as far as it has room.
    Wishes are admitted by gain classes, counted per part, so no part's wishes are sorted
    in one place: whole classes are admitted while they fit, and of the class that doesn't
    a share by hash small enough to fit.
    """
    spark = edges.sparkSession
    n = num_vertices(edges, n)
    room = math.floor((1 + tolerance) * math.ceil(n / parts))
    both = materialize(edges.where("src != dst").select("src", "dst").unionByName(edges.where("src != dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("*").alias("w")), "lp")
    state = materialize(spark.range(n).select(F.col("id").alias("v"), F.floor(F.col("id") * parts / max(n, 1)).cast("int").alias("part")), "lp")
    for k in range(rounds):
        near = both.join(state.withColumnsRenamed({"v": "dst"}), "dst").groupBy(F.col("src").alias("v"), "part").agg(F.sum("w").alias("w"))
        wish = near.groupBy("v").agg(F.max(F.struct("w", (-F.col("part")).alias("p"))).alias("best"), F.collect_list(F.struct("part", "w")).alias("all"))
        own = F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + F.when(x["part"] == F.col("part"), x["w"]).otherwise(0))
        asks = wish.join(state, "v").select("v", "part", (-F.col("best.p")).cast("int").alias("to"), F.least(F.col("best.w") - own, F.lit(1000)).alias("gain")).where("to != part and gain > 0")
        asks = materialize(asks, "lp")
        sizes = {r.part: r.n for r in state.groupBy("part").agg(F.count("*").alias("n")).collect()}
        classes = asks.groupBy("to", "gain").agg(F.count("*").alias("n")).collect()
        admitted = []
        for p in range(parts):
            left = room - sizes.get(p, 0)
            for r in sorted((r for r in classes if r.to == p), key=lambda r: -r.gain):
                share = 1.0 if r.n <= left else max(0.0, (left - 3 * math.sqrt(max(left, 0)) - 1) / r.n)
                if share <= 0:
                    break
                admitted.append((p, r.gain, share))
                left -= r.n if share == 1.0 else left
        if not admitted:
            break
        take = spark.createDataFrame(admitted, "to int, gain long, share double")
        moved = asks.join(F.broadcast(take), ["to", "gain"]).where(F.pmod(F.xxhash64("v", F.lit(k)), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("v", "to")
        new = materialize(state.join(moved, "v", "left").select("v", F.coalesce("to", "part").alias("part")), "lp")
        worst = new.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if worst > room:  # the hash let too many in
            break
        state = new
    return state


def edge_cut(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """cut, edges: how many edges run between parts, of how many."""
    a = assignment.select(F.col("v").alias("src"), F.col("part").alias("p"))
    z = assignment.select(F.col("v").alias("dst"), F.col("part").alias("q"))
    return edges.join(a, "src").join(z, "dst").agg(F.coalesce(F.sum((F.col("p") != F.col("q")).cast("long")), F.lit(0)).alias("cut"), F.count("*").alias("edges"))


def lp_parts(edges: DataFrame, parts: int, n: int | None = None, align: int = ALIGN, **options) -> tuple[DataFrame, DataFrame, int]:
    """Blocks, edges and number of ids after vertices are ordered by the part that label propagation gives them.

    A part's ids begin at a multiple of ``align``; its block is the strip of its sources by all destinations.
    """
    from .build import part_order

    order = materialize(part_order(label_propagation(edges, parts, n, **options), align), "lp")
    spans = {r.part: (r.a, r.z) for r in order.groupBy("part").agg(F.min("new_id").alias("a"), (F.max("new_id") + 1).alias("z")).collect()}
    total = max((z for _, z in spans.values()), default=0)
    moved = edges
    for c in ("src", "dst"):
        moved = moved.join(order.select(F.col("v").alias(c), F.col("new_id").alias("_new")), c).drop(c).withColumnRenamed("_new", c)
    moved = materialize(moved.select(*edges.columns), "lp")
    counts = {r.s: r.n for r in moved.groupBy(segment(F.col("src"), [*(spans[p][0] for p in sorted(spans)), total]).alias("s")).agg(F.count("*").alias("n")).collect()}
    rows = [(p, *spans[p], 0, total, counts.get(i, 0)) for i, p in enumerate(sorted(spans))]
    return _frame(edges.sparkSession, rows), moved, total


STRATEGIES = {
    "row": row,
    "column": column,
    "mondriaan_row_column": mondriaan_row_column,
    "mondriaan_column_row": mondriaan_column_row,
    "naive": naive,
    "hash": hash_rows,
    "checkerboard": checkerboard,
    "cycle": cycle,
    "stagger": stagger,
    "lp": lambda edges, parts, **options: lp_parts(edges, parts, **options)[0],
}


def partition(edges: DataFrame, strategy: str, parts: int, **options) -> DataFrame:
    """Blocks by the strategy of that name; an unknown name raises. Blocks of "hash" and "lp" are in the ids of their order."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](edges, parts, **options)


def laid_out(edges: DataFrame, strategy: str, parts: int, n: int | None = None, **options) -> tuple[DataFrame, DataFrame, int]:
    """Blocks, the edges in the ids that the blocks are in, and the number of these ids."""
    n = num_vertices(edges, n)
    if strategy == "lp":
        return lp_parts(edges, parts, n, **options)
    blocks = partition(edges, strategy, parts, n=n, **options)
    return blocks, hash_moved(edges, parts, n) if strategy == "hash" else edges, n
