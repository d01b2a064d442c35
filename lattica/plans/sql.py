"""Pieces of SQL for the catalogue: derived graphs, recursions, unrolled rounds, cuts."""

from __future__ import annotations

_LEAD = "SELECT src, dst FROM (SELECT CAST(l_partkey AS BIGINT) AS src, CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS dst FROM lineitem {where}) WHERE dst IS NOT NULL"
_RETQ = "SELECT CAST(l_orderkey AS BIGINT) * 2 AS a, CAST(l_partkey AS BIGINT) * 2 + 1 AS b FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48"
_EDGES = {
    "copart": _LEAD.format(where=""),
    "copart_q40": _LEAD.format(where="WHERE l_quantity >= 40"),
    "retq": f"SELECT a AS src, b AS dst FROM ({_RETQ}) UNION ALL SELECT b, a FROM ({_RETQ})",
}
#: The vertex of most out-edges (smallest id of those).
BUSIEST = "(SELECT src FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"


def edges(graph: str) -> str:
    return _EDGES[graph]


def with_edges(graph: str, recursive: str = "") -> str:
    return f"WITH {recursive}e AS MATERIALIZED ({_EDGES[graph]}) "


def with_vertices(graph: str, recursive: str = "") -> str:
    return with_edges(graph, recursive) + ", vs AS (SELECT src AS v FROM e UNION SELECT dst FROM e) "


def degrees(select: str) -> str:
    return with_vertices("copart_q40") + ", g AS (SELECT v, (SELECT count(*) FROM e WHERE dst = v) AS in_degree, (SELECT count(*) FROM e WHERE src = v) AS out_degree FROM vs) " + select


COMPACT = with_vertices("copart_q40") + ", ids AS (SELECT v AS orig_id, dense_rank() OVER (ORDER BY v) - 1 AS v FROM vs) "


def levels(graph: str, root: str, depth: int = 30) -> str:
    """CTEs ending in levels (v, val)."""
    return with_vertices(graph, "RECURSIVE ") + f""", walk(v, val) AS (SELECT CAST({root} AS BIGINT), CAST(0 AS BIGINT) UNION SELECT dst, val + 1 FROM walk JOIN e ON src = walk.v WHERE val < {depth}),
levels AS (SELECT vs.v, coalesce(min(val), 4294967295) AS val FROM vs LEFT JOIN walk ON walk.v = vs.v GROUP BY vs.v) """


def distances(graph: str, root: str, rounds: int = 25) -> str:
    """CTEs ending in distances (v, val): relaxation, unrolled."""
    text = with_vertices(graph) + f", d0 AS MATERIALIZED (SELECT v, CASE WHEN v = {root} THEN CAST(0 AS BIGINT) END AS val FROM vs)"
    for k in range(1, rounds + 1):
        text += f", d{k} AS MATERIALIZED (SELECT v, CAST(min(val) AS BIGINT) AS val FROM (SELECT v, val FROM d{k - 1} UNION ALL SELECT dst, val + (src + dst) % 100 FROM d{k - 1} JOIN e ON src = v) GROUP BY v)"
    return text + f", distances AS (SELECT v, coalesce(val, 4294967295) AS val FROM d{rounds}) "


def labels(graph: str, rounds: int = 12) -> str:
    """CTEs ending in labels_ (v, val): smallest labels, unrolled."""
    text = with_vertices(graph) + ", c0 AS MATERIALIZED (SELECT v, v AS val FROM vs)"
    for k in range(1, rounds + 1):
        text += f", c{k} AS MATERIALIZED (SELECT v, min(val) AS val FROM (SELECT v, val FROM c{k - 1} UNION ALL SELECT dst, val FROM c{k - 1} JOIN e ON src = v) GROUP BY v)"
    return text + f", labels_ AS (SELECT v, val FROM c{rounds}) "


def ranks(graph: str, iterations: int, middle: bool = False) -> str:
    """CTEs ending in final (v, val); middle: the values after the first of several rounds."""
    text = with_vertices(graph) + ", g AS MATERIALIZED (SELECT v, n AS deg FROM vs LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) ON src = v), r0 AS MATERIALIZED (SELECT v, CASE WHEN deg > 0 THEN 1.0::DOUBLE / deg ELSE 1.0::DOUBLE END AS val FROM g)"
    rounds = 1 if middle else iterations
    for k in range(1, rounds + 1):
        rank = "0.15::DOUBLE + 0.85::DOUBLE * coalesce(s, 0)"
        value = rank if k == iterations else f"CASE WHEN deg > 0 THEN ({rank}) / deg ELSE {rank} END"
        text += f", r{k} AS MATERIALIZED (SELECT v, {value} AS val FROM g LEFT JOIN (SELECT dst, sum(val) AS s FROM e JOIN r{k - 1} ON v = src GROUP BY dst) ON dst = v)"
    return text + f", final AS (SELECT v, val FROM r{rounds}) "


_N = "n AS (SELECT max(greatest(src, dst)) + 1 AS n FROM e)"


def _cuts(weights: str, parts: int, total: str) -> str:
    """A recursion over (c, w) that numbers chunks by part."""
    return f"""SELECT CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS p, w AS acc FROM {weights} WHERE c = 0
UNION ALL SELECT k.c, walk.p + CASE WHEN walk.acc * {parts} >= {total} THEN 1 ELSE 0 END, CASE WHEN walk.acc * {parts} >= {total} THEN k.w ELSE walk.acc + k.w END FROM walk JOIN {weights} k ON k.c = walk.c + 1"""


def strips(column: str, parts: int, align: int = 64) -> str:
    own = f"CAST(min(c) * {align} AS BIGINT) AS x, CAST(least((max(c) + 1) * {align}, (SELECT n FROM n)) AS BIGINT) AS y"
    order = "x AS from_source, y AS to_source, CAST(0 AS BIGINT) AS from_dest, CAST(n AS BIGINT) AS to_dest" if column == "src" else "CAST(0 AS BIGINT) AS from_source, CAST(n AS BIGINT) AS to_source, x AS from_dest, y AS to_dest"
    return f"""WITH RECURSIVE e AS MATERIALIZED ({_EDGES['copart']}), {_N},
h AS (SELECT c, count({column}) AS w FROM (SELECT unnest(range(0, (n + {align - 1}) // {align})) AS c FROM n) LEFT JOIN e ON {column} // {align} = c GROUP BY c),
walk AS ({_cuts('h', parts, '(SELECT count(*) FROM e)')}),
s AS (SELECT p, {own}, CAST(sum(w) AS BIGINT) AS edges FROM walk JOIN h USING (c) GROUP BY p)
SELECT CAST(p AS INT) AS owner, {order}, edges FROM s, n"""


def mondriaan(first: str, outer: int, inner: int, align: int = 64) -> str:
    second = "dst" if first == "src" else "src"
    a, b = ("source", "dest") if first == "src" else ("dest", "source")
    return f"""WITH RECURSIVE e AS MATERIALIZED ({_EDGES['copart']}), {_N}, k AS (SELECT unnest(range(0, (n + {align - 1}) // {align})) AS c FROM n),
h AS (SELECT c, count({first}) AS w FROM k LEFT JOIN e ON {first} // {align} = c GROUP BY c),
walk AS ({_cuts('h', outer, '(SELECT count(*) FROM e)')}),
strip AS (SELECT p, min(c) AS low, max(c) AS high FROM walk GROUP BY p),
cell AS (SELECT s.p, k.c, count(e.src) AS w FROM strip s CROSS JOIN k LEFT JOIN e ON {second} // {align} = k.c AND {first} // {align} BETWEEN s.low AND s.high GROUP BY s.p, k.c),
total AS (SELECT p, sum(w) AS t FROM cell GROUP BY p),
sub AS (SELECT p, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS q, w AS acc FROM cell WHERE c = 0
UNION ALL SELECT x.p, x.c, sub.q + CASE WHEN sub.acc * {inner} >= t THEN 1 ELSE 0 END, CASE WHEN sub.acc * {inner} >= t THEN x.w ELSE sub.acc + x.w END FROM sub JOIN cell x ON x.p = sub.p AND x.c = sub.c + 1 JOIN total ON total.p = x.p),
b AS (SELECT sub.p, q, min(sub.c) AS x, max(sub.c) AS y, CAST(sum(w) AS BIGINT) AS edges FROM sub JOIN cell ON cell.p = sub.p AND cell.c = sub.c GROUP BY sub.p, q)
SELECT CAST(row_number() OVER (ORDER BY p, q) - 1 AS INT) AS owner, CAST(low * {align} AS BIGINT) AS from_{a}, CAST(least((high + 1) * {align}, n) AS BIGINT) AS to_{a}, CAST(x * {align} AS BIGINT) AS from_{b}, CAST(least((y + 1) * {align}, n) AS BIGINT) AS to_{b}, edges FROM b JOIN strip USING (p), n"""


def _grid(k: int, graph: str, align: int = 64) -> str:
    """CTEs: e, n, r (i, a, z: ranges), cells (i, j, edges)."""
    return f"""WITH e AS MATERIALIZED ({_EDGES[graph]}), {_N},
cuts AS (SELECT i, CASE WHEN i = {k} THEN n ELSE (i * (n // {k}) + least(i, n % {k})) // {align} * {align} END AS cut FROM n, (SELECT unnest(range(0, {k + 1})) AS i)),
r AS (SELECT x.i, x.cut AS a, y.cut AS z FROM cuts x JOIN cuts y ON y.i = x.i + 1),
cells AS (SELECT s.i, t.i AS j, s.a, s.z, t.a AS c, t.z AS d, count(src) AS edges FROM r s CROSS JOIN r t LEFT JOIN e ON src >= s.a AND src < s.z AND dst >= t.a AND dst < t.z GROUP BY ALL) """


def grid(k: int, owner: str | None, graph: str = "copart") -> str:
    if owner is None:
        return _grid(k, graph) + "SELECT CAST(i AS INT) AS row, CAST(j AS INT) AS col, edges FROM cells WHERE edges > 0"
    return _grid(k, graph) + f"SELECT CAST({owner} AS INT) AS owner, CAST(a AS BIGINT) AS from_source, CAST(z AS BIGINT) AS to_source, CAST(c AS BIGINT) AS from_dest, CAST(d AS BIGINT) AS to_dest, edges FROM cells"


def communication(k: int, owner: str) -> str:
    """CTEs over copart_q40: ends (owner, kind, v), comm (owner, n)."""
    return _grid(k, "copart_q40") + f""", owned AS (SELECT CAST({owner} AS INT) AS owner, src, dst FROM e JOIN cells ON src >= a AND src < z AND dst >= c AND dst < d),
ends AS (SELECT DISTINCT owner, 'recv' AS kind, src AS v FROM owned UNION SELECT owner, 'send', dst FROM owned),
managed AS (SELECT CAST({owner} AS INT) AS owner, greatest(a, c) AS x, least(z, d) AS y FROM cells WHERE greatest(a, c) < least(z, d)),
outside AS (SELECT * FROM ends WHERE NOT EXISTS (SELECT 1 FROM managed m WHERE m.owner = ends.owner AND v >= x AND v < y)),
comm AS (SELECT o.owner, count(outside.v) AS n FROM (SELECT DISTINCT CAST({owner} AS INT) AS owner FROM cells) o LEFT JOIN outside USING (owner) GROUP BY o.owner) """


def hash_strips(parts: int, align: int = 64) -> str:
    moved = "({c} % {p}) * (n // {p}) + least({c} % {p}, n % {p}) + {c} // {p}"
    return f"""WITH RECURSIVE e AS MATERIALIZED ({_EDGES['copart']}), {_N},
m AS (SELECT {moved.format(c='src', p=parts)} AS src FROM e, n),
h AS (SELECT c, least({align}, n - c * {align}) AS w FROM n, (SELECT unnest(range(0, (n + {align - 1}) // {align})) AS c FROM n)),
walk AS (SELECT CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS p, w AS acc FROM h WHERE c = 0
UNION ALL SELECT h.c, walk.p + CASE WHEN walk.acc >= (SELECT (n + {parts - 1}) // {parts} FROM n) THEN 1 ELSE 0 END, CASE WHEN walk.acc >= (SELECT (n + {parts - 1}) // {parts} FROM n) THEN h.w ELSE walk.acc + h.w END FROM walk JOIN h ON h.c = walk.c + 1),
s AS (SELECT p, min(c) * {align} AS x, least((max(c) + 1) * {align}, (SELECT n FROM n)) AS y FROM walk GROUP BY p)
SELECT CAST(p AS INT) AS owner, CAST(x AS BIGINT) AS from_source, CAST(y AS BIGINT) AS to_source, CAST(0 AS BIGINT) AS from_dest, CAST((SELECT n FROM n) AS BIGINT) AS to_dest, (SELECT count(*) FROM m WHERE src >= x AND src < y) AS edges FROM s"""
