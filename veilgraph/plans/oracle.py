"""DuckDB SQL with the rows of the registered queries."""

from __future__ import annotations

STEPS = 10

_PART = """
g AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_quantity >= 45 AND b.l_quantity >= 45),
v AS (SELECT p_partkey AS id FROM part)"""
_CUSTOMER = """
bought AS (SELECT DISTINCT l_partkey AS p, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 48),
g AS MATERIALIZED (SELECT DISTINCT a.c AS src, b.c AS dst FROM bought a JOIN bought b ON a.p = b.p AND a.c < b.c),
v AS (SELECT c_custkey AS id FROM customer)"""
_THIN = "ga AS MATERIALIZED (SELECT src, dst FROM g WHERE ('0x' || substr(md5('42:' || src || ':' || dst), 1, 8))::BIGINT % 10 >= 1)"


def _sym(edges: str = "g", name: str = "sym") -> str:
    return f"{name} AS MATERIALIZED (SELECT src, dst FROM {edges} UNION ALL SELECT dst, src FROM {edges})"


def _deg(sym: str = "sym", name: str = "deg") -> str:
    return f"{name} AS MATERIALIZED (SELECT v.id, count(s.src)::BIGINT AS deg FROM v LEFT JOIN {sym} s ON s.src = v.id GROUP BY v.id)"


def _with(*parts: str, recursive: bool = False) -> str:
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(p.strip() for p in parts) + "\n"


def _tri(edges: str, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM {edges} a JOIN {edges} b ON a.dst = b.src JOIN {edges} c ON c.src = a.src AND c.dst = b.dst)"


def _clustering(edges: str, sym: str, deg: str, tri: str, name: str) -> list[str]:
    return [
        _sym(edges, sym), _deg(sym, deg), _tri(edges, tri),
        f"{name} AS MATERIALIZED (SELECT d.id, d.deg, coalesce(t.tri, 0)::BIGINT AS tri, CASE WHEN d.deg < 2 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(t.tri, 0) / (d.deg * (d.deg - 1)) END AS clustering "
        f"FROM {deg} d LEFT JOIN (SELECT id, count(*) AS tri FROM (SELECT x AS id FROM {tri} UNION ALL SELECT y FROM {tri} UNION ALL SELECT z FROM {tri}) GROUP BY id) t ON t.id = d.id)",
    ]


def _w1(p: str, q: str, digits: int = 9) -> str:
    """Distance of two relations with a column val."""
    return f"""
SELECT round(sum(abs(cp / np - cq / nq) * coalesce(nxt - val, 0)), {digits}) AS dist FROM (
  SELECT val, sum(p) OVER o AS cp, sum(q) OVER o AS cq, lead(val) OVER (ORDER BY val) AS nxt, (sum(p) OVER ())::DOUBLE AS np, (sum(q) OVER ())::DOUBLE AS nq
  FROM (SELECT val, sum(p) AS p, sum(q) AS q FROM (SELECT val, 1 AS p, 0 AS q FROM {p} UNION ALL SELECT val, 0, 1 FROM {q}) GROUP BY val)
  WINDOW o AS (ORDER BY val ROWS UNBOUNDED PRECEDING))"""


def _power(kind: str, sym: str, deg: str, name: str, steps: int = STEPS, alpha: float = 0.1, norm: bool = True) -> list[str]:
    """Unrolled steps; the last is called ``name``."""
    start = {"pagerank": "1.0::DOUBLE / (SELECT count(*) FROM v)", "katz": "0.0::DOUBLE", "eigenvector": "1.0::DOUBLE / (SELECT count(*) FROM v)"}[kind]
    out = [f"{name}0 AS MATERIALIZED (SELECT id, deg, {start} AS val FROM {deg})"]
    for i in range(steps):
        a, b = f"{name}{i}", f"{name}{i + 1}"
        sent = "x.val / nullif(x.deg, 0)" if kind == "pagerank" else "x.val"
        got = f"(SELECT s.src AS id, sum({sent}) AS got FROM {sym} s JOIN {a} x ON x.id = s.dst GROUP BY s.src)"
        value = {
            "pagerank": f"0.85::DOUBLE * (coalesce(r.got, 0) + (SELECT coalesce(sum(val), 0) FROM {a} WHERE deg = 0) / (SELECT count(*) FROM v)) + 0.15::DOUBLE / (SELECT count(*) FROM v)",
            "katz": f"{alpha}::DOUBLE * coalesce(r.got, 0) + 1.0::DOUBLE",
            "eigenvector": "x.val + coalesce(r.got, 0)",
        }[kind]
        step = f"SELECT x.id, x.deg, {value} AS val FROM {a} x LEFT JOIN {got} r ON r.id = x.id"
        if kind == "eigenvector":
            step = f"SELECT id, deg, val / sqrt(sum(val * val) OVER ()) AS val FROM ({step})"
        out.append(f"{b} AS MATERIALIZED ({step})")
    last = f"{name}{steps}"
    out.append(f"{name} AS MATERIALIZED (SELECT id, " + ("val / sqrt(sum(val * val) OVER ())" if kind == "katz" and norm else "val") + f" AS val FROM {last})")
    return out


def _converged(kind: str, edges: str, deg: str, name: str, alpha: float = 0.1, norm: bool = True, tol: str = "1e-6::DOUBLE * (SELECT count(*) FROM v)", squares: bool = False) -> list[str]:
    """Steps until the change in sum (with ``squares``, in length) is under ``tol``; the values are those after the last step, with ``squares`` before it. Needs WITH RECURSIVE."""
    n = "(SELECT count(*) FROM v)"
    start = "0.0::DOUBLE" if kind == "katz" else f"1.0::DOUBLE / {n}"
    sent = "x.val / nullif(x.deg, 0)" if kind == "pagerank" else "x.val"
    value = {
        "pagerank": f"0.85::DOUBLE * (got + coalesce(sum(CASE WHEN deg = 0 THEN old END) OVER (), 0) / {n}) + 0.15::DOUBLE / {n}",
        "katz": f"{alpha}::DOUBLE * got + 1.0::DOUBLE",
        "eigenvector": "(old + got) / sqrt(sum((old + got) * (old + got)) OVER ())",
    }[kind]
    change = "sqrt(sum((new - old) * (new - old)) OVER ())" if squares else "sum(abs(new - old)) OVER ()"
    last = f"SELECT id, {'old' if squares else 'val'} AS val FROM {name}s WHERE step = (SELECT max(step) FROM {name}s)"
    if kind == "katz" and norm:
        last = f"SELECT id, val / sqrt(sum(val * val) OVER ()) AS val FROM ({last})"
    return [
        f"{name}e AS MATERIALIZED (SELECT src, dst FROM {edges} UNION ALL SELECT id, id FROM v)",
        f"""{name}s(step, id, deg, old, val, done) AS (
  SELECT 0, id, deg, {start}, {start}, false FROM {deg}
  UNION ALL SELECT step + 1, id, deg, old, new, {change} < {tol} FROM (SELECT step, id, deg, old, {value} AS new FROM (
    SELECT any_value(x.step) AS step, s.src AS id, max(x.deg) FILTER (s.src = s.dst) AS deg, max(x.val) FILTER (s.src = s.dst) AS old, coalesce(sum({sent}) FILTER (s.src <> s.dst), 0) AS got
    FROM {name}s x JOIN {name}e s ON s.dst = x.id WHERE NOT x.done GROUP BY s.src)))""",
        f"{name} AS MATERIALIZED ({last})",
    ]


def _swapped(seed: int, rounds: int) -> list[str]:
    """Rounds of swaps over ``ends`` (a, b, c1, c2); the last table is ``e`` and the number of rounds."""
    out = ["e0 AS (SELECT a, b, c1, c2 FROM ends)"]
    for i in range(rounds):
        low, high = "least(a, b)", "greatest(a, b)"
        out += [
            f"turned{i} AS (SELECT *, c1 = c2 AND ('0x' || substr(md5('{seed}:{i}:turn:' || {low} || ':' || {high}), 1, 8))::BIGINT % 2 = 1 AS t, md5('{seed}:{i}:' || {low} || ':' || {high}) AS h FROM e{i})",
            f"faced{i} AS (SELECT CASE WHEN t THEN {high} WHEN c1 = c2 THEN {low} ELSE a END AS a, CASE WHEN t THEN {low} WHEN c1 = c2 THEN {high} ELSE b END AS b, c1, c2, h FROM turned{i})",
            f"placed{i} AS MATERIALIZED (SELECT a, b, c1, c2, row_number() OVER (PARTITION BY c1, c2 ORDER BY h, a, b) - 1 AS place FROM faced{i})",
            f"pairs{i} AS MATERIALIZED (SELECT e.c1, e.c2, e.place // 2 AS pair, e.a AS ea, e.b AS eb, f.a AS fa, f.b AS fb FROM placed{i} e JOIN placed{i} f ON e.c1 = f.c1 AND e.c2 = f.c2 AND f.place = e.place + 1 WHERE e.place % 2 = 0 AND e.a <> f.a AND e.b <> f.b AND e.a <> f.b AND f.a <> e.b)",
            f"made{i} AS MATERIALIZED (SELECT c1, c2, pair, ea AS a, fb AS b FROM pairs{i} UNION ALL SELECT c1, c2, pair, fa, eb FROM pairs{i})",
            f"bad{i} AS (SELECT c1, c2, pair FROM made{i} m JOIN (SELECT {low} AS lo, {high} AS hi FROM placed{i} UNION ALL SELECT {low}, {high} FROM made{i} GROUP BY ALL HAVING count(*) > 1) d ON d.lo = least(m.a, m.b) AND d.hi = greatest(m.a, m.b))",
            f"swapped{i} AS MATERIALIZED (SELECT * FROM made{i} ANTI JOIN bad{i} USING (c1, c2, pair))",
            f"e{i + 1} AS MATERIALIZED (SELECT a, b, c1, c2 FROM (SELECT *, place // 2 AS pair FROM placed{i}) ANTI JOIN swapped{i} USING (c1, c2, pair) UNION ALL SELECT a, b, c1, c2 FROM swapped{i})",
        ]
    return out


def _wl(rounds: int, nodes: str = "SELECT id FROM v", sym: str = "sym", name: str = "wl", key: str = "id") -> list[str]:
    """Colours named by their smallest node."""
    out = [f"{name}0 AS MATERIALIZED (SELECT {key}, (SELECT min({key}) FROM ({nodes})) AS color FROM ({nodes}))"]
    for i in range(rounds):
        out.append(
            f"{name}{i + 1} AS MATERIALIZED (SELECT {key}, min({key}) OVER (PARTITION BY own, seen) AS color FROM (SELECT c.{key}, c.color AS own, coalesce(l.seen, []) AS seen FROM {name}{i} c "
            f"LEFT JOIN (SELECT s.src AS {key}, list(n.color ORDER BY n.color) AS seen FROM {sym} s JOIN {name}{i} n ON n.{key} = s.dst GROUP BY s.src) l ON l.{key} = c.{key}))"
        )
    return out


_COLOURED = """
ends AS MATERIALIZED (SELECT CASE WHEN s.deg > d.deg THEN g.dst ELSE g.src END AS a, CASE WHEN s.deg > d.deg THEN g.src ELSE g.dst END AS b, least(s.deg, d.deg) AS c1, greatest(s.deg, d.deg) AS c2
  FROM g JOIN deg s ON s.id = g.src JOIN deg d ON d.id = g.dst)"""
_CDEG = "cdeg AS MATERIALIZED (SELECT s.src AS id, d.deg AS color, count(*)::BIGINT AS deg FROM sym s JOIN deg d ON d.id = s.dst GROUP BY s.src, d.deg)"
_PAIRS = "pairs AS MATERIALIZED (SELECT o.deg AS c1, c.color AS c2, sum(c.deg)::BIGINT AS m FROM cdeg c JOIN deg o ON o.id = c.id GROUP BY o.deg, c.color)"
_PRIVATE = """
full_ends AS MATERIALIZED (SELECT a.deg::DOUBLE AS d12, b.deg::DOUBLE AS d21, p.m::DOUBLE AS m FROM sym s JOIN deg x ON x.id = s.src JOIN deg y ON y.id = s.dst
  JOIN cdeg a ON a.id = s.src AND a.color = y.deg JOIN cdeg b ON b.id = s.dst AND b.color = x.deg JOIN pairs p ON p.c1 = x.deg AND p.c2 = y.deg)"""
_SHORT = "(SELECT sum(q - m::DOUBLE * m / n) FROM (SELECT o.deg AS own, c.color, sum(c.deg) AS m, sum(c.deg * c.deg)::DOUBLE AS q FROM cdeg c JOIN deg o ON o.id = c.id GROUP BY o.deg, c.color) JOIN (SELECT deg AS own, count(*) AS n FROM deg GROUP BY deg) USING (own))"

_G = (_PART, _sym(), _deg())
_GA = (_PART, _THIN, _sym(), _deg(), _sym("ga", "syma"), _deg("syma", "dega"))
_C = (_CUSTOMER, _sym(), _deg())
_CA = (_CUSTOMER, _THIN, _sym(), _deg(), _sym("ga", "syma"), _deg("syma", "dega"))
_COMP = "comp(id, r) AS (SELECT id, id FROM v UNION SELECT s.dst, c.r FROM comp c JOIN {sym} s ON s.src = c.id WHERE c.r < s.dst)"
_SAMPLES = "s AS (SELECT l_returnflag AS method, l_linestatus AS metric, l_quantity AS value FROM lineitem)"

SQL: dict[str, str] = {}

SQL["edges_canonical"] = _with(_PART) + "SELECT src, dst FROM g"
SQL["edges_both_ways"] = _with(_PART, _sym()) + "SELECT src, dst FROM sym"
SQL["canonical_from_raw_pairs"] = "SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT l_partkey % 500 AS a, l_suppkey * 7 % 500 AS b FROM lineitem) WHERE a <> b"
SQL["relabel_by_name"] = "SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS id FROM customer"
SQL["first_appearance_labels"] = "SELECT old, row_number() OVER (ORDER BY pos, old) - 1 AS id FROM (SELECT old, min(pos) AS pos FROM (SELECT o_custkey AS old, o_orderkey * 2 AS pos FROM orders UNION ALL SELECT o_custkey * 3 % 1000, o_orderkey * 2 + 1 FROM orders) GROUP BY old)"
SQL["dense_colors"] = "SELECT p_partkey AS id, dense_rank() OVER (ORDER BY p_brand) - 1 AS color FROM part"
SQL["validation_counts"] = _with(_PART) + "SELECT count(*) AS n, count(DISTINCT id) AS ids, 0 AS low, count(*) - 1 AS high, (SELECT count(*) FROM g)::INT AS edges, true AS refused FROM v"
SQL["edge_list_read"] = SQL["json_edges_read"] = SQL["edges_canonical"]
SQL["gml_read"] = _with(*(_PART, _sym(), _deg())) + "SELECT 'p' || id AS label, deg FROM deg"
SQL["graph_written_and_read"] = _with(*(_CUSTOMER, _sym(), _deg())) + "SELECT id, deg FROM deg"
SQL["edges_oriented"] = _with(_PART) + """
SELECT CASE WHEN t THEN dst ELSE src END AS src, CASE WHEN t THEN src ELSE dst END AS dst FROM (
  SELECT g.src, g.dst, CASE WHEN a.p_size <> b.p_size THEN a.p_size > b.p_size WHEN a.p_brand <> b.p_brand THEN a.p_brand > b.p_brand ELSE false END AS t
  FROM g JOIN part a ON a.p_partkey = g.src JOIN part b ON b.p_partkey = g.dst)"""
SQL["generated_gnm"] = """
WITH stream AS (SELECT range AS turn, ('0x' || substr(md5('8:u:' || range), 1, 13))::BIGINT % 300 AS a, ('0x' || substr(md5('8:v:' || range), 1, 13))::BIGINT % 300 AS b FROM range(1314))
SELECT src, dst FROM (SELECT least(a, b) AS src, greatest(a, b) AS dst, min(turn) AS turn FROM stream WHERE a <> b GROUP BY ALL ORDER BY turn LIMIT 500)"""
SQL["generated_preferential"] = """
WITH RECURSIVE chosen AS (SELECT range AS e, ('0x' || substr(md5('5:end:' || range || ':0'), 1, 13))::BIGINT % (2 * range) AS place FROM range(1, 399)),
walk(e, place) AS (SELECT e, place FROM chosen UNION ALL SELECT w.e, c.place FROM walk w JOIN chosen c ON c.e = w.place // 2 WHERE w.place % 2 = 1)
SELECT 0 AS src, 1 AS dst UNION ALL SELECT CASE WHEN place % 2 = 0 THEN place // 2 + 1 ELSE 0 END, e + 1 FROM walk WHERE place % 2 = 0 OR place = 1"""
SQL["generated_preferential_degrees"] = "SELECT 200 AS nodes, 2 * (3 + 196 * 3) AS ends, true AS joined, 0 AS short"
SQL["generated_random_graph"] = """
WITH p AS (SELECT u.range AS src, w.range AS dst, row_number() OVER (ORDER BY u.range, w.range) - 1 AS pos FROM range(200) u JOIN range(200) w ON u.range < w.range)
SELECT src, dst FROM p WHERE (('0x' || substr(md5('7:' || pos), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE < 0.05"""
SQL["generated_two_grids"] = """
WITH e AS (
  SELECT range AS src, range + 1 AS dst FROM range(15) WHERE range % 4 < 3 UNION ALL SELECT range, range + 4 FROM range(12)
  UNION ALL SELECT range + 26, range + 27 FROM range(15) WHERE range % 4 < 3 UNION ALL SELECT range + 26, range + 30 FROM range(12)
  UNION ALL SELECT range + 15, range + 16 FROM range(11))
SELECT id, count(*) AS deg FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id"""

_U = "(('0x' || substr(md5('{0}'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE"
SQL["generated_communities"] = _with(
    f"sizes AS (SELECT range AS c, least(floor(10.0::DOUBLE * pow(1 - {_U.format("3:size:' || range || '")}, -1.0::DOUBLE / 1.5))::BIGINT, 100) AS size FROM range(50))",
    "placed AS (SELECT c, sum(size) OVER (ORDER BY c) - size AS low, least(sum(size) OVER (ORDER BY c), 500) AS upto FROM sizes)",
    "nodes AS MATERIALIZED (SELECT r.range AS id, c FROM placed JOIN range(500) r ON r.range >= low AND r.range < upto)",
    f"deg AS (SELECT id, c, floor(least(greatest(1.0::DOUBLE, 2.0::DOUBLE * pow(1 - {_U.format("3:degree:' || id || '")}, -1.0::DOUBLE / 1.5)), 2 * sqrt(500.0::DOUBLE)))::BIGINT AS d FROM nodes)",
    "each AS (SELECT id, c, unnest(range(1, d + 1)) AS stub FROM deg)",
    f"stubs AS (SELECT id, stub, CASE WHEN {_U.format("3:out:' || id || ':' || stub || '")} < 0.2 THEN -1 ELSE c END AS grp FROM each)",
    "met AS (SELECT grp, (row_number() OVER (PARTITION BY grp ORDER BY md5('3:stub:' || id || ':' || stub), id, stub) - 1) // 2 AS pair, id FROM stubs)",
    "edges AS (SELECT DISTINCT src, dst FROM (SELECT min(id) AS src, max(id) AS dst FROM met GROUP BY grp, pair) WHERE src <> dst)",
) + "SELECT src, dst, a.c AS c1, b.c AS c2 FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst"

SQL["num_nodes_edges"] = _with(_PART, _THIN) + """
SELECT 'G' AS graph, 'nodes' AS what, count(*) AS n FROM v UNION ALL SELECT 'G', 'edges', count(*) FROM g
UNION ALL SELECT 'Ga', 'nodes', count(*) FROM v UNION ALL SELECT 'Ga', 'edges', count(*) FROM ga"""
SQL["degrees"] = _with(*_G) + "SELECT id, deg FROM deg"
SQL["degree_histogram"] = _with(*_G) + "SELECT deg, count(*) AS cnt FROM deg GROUP BY deg"
_STATS = "max(deg) AS max_degree, median(deg)::DOUBLE AS median_degree, round(avg(deg), 9) AS mean_degree"
SQL["degree_stats"] = _with(*_GA) + f"SELECT 'G' AS graph, {_STATS} FROM deg UNION ALL SELECT 'Ga', {_STATS} FROM dega"
SQL["triangles"] = _with(_PART, _tri("g", "tri")) + "SELECT x, y, z FROM tri"
SQL["local_clustering"] = _with(_PART, *_clustering("g", "sym", "deg", "tri", "cl")) + "SELECT id, deg, tri, round(clustering, 9) AS clustering FROM cl"
_CLUSTER = "round(sum(tri)::DOUBLE / 3, 9) AS triangles, round(avg(clustering), 9) AS avg_clustering, round(2 * sum(tri)::DOUBLE / sum(deg * (deg - 1)), 9) AS transitivity"
SQL["clustering_summary"] = _with(_CUSTOMER, *_clustering("g", "sym", "deg", "tri", "cl")) + f"SELECT {_CLUSTER} FROM cl"
SQL["components"] = _with(_PART, _sym(), _COMP.format(sym="sym"), recursive=True) + "SELECT id, min(r) AS component FROM comp GROUP BY id"
SQL["components_by_stars"] = _with(_PART, _sym(), _COMP.format(sym="sym"), recursive=True) + "SELECT id AS node, min(r) AS component FROM comp WHERE id IN (SELECT src FROM sym) GROUP BY id"
SQL["component_count"] = _with(_PART, _sym(), _COMP.format(sym="sym"), recursive=True) + "SELECT count(DISTINCT component) AS components FROM (SELECT id, min(r) AS component FROM comp GROUP BY id)"

_VAL = "{name} AS MATERIALIZED (SELECT deg / ((SELECT count(*) FROM v) - 1)::DOUBLE AS val FROM {deg})"
SQL["degree_centrality_w1"] = _with(*_GA, _VAL.format(name="p", deg="deg"), _VAL.format(name="q", deg="dega")) + _w1("p", "q", 12)
SQL["clustering_w1"] = _with(_PART, _THIN, *_clustering("g", "sym", "deg", "tri", "cl"), *_clustering("ga", "syma", "dega", "tria", "cla"), "p AS (SELECT clustering AS val FROM cl)", "q AS (SELECT clustering AS val FROM cla)") + _w1("p", "q")
for _kind in ("pagerank", "katz", "eigenvector"):
    SQL[_kind] = _with(*_C, *_converged(_kind, "sym", "deg", "x"), recursive=True) + "SELECT id, round(val, 10) AS val FROM x"
    SQL[f"{_kind}_by_joins"] = _with(*_C, *_power(_kind, "sym", "deg", "x")) + "SELECT id, round(val, 10) AS val FROM x"
    SQL[f"{_kind}_w1"] = _with(*_CA, *_converged(_kind, "sym", "deg", "x"), *_converged(_kind, "syma", "dega", "y"), recursive=True) + _w1("x", "y", 10)
SQL["katz_vector"] = _with(*_C, *_converged("katz", "sym", "deg", "x", alpha=0.05, norm=False, tol="1e-12::DOUBLE", squares=True), recursive=True) + "SELECT id, round(val, 9) AS val FROM x"
_BFS = """
{name}(s, t, h) USING KEY (s, t) AS (SELECT id, id, 0 FROM v UNION SELECT b.s, e.dst, b.h + 1 FROM {name} b JOIN {sym} e ON e.src = b.t LEFT JOIN recurring.{name} r ON r.s = b.s AND r.t = e.dst WHERE r.s IS NULL)"""
_CLOSE = "{name} AS MATERIALIZED (SELECT s AS id, coalesce((count(*) - 1)::DOUBLE / nullif(sum(h), 0), 0) AS val FROM {bfs} GROUP BY s)"
SQL["closeness"] = _with(_PART, _sym(), _BFS.format(name="b", sym="sym"), _CLOSE.format(name="c", bfs="b"), recursive=True) + "SELECT id, round(val, 9) AS val FROM c"
SQL["closeness_w1"] = _with(_PART, _THIN, _sym(), _sym("ga", "syma"), _BFS.format(name="b", sym="sym"), _BFS.format(name="ba", sym="syma"), _CLOSE.format(name="p", bfs="b"), _CLOSE.format(name="q", bfs="ba"), recursive=True) + _w1("p", "q")

SQL["wl_colors_d1"] = _with(_PART, _sym(), *_wl(1)) + "SELECT id, color FROM wl1"
SQL["wl_colors_d2"] = _with(_PART, _sym(), *_wl(2)) + "SELECT id, color FROM wl2"
SQL["wl_canonical_labels"] = _with(_PART, _sym(), *_wl(2)) + "SELECT id, dense_rank() OVER (ORDER BY color) - 1 AS label FROM wl2"
SQL["wl_combined"] = _with(*_G) + "SELECT deg.id, min(deg.id) OVER (PARTITION BY deg.deg, part.p_size) AS color FROM deg JOIN part ON part.p_partkey = deg.id"
_UNION = (
    "both_v AS (SELECT id FROM v UNION ALL SELECT id + 1000000000 FROM v)",
    "both_s AS MATERIALIZED (SELECT src, dst FROM sym UNION ALL SELECT src + 1000000000, dst + 1000000000 FROM syma)",
    *_wl(2, "SELECT id FROM both_v", "both_s", "u"),
)
_TVD = "sum(abs(p / (SELECT count(*) FROM v)::DOUBLE - q / (SELECT count(*) FROM v)::DOUBLE)) / 2"
_WL_TVD = f"(SELECT {_TVD} FROM (SELECT color, count(*) FILTER (id < 1000000000) AS p, count(*) FILTER (id >= 1000000000) AS q FROM u2 GROUP BY color))"
SQL["wl_tvd_d2"] = _with(*_GA, *_UNION) + f"SELECT round({_WL_TVD}, 9) AS dist"
SQL["degree_tvd"] = _with(*_GA) + f"SELECT round({_TVD}, 9) AS dist FROM (SELECT deg, sum(p) AS p, sum(q) AS q FROM (SELECT deg, 1 AS p, 0 AS q FROM deg UNION ALL SELECT deg, 0, 1 FROM dega) GROUP BY deg)"
SQL["color_degree"] = _with(*_C, _CDEG) + "SELECT id, color, deg FROM cdeg"
SQL["color_histogram_directed"] = _with(_CUSTOMER) + """
SELECT g.src AS id, 'out' AS side, c_mktsegment AS color, count(*) AS deg FROM g JOIN customer ON c_custkey = g.dst GROUP BY ALL
UNION ALL SELECT g.dst, 'in', c_mktsegment, count(*) FROM g JOIN customer ON c_custkey = g.src GROUP BY ALL"""
SQL["distinct_colors"] = _with(_PART, _sym(), *_wl(3)) + "\nUNION ALL ".join(
    f"SELECT {i} AS round, count(DISTINCT color) AS colors FROM wl{i}" + (f" HAVING count(DISTINCT color) > (SELECT count(DISTINCT color) FROM wl{i - 1})" if i else "") for i in range(4)
)
_ARCS = "LEFT JOIN (SELECT s.{0} AS id, list(n.color ORDER BY n.color) AS seen FROM g s JOIN wd{1} n ON n.id = s.{2} GROUP BY s.{0}) {3} ON {3}.id = c.id"
SQL["wl_directed_d2"] = _with(_PART, "wd0 AS MATERIALIZED (SELECT id, (SELECT min(id) FROM v) AS color FROM v)", *(
    f"wd{i + 1} AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY own, o, t) AS color FROM (SELECT c.id, c.color AS own, coalesce(l.seen, []) AS o, coalesce(m.seen, []) AS t FROM wd{i} c "
    f"{_ARCS.format('src', i, 'dst', 'l')} {_ARCS.format('dst', i, 'src', 'm')}))" for i in range(2)
)) + "SELECT id, color FROM wd2"
SQL["nest_validated"] = "SELECT true AS sampled, false AS thinned"
SQL["color_pair_totals"] = _with(*_C, _CDEG, _PAIRS) + "SELECT c1, c2, m FROM pairs"
SQL["joint_degree_matrix"] = _with(*_C, _COLOURED) + "SELECT c1 AS k1, c2 AS k2, count(*) AS cnt FROM ends GROUP BY c1, c2"
SQL["privacy_loss"] = _with(*_C, _CDEG, _PAIRS, _PRIVATE) + "SELECT round(sum(d12 * d21 / m) / 2, 6) AS loss, round(sum(d12 * (d21 / m) * (1 - pow(1 - d21 / m, d12 - 1))), 6) AS multi FROM full_ends"
SQL["utility_loss_katz"] = _with(*_C, *_power("katz", "sym", "deg", "x", alpha=0.05, norm=False)) + "SELECT round(sum(q - s * s / n), 6) AS loss FROM (SELECT d.deg, count(*) AS n, sum(x.val) AS s, sum(x.val * x.val) AS q FROM x JOIN deg d ON d.id = x.id GROUP BY d.deg)"
SQL["utility_loss_short_term"] = _with(*_C, _CDEG) + f"SELECT round({_SHORT}, 6) AS loss"
SQL["suboptimality_gap"] = _with(*_C, _CDEG, _PAIRS, _PRIVATE) + f"""
SELECT round(u, 6) AS utility, round(p, 6) AS privacy, round(u + 0.01::DOUBLE * p, 6) AS total, round(u + 0.01::DOUBLE * p - 0.01::DOUBLE * one, 6) AS gap, k AS clusters FROM (
  SELECT {_SHORT} AS u, (SELECT sum(d12 * d21 / m) / 2 FROM full_ends) AS p, (SELECT count(DISTINCT deg) FROM deg) AS k,
  (SELECT sum(a.deg::DOUBLE * b.deg) / (SELECT count(*) FROM sym) / 2 FROM sym s JOIN deg a ON a.id = s.src JOIN deg b ON b.id = s.dst) AS one)"""
SQL["equivalence_class_stats"] = _with(
    *_G, "sig AS (SELECT d.id, d.deg AS own, coalesce(l.seen, []) AS seen FROM deg d LEFT JOIN (SELECT s.src AS id, list(n.deg ORDER BY n.deg) AS seen FROM sym s JOIN deg n ON n.id = s.dst GROUP BY s.src) l ON l.id = d.id)",
    "sized AS (SELECT count(*) OVER (PARTITION BY own, seen) AS size FROM sig)",
) + "SELECT round(avg(1.0::DOUBLE / size), 9) AS mean_guess, round(avg(1.0::DOUBLE / size) FILTER (size > 1), 9) AS mean_guess_without_singletons, median(size)::DOUBLE AS median_size, round(avg(size), 9) AS mean_size, count(*) FILTER (size = 1) AS singletons FROM sized"

_JACCARD = "(SELECT count(*) FROM ga JOIN g USING (src, dst))::DOUBLE / (SELECT count(*) FROM (SELECT src, dst FROM g UNION SELECT src, dst FROM ga))"
SQL["edge_jaccard"] = _with(_PART, _THIN) + f"SELECT round({_JACCARD}, 9) AS jaccard"
SQL["edge_difference"] = _with(_PART, _THIN) + "SELECT 'a' AS side, src, dst FROM g ANTI JOIN ga USING (src, dst) UNION ALL SELECT 'b', src, dst FROM ga ANTI JOIN g USING (src, dst)"
_KDEG = "(SELECT sum(n) FILTER (n >= 20) / sum(n)::DOUBLE FROM (SELECT count(*) AS n FROM {deg} GROUP BY deg))"
SQL["k_degree_fraction"] = _with(*_G) + f"SELECT round({_KDEG.format(deg='deg')}, 9) AS fraction"
SQL["erdos_gallai"] = _with(*_C, "r AS MATERIALIZED (SELECT deg, row_number() OVER (ORDER BY deg DESC, id) AS k, sum(deg) OVER (ORDER BY deg DESC, id ROWS UNBOUNDED PRECEDING) AS upto FROM deg)") + """
SELECT (SELECT sum(deg) % 2 = 0 FROM deg) AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT ON (deg) k, upto FROM r ORDER BY deg, k DESC) h
  WHERE h.upto > h.k * (h.k - 1) + (SELECT coalesce(sum(least(x.deg, h.k)), 0) FROM r x WHERE x.k > h.k)) AS graphical"""

_KEPT = "kept AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (ORDER BY md5('5:delete:' || src || ':' || dst), src, dst) AS place FROM g) WHERE place > 100)"
SQL["random_edge_del"] = _with(_PART, _KEPT) + "SELECT src, dst FROM kept"
SQL["random_edge_add_del"] = _with(
    _PART, _KEPT,
    "stream AS (SELECT range AS turn, ('0x' || substr(md5('5:u:' || range), 1, 13))::BIGINT % (SELECT count(*) FROM v) AS a, ('0x' || substr(md5('5:v:' || range), 1, 13))::BIGINT % (SELECT count(*) FROM v) AS b FROM range(314))",
    "fresh AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, min(turn) AS turn FROM stream WHERE a <> b GROUP BY ALL)",
) + "SELECT src, dst FROM kept UNION ALL (SELECT src, dst FROM fresh ANTI JOIN kept USING (src, dst) ORDER BY turn LIMIT 100)"
SQL["configuration_model"] = _with(
    *_G,
    "give AS (SELECT deg, row_number() OVER (ORDER BY md5('3:give:' || id), id) AS place FROM deg)",
    "take AS (SELECT id, row_number() OVER (ORDER BY md5('3:take:' || id), id) AS place FROM deg)",
    "stubs AS (SELECT id, unnest(range(1, deg + 1)) AS stub FROM give JOIN take USING (place))",
    "placed AS (SELECT id, row_number() OVER (ORDER BY md5('3:stub:' || id || ':' || stub), id, stub) - 1 AS place FROM stubs)",
    "met AS (SELECT min(id) AS src, max(id) AS dst FROM placed GROUP BY place % (SELECT count(*) FROM g))",
) + "SELECT DISTINCT src, dst FROM met WHERE src <> dst"
SQL["pygmalion_pseudograph"] = _with(
    *_G, _COLOURED,
    "jdm AS (SELECT c1 AS k1, c2 AS k2, count(*) AS cnt FROM ends GROUP BY c1, c2)",
    "es AS (SELECT k1, k2, k1 || ':' || k2 || ':' || unnest(range(1, cnt + 1)) AS edge FROM jdm)",
    "stubs AS (SELECT edge, k1 AS k, 0 AS e FROM es UNION ALL SELECT edge, k2, 1 FROM es)",
    "placed AS (SELECT edge, k, (row_number() OVER (PARTITION BY k ORDER BY md5('4:stub:' || edge || ':' || e), edge, e) - 1) // k AS slot FROM stubs)",
    "ids AS (SELECT k, slot, row_number() OVER (ORDER BY k, slot) - 1 AS id FROM (SELECT DISTINCT k, slot FROM placed))",
) + "SELECT DISTINCT src, dst FROM (SELECT min(id) AS src, max(id) AS dst FROM placed JOIN ids USING (k, slot) GROUP BY edge)"
_PSEUDO = [
    "stubs AS (SELECT edge, k1 AS k, 0 AS e FROM es UNION ALL SELECT edge, k2, 1 FROM es)",
    "placed AS (SELECT edge, k, (row_number() OVER (PARTITION BY k ORDER BY md5('4:stub:' || edge || ':' || e), edge, e) - 1) // k AS slot FROM stubs)",
    "ids AS (SELECT k, slot, row_number() OVER (ORDER BY k, slot) - 1 AS id FROM (SELECT DISTINCT k, slot FROM placed))",
]
_NOISE = "(('0x' || substr(md5('4:noise:' || k1 || ':' || k2), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE - 0.5::DOUBLE"
_NOISY = [
    "jdm AS (SELECT c1 AS k1, c2 AS k2, count(*) AS cnt FROM ends GROUP BY c1, c2)",
    f"moved AS (SELECT k1, k2, cnt, row_number() OVER (ORDER BY cnt, k1, k2) AS at, cnt - (4.0::DOUBLE * (greatest(k1, k2) - 1) + 1) * sign(u) * ln(1 - 2 * abs(u)) AS y FROM (SELECT *, {_NOISE} AS u FROM jdm))",
    # the least squares fit that ascends: the largest, over starts up to a place, of the least mean from there to an end from it on
    "means AS (SELECT a.at AS i, b.at AS j, avg(b.y) OVER (PARTITION BY a.at ORDER BY b.at ROWS UNBOUNDED PRECEDING) AS mean FROM moved a JOIN moved b ON b.at >= a.at)",
    "least_means AS (SELECT i, j, min(mean) OVER (PARTITION BY i ORDER BY j DESC ROWS UNBOUNDED PRECEDING) AS mean FROM means)",
    "counts AS MATERIALIZED (SELECT k1, k2, m.cnt, round_even(max(l.mean), 0)::BIGINT AS noisy FROM moved m JOIN least_means l ON l.j = m.at GROUP BY k1, k2, m.cnt)",
]
SQL["pygmalion_counts"] = _with(*_G, _COLOURED, *_NOISY) + "SELECT k1, k2, cnt, noisy FROM counts"
SQL["pygmalion"] = _with(*_G, _COLOURED, *_NOISY, "es AS (SELECT k1, k2, k1 || ':' || k2 || ':' || unnest(range(1, noisy + 1)) AS edge FROM counts WHERE noisy > 0)", *_PSEUDO) + "SELECT DISTINCT src, dst FROM (SELECT min(id) AS src, max(id) AS dst FROM placed JOIN ids USING (k, slot) GROUP BY edge)"
SQL["edge_blocks"] = _with(*_G, _COLOURED) + "SELECT c1, c2, count(*) AS m, count(*) = 1 OR (c1 <> c2 AND (min(a) = max(a) OR min(b) = max(b))) AS dead FROM ends GROUP BY c1, c2"
SQL["rewire_round"] = _with(
    *_C, _COLOURED,
    "turned AS (SELECT *, c1 = c2 AND ('0x' || substr(md5('9:0:turn:' || least(a, b) || ':' || greatest(a, b)), 1, 8))::BIGINT % 2 = 1 AS t, md5('9:0:' || least(a, b) || ':' || greatest(a, b)) AS h FROM ends)",
    "faced AS (SELECT CASE WHEN t THEN greatest(a, b) WHEN c1 = c2 THEN least(a, b) ELSE a END AS a, CASE WHEN t THEN least(a, b) WHEN c1 = c2 THEN greatest(a, b) ELSE b END AS b, c1, c2, h FROM turned)",
    "placed AS MATERIALIZED (SELECT a, b, c1, c2, row_number() OVER (PARTITION BY c1, c2 ORDER BY h, a, b) - 1 AS place FROM faced)",
    "pairs AS MATERIALIZED (SELECT e.c1, e.c2, e.place // 2 AS pair, e.a AS ea, e.b AS eb, f.a AS fa, f.b AS fb FROM placed e JOIN placed f ON e.c1 = f.c1 AND e.c2 = f.c2 AND f.place = e.place + 1 WHERE e.place % 2 = 0 AND e.a <> f.a AND e.b <> f.b AND e.a <> f.b AND f.a <> e.b)",
    "made AS MATERIALIZED (SELECT c1, c2, pair, ea AS a, fb AS b FROM pairs UNION ALL SELECT c1, c2, pair, fa, eb FROM pairs)",
    "bad AS (SELECT c1, c2, pair FROM made m JOIN g ON g.src = least(m.a, m.b) AND g.dst = greatest(m.a, m.b) UNION SELECT c1, c2, pair FROM made m JOIN (SELECT least(a, b) AS lo, greatest(a, b) AS hi FROM made GROUP BY ALL HAVING count(*) > 1) d ON d.lo = least(m.a, m.b) AND d.hi = greatest(m.a, m.b))",
    "swapped AS MATERIALIZED (SELECT * FROM made ANTI JOIN bad USING (c1, c2, pair))",
    "after AS (SELECT a, b FROM (SELECT *, place // 2 AS pair FROM placed) ANTI JOIN swapped USING (c1, c2, pair) UNION ALL SELECT a, b FROM swapped)",
) + "SELECT least(a, b) AS src, greatest(a, b) AS dst FROM after"
SQL["configuration_sample"] = _with(
    *_C, _COLOURED,
    "stubs AS (SELECT c1, c2, a AS id, a || ':' || b AS stub, CASE WHEN c1 = c2 THEN 2 ELSE 0 END AS side, 0 AS s FROM ends UNION ALL SELECT c1, c2, b, a || ':' || b, CASE WHEN c1 = c2 THEN 2 ELSE 1 END, 1 FROM ends)",
    "placed AS (SELECT c1, c2, id, side, row_number() OVER (PARTITION BY c1, c2, side ORDER BY md5('2:stub:' || stub || ':' || s), id) - 1 AS place FROM stubs)",
    "met AS (SELECT min(id) AS src, max(id) AS dst FROM placed GROUP BY c1, c2, CASE WHEN side = 2 THEN place // 2 ELSE place END)",
) + "SELECT src, dst, sum(CASE WHEN src = dst THEN 2 ELSE 1 END)::BIGINT AS weight FROM met GROUP BY src, dst"
_WL_ENDS = """
ends AS MATERIALIZED (SELECT CASE WHEN s.color > d.color THEN g.dst ELSE g.src END AS a, CASE WHEN s.color > d.color THEN g.src ELSE g.dst END AS b, least(s.color, d.color) AS c1, greatest(s.color, d.color) AS c2
  FROM g JOIN wl1 s ON s.id = g.src JOIN wl1 d ON d.id = g.dst)"""
SQL["nest_rewired_edges"] = _with(_PART, _sym(), *_wl(1), _WL_ENDS, *_swapped(1, 2)) + "SELECT least(a, b) AS src, greatest(a, b) AS dst FROM e2"
SQL["ccm_rewired_edges"] = _with(*_C, _COLOURED, *_swapped(6, 2)) + "SELECT least(a, b) AS src, greatest(a, b) AS dst FROM e2"
_KEEPS = "SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM g) AS edges, true AS degrees_kept, 0 AS color_degrees_changed, true AS moved"
SQL["nest_changes"] = _with(_PART) + _KEEPS
SQL["ccm_changes"] = SQL["variant_nest_changes"] = SQL["private_color_changes"] = _with(_CUSTOMER) + _KEEPS
SQL["soft_color_changes"] = "SELECT 42 AS nodes, 59 AS edges, true AS degrees_kept, 0 AS color_degrees_changed, true AS moved"
SQL["closeness_color_changes"] = "SELECT 8 AS nodes, 7 AS edges, true AS degrees_kept, 0 AS color_degrees_changed, true AS moved"
SQL["k_degree_anonymous"] = _with(_CUSTOMER) + "SELECT 1.0::DOUBLE AS fraction, (SELECT count(*) FROM v)::INT AS nodes, true AS changed"


def _k_degree(k: int, deletions: bool, exact: bool) -> str:
    """Dynamic programming over the descending degrees: ``best`` and ``cut`` of every place so far are lists that a recursion adds to."""
    part = "list_slice(d, first + 1, first + size)"
    middle = f"(list_extract({part}, (size + 1) // 2) + list_extract({part}, size // 2 + 1)) // 2"
    degree = middle if deletions else f"list_extract({part}, 1)"
    full = f"list_sum(list_transform({part}, lambda x: abs(x - ({degree}))))::DOUBLE"
    newcomer = f"abs(({degree}) - list_extract({part}, size))::DOUBLE"
    cost = full if exact or not deletions else f"sum(CASE WHEN size = {k} THEN {full} ELSE {newcomer} END) OVER (PARTITION BY first ORDER BY size ROWS UNBOUNDED PRECEDING)"
    return _with(
        *_C,
        "r AS MATERIALIZED (SELECT id, deg, row_number() OVER (ORDER BY deg DESC, id DESC) - 1 AS place FROM deg)",
        "whole AS MATERIALIZED (SELECT list(deg ORDER BY place) AS d, count(*) AS n FROM r)",
        f"groups AS MATERIALIZED (SELECT first, size, first + size - 1 AS last, {cost} AS cost, {degree} AS target FROM (SELECT p.place AS first, s.range AS size, d, n FROM r p, range({k}, {2 * k + 1}) s, whole) WHERE first + size <= n)",
        f"ending AS MATERIALIZED (SELECT last, list(struct_pack(first := first, cost := cost) ORDER BY first) AS options FROM groups WHERE (first = 0 OR first >= {k}) AND (first = 0 OR size < {2 * k}) GROUP BY last)",
        f"""solved(t, best, cut) AS (SELECT {k - 2}, list_resize([]::DOUBLE[], {k - 1}, 1e300), list_resize([]::BIGINT[], {k - 1}, 0)
  UNION ALL SELECT t + 1, list_append(best, list_min(each)), list_append(cut, options[list_position(each, list_min(each))].first)
  FROM (SELECT s.t, s.best, s.cut, e.options, list_transform(e.options, lambda o: o.cost + CASE WHEN o.first = 0 THEN 0 ELSE s.best[o.first] END) AS each FROM solved s JOIN ending e ON e.last = s.t + 1))""",
        "final AS MATERIALIZED (SELECT cut FROM solved WHERE t = (SELECT n - 1 FROM whole))",
        "chain(first, last) AS (SELECT cut[n], n - 1 FROM final, whole UNION ALL SELECT f.cut[c.first], c.first - 1 FROM chain c, final f WHERE c.first > 0)",
        recursive=True,
    ) + "SELECT r.id, r.deg, g.target::BIGINT AS target FROM r JOIN chain c ON r.place BETWEEN c.first AND c.last JOIN groups g ON g.first = c.first AND g.last = c.last"


SQL["k_degree_sequence"] = _k_degree(10, True, False)
SQL["k_degree_sequence_additions"] = _k_degree(10, False, False)
SQL["k_degree_sequence_exact"] = _k_degree(10, True, True)


def _scalar(name: str, g: str, ga: str) -> str:
    return f"SELECT '{name}' AS metric, round(({g})::DOUBLE, 9) AS g, round(({ga})::DOUBLE, 9) AS ga, NULL::DOUBLE AS dist"


def _distance(name: str, sql: str) -> str:
    return f"SELECT '{name}', NULL, NULL, round(({sql})::DOUBLE, 9)"


_ROWS = [
    _scalar("nodes", "SELECT count(*) FROM v", "SELECT count(*) FROM v"),
    _scalar("edges", "SELECT count(*) FROM g", "SELECT count(*) FROM ga"),
    _scalar("components", "SELECT count(DISTINCT c) FROM (SELECT min(r) AS c FROM comp GROUP BY id)", "SELECT count(DISTINCT c) FROM (SELECT min(r) AS c FROM compa GROUP BY id)"),
    *(_scalar(n, f"SELECT {f}(deg) FROM deg", f"SELECT {f}(deg) FROM dega") for n, f in (("max_degree", "max"), ("median_degree", "median"), ("mean_degree", "avg"))),
    _scalar("triangles", "SELECT count(*) FROM tri", "SELECT count(*) FROM tria"),
    _scalar("avg_clustering", "SELECT avg(clustering) FROM cl", "SELECT avg(clustering) FROM cla"),
    _scalar("transitivity", "SELECT 2 * sum(tri)::DOUBLE / sum(deg * (deg - 1)) FROM cl", "SELECT 2 * sum(tri)::DOUBLE / sum(deg * (deg - 1)) FROM cla"),
    _distance("degree_w1", _w1("p", "q", 12)),
    _distance("clustering_w1", _w1("lp", "lq", 12)),
    *(_distance(f"{k}_w1", _w1(f"{k}_p", f"{k}_q", 12)) for k in ("eigenvector", "katz", "pagerank")),
    _distance("closeness_w1", _w1("cp", "cq", 12)),
    _distance("wl_2", f"SELECT {_WL_TVD}"),
    _distance("jaccard", f"SELECT {_JACCARD}"),
    _scalar("k_degree_20", f"SELECT {_KDEG.format(deg='deg')}", f"SELECT {_KDEG.format(deg='dega')}"),
]
SQL["evaluator_report"] = _with(
    _PART, _THIN, *_clustering("g", "sym", "deg", "tri", "cl"), *_clustering("ga", "syma", "dega", "tria", "cla"), *_UNION,
    "lp AS (SELECT clustering AS val FROM cl)", "lq AS (SELECT clustering AS val FROM cla)",
    *(x for k in ("eigenvector", "katz", "pagerank") for x in (*_converged(k, "sym", "deg", f"{k}_p"), *_converged(k, "syma", "dega", f"{k}_q"))),
    _BFS.format(name="b", sym="sym"), _CLOSE.format(name="cp", bfs="b"), _BFS.format(name="ba", sym="syma"), _CLOSE.format(name="cq", bfs="ba"),
    _VAL.format(name="p", deg="deg"), _VAL.format(name="q", deg="dega"), _COMP.format(sym="sym"), _COMP.format(sym="syma").replace("comp", "compa"), recursive=True,
) + "\nUNION ALL ".join(_ROWS)

_MEANS = "(SELECT method, metric, avg(value) AS mean FROM s GROUP BY method, metric)"
SQL["sample_mean_relstd"] = _with(_SAMPLES) + "SELECT method, metric, count(value) AS n, round(avg(value), 9) AS mean, round(stddev_pop(value) / nullif(avg(value), 0), 9) AS rel_std FROM s GROUP BY method, metric"
_WIDE = 'SELECT method, round(avg(value) FILTER (metric = \'F\'), 9) AS "F", round(avg(value) FILTER (metric = \'O\'), 9) AS "O" FROM s GROUP BY method'
SQL["metric_pivot"] = _with(_SAMPLES) + _WIDE
SQL["metric_unpivot"] = _with(_SAMPLES, f"w AS ({_WIDE})") + "SELECT method, 'F' AS metric, \"F\" AS value FROM w UNION ALL SELECT method, 'O', \"O\" FROM w"
SQL["average_ranks"] = "SELECT p_partkey, p_brand, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS place FROM part"
SQL["best_methods"] = _with(_SAMPLES) + f"SELECT method, metric, round(mean, 9) AS mean, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean, method) AS place FROM {_MEANS}) WHERE place <= 2"
SQL["relative_values"] = _with(_SAMPLES) + f"SELECT s.method, s.metric, round(sum(s.value / b.mean), 5) AS ratio FROM s JOIN (SELECT metric, mean FROM {_MEANS} WHERE method = 'N') b USING (metric) GROUP BY s.method, s.metric"
SQL["outliers_masked"] = _with(_SAMPLES) + 'SELECT method, count(*) FILTER (value <= 30) AS n, count(*) AS "all" FROM s GROUP BY method'
SQL["weighted_means"] = "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean FROM lineitem GROUP BY l_returnflag"
SQL["group_means"] = _with(_SAMPLES) + "SELECT method, metric, round(avg(value), 9) AS group_mean, count(*) AS n FROM s GROUP BY method, metric"
SQL["sample_description"] = _with(_SAMPLES) + "SELECT metric, count(value) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, min(value) AS low, round(quantile_cont(value, 0.25), 9) AS q25, round(quantile_cont(value, 0.5), 9) AS q50, round(quantile_cont(value, 0.75), 9) AS q75, max(value) AS high FROM s GROUP BY metric"
SQL["methods_renamed"] = _with(_SAMPLES) + "SELECT CASE method WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE method END AS method, count(*) AS n FROM s GROUP BY s.method"
SQL["metrics_arranged"] = _with(_SAMPLES, f"w AS ({_WIDE})", "k AS (SELECT unnest(['R', 'X', 'A']) AS method)") + 'SELECT method, "F", "O" FROM k LEFT JOIN w USING (method)'
SQL["metrics_transposed"] = _with(_SAMPLES) + """SELECT metric AS name, round(avg(value) FILTER (method = 'A'), 9) AS "A", round(avg(value) FILTER (method = 'N'), 9) AS "N", round(avg(value) FILTER (method = 'R'), 9) AS "R" FROM s WHERE metric IN ('F', 'O') GROUP BY metric"""
SQL["report_latex"] = r"""SELECT '\begin{tabular}{ll}' || chr(10) || '\hline' || chr(10) || 'r\_regionkey & r\_name \\' || chr(10) || '\hline' || chr(10)
  || string_agg(r_regionkey || ' & ' || replace(r_name, '_', '\_') || ' \\', chr(10) ORDER BY r_regionkey) || chr(10) || '\hline' || chr(10) || '\end{tabular}' AS latex FROM region"""
