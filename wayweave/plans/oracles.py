"""DuckDB statements that give the same rows as the registered queries."""

from __future__ import annotations

from ..functions.hashing import P, coefficients, premix
from .queries import HOT, K, LEVELS, OBJECTS, PAIRS, PATHS, SEED, STREET, SWEEP, TARGETS

_SIDE = """CASE WHEN x1 <= {s} AND x2 <= {s} THEN 1 WHEN x1 > {s} AND x2 > {s} THEN 2
  WHEN abs(x1 - {s}) >= abs(x2 - {s}) THEN CASE WHEN x1 > x2 THEN 2 ELSE 1 END ELSE CASE WHEN x2 > x1 THEN 2 ELSE 1 END END"""
_MID = "(min(least(x1, x2)) OVER (PARTITION BY part) + max(greatest(x1, x2)) OVER (PARTITION BY part)) / 2"

GRID = f"""
ends AS (SELECT k AS edge_id, k % 25 AS src, (k % 25 + [1, 24, 5, 20][k // 25 + 1]) % 25 AS dst FROM (SELECT unnest(range(100)) AS k)),
edges AS (SELECT edge_id, src, dst, src % 5 * 100 AS x1, src // 5 * 100 AS y1, dst % 5 * 100 AS x2, dst // 5 * 100 AS y2 FROM ends),
passages AS (SELECT user_id AS obj_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS edge_id, ts, event_id FROM events),
seen AS (SELECT DISTINCT edge_id, obj_id FROM passages),
conn AS (SELECT a.edge_id, b.edge_id AS succ_id FROM edges a JOIN edges b ON a.dst = b.src),
r0 AS (SELECT edge_id, 10 AS region_id FROM edges),
s1 AS (SELECT *, {_MID} AS mid FROM (SELECT *, 0 AS part FROM edges)),
p1 AS (SELECT edge_id, x1, x2, {_SIDE.format(s='mid')} AS part FROM s1),
r1 AS (SELECT edge_id, CAST(part * 10 + 1 AS INTEGER) AS region_id FROM p1),
s2 AS (SELECT *, {_MID} AS mid FROM p1),
p2 AS (SELECT edge_id, part * 10 + {_SIDE.format(s='mid')} AS part FROM s2),
r2 AS (SELECT edge_id, CAST(part * 10 + 2 AS INTEGER) AS region_id FROM p2)"""

LANES = """
lane AS (SELECT 5 * CAST(r_regionkey AS BIGINT) + d + 3 AS edge_id, CAST(r_regionkey AS BIGINT) AS src, d AS dst FROM region, (SELECT unnest(range(5)) AS d)),
lane_seen AS (
  SELECT DISTINCT 5 * CAST(ns.n_regionkey AS BIGINT) + nc.n_regionkey + 3 AS edge_id, l_partkey AS obj_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN nation ns ON s_nationkey = ns.n_nationkey),
lane_region AS (SELECT edge_id, 10 AS region_id FROM lane),
lane_conn AS (SELECT a.edge_id, b.edge_id AS succ_id FROM lane a JOIN lane b ON a.dst = b.src)"""


def _mine(name: str, regions: str, t: float, levels: int, seen: str = "seen", conn: str = "conn") -> str:
    """Recursive CTEs {name}_own, _tot, _hot and {name}: region_id, level, path, objs, support, ratio."""
    return f"""
{name}_own AS (SELECT DISTINCT region_id, edge_id, obj_id FROM {seen} JOIN {regions} USING (edge_id)),
{name}_tot AS (SELECT region_id, count(DISTINCT obj_id) AS n FROM {name}_own GROUP BY region_id),
{name}_hot AS (SELECT region_id, edge_id, any_value(n) AS n, list(obj_id) AS objs, count(*) AS support FROM {name}_own JOIN {name}_tot USING (region_id)
  GROUP BY region_id, edge_id HAVING CAST(count(*) AS DOUBLE) / any_value(n) >= {t}),
{name}_rec AS (
  SELECT region_id, 1 AS level, [edge_id] AS path, objs, n FROM {name}_hot
  UNION ALL
  SELECT * FROM (
    SELECT p.region_id, p.level + 1 AS level, list_append(p.path, h.edge_id) AS path, list_intersect(p.objs, h.objs) AS objs, p.n
    FROM {name}_rec p JOIN {conn} c ON c.edge_id = p.path[-1] JOIN {name}_hot h ON h.edge_id = c.succ_id AND h.region_id = p.region_id
    WHERE p.level < {levels} AND (h.edge_id = p.path[-1] OR NOT list_contains(p.path, h.edge_id)))
  WHERE CAST(len(objs) AS DOUBLE) / n >= {t}),
{name} AS (SELECT region_id, level, path, objs, CAST(len(objs) AS BIGINT) AS support, CAST(len(objs) AS DOUBLE) / n AS ratio FROM {name}_rec)"""


def _maximal(name: str) -> str:
    return f"""
{name}_sub AS (SELECT region_id, path[:-2] AS path FROM {name} WHERE level >= 2 UNION SELECT region_id, path[2:] FROM {name} WHERE level >= 2),
{name}_max AS (SELECT * FROM {name} a WHERE NOT EXISTS (SELECT 1 FROM {name}_sub s WHERE s.region_id = a.region_id AND s.path = a.path))"""


def _with(*parts: str, body: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + body


_S = lambda c: f"array_to_string({c}, ',')"
ALL = _mine("m", "r0", PATHS, LEVELS)
TWO = _mine("m", "r0", PAIRS, 2)
REG = _mine("m", "r1", PATHS, LEVELS)

SPANS = REG + "," + _maximal("m") + f""",
common AS (SELECT a.region_id AS region_a, b.region_id AS region_b, count(*) AS n_common FROM (SELECT DISTINCT region_id, obj_id FROM m_own) a
  JOIN (SELECT DISTINCT region_id, obj_id FROM m_own) b ON a.obj_id = b.obj_id AND a.region_id <> b.region_id GROUP BY ALL),
border AS (SELECT a.region_id AS region_a, b.region_id AS region_b, c.edge_id, c.succ_id FROM conn c JOIN r1 a ON a.edge_id = c.edge_id JOIN r1 b ON b.edge_id = c.succ_id
  WHERE a.region_id <> b.region_id),
cand AS (SELECT DISTINCT p.region_id AS region_a, p.path AS p1, q.region_id AS region_b, q.path AS p2, p.objs FROM m_max p JOIN border b ON b.region_a = p.region_id AND b.edge_id = p.path[-1]
  JOIN m_max q ON q.region_id = b.region_b AND q.path[1] = b.succ_id),
edge_objs AS (SELECT edge_id, list(obj_id) AS eo FROM seen GROUP BY edge_id),
grow AS (
  SELECT region_a, p1, region_b, p2, 0 AS i, objs FROM cand
  UNION ALL
  SELECT * FROM (SELECT g.region_a, g.p1, g.region_b, g.p2, g.i + 1 AS i, list_intersect(g.objs, e.eo) AS objs FROM grow g JOIN edge_objs e ON e.edge_id = g.p2[g.i + 1] WHERE g.i < len(g.p2)) x
  WHERE EXISTS (SELECT 1 FROM common c WHERE c.region_a = x.region_a AND c.region_b = x.region_b AND CAST(len(x.objs) AS DOUBLE) / c.n_common >= {PATHS})),
best AS (SELECT region_a, p1, region_b, p2, max(i) AS i, arg_max(len(objs), i) AS n_objects FROM grow WHERE i > 0 GROUP BY ALL),
spans AS (SELECT region_a, p1, region_b, p2, CASE WHEN i = len(p2) THEN 'span_full' ELSE 'span_partial' END AS kind, i, CAST(n_objects AS BIGINT) AS n_objects,
  CAST(n_objects AS DOUBLE) / n_common AS ratio, list_concat(p1, p2[:i]) AS path FROM best JOIN common USING (region_a, region_b)),
remainders AS (SELECT region_a, p1, region_b, p2, list_filter(p2, lambda x: NOT list_contains(p2[:i], x)) AS path FROM spans WHERE kind = 'span_partial'),
local AS (SELECT p.region_id, p.path FROM m_max p WHERE (SELECT count(*) FROM cand c WHERE c.region_a = p.region_id AND c.p1 = p.path) < (SELECT count(*) FROM m_max q WHERE q.region_id <> p.region_id))"""

_HASHES = "[" + ", ".join(f"({a} * m + {b}) % {P}" for a, b in coefficients(K, SEED)) + "]"
SKETCH = f"""
hashed AS (SELECT edge_id, unnest({_HASHES}) AS h, unnest(range({K})) AS pos FROM (SELECT edge_id, {premix('obj_id', '//')} AS m FROM seen)),
lows AS (SELECT edge_id, pos, min(h) AS h, count(*) AS n_raw FROM hashed GROUP BY edge_id, pos),
sketch AS (SELECT edge_id, max(n_raw) AS n_raw, list(h ORDER BY pos) AS sig FROM lows GROUP BY edge_id)"""


def _cohen(regions: str) -> str:
    return f"""
unions AS (SELECT region_id, pos, min(h) AS h FROM lows JOIN {regions} USING (edge_id) GROUP BY region_id, pos),
cohen AS (SELECT region_id, CAST(trunc(CAST({K} AS DOUBLE) / (sum(h) / CAST({P} AS DOUBLE)) - 1) AS BIGINT) AS estimate FROM unions GROUP BY region_id)"""


_HOTS = """shot AS (SELECT region_id, edge_id, n_raw, estimate, CAST(n_raw AS DOUBLE) / estimate AS ratio, sig FROM sketch JOIN r0 USING (edge_id) JOIN cohen USING (region_id)
  WHERE CAST(n_raw AS DOUBLE) / estimate >= {t})"""
_SPAIRS = f"""spairs AS (SELECT * FROM (SELECT [a.edge_id, b.edge_id] AS path, CAST(len(list_filter(a.sig, lambda x: list_contains(b.sig, x))) AS DOUBLE) / {K} AS ratio
  FROM shot a JOIN conn c ON c.edge_id = a.edge_id JOIN shot b ON b.edge_id = c.succ_id) WHERE ratio >= {PAIRS})"""
_BOTH = "list_filter({}, lambda x: list_contains({}, x))"
_SSPANS = f"""shot1 AS (SELECT region_id, edge_id, sig FROM sketch JOIN r1 USING (edge_id) JOIN cohen USING (region_id) WHERE CAST(n_raw AS DOUBLE) / estimate >= {PATHS}),
stwo AS (SELECT * FROM (SELECT a.region_id, [a.edge_id, b.edge_id] AS path, {_BOTH.format('a.sig', 'b.sig')} AS sig FROM shot1 a JOIN conn c ON c.edge_id = a.edge_id JOIN shot1 b ON b.edge_id = c.succ_id AND b.region_id = a.region_id)
  WHERE CAST(len(sig) AS DOUBLE) / {K} >= {PATHS}),
smax AS (SELECT * FROM stwo UNION ALL SELECT region_id, [edge_id], sig FROM shot1 s WHERE NOT EXISTS (SELECT 1 FROM stwo t WHERE t.region_id = s.region_id AND list_contains(t.path, s.edge_id))),
border AS (SELECT a.region_id AS region_a, b.region_id AS region_b, c.edge_id, c.succ_id FROM conn c JOIN r1 a ON a.edge_id = c.edge_id JOIN r1 b ON b.edge_id = c.succ_id WHERE a.region_id <> b.region_id),
scand AS (SELECT DISTINCT p.region_id AS region_a, p.path AS p1, q.region_id AS region_b, q.path AS p2, p.sig FROM smax p JOIN border b ON b.region_a = p.region_id AND b.edge_id = p.path[-1]
  JOIN smax q ON q.region_id = b.region_b AND q.path[1] = b.succ_id),
sgrow AS (
  SELECT region_a, p1, region_b, p2, 0 AS i, sig FROM scand
  UNION ALL
  SELECT * FROM (SELECT g.region_a, g.p1, g.region_b, g.p2, g.i + 1 AS i, {_BOTH.format('g.sig', 'e.sig')} AS sig FROM sgrow g JOIN sketch e ON e.edge_id = g.p2[g.i + 1] WHERE g.i < len(g.p2)) x WHERE CAST(len(sig) AS DOUBLE) / {K} >= {PATHS}),
sbest AS (SELECT region_a, p1, region_b, p2, max(i) AS i, CAST(arg_max(len(sig), i) AS BIGINT) AS n_objects FROM sgrow WHERE i > 0 GROUP BY ALL)"""
_CODE = "CASE WHEN length({0}) < 3 THEN lpad({0}, 3, '0') ELSE {0} END"
_PAIRCODE = f"{_CODE.format('CAST(path[1] AS VARCHAR)')} || '000' || {_CODE.format('CAST(path[2] AS VARCHAR)')}"
_BR = "'[' || array_to_string(path, ',') || ']'"

_PARTS = """
s1 AS (SELECT *, {mid} AS mid FROM (SELECT *, 0 AS part FROM streets)), p1 AS (SELECT edge_id, x1, x2, {side} AS part FROM s1),
s2 AS (SELECT *, {mid} AS mid FROM p1), sr AS (SELECT edge_id, CAST((part * 10 + {side}) * 10 + 2 AS INTEGER) AS region_id FROM s2)""".format(mid=_MID, side=_SIDE.format(s="mid"))
STREETS = """
width AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM part),
streets AS (SELECT 2 * src + up + 3 AS edge_id, src, dst, src % w * 100 AS x1, src // w * 100 AS y1, (src % w + 1 - up) * 100 AS x2, (src // w + up) * 100 AS y2
  FROM (SELECT w, up, p_partkey AS src, p_partkey + CASE up WHEN 0 THEN 1 ELSE w END AS dst FROM part, width, (SELECT unnest([0, 1]) AS up))
  WHERE src % w + 1 - up < w AND dst IN (SELECT p_partkey FROM part)),
street_conn AS (SELECT a.edge_id, b.edge_id AS succ_id FROM streets a JOIN streets b ON a.dst = b.src),
street_seen AS (SELECT DISTINCT edge_id, l_suppkey AS obj_id FROM lineitem JOIN streets ON l_partkey = src),""" + _PARTS
STREET_PATHS = _mine("m", "sr", STREET, 2, "street_seen", "street_conn")


def _lines(paths: str, regions: str, t: float, costs: bool = False) -> str:
    """Statement of the log lines of all regions."""
    front = "CAST(n_bytes AS VARCHAR) || ',' || CAST(round(n_bytes * 0.0001::DOUBLE, 4) AS VARCHAR) || ',' || " if costs else ""
    return f"""SELECT region_id, {front}n_objects || ',{t},100,-1,-1,' || region_id || ',' || coalesce(string_agg({_BR}, ',' ORDER BY {_BR}), '[0]') AS line
FROM (SELECT region_id, count(DISTINCT obj_id) AS n_objects, 4 * (count(DISTINCT edge_id) + count(*)) AS n_bytes FROM seen JOIN {regions} USING (edge_id) GROUP BY region_id)
LEFT JOIN ({paths}) USING (region_id) GROUP BY region_id, n_objects, n_bytes"""


_SENT = """lines AS (SELECT region_id, level, length('[' || array_to_string(path, ', ') || ']') AS n
  FROM (SELECT region_id, level, path FROM m_max UNION ALL SELECT region_id, 0, path FROM m WHERE level = 1)),
levels AS (SELECT region_id, level, sum(n) + 2 * (count(*) - 1) + 2 + length(CAST(level AS VARCHAR)) + 4 AS n FROM lines GROUP BY region_id, level),
sent AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS sent FROM (SELECT sum(n) + 2 * (count(*) - 1) + 2 AS n FROM levels GROUP BY region_id)),
firsts AS (SELECT CAST(coalesce(4 * sum(n), 0) AS BIGINT) AS first_bytes FROM (SELECT count(DISTINCT edge_id) + count(*) AS n FROM m_own WHERE region_id IN (SELECT region_id FROM m) GROUP BY region_id))"""
_HEAD = f"(SELECT count(DISTINCT obj_id) FROM seen) || ',' || sent || ',' || first_bytes || ',{PATHS},100,-1,-1,0'"
_JSON = "'[' || array_to_string(path, ', ') || '],'"
_MANY = 64


def _targets() -> str:
    """picks: target, k of the search for TARGETS (two, falling) over the first _MANY lengths; then hot edges and pairs on those signatures."""
    high, low = TARGETS
    hashes = "[" + ", ".join(f"({a} * m + {b}) % {P}" for a, b in coefficients(_MANY, SEED)) + "]"
    return f"""
hashed AS (SELECT edge_id, unnest({hashes}) AS h, unnest(range({_MANY})) AS pos FROM (SELECT edge_id, {premix('obj_id', '//')} AS m FROM seen)),
lows AS (SELECT edge_id, pos, min(h) AS h, count(*) AS n_raw FROM hashed GROUP BY edge_id, pos),
raw AS (SELECT sum(n) AS raw_bytes FROM (SELECT length(CAST(edge_id AS VARCHAR)) + sum(length(CAST(obj_id AS VARCHAR)) + 1) + 1 AS n FROM seen GROUP BY edge_id)),
fixed AS (SELECT sum(length(CAST(edge_id AS VARCHAR)) + length(CAST(n_raw AS VARCHAR)) + 2) AS f FROM lows WHERE pos = 0),
bytes AS (SELECT CAST(pos + 1 AS INTEGER) AS k, CAST(raw_bytes AS DOUBLE) / (f + sum(n) OVER (ORDER BY pos)) AS ratio FROM (SELECT pos, sum(length(CAST(h AS VARCHAR)) + 1) AS n FROM lows GROUP BY pos), fixed, raw),
pick1 AS (SELECT k, ratio >= {high * 0.9} AS ok FROM bytes WHERE ratio <= {high} * 1.1::DOUBLE ORDER BY k LIMIT 1),
pick2 AS (SELECT k, ratio >= {low * 0.9} AS ok FROM bytes WHERE ratio <= {low} * 1.1::DOUBLE AND k >= (SELECT CASE WHEN ok THEN k + 1 ELSE k END FROM pick1) ORDER BY k LIMIT 1),
picks AS (SELECT {high}::DOUBLE AS target, k FROM pick1 WHERE ok UNION ALL SELECT {low}::DOUBLE, k FROM pick2 WHERE ok),
sizes AS (SELECT target, k, CAST(trunc(CAST(k AS DOUBLE) / (sum(h) / CAST({P} AS DOUBLE)) - 1) AS BIGINT) AS estimate
  FROM (SELECT target, k, pos, min(h) AS h FROM picks JOIN lows ON pos < k GROUP BY target, k, pos) GROUP BY target, k),
given AS (SELECT unnest([{PAIRS}::DOUBLE, {HOT}::DOUBLE]) AS threshold),
warm AS (SELECT threshold, target, k, edge_id, list(h ORDER BY pos) AS sig FROM sizes JOIN lows ON pos < k, given GROUP BY threshold, target, k, estimate, edge_id
  HAVING CAST(max(n_raw) AS DOUBLE) / nullif(estimate, 0) >= threshold),
two AS (SELECT threshold, target, k, CAST(len({_BOTH.format('a.sig', 'b.sig')}) AS DOUBLE) / k AS ratio FROM warm a JOIN conn c USING (edge_id) JOIN warm b USING (threshold, target, k) WHERE b.edge_id = c.succ_id)"""


ORACLES = {
    "hot_edges": _with(GRID, _mine("m", "r0", HOT, 1), body="SELECT path[1] AS edge_id, support, CAST(n AS BIGINT) AS n_objects, ratio FROM m JOIN m_tot USING (region_id)"),
    "lane_hot_edges": _with(LANES, _mine("m", "lane_region", 0.6, 1, "lane_seen", "lane_conn"), body="SELECT path[1] AS edge_id, support, CAST(n AS BIGINT) AS n_objects, ratio FROM m JOIN m_tot USING (region_id)"),
    "lane_connections": _with(LANES, body="SELECT * FROM lane_conn"),
    "lane_paths": _with(LANES, _mine("m", "lane_region", 0.45, 3, "lane_seen", "lane_conn"), body=f"SELECT level, {_S('path')} AS path, support, ratio FROM m"),
    "connections": _with(GRID, body="SELECT * FROM conn"),
    "edge_weights": _with(GRID, """b AS (SELECT min(least(x1, x2)) AS ax, max(greatest(x1, x2)) AS bx, min(least(y1, y2)) AS ay, max(greatest(y1, y2)) AS yy FROM edges),
far AS (SELECT edge_id, greatest(abs((x1 + x2) / 2 - (ax + bx) / 2) / (bx - ax), abs((y1 + y2) / 2 - (ay + yy) / 2) / (yy - ay)) AS f FROM edges, b)""",
                          body="SELECT edge_id, CASE WHEN f <= 0.2 THEN 3 WHEN f <= 0.4 THEN 2 WHEN f <= 0.6 THEN 1 ELSE 0 END AS weight FROM far"),
    "edge_midpoints": _with(GRID, body="SELECT edge_id, (x1 + x2) / 2 AS mid_x, (y1 + y2) / 2 AS mid_y FROM edges"),
    "rotate_nodes": _with(GRID, body="""SELECT node_id, round(x * cos(radians(-5)) - y * sin(radians(-5)), 6) AS x, round(x * sin(radians(-5)) + y * cos(radians(-5)), 6) AS y
FROM (SELECT src AS node_id, x1 AS x, y1 AS y FROM edges UNION SELECT dst, x2, y2 FROM edges)"""),
    "central_topk": _with(GRID, body="""SELECT edge_id, round(d, 6) AS distance FROM (SELECT edge_id, pow(pow((x1 + x2) / 2 - (SELECT avg((x1 + x2) / 2) FROM edges), 2)
  + pow((y1 + y2) / 2 - (SELECT avg((y1 + y2) / 2) FROM edges), 2), 0.45) AS d FROM edges) ORDER BY d, edge_id LIMIT 8"""),
    "grid_motions": _with(GRID, body="SELECT obj_id, CAST(row_number() OVER (PARTITION BY obj_id ORDER BY ts, event_id) AS INTEGER) AS pos, edge_id FROM passages"),
    "sightings_by_edge": _with(GRID, body="SELECT edge_id, count(*) AS n_objects FROM seen GROUP BY edge_id"),
    "partition_d0": _with(GRID, body="SELECT * FROM r0"),
    "partition_d1": _with(GRID, body="SELECT * FROM r1"),
    "partition_d2": _with(GRID, body="SELECT * FROM r2"),
    "regional_connections": _with(GRID, body="SELECT region_id, edge_id, succ_id FROM conn JOIN r1 USING (edge_id)"),
    "borders": _with(GRID, body="""SELECT a.region_id AS region_a, b.region_id AS region_b, c.edge_id, c.succ_id FROM conn c JOIN r2 a ON a.edge_id = c.edge_id
JOIN r2 b ON b.edge_id = c.succ_id WHERE a.region_id <> b.region_id"""),
    "region_objects": _with(GRID, body="""SELECT region_id, count(DISTINCT obj_id) AS n_objects, count(DISTINCT edge_id) AS n_edges,
CAST(count(DISTINCT obj_id) AS DOUBLE) / count(DISTINCT edge_id) AS objects_per_edge FROM seen JOIN r2 USING (edge_id) GROUP BY region_id"""),
    "pairs": _with(GRID, TWO, body=f"SELECT {_S('path')} AS path, support, ratio FROM m WHERE level = 2"),
    "triples": _with(GRID, _mine("m", "r0", PATHS, 3), body=f"SELECT {_S('path')} AS path, support, ratio FROM m WHERE level = 3"),
    "paths_all": _with(GRID, ALL, body=f"SELECT level, {_S('path')} AS path, support, ratio FROM m"),
    "paths_maximal": _with(GRID, ALL, _maximal("m"), body=f"SELECT level, {_S('path')} AS path, support FROM m_max"),
    "paths_by_level": _with(GRID, ALL, body="SELECT level, count(*) AS n_paths FROM m GROUP BY level"),
    "region_paths": _with(GRID, REG, body=f"SELECT region_id, level, {_S('path')} AS path, support, ratio FROM m"),
    "region_ready": _with(GRID, _mine("m", "r2", HOT, 1), body="SELECT DISTINCT region_id FROM m"),
    "distinct_path_edges": _with(GRID, ALL, body="SELECT DISTINCT unnest(path) AS edge_id FROM m WHERE level >= 2"),
    "region_common_objects": _with(GRID, """o AS (SELECT DISTINCT region_id, obj_id FROM seen JOIN r1 USING (edge_id))""",
                                   body="SELECT a.region_id AS region_a, b.region_id AS region_b, count(*) AS n_common FROM o a JOIN o b ON a.obj_id = b.obj_id AND a.region_id <> b.region_id GROUP BY ALL"),
    "span_candidates": _with(GRID, SPANS, body=f"SELECT region_a, {_S('p1')} AS p1, region_b, {_S('p2')} AS p2 FROM cand"),
    "span_paths": _with(GRID, SPANS, body=f"SELECT region_a, region_b, {_S('p1')} AS p1, {_S('p2')} AS p2, kind, n_objects, ratio, {_S('path')} AS path FROM spans"),
    "span_paths_sketch": _with(GRID, SKETCH, _cohen("r1"), _SSPANS, body=f"""SELECT region_a, region_b, {_S('p1')} AS p1, {_S('p2')} AS p2, CASE WHEN i = len(p2) THEN 'span_full' ELSE 'span_partial' END AS kind,
  n_objects, CAST(n_objects AS DOUBLE) / {K} AS ratio, array_to_string(list_concat(p1, p2[:i]), ',') AS path FROM sbest"""),
    "object_sweep": _with(GRID, f"""firsts AS (SELECT obj_id, dense_rank() OVER (ORDER BY obj_id) AS nth FROM seen),
picked AS (SELECT DISTINCT objects, edge_id, obj_id FROM seen JOIN firsts USING (obj_id), (SELECT unnest({OBJECTS}) AS objects) WHERE nth <= objects),
totals AS (SELECT objects, count(DISTINCT obj_id) AS n FROM picked JOIN edges USING (edge_id) GROUP BY objects),
ratios AS (SELECT objects, edge_id, CAST(count(*) AS DOUBLE) / n AS ratio FROM picked JOIN edges USING (edge_id) JOIN totals USING (objects) GROUP BY objects, edge_id, n)""",
                          body="SELECT CAST(objects AS INTEGER) AS objects, threshold, 10 AS region_id, 1 AS level, count(*) AS n_paths FROM ratios, (SELECT unnest([0.15::DOUBLE, 0.30::DOUBLE]) AS threshold) WHERE ratio >= threshold GROUP BY objects, threshold"),
    "level_reached": _with(GRID, REG, body="SELECT region_id, max(level) AS greatest_level FROM m GROUP BY region_id"),
    "sketch_first_level_bytes": _with(GRID, SKETCH, body="SELECT region_id, CAST(sum(2 + len(sig)) AS BIGINT) AS integers, CAST(sum(2 + len(sig)) * 4 AS BIGINT) AS n_bytes, round(sum(2 + len(sig)) * 4 * 0.0001::DOUBLE, 4) AS cost FROM sketch JOIN r2 USING (edge_id) GROUP BY region_id"),
    "numbered_edges": _with(GRID, body="SELECT edge_id AS old_id, row_number() OVER (ORDER BY src, dst, edge_id) + 2 + CASE WHEN row_number() OVER (ORDER BY src, dst, edge_id) + 2 >= 112 THEN 1 ELSE 0 END AS edge_id FROM edges"),
    "scaled_nodes": _with(GRID, body="SELECT DISTINCT src AS node_id, CAST(x1 * 100000000 AS BIGINT) AS x, CAST(y1 * 100000000 AS BIGINT) AS y FROM edges"),
    "connections_skipping_first": _with(GRID, body="SELECT * FROM conn WHERE succ_id <> (SELECT min(edge_id) FROM edges)"),
    "span_remainders": _with(GRID, SPANS, body=f"SELECT region_a, region_b, {_S('p1')} AS p1, {_S('p2')} AS p2, {_S('path')} AS path FROM remainders"),
    "absorbed_paths": _with(GRID, SPANS, body=f"SELECT DISTINCT region_b, {_S('p2')} AS p2 FROM spans"),
    "path_catalog_counts": _with(GRID, SPANS, body="""SELECT kind, count(*) AS n_entries FROM (
SELECT region_a, region_b, path, kind FROM spans UNION SELECT region_a, region_b, path, 'remainder' FROM remainders UNION SELECT region_b, NULL, p2, 'absorbed' FROM spans
UNION SELECT region_id, NULL, path, 'local' FROM local) GROUP BY kind"""),
    "span_counts": _with(GRID, SPANS, body="SELECT kind, count(*) AS n_spans, count(DISTINCT (region_a, region_b, path)) AS n_distinct_spans FROM spans GROUP BY kind"),
    "minhash_signatures": _with(GRID, SKETCH, body=f"SELECT edge_id, n_raw, {_S('sig')} AS sig FROM sketch"),
    "cohen_by_region": _with(GRID, SKETCH, _cohen("r2"), body="SELECT * FROM cohen"),
    "union_signature": _with(GRID, SKETCH, _cohen("r1"), body="SELECT region_id, CAST(pos AS INTEGER) AS pos, h FROM unions"),
    "hot_edges_sketch": _with(GRID, SKETCH, _cohen("r0"), _HOTS.format(t=HOT), body="SELECT edge_id, n_raw, estimate, ratio FROM shot"),
    "pairs_sketch": _with(GRID, SKETCH, _cohen("r0"), _HOTS.format(t=PAIRS), _SPAIRS, body=f"SELECT {_S('path')} AS path, ratio FROM spairs"),
    "hot_edges_override": _with(GRID, SKETCH, _mine("m", "r0", HOT, 1), body="SELECT edge_id, n_raw FROM sketch WHERE edge_id IN (SELECT path[1] FROM m)"),
    "sketch_accuracy": _with(GRID, TWO, SKETCH, _cohen("r0"), _HOTS.format(t=PAIRS), _SPAIRS, body="""SELECT coalesce(a.level, b.level) AS level, count(a.level) AS n_exact, count(b.level) AS n_sketch,
count(CASE WHEN a.level = b.level THEN 1 END) AS n_both FROM m a FULL JOIN (SELECT 1 AS level, [edge_id] AS path FROM shot UNION ALL SELECT 2, path FROM spairs) b ON a.path = b.path GROUP BY 1"""),
    "first_level_bytes": _with(GRID, body="""SELECT region_id, n AS integers, n * 4 AS n_bytes, round(n * 4 * CAST(0.0001 AS DOUBLE), 4) AS cost FROM (
SELECT region_id, count(DISTINCT edge_id) + count(*) AS n FROM seen JOIN r2 USING (edge_id) GROUP BY region_id)"""),
    "gather_bytes": _with(GRID, REG, _maximal("m"), """lines AS (SELECT region_id, level, length('[' || array_to_string(path, ', ') || ']') AS n
  FROM (SELECT region_id, level, path FROM m_max UNION ALL SELECT region_id, 0, path FROM m WHERE level = 1)),
levels AS (SELECT region_id, level, sum(n) + 2 * (count(*) - 1) + 2 + length(CAST(level AS VARCHAR)) + 4 AS n FROM lines GROUP BY region_id, level)""",
                          body="SELECT region_id, CAST(sum(n) + 2 * (count(*) - 1) + 2 AS BIGINT) AS n_bytes FROM levels GROUP BY region_id"),
    "message_bytes": _with(GRID, SPANS, f"""lines AS (SELECT region_id, level, length('[' || array_to_string(path, ', ') || ']') AS n
  FROM (SELECT region_id, level, path FROM m_max UNION ALL SELECT region_id, 0, path FROM m WHERE level = 1)),
levels AS (SELECT region_id, level, sum(n) + 2 * (count(*) - 1) + 2 + length(CAST(level AS VARCHAR)) + 4 AS n FROM lines GROUP BY region_id, level),
msgs AS (
  SELECT 'paths' AS message, sum(n) + 2 * (count(*) - 1) + 2 AS n FROM levels GROUP BY region_id
  UNION ALL SELECT 'objects', length('{{' || string_agg(CAST(obj_id AS VARCHAR), ', ') || '}}') + 2 FROM (SELECT DISTINCT region_id, obj_id FROM m_own) WHERE region_id IN (SELECT region_id FROM m_hot) GROUP BY region_id
  UNION ALL SELECT 'path_objects', length('[' || array_to_string(objs, ', ') || ']') FROM cand
  UNION ALL SELECT 'edge_objects', length('[' || array_to_string(eo, ', ') || ']')
    FROM (SELECT unnest(c.p2[:coalesce(i, 0) + 1]) AS edge_id FROM cand c LEFT JOIN spans s ON s.region_a = c.region_a AND s.p1 = c.p1 AND s.region_b = c.region_b AND s.p2 = c.p2) JOIN edge_objs USING (edge_id))""",
                           body="SELECT message, count(*) AS n_messages, CAST(sum(n) AS BIGINT) AS n_bytes FROM msgs GROUP BY message"),
    "compression_ratio": _with(GRID, SKETCH, """raw AS (SELECT sum(n) AS raw_bytes FROM (SELECT length(CAST(edge_id AS VARCHAR)) + sum(length(CAST(obj_id AS VARCHAR)) + 1) + 1 AS n FROM seen GROUP BY edge_id)),
fixed AS (SELECT sum(length(CAST(edge_id AS VARCHAR)) + length(CAST(n_raw AS VARCHAR)) + 2) AS f FROM sketch),
bytes AS (SELECT CAST(pos + 1 AS INTEGER) AS k, CAST(f + sum(n) OVER (ORDER BY pos) AS BIGINT) AS hashed_bytes FROM (SELECT pos, sum(length(CAST(h AS VARCHAR)) + 1) AS n FROM lows GROUP BY pos), fixed)""",
                               body="SELECT k, hashed_bytes, CAST(raw_bytes AS DOUBLE) / hashed_bytes AS ratio FROM bytes, raw"),
    "path_log_lines": _with(GRID, REG, _maximal("m"), body=_lines("SELECT region_id, path FROM m_max", "r1", PATHS)),
    "path_log_rows": _with(GRID, REG, _maximal("m"), body=f"""SELECT n_objects, {PATHS}::DOUBLE AS threshold, 100 AS edges, -1 AS k, -1 AS compress, region_id, {_S('path')} AS path
FROM (SELECT region_id, count(DISTINCT obj_id) AS n_objects FROM seen JOIN r1 USING (edge_id) GROUP BY region_id) LEFT JOIN m_max USING (region_id)"""),
    "single_log_lines": _with(GRID, _mine("m", "r2", HOT, 1), body=_lines("SELECT region_id, path FROM m", "r2", HOT)),
    "pair_log_lines": _with(GRID, _mine("m", "r1", PATHS, 2), body=_lines("SELECT region_id, path FROM m WHERE level = 2", "r1", PATHS)),
    "longer_log_lines": _with(GRID, REG, _maximal("m"), body=_lines("SELECT region_id, path FROM m_max WHERE level >= 2", "r1", PATHS)),
    "cost_log_lines": _with(GRID, REG, _maximal("m"), body=_lines("SELECT region_id, path FROM m_max", "r1", PATHS, True)),
    "info_log_lines": _with(GRID, body=f"""SELECT region_id, '4_1. 100,' || n || ',' || CAST(CAST(n AS DOUBLE) / 100 AS VARCHAR) || ',{HOT}' AS line
FROM (SELECT region_id, count(DISTINCT obj_id) AS n FROM seen JOIN r2 USING (edge_id) GROUP BY region_id)"""),
    "seed_log_line": _with(GRID, SPANS, body=f"""SELECT '{SEED};' || (SELECT count(DISTINCT obj_id) FROM seen) || ',{PATHS},100,-1,-1,0' || coalesce(',' || string_agg({_BR}, ',' ORDER BY {_BR}), '') AS line
FROM (SELECT DISTINCT path FROM spans)"""),
    "span_cost_line": _with(GRID, SPANS, _SENT, body=f"SELECT {_HEAD} || coalesce(',' || (SELECT string_agg({_BR}, ',' ORDER BY {_BR}) FROM (SELECT DISTINCT path FROM spans)), '') AS line FROM sent, firsts"),
    "edge_cost_line": _with(GRID, REG, _maximal("m"), _SENT, body=f"""SELECT {_HEAD} || ',[' || coalesce((SELECT string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) FROM (SELECT DISTINCT unnest(path) AS e FROM m_max)), '') || ']' AS line
FROM sent, firsts"""),
    "result_report": _with(GRID, SPANS, f"""entries AS (SELECT region_a AS a, region_b AS b, path, kind FROM spans UNION SELECT region_b, region_b, path, 'remainder' FROM remainders
  UNION SELECT region_b, region_b, p2, 'absorbed' FROM spans UNION SELECT region_id, region_id, path, 'local' FROM local),
listed AS (SELECT a, b, '    ' || b || ': ' || string_agg(t, '' ORDER BY t) AS line FROM (SELECT DISTINCT a, b, {_JSON} AS t FROM entries WHERE kind <> 'absorbed') GROUP BY a, b
  UNION ALL SELECT DISTINCT a, NULL, CAST(a AS VARCHAR) FROM entries WHERE kind <> 'absorbed'),
top AS (SELECT unnest(range(6)) AS line_no, unnest(['TOP LEADER', 'Total number of Span-HoMoPaths: ' || (SELECT count(DISTINCT (a, b, path)) FROM entries WHERE kind LIKE 'span%'),
  'Total number of HoMoPaths : ' || (SELECT count(DISTINCT (a, b, path)) FROM entries), 'HoMoPaths Span Regions : ', 'Exec Time : 0.0', 'Threshold: {PATHS} , Compress:-1']) AS line)""",
                           body="SELECT CAST(line_no AS INTEGER) AS line_no, line FROM top UNION ALL SELECT CAST(row_number() OVER (ORDER BY a, b NULLS FIRST) + 5 AS INTEGER), line FROM listed"),
    "gathered_first_level": _with(GRID, _mine("m", "r2", HOT, 1), body="""SELECT count(*) AS n_regions, CAST(coalesce(sum(n), 0) AS BIGINT) AS integers, CAST(coalesce(4 * sum(n), 0) AS BIGINT) AS n_bytes FROM (
SELECT count(DISTINCT edge_id) + count(*) AS n FROM m_own WHERE region_id IN (SELECT region_id FROM m) GROUP BY region_id)"""),
    "gathered_sketch_level": _with(GRID, SKETCH, _cohen("r2"), f"""ready AS (SELECT DISTINCT region_id FROM sketch JOIN r2 USING (edge_id) JOIN cohen USING (region_id) WHERE CAST(n_raw AS DOUBLE) / estimate >= {HOT})""",
                                   body="""SELECT count(*) AS n_regions, CAST(coalesce(sum(n), 0) AS BIGINT) AS integers, CAST(coalesce(4 * sum(n), 0) AS BIGINT) AS n_bytes FROM (
SELECT sum(2 + len(sig)) AS n FROM sketch JOIN r2 USING (edge_id) WHERE region_id IN (SELECT region_id FROM ready) GROUP BY region_id)"""),
    "target_sweep": _with(GRID, TWO, _targets(), body=f"""SELECT threshold, -1::DOUBLE AS target, -1 AS k, region_id, level, count(*) AS n_paths FROM m, given WHERE ratio >= threshold GROUP BY ALL
UNION ALL SELECT threshold, target, k, 10, 1, count(*) FROM warm GROUP BY ALL UNION ALL SELECT threshold, target, k, 10, 2, count(*) FROM two WHERE ratio >= threshold GROUP BY ALL"""),
    "street_edges": _with(STREETS, body="SELECT * FROM streets"),
    "street_connections": _with(STREETS, body="SELECT * FROM street_conn"),
    "street_weights": _with(STREETS, """b AS (SELECT min(least(x1, x2)) AS ax, max(greatest(x1, x2)) AS bx, min(least(y1, y2)) AS ay, max(greatest(y1, y2)) AS yy FROM streets),
far AS (SELECT edge_id, greatest(abs((x1 + x2) / 2 - (ax + bx) / 2) / (bx - ax), abs((y1 + y2) / 2 - (ay + yy) / 2) / (yy - ay)) AS f FROM streets, b)""",
                            body="SELECT edge_id, CASE WHEN f <= 0.2 THEN 3 WHEN f <= 0.4 THEN 2 WHEN f <= 0.6 THEN 1 ELSE 0 END AS weight FROM far"),
    "street_regions": _with(STREETS, body="SELECT * FROM sr"),
    "street_borders": _with(STREETS, body="""SELECT a.region_id AS region_a, b.region_id AS region_b, c.edge_id, c.succ_id FROM street_conn c JOIN sr a ON a.edge_id = c.edge_id
JOIN sr b ON b.edge_id = c.succ_id WHERE a.region_id <> b.region_id"""),
    "street_hot_edges": _with(STREETS, STREET_PATHS, body="SELECT region_id, path[1] AS edge_id, support, CAST(n AS BIGINT) AS n_objects, ratio FROM m JOIN m_tot USING (region_id) WHERE level = 1"),
    "street_pairs": _with(STREETS, STREET_PATHS, body=f"SELECT region_id, level, {_S('path')} AS path, support, ratio FROM m"),
    "pair_codes": _with(GRID, TWO, body=f"SELECT {_S('path')} AS path, {_PAIRCODE} AS code FROM m WHERE level = 2"),
    "pair_report": _with(GRID, TWO, f"""two AS (SELECT threshold, {_BR} AS pair, {_PAIRCODE} AS code FROM m, (SELECT unnest([0.25::DOUBLE, 0.28::DOUBLE]) AS threshold) WHERE level = 2 AND ratio >= threshold),
codes AS (SELECT threshold, '[' || string_agg(code, ',' ORDER BY pair) || ']' AS codes FROM two GROUP BY threshold)""",
                         body="""SELECT t.threshold, -1 AS k, head, coalesce(codes, '') AS codes FROM (SELECT unnest([0.25::DOUBLE, 0.28::DOUBLE, 0.99::DOUBLE]) AS threshold, unnest(['last', 'only', 'none']) AS head) t LEFT JOIN codes USING (threshold)"""),
    "threshold_sweep": _with(GRID, _mine("m", "r1", min(SWEEP), 3), body=f"""SELECT threshold, region_id, level, count(*) AS n_paths FROM m, (SELECT unnest({SWEEP}::DOUBLE[]) AS threshold)
WHERE ratio >= threshold GROUP BY ALL"""),
    "live_edge_counts": _with(GRID, body="SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, edge_id, count(DISTINCT obj_id) AS n_objects FROM passages GROUP BY 1, 2"),
}
