"""DuckDB SQL of the greedy strategies: windows in closed form, by pointers from every possible first row of a window.

What a row adds to a window that begins at row a depends only on how often its keys and columns came since a. So for each a
the sizes of the next rows are summed, the first row that does not fit is where the next window begins, and a recursive
walk over these pointers names the windows. AHEAD is more rows than any window of the fixtures holds.
"""

from __future__ import annotations

from gridscribe.functions import text as T
from gridscribe.plans import oracle_parts as B

AHEAD = 75
MOST_PICKS = 31


def layout(*names: str) -> str:
    """lay(table_id, blk, header, hsize, title, tsize): the only header block of each fixture."""
    rows = ", ".join(f"('{n}', 0, '{text}', {fixed}, '{n}', {B.size(n)})" for n in names for _, _, _, text, fixed in B.blocks(n))
    return f", lay AS (SELECT * FROM (VALUES {rows}) AS x(table_id, blk, header, hsize, title, tsize))"


def compress_units(*names: str) -> str:
    """CTEs up to units(table_id, blk, ord, row, col, key, text, size, name, nsize) in the order of the hash bins, and lay."""
    return B.cells(*names) + B.BINS + B.GAINS + B.ORDER + f""", best AS (SELECT b.table_id, b.row, min(bin_rank) AS r FROM bins b JOIN ranked USING (table_id, col, slot) GROUP BY ALL),
ord AS (SELECT a.table_id, a.row, row_number() OVER (PARTITION BY a.table_id ORDER BY r NULLS LAST, a.row) - 1 AS ord FROM (SELECT DISTINCT table_id, row FROM raw) a LEFT JOIN best USING (table_id, row)),
h AS (SELECT table_id, col, name, {T.sql_size('name')} AS nsize FROM (VALUES {B.heads(*names)}) AS x(table_id, col, name)),
units AS MATERIALIZED (SELECT table_id, 0 AS blk, o.ord, c.row, c.col, c.key, c.text, c.size, h.name, h.nsize FROM cells c JOIN ord o USING (table_id, row) JOIN h USING (table_id, col))""" + layout(*names)


def _cost(x: str, y: str) -> str:
    return f"(least({x} * ({y}), ({y}) + {x} + 3) - CASE WHEN {y} = 1 THEN 0 ELSE least({x} * ({y} - 1), {y} - 1 + {x} + 3) END)"


def windows(code_cells: bool = True, code_headers: bool = False, show_header: bool = True, by_plain_size: bool = False) -> str:
    """CTEs up to win(table_id, blk, window_id, ord, add): add is what the row adds to its window."""
    per_cell = _cost("size", "y") + " + 1" if code_cells and not by_plain_size else "size + 1"
    per_head = " + " + _cost("nsize", "(ord - a + 1)") + " + 1" if code_headers else ""
    header = "l.hsize" if show_header else "0"
    return f""", starts AS (SELECT DISTINCT table_id, blk, ord AS a FROM units),
near AS (SELECT u.table_id, u.blk, s.a, u.ord, u.size, u.nsize, row_number() OVER (PARTITION BY u.table_id, u.blk, s.a, u.key ORDER BY u.ord, u.col) AS y FROM starts s JOIN units u ON u.table_id = s.table_id AND u.blk = s.blk AND u.ord >= s.a AND u.ord < s.a + {AHEAD}),
adds AS (SELECT table_id, blk, a, ord, sum({per_cell}{per_head}) AS add FROM near GROUP BY ALL),
sums AS (SELECT n.table_id, n.blk, n.a, n.ord, n.add + l.tsize + 1 AS add, {header} + sum(n.add + l.tsize + 1) OVER (PARTITION BY n.table_id, n.blk, n.a ORDER BY n.ord) AS used FROM adds n JOIN lay l ON l.table_id = n.table_id AND l.blk = n.blk),
jump AS MATERIALIZED (SELECT table_id, blk, a, min(CASE WHEN used > {T.WINDOW} AND ord > a THEN ord END) AS next FROM sums GROUP BY ALL),
hops AS (SELECT table_id, blk, min(a) AS a, 0 AS window_id FROM starts GROUP BY ALL UNION ALL SELECT h.table_id, h.blk, j.next, h.window_id + 1 FROM hops h JOIN jump j ON j.table_id = h.table_id AND j.blk = h.blk AND j.a = h.a WHERE j.next IS NOT NULL),
win AS (SELECT s.table_id, s.blk, h.window_id, s.ord, s.add FROM hops h JOIN jump j USING (table_id, blk, a) JOIN sums s ON s.table_id = h.table_id AND s.blk = h.blk AND s.a = h.a AND (j.next IS NULL OR s.ord < j.next))"""


def codes(code_cells: bool = True, code_headers: bool = False) -> str:
    """CTEs held (cells in their windows), codes(table_id, blk, window_id, key, code, refer, n), and headcodes by column."""
    pays = "size * y > size + y + 3" if code_cells else "false"
    heads = "nsize * n_rows > nsize + n_rows + 3" if code_headers else "false"
    return f""", held AS (SELECT u.*, w.window_id, row_number() OVER (PARTITION BY u.table_id, u.blk, w.window_id, u.key ORDER BY u.ord, u.col) AS y FROM units u JOIN win w USING (table_id, blk, ord)),
paid AS (SELECT *, row_number() OVER (PARTITION BY table_id, blk, window_id, key ORDER BY ord, col) AS nth FROM held WHERE {pays}),
codes AS (SELECT table_id, blk, window_id, key, text AS refer, row_number() OVER (PARTITION BY table_id, blk, window_id ORDER BY ord, col) AS n FROM paid WHERE nth = 1),
headcodes AS (SELECT table_id, blk, window_id, col, name AS refer FROM (SELECT table_id, blk, window_id, col, name, nsize, count(*) AS n_rows FROM held GROUP BY ALL) WHERE {heads})"""


def passages(code_headers: bool = False, show_header: bool = True, joint: str = " ; ") -> str:
    """CTE texts(table_id, block_id, window_id, passage, plain, size, rows): both as coded, and as it is."""
    head = "coalesce('[C' || hc.col || ']', u.name) || ' : ' || " if code_headers else ""
    top = "l.header" if show_header else "''"
    fixed = "any_value(l.hsize)" if show_header else "0"
    return f""", cells_out AS (SELECT u.table_id, u.blk, u.window_id, u.ord, u.row, u.col, {head}coalesce('[E' || c.n || ']', u.text) AS coded, u.text AS plain, CASE WHEN u.col = max(u.col) OVER (PARTITION BY u.table_id, u.blk) THEN '  [SEP] ' ELSE '{joint}' END AS joint
  FROM held u LEFT JOIN codes c USING (table_id, blk, window_id, key) LEFT JOIN headcodes hc ON hc.table_id = u.table_id AND hc.blk = u.blk AND hc.window_id = u.window_id AND hc.col = u.col),
lines AS (SELECT table_id, blk, window_id, ord, row, string_agg(coded || joint, '' ORDER BY col) AS coded, string_agg(plain || joint, '' ORDER BY col) AS plain FROM cells_out GROUP BY ALL),
refers AS (SELECT table_id, blk, window_id, string_agg(t, '' ORDER BY k, n) AS refers FROM (SELECT table_id, blk, window_id, 1 AS k, n, '[E' || n || '] is ' || refer || ' [SEP] ' AS t FROM codes UNION ALL SELECT table_id, blk, window_id, 0, col, '[C' || col || '] is ' || refer || ' [SEP] ' FROM headcodes) GROUP BY ALL),
texts AS (SELECT i.table_id, CAST(i.blk AS BIGINT) AS block_id, CAST(i.window_id AS BIGINT) AS window_id, any_value({top}) || coalesce(any_value(r.refers), '') || string_agg(l.title || ' [SEP] ' || i.coded, '' ORDER BY i.ord) AS passage,
  any_value({top}) || string_agg(l.title || ' [SEP] ' || i.plain, '' ORDER BY i.ord) AS plain, CAST({fixed} + sum(w.add) AS BIGINT) AS size, string_agg(i.row::VARCHAR, ',' ORDER BY i.ord) AS rows
  FROM lines i JOIN win w ON w.table_id = i.table_id AND w.blk = i.blk AND w.ord = i.ord JOIN lay l ON l.table_id = i.table_id AND l.blk = i.blk LEFT JOIN refers r ON r.table_id = i.table_id AND r.blk = i.blk AND r.window_id = i.window_id GROUP BY i.table_id, i.blk, i.window_id)"""


_PLAIN = " SELECT table_id, block_id, window_id, passage, size, rows FROM texts"
_NAMES = ("nation", "supplier", "customer", "part", "orders")


def ratios() -> str:
    """CTE ratios(table_id, schema_count, compress_count, ratio); it has to stand alone, for the plain strategy walks tables one by one."""
    plain = " UNION ALL ".join(f"SELECT * FROM ({B.chain(n)} SELECT '{n}' AS table_id, count(DISTINCT window_id) AS schema_count FROM win)" for n in _NAMES)
    coded = compress_units(*_NAMES) + windows() + " SELECT table_id, count(DISTINCT window_id) AS compress_count FROM win GROUP BY table_id"
    return f"WITH plain AS ({plain}), coded AS ({coded}), ratios AS (SELECT table_id, schema_count, compress_count, round(schema_count / compress_count, 2) AS ratio FROM plain JOIN coded USING (table_id))"


def block_cells(name: str) -> str:
    """CTE bcells(seq, row, text, size): a table's cells one after another, as the block strategy renders them."""
    last = len(B.COLUMNS[name]) - 1
    return B.cells(name) + f""", h AS (SELECT * FROM (VALUES {B.heads(name)}) AS x(table_id, col, name)),
bcells AS (SELECT row * {last + 1} + col AS seq, row, (CASE WHEN col = 0 THEN '{name} [SEP]' ELSE '' END) || name || ' : ' || text || ' ' || (CASE WHEN col = {last} THEN '[SEP]' ELSE ';' END) || ' ' AS text, CASE WHEN col = 0 THEN {B.size(name) + 1} ELSE 0 END + {T.sql_size('name')} + 1 + size + 1 AS size FROM cells JOIN h USING (table_id, col))"""


def block_passages(name: str) -> str:
    return block_cells(name) + f""", bsums AS (SELECT *, sum(size) OVER (ORDER BY seq) - size AS s FROM bcells),
jump AS MATERIALIZED (SELECT a.seq AS a, min(b.seq) AS next FROM bsums a LEFT JOIN bsums b ON b.seq > a.seq AND b.seq < a.seq + 400 AND b.s + b.size - a.s > {T.WINDOW} GROUP BY a.seq),
hops AS (SELECT 0::BIGINT AS a, 0 AS window_id UNION ALL SELECT j.next::BIGINT, h.window_id + 1 FROM hops h JOIN jump j USING (a) WHERE j.next IS NOT NULL),
held AS (SELECT b.*, h.window_id FROM hops h JOIN jump j USING (a) JOIN bcells b ON b.seq >= h.a AND (j.next IS NULL OR b.seq < j.next))
SELECT '{name}' AS table_id, CAST(0 AS BIGINT) AS block_id, CAST(window_id AS BIGINT) AS window_id, string_agg(text, '' ORDER BY seq) AS passage, CAST(sum(size) AS BIGINT) AS size, string_agg(row::VARCHAR, ',' ORDER BY seq) AS rows FROM held GROUP BY window_id"""


def first_fit_bins(capacity: int, *names: str) -> str:
    """Items one after another; the state is the room left in each bin."""
    return f"""WITH RECURSIVE items AS (SELECT table_id, col AS ord, CAST({T.sql_size('name')} AS INTEGER) AS size FROM (VALUES {B.heads(*names)}) AS x(table_id, col, name)),
fit AS (SELECT DISTINCT table_id, -1 AS ord, 0 AS size, 0 AS bin, CAST([] AS INTEGER[]) AS rooms FROM items UNION ALL
  SELECT table_id, ord, size, CASE WHEN spot > 0 THEN spot - 1 ELSE len(rooms) END, CASE WHEN spot > 0 THEN list_concat(list_concat(rooms[1:spot - 1], [rooms[spot] - size]), rooms[spot + 1:]) ELSE list_append(rooms, greatest({capacity}, size) - size) END
  FROM (SELECT i.table_id, i.ord, i.size, f.rooms, CAST(coalesce(list_position(list_transform(f.rooms, lambda r: r >= i.size), true), 0) AS INTEGER) AS spot FROM fit f JOIN items i ON i.table_id = f.table_id AND i.ord = f.ord + 1))
SELECT table_id, ord, size, bin FROM fit WHERE ord >= 0"""


def agree_index(name: str) -> str:
    """CTEs up to placed(row, pick, ord): picks and rows settled one after another, each step one CTE."""
    out = B.cells(name) + B.SAMPLE + f""", setrows AS (SELECT cols, n_cols, unnest([a, b]) AS r FROM pairs),
left0 AS MATERIALIZED (SELECT [x::INTEGER FOR x IN string_split(cols, ',')] AS cols, list(DISTINCT r) AS rows FROM setrows GROUP BY ALL),
classed2 AS (SELECT row, col, dense_rank() OVER (PARTITION BY col ORDER BY f) - 1 AS class_id FROM (SELECT row, col, min(row) OVER (PARTITION BY col, key) AS f FROM cells)),
rows0 AS MATERIALIZED (SELECT row, list(class_id ORDER BY col) AS classes FROM classed2 GROUP BY row)"""
    for i in range(MOST_PICKS):
        out += f""", pick{i} AS MATERIALIZED (SELECT * FROM left{i} WHERE len(rows) > 0 ORDER BY -len(cols) * len(rows), cols LIMIT 1),
left{i + 1} AS MATERIALIZED (SELECT l.cols, list_filter(l.rows, lambda x: NOT list_contains(p.rows, x)) AS rows FROM left{i} l, pick{i} p WHERE l.cols <> p.cols),
keyed{i} AS MATERIALIZED (SELECT r.*, count(*) OVER (PARTITION BY g) AS n FROM (SELECT r.row, r.classes, list_transform(p.cols, lambda c: r.classes[c + 1]) AS g FROM rows{i} r, pick{i} p) r),
rows{i + 1} AS MATERIALIZED (SELECT row, classes FROM keyed{i} WHERE n = 1 UNION ALL SELECT row, classes FROM rows{i} WHERE NOT EXISTS (SELECT 1 FROM pick{i}))"""
    picked = " UNION ALL ".join(f"SELECT {i} AS pick, cols FROM pick{i}" for i in range(MOST_PICKS))
    took = " UNION ALL ".join(f"SELECT row, {i} AS pick, n, g FROM keyed{i} WHERE n > 1" for i in range(MOST_PICKS))
    return out + f""", picks AS ({picked}), took AS ({took} UNION ALL SELECT row, (SELECT count(*) FROM picks)::INTEGER, NULL, NULL FROM rows{MOST_PICKS}),
placed AS MATERIALIZED (SELECT row, pick, CAST(row_number() OVER (ORDER BY pick, n DESC NULLS LAST, g NULLS FIRST, row) - 1 AS INTEGER) AS ord FROM took)"""


def agree_units(name: str) -> str:
    """CTEs units and lay of a table whose headers fit one block: the set's columns are one unit at its first column."""
    return agree_index(name) + f""", h AS (SELECT col, name, {T.sql_size('name')} AS nsize FROM (VALUES {B.heads(name)}) AS x(table_id, col, name)),
homes AS (SELECT p.pick, h.col, CASE WHEN list_contains(p.cols, h.col) THEN list_min(p.cols) ELSE h.col END AS home, h.name, h.nsize FROM (SELECT * FROM picks UNION ALL SELECT (SELECT count(*) FROM picks)::INTEGER, CAST([] AS INTEGER[])) p, h),
units AS MATERIALIZED (SELECT '{name}' AS table_id, o.pick AS blk, o.ord, c.row, m.home AS col, string_agg(c.key, chr(31) ORDER BY c.col) AS key, string_agg(c.text, ' & ' ORDER BY c.col) AS text, sum(c.size) + count(*) - 1 AS size, '' AS name, 0 AS nsize
  FROM cells c JOIN placed o USING (row) JOIN homes m ON m.pick = o.pick AND m.col = c.col GROUP BY ALL),
unitnames AS (SELECT pick, home, string_agg(name, ' & ' ORDER BY col) AS name, sum(nsize + 1) AS s FROM homes GROUP BY ALL),
lay AS (SELECT '{name}' AS table_id, pick AS blk, string_agg(name, ' | ' ORDER BY home) || ' [SEP]' AS header, sum(s) AS hsize, '{name}' AS title, {B.size(name)} AS tsize FROM unitnames GROUP BY ALL)"""


def _entries(kind: str) -> str:
    return f"SELECT table_id, CAST(blk AS INTEGER) AS block_id, CAST(window_id AS INTEGER) AS window_id, {kind} FROM codes"


ORACLE = {
    "compress_passages": compress_units("part", "orders") + windows() + codes() + passages() + _PLAIN,
    "schema_cell_coding_passages": compress_units("part") + windows(code_headers=True) + codes(code_headers=True) + passages(code_headers=True) + _PLAIN,
    "schema_coding_passages": compress_units("part") + windows(code_cells=False, code_headers=True, show_header=False) + codes(code_cells=False, code_headers=True) + passages(code_headers=True, show_header=False) + _PLAIN,
    "cpr_scm_pairs": compress_units("part") + windows(by_plain_size=True) + codes() + passages() + " SELECT table_id, CAST(block_id AS INTEGER) AS block_id, CAST(window_id AS INTEGER) AS window_id, passage, plain AS scm_passage, CAST(size AS INTEGER) AS size FROM texts",
    "code_entries": compress_units("part") + windows() + codes() + " " + _entries("'[E' || n || ']' AS code, refer"),
    "special_tokens": compress_units("part") + windows() + codes() + " SELECT '[E' || n || ']' AS token, count(*) AS n FROM codes GROUP BY codes.n",
    "compression_ratio": ratios() + " SELECT * FROM ratios",
    "ratio_sorted": ratios() + " SELECT table_id, ratio, row_number() OVER (ORDER BY ratio DESC, table_id) AS place FROM ratios",
    "merged_passages": compress_units("part") + windows() + " SELECT row_number() OVER (ORDER BY w.window_id) - 1 AS p_id, w.table_id, string_agg(u.row::VARCHAR, ',' ORDER BY u.row) AS base_p_ids FROM win w JOIN (SELECT DISTINCT table_id, ord, row FROM units) u USING (table_id, ord) GROUP BY w.table_id, w.window_id",
    "ratio_histogram": ratios() + " SELECT CASE WHEN ratio - floor(ratio) >= 0.5 THEN '[' || floor(ratio)::INT || '.5-' || (floor(ratio)::INT + 1) || ')' ELSE '[' || floor(ratio)::INT || '-' || floor(ratio)::INT || '.5)' END AS bucket, count(*) AS table_count FROM ratios GROUP BY ALL",
    "block_passages": block_passages("supplier"),
    "first_fit_bins": first_fit_bins(3, "orders", "lineitem", "part"),
    "agree_index": agree_index("customer") + " SELECT 'customer' AS table_id, row, pick, ord FROM placed",
    "agree_passages": agree_units("customer") + windows() + codes() + passages(joint=" | ") + _PLAIN,
}
