"""Building blocks of the DuckDB SQL: common table expressions from the same scalar definitions."""

from __future__ import annotations

from gridscribe.functions import text as T

COLUMNS = {
    "nation": "n_nationkey n_name n_regionkey", "supplier": "s_suppkey s_name s_nationkey s_acctbal", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "event_id ts user_id event_type value props",
}
COLUMNS = {k: v.split() for k, v in COLUMNS.items()}


def raw(*names: str) -> str:
    """CTEs up to raw(table_id, row, col, text): every cell as a string."""
    parts, based = [], []
    for n in names:
        order = ", ".join(f"{c} NULLS FIRST" for c in COLUMNS[n])
        based.append(f"base_{n} AS (SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS row, * FROM {n})")
        parts += [f"SELECT '{n}' AS table_id, row, {i} AS col, {T.sql_strip(f'CAST({c} AS VARCHAR)')} AS text FROM base_{n}" for i, c in enumerate(COLUMNS[n])]
    return "WITH RECURSIVE " + ", ".join(based) + ", raw AS (" + " UNION ALL ".join(parts) + ")"


def cells(*names: str) -> str:
    """CTEs up to cells(table_id, row, col, key, text, size): the canonical cells."""
    return raw(*names) + f""", keyed AS (SELECT *, lower(text) AS key FROM raw),
words AS (SELECT table_id, col, key, arg_min(text, row) AS f FROM keyed GROUP BY ALL),
sized AS (SELECT table_id, col, key, {T.sql_truncated('f', T.CELL_MAX)} AS text, least({T.sql_size('f')}, {T.CELL_MAX}) AS size FROM words),
cells AS (SELECT k.table_id, k.row, k.col, k.key, s.text, s.size FROM keyed k JOIN sized s USING (table_id, col, key))"""


def heads(*names: str) -> str:
    """A VALUES list: table_id, col, name."""
    return ", ".join(f"('{n}', {i}, '{c.split('_', 1)[-1]}')" for n in names for i, c in enumerate(COLUMNS[n]))


def size(text: str) -> int:
    import re

    return len(re.findall(r"\w+|[^\s\w]", text.replace("_", " _ ")))


def blocks(*names: str, budget: int = 50) -> list[tuple[str, int, list[int], str, int]]:
    """Header blocks of the fixture's fixed headers."""
    out = []
    for n in names:
        used, own = 0, [[]]
        for i, c in enumerate(x.split("_", 1)[-1] for x in COLUMNS[n]):
            s = size(c) + 1
            if used and used + s > budget:
                own.append([])
                used = 0
            own[-1].append((i, c, s))
            used += s
        for b, cols in enumerate(own):
            text = "".join(("" if j == 0 and b else " ") + c + " ; " for j, (_, c, _) in enumerate(cols)).rstrip()[:-1] + "[SEP]"
            out.append((n, b, [i for i, _, _ in cols], text, sum(s for _, _, s in cols)))
    return out


def chain(name: str, sep: int = 2) -> str:
    """CTEs up to win(window_id, row): next-fit windows, by pointers from each row to the first row of the next window."""
    (_, _, cols, header, fixed), = blocks(name)
    room = T.WINDOW - fixed
    joint, last = " ; " * sep, (" ; " * sep).rstrip()[:-1] + " [SEP] "
    return cells(name) + f""", rendered AS (SELECT row, '{name} [SEP] ' || string_agg(text, '{joint}' ORDER BY col) || '{last}' AS text, {size(name)} + 1 + CAST(sum(size + {sep}) AS BIGINT) AS sz FROM cells GROUP BY row),
summed AS (SELECT *, sum(sz) OVER (ORDER BY row) - sz AS s FROM rendered),
jump AS MATERIALIZED (SELECT a.row, 1 + coalesce(max(b.row), a.row) AS nrow FROM summed a LEFT JOIN summed b ON b.row > a.row AND b.row < a.row + 500 AND b.s + b.sz - a.s <= {room} GROUP BY a.row),
hops AS (SELECT 0 AS window_id, 0 AS row UNION ALL SELECT window_id + 1, CAST(j.nrow AS INTEGER) FROM hops h JOIN jump j USING (row) WHERE j.nrow <= (SELECT max(row) FROM summed)),
win AS (SELECT r.row, max(h.window_id) AS window_id FROM rendered r ASOF JOIN hops h ON r.row >= h.row GROUP BY r.row)"""


BINS = f""", sizes AS (SELECT table_id, count(DISTINCT row) AS n_rows FROM cells GROUP BY table_id),
bins AS (SELECT c.table_id, col, {T.sql_slot('key', 'n_rows')} AS slot, row FROM cells c JOIN sizes USING (table_id) WHERE key <> '')"""
GAINS = """, met AS (SELECT b.table_id, b.col, b.slot, c.key, count(*) AS n, max(c.size) AS size FROM bins b JOIN cells c USING (table_id, row) GROUP BY ALL),
gains AS (SELECT table_id, col, slot, CAST(sum((n - 1) * size) AS BIGINT) AS gain FROM met GROUP BY ALL)"""
ORDER = ", ranked AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY gain DESC, col, slot) AS bin_rank FROM gains)"
WEIGHTS = """, groups AS (SELECT table_id, col, key, count(*) AS n, any_value(size) AS size FROM cells GROUP BY ALL),
weights AS (SELECT table_id, col, CAST(sum(greatest(0, n * size - (n + size + 3))) AS BIGINT) AS weight FROM groups GROUP BY ALL)"""
TYPED = f""", typed AS (SELECT *, {T.sql_type('text')} AS type FROM raw), hit AS (
  SELECT table_id, col, type, row, row_number() OVER (PARTITION BY table_id, col, type ORDER BY row) AS k FROM typed WHERE type IS NOT NULL),
types AS (SELECT c.table_id, c.col, h.type FROM (SELECT DISTINCT table_id, col FROM raw) c LEFT JOIN (
  SELECT table_id, col, arg_min(type, row) AS type FROM hit WHERE k = 3 OR (k = 1 AND type = 'POLYGON') GROUP BY ALL) h USING (table_id, col))"""
SAMPLE = """, classed AS (SELECT table_id, row, col, key FROM cells), sampled AS (
  SELECT table_id, row FROM (SELECT DISTINCT table_id, row FROM cells) QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY md5(table_id || '|' || row), row) <= 333),
own AS (SELECT c.* FROM classed c JOIN sampled USING (table_id, row)),
pairs AS (SELECT x.table_id, x.row AS a, y.row AS b, string_agg(x.col::VARCHAR, ',' ORDER BY x.col) AS cols, count(*) AS n_cols
  FROM own x JOIN own y ON x.table_id = y.table_id AND x.col = y.col AND x.key = y.key AND x.row < y.row GROUP BY ALL)"""
VECTORS = """WITH v AS (SELECT vec_id AS p_id, embedding::DOUBLE[] AS emb, label::VARCHAR AS table_id FROM embeddings),
scored AS (SELECT q.p_id AS qid, q.table_id AS gold, p.p_id, p.table_id, round(list_inner_product(q.emb, p.emb), 6) AS score FROM v q, v p WHERE q.p_id % 100 = 0),
run AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, p_id) AS rank FROM scored)"""
