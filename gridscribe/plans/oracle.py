"""DuckDB SQL for the queries, built from the same scalar definitions."""

from __future__ import annotations

from gridscribe.functions import text as T
from gridscribe.plans.coded_oracle import ORACLE as CODED
from gridscribe.plans.oracle_parts import BINS, COLUMNS, GAINS, ORDER, SAMPLE, TYPED, VECTORS, WEIGHTS, blocks, cells, chain, heads, raw  # noqa: F401


def _top(k: int, n: int, name: str) -> str:
    return f""", first_{name} AS (SELECT *, min(rank) OVER (PARTITION BY qid, table_id) AS fr FROM run WHERE rank <= {k}),
pos_{name} AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY fr) AS tbl_pos FROM first_{name}),
cut_{name} AS (SELECT *, min(CASE WHEN tbl_pos = {n} + 1 THEN rank END) OVER (PARTITION BY qid) AS cut FROM pos_{name}),
top_{name} AS (SELECT * FROM cut_{name} WHERE cut IS NULL OR rank < cut),
hit_{name} AS (SELECT qid, max((tbl_pos <= {n} AND table_id = gold)::INT) AS hit FROM top_{name} GROUP BY qid)"""


_BATCH = """WITH v AS (SELECT vec_id AS p_id, embedding::DOUBLE[] AS emb FROM embeddings),
pairs AS (SELECT q.p_id AS qid, p.p_id, q.emb AS a, p.emb AS b FROM v q JOIN v p ON q.p_id // 500 = p.p_id // 500),
far AS (SELECT qid, p_id, round(0.0 - list_sum([(a[i] - b[i]) * (a[i] - b[i]) FOR i IN range(1, len(a) + 1)]), 6) AS score FROM pairs),
near AS (SELECT qid, p_id, round(list_inner_product(a, b), 6) AS score FROM pairs)"""


def _soft(source: str, t: float) -> str:
    return f"SELECT qid, p_id, score, score / {t} - max(score / {t}) OVER w - ln(sum(exp(score / {t} - m)) OVER w) AS lp FROM (SELECT *, max(score / {t}) OVER (PARTITION BY qid) AS m FROM {source}) WINDOW w AS (PARTITION BY qid)"


def _draw(salt: str) -> str:
    return f"('0x' || substr(md5(table_id || '|' || row || '|{salt}'), 1, 7))::BIGINT"


_OF = f"""(VALUES {heads("orders", "lineitem")}) AS x(table_id, col, name)"""
_PLAIN = "regexp_replace(regexp_replace(CAST({0} AS DECIMAL(31, 4))::VARCHAR, '0+$', ''), '[.]$', '')"
_NUMBER = "'^[+-]?[0-9]+([.][0-9]+)?$'"
_TEMPLATES = raw("orders", "lineitem") + TYPED + f""", h AS (SELECT table_id, list(name ORDER BY col) AS names FROM {_OF} GROUP BY table_id),
kinds AS (SELECT table_id, list(coalesce(type, '') ORDER BY col) AS kinds FROM types GROUP BY table_id),
wide AS MATERIALIZED (SELECT table_id, row, list(text ORDER BY col) AS cells, count(*) AS n_cols FROM raw GROUP BY ALL),
a AS (SELECT *, CAST({_draw("sel")} % n_cols AS INTEGER) AS sel_col, CASE WHEN n_cols > 2 THEN 1 + {_draw("conditions")} % 2 ELSE 1 END AS n_conds, {_draw("where")} % (n_cols - 1) + 1 AS first, {_draw("where2")} % greatest(n_cols - 2, 1) + 1 AS second0 FROM wide),
b AS (SELECT *, [CAST((sel_col + first) % n_cols AS INTEGER), CAST((sel_col + CASE WHEN second0 >= first THEN second0 + 1 ELSE second0 END) % n_cols AS INTEGER)][1:n_conds] AS cols FROM a),
chosen AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY table_id ORDER BY md5(table_id || '|' || row), row) AS INTEGER) AS id FROM b WHERE len(list_filter(cols, lambda c: cells[c + 1] = '')) = 0 QUALIFY id <= 10),
each AS (SELECT table_id, row, id, sel_col, unnest(range(0, len(cols))) AS i, unnest(cols) AS col FROM chosen),
valued AS (SELECT e.*, h.names[e.col + 1] AS name, k.kinds[e.col + 1] AS kind, w.cells[e.col + 1] AS text FROM each e JOIN wide w USING (table_id, row) JOIN h USING (table_id) JOIN kinds k USING (table_id)),
ruled AS (SELECT *, kind IN ('INT', 'FLOAT') AND regexp_matches(text, {_NUMBER}) AS number FROM valued),
opped AS (SELECT *, CASE WHEN number THEN text::DECIMAL(30, 4) END AS exact, CAST(({_draw("little").replace("little'", "little' || i")} % 10) / CASE WHEN kind = 'FLOAT' THEN 10.0 ELSE 1.0 END AS DECIMAL(4, 1)) AS little,
  CASE WHEN number THEN ['=', '>', '<', 'between'][{_draw("op").replace("op'", "op' || i")} % 4 + 1] ELSE '=' END AS op FROM ruled),
bounds AS (SELECT *, {_PLAIN.format("exact - little")} AS low, {_PLAIN.format("exact + little")} AS high, {_PLAIN.format("exact")} AS same FROM opped),
conds AS MATERIALIZED (SELECT *, CASE WHEN op IN ('>', 'between') THEN low WHEN op = '<' THEN high WHEN number THEN same ELSE text END AS value, CASE WHEN op = 'between' THEN high END AS value_2,
  name || CASE WHEN op = 'between' THEN ' between ' || low || ' and ' || high ELSE ' ' || op || ' ' || CASE WHEN op = '>' THEN low WHEN op = '<' THEN high WHEN number THEN same ELSE chr(39) || replace(text, chr(39), chr(39) || chr(39)) || chr(39) END END AS sql FROM bounds),
joined AS (SELECT table_id, row, id, sel_col, string_agg(col::VARCHAR, '~' ORDER BY i) AS col, string_agg(op, '~' ORDER BY i) AS op, string_agg(value, '~' ORDER BY i) AS value, string_agg(coalesce(value_2, ''), '~' ORDER BY i) AS value_2, string_agg(sql, ' and ' ORDER BY i) AS conditions, list(col ORDER BY i) AS cols FROM conds GROUP BY ALL),
aggregated AS (SELECT j.*, h.names[sel_col + 1] AS sel_name, CASE WHEN k.kinds[sel_col + 1] IN ('INT', 'FLOAT') THEN ['', 'count', 'max', 'min', 'avg', 'sum'][{_draw("aggregate")} % 6 + 1] ELSE ['', 'count'][{_draw("aggregate")} % 2 + 1] END AS aggregate FROM joined j JOIN h USING (table_id) JOIN kinds k USING (table_id)),
worded AS MATERIALIZED (SELECT table_id, id, row, sel_col, aggregate, col, op, value, value_2, cols, 'select ' || CASE WHEN aggregate <> '' THEN aggregate || '(' || sel_name || ')' ELSE sel_name END || ' where ' || conditions AS sql FROM aggregated)"""


def _one_row(*names: str) -> str:
    """Passages of one row each, for tables whose rows fit a window; window ids count a table's rows."""
    return cells(*names) + f", h AS (SELECT * FROM (VALUES {heads(*names)}) AS x(table_id, col, name)), n AS (SELECT table_id, max(col) AS last FROM h GROUP BY 1) SELECT table_id, CAST(0 AS BIGINT) AS block_id, CAST(row AS BIGINT) AS window_id, table_id || ' [SEP]' || string_agg(name || ' : ' || text || ' ' || (CASE WHEN col = last THEN '[SEP]' ELSE ';' END) || ' ', '' ORDER BY col) AS passage, CAST(2 + sum({T.sql_size('name')} + 2 + size) AS BIGINT) AS size, string_agg(row::VARCHAR, ',') AS rows FROM cells JOIN h USING (table_id, col) JOIN n USING (table_id) GROUP BY table_id, row"


_NAMES = ("nation", "supplier", "customer", "part", "orders")
_JOIN = ("nation", "supplier", "customer", "part", "orders", "lineitem")
_STRIPPED_TEXT = T.sql_strip("text")

_OFFSETS = """WITH r AS (SELECT DISTINCT l_orderkey AS qid, l_linenumber AS n FROM lineitem),
g AS (SELECT qid, n // 3 AS p_id, list(n ORDER BY n) AS bases FROM r GROUP BY ALL)"""

ORACLE = {
    "cell_keys": f"SELECT doc_id, md5({T.sql_key('text')}) AS key_md5 FROM documents",
    "token_sizes": f"SELECT doc_id, {T.sql_size('text')} AS n_tokens FROM documents",
    "truncated_cells": f"SELECT doc_id, {T.sql_truncated('t', T.CELL_MAX)} AS text, least({T.sql_size('t')}, {T.CELL_MAX}) AS size FROM (SELECT doc_id, {_STRIPPED_TEXT} AS t FROM documents)",
    "canonical_cells": cells("part") + " SELECT table_id, row, col, key, text, size FROM cells",
    "cell_type_inference": raw("events") + f" SELECT col, {T.sql_type('text')} AS type, count(*) AS n FROM raw GROUP BY ALL",
    "column_type_inference": raw("events", "orders", "lineitem") + TYPED + " SELECT table_id, col, type FROM types",
    "column_classes": cells("orders", "part") + " SELECT table_id, col, key, row_number() OVER (PARTITION BY table_id, col ORDER BY f) - 1 AS class_id, n FROM (SELECT table_id, col, key, min(row) AS f, count(*) AS n FROM cells GROUP BY ALL)",
    "column_weights": cells("orders", "part") + WEIGHTS + " SELECT * FROM weights",
    "max_weight_column": cells("orders", "part", "customer") + WEIGHTS + " SELECT table_id, arg_max(col, weight * 1000 - col) AS col FROM weights GROUP BY table_id",
    "hash_bins": cells("customer") + BINS + " SELECT table_id, col, slot, row FROM bins",
    "bin_gain": cells("part") + BINS + GAINS + " SELECT table_id, col, slot, gain FROM gains",
    "bin_ranking": cells("part") + BINS + GAINS + ORDER + " SELECT table_id, col, slot, bin_rank FROM ranked",
    "compress_row_order": cells("part") + BINS + GAINS + ORDER + ", best AS (SELECT b.table_id, b.row, min(bin_rank) AS r FROM bins b JOIN ranked USING (table_id, col, slot) GROUP BY ALL) SELECT a.table_id, a.row, row_number() OVER (PARTITION BY a.table_id ORDER BY r NULLS LAST, a.row) - 1 AS ord FROM (SELECT DISTINCT table_id, row FROM raw) a LEFT JOIN best USING (table_id, row)",
    "schema_blocks": "SELECT table_id, block_id, cols, header, CAST(header_size AS BIGINT) AS header_size FROM (VALUES " + ", ".join(f"('{n}', {b}, '{','.join(map(str, c))}', '{t}', {s})" for n, b, c, t, s in blocks("nation", "supplier", "customer", "part", "orders", "lineitem", "events", budget=10)) + ") AS x(table_id, block_id, cols, header, header_size)",
    "block_cells": cells("supplier") + f", h AS (SELECT * FROM (VALUES {heads('supplier')}) AS x(table_id, col, name)) SELECT table_id, row, col, (CASE WHEN col = 0 THEN 'supplier [SEP]' ELSE '' END) || name || ' : ' || text || ' ' || (CASE WHEN col = 3 THEN '[SEP]' ELSE ';' END) || ' ' AS text, CASE WHEN col = 0 THEN 2 ELSE 0 END + {T.sql_size('name')} + 1 + size + 1 AS size FROM cells JOIN h USING (table_id, col)",
    "one_row_passages": _one_row("nation", "supplier"),
    "decompressed_passages": _one_row("part"),
    "schema_windows": chain("lineitem") + " SELECT CAST(window_id AS INTEGER) AS window_id, min(row) AS first_row, max(row) AS last_row, count(*) AS n FROM win GROUP BY window_id",
    "schema_passages": chain("orders") + f" SELECT 'orders' AS table_id, CAST(0 AS BIGINT) AS block_id, CAST(window_id AS BIGINT) AS window_id, '{blocks('orders')[0][3]}' || string_agg(text, '' ORDER BY row) AS passage, CAST({blocks('orders')[0][4]} + sum(sz) AS BIGINT) AS size, string_agg(row::VARCHAR, ',' ORDER BY row) AS rows, CAST(window_id AS BIGINT) AS p_id FROM win JOIN rendered USING (row) GROUP BY window_id",
    "compress_window_cost": chain("orders") + ", keys AS (SELECT window_id, key, count(*) AS y, max(size) AS x FROM cells JOIN win USING (row) GROUP BY ALL) SELECT CAST(window_id AS INTEGER) AS window_id, CAST(sum(least(y * x, y + x + 3)) AS BIGINT) AS coded, CAST(sum(x * y) AS BIGINT) AS plain, CAST(sum(y) AS BIGINT) AS n_cells FROM keys GROUP BY window_id",
    "strategy_stats": " UNION ALL ".join(f"SELECT * FROM ({chain(n)} SELECT '{n}' AS table_id, count(DISTINCT window_id) AS count FROM win)" for n in ("nation", "supplier", "customer", "part", "orders")),
    "agree_pairs": cells("supplier", "customer") + SAMPLE + " SELECT table_id, a, b, cols FROM pairs",
    "agree_sets": cells("supplier", "customer") + SAMPLE + " SELECT table_id, cols, count(DISTINCT r) AS n_rows, CAST(any_value(n_cols) * count(DISTINCT r) AS BIGINT) AS weight FROM (SELECT table_id, cols, n_cols, unnest([a, b]) AS r FROM pairs) GROUP BY table_id, cols",
    "knn_exact": VECTORS + " SELECT qid, p_id, score, rank FROM run WHERE rank <= 5",
    "top_tables": VECTORS + _top(40, 3, "a") + " SELECT qid, p_id, tbl_pos FROM top_a",
    "hit_at_n": VECTORS + _top(40, 3, "a") + " SELECT round(avg(hit) * 100, 6) AS hit_at_n, count(*) AS n_queries FROM hit_a",
    "run_flat": VECTORS + " SELECT qid, rank, table_id, CAST(table_id = gold AS BIGINT) AS correct FROM run WHERE rank <= 10",
    "run_confusion": VECTORS + _top(40, 1, "a") + _top(40, 5, "b") + " SELECT a.hit AS hit_a, b.hit AS hit_b, count(*) AS n FROM hit_a a JOIN hit_b b USING (qid) GROUP BY ALL",
    "joinable_values": cells(*_JOIN) + rf""", h AS (SELECT table_id, col, lower(name) AS col_key FROM (VALUES {heads(*_JOIN)}) AS x(table_id, col, name) WHERE col < 6 AND NOT regexp_matches(name, 'year|date|time|number|score|#')),
shared AS (SELECT col_key, key, string_agg(DISTINCT table_id, ',' ORDER BY table_id) AS table_ids FROM cells JOIN h USING (table_id, col) WHERE key <> '' GROUP BY ALL HAVING count(DISTINCT table_id) > 1)
SELECT col_key, key, table_ids FROM shared QUALIFY row_number() OVER (PARTITION BY col_key ORDER BY key) <= 10""",
    "sql_templates": _TEMPLATES + " SELECT * EXCLUDE (cols) FROM worded",
    "template_results": _TEMPLATES + f""", tested AS (SELECT c.table_id, c.id, w.row, w.cells, coalesce(CASE c.op WHEN '=' THEN t = c.value OR (regexp_matches(t, {_NUMBER}) AND try_cast(t AS DECIMAL(30, 4)) = try_cast(c.value AS DECIMAL(30, 4))) WHEN '>' THEN try_cast(t AS DECIMAL(30, 4)) > try_cast(c.value AS DECIMAL(30, 4))
    WHEN '<' THEN try_cast(t AS DECIMAL(30, 4)) < try_cast(c.value AS DECIMAL(30, 4)) ELSE try_cast(t AS DECIMAL(30, 4)) BETWEEN try_cast(c.value AS DECIMAL(30, 4)) AND try_cast(c.value_2 AS DECIMAL(30, 4)) END, false) AS ok FROM conds c JOIN (SELECT * FROM wide) w USING (table_id), LATERAL (SELECT w.cells[c.col + 1] AS t)),
hits AS (SELECT table_id, id, row, bool_and(ok) AS hit, any_value(cells) AS cells FROM tested GROUP BY table_id, id, row),
found AS (SELECT h.table_id, h.id, w.aggregate, h.hit, CASE WHEN h.hit THEN h.cells[w.sel_col + 1] END AS text FROM hits h JOIN worded w USING (table_id, id)),
summed AS (SELECT table_id, id, aggregate, CAST(sum(hit::BIGINT) AS BIGINT) AS n_rows, min(text) AS least, min(try_cast(text AS DECIMAL(30, 4))) AS lo, max(try_cast(text AS DECIMAL(30, 4))) AS hi, sum(try_cast(text AS DECIMAL(30, 4))) AS total, count(try_cast(text AS DECIMAL(30, 4))) AS n FROM found GROUP BY ALL)
SELECT table_id, id, n_rows, CASE aggregate WHEN 'count' THEN n_rows::VARCHAR WHEN 'min' THEN lo::VARCHAR WHEN 'max' THEN hi::VARCHAR WHEN 'sum' THEN total::VARCHAR WHEN 'avg' THEN CAST(CAST(total AS DOUBLE) / n AS DECIMAL(38, 4))::VARCHAR ELSE least END AS result FROM summed""",
    "paraphrase_columns": _TEMPLATES + " SELECT table_id, id, array_to_string(list_concat([sel_col], cols), ',') AS cols FROM worded",
    "sql_tokens": r"""WITH q AS (SELECT c_custkey, lower('SELECT Count(c_name) WHERE c_mktsegment = ''' || c_mktsegment || ' x'' and c_custkey > ' || c_custkey || CASE WHEN c_nationkey = 3 THEN '''' ELSE '' END) AS s FROM customer)
SELECT c_custkey, CASE WHEN (length(s) - length(replace(s, '''', ''))) % 2 = 0 THEN array_to_string(regexp_extract_all(s, '''[^'']*''|(?:count|sum|max|min|avg)\([^)]*\)|[^\s'']+'), '~') END AS tokens FROM q""",
    "sql_parse": r"SELECT c_custkey, 'count(c_name)' AS sel, 'c_mktsegment = ''' || lower(c_mktsegment) || ' x'' and c_custkey > ' || c_custkey || CASE WHEN c_nationkey = 3 THEN '''' ELSE '' END AS cond FROM customer",
    "cycle_consistency": "SELECT c_custkey, c_nationkey >= 5 AS consistent FROM customer",
    "copy_check": r"""WITH q AS (SELECT p_partkey, p_type, p_name, lower('Which Brand has ' || p_type || ' of ' || CASE WHEN p_size > 25 THEN p_name ELSE 'any name' END) AS t FROM part)
SELECT p_partkey, array_to_string(list_concat(list_filter(['brand', 'retailprice'], lambda x: contains(t, x)), list_filter([p_type, p_name], lambda x: len(regexp_split_to_array(trim(x), '\s+')) >= 2 AND contains(t, lower(x)))), '~') AS copied FROM q""",
    "col_letters": "SELECT p_partkey, " + " || ".join(f"CASE WHEN p_partkey >= {o} THEN chr(((p_partkey - {o}) // {26**i} % 26 + 65)::INT) ELSE '' END" for i in range(6, -1, -1) for o in [sum(26**j for j in range(i + 1))]) + " AS letters FROM part",
    "grid_row_lists": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN '' ELSE l_orderkey || ',' || l_linenumber END AS rows FROM lineitem",
    "label_row_cut": "WITH r AS (SELECT coalesce(source, '') AS table_id, doc_id AS row, CAST(doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS BIGINT) AS is_label FROM documents) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY is_label DESC, row) <= 10",
    "split_by_table": "SELECT doc_id AS table_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 < floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'dev' END AS part FROM documents",
    "hard_negatives": """WITH v AS (SELECT vec_id AS p_id, label::VARCHAR AS table_id FROM embeddings),
placed AS (SELECT *, row_number() OVER (ORDER BY table_id, p_id) - 1 AS place FROM v), spans AS (SELECT table_id, min(place) AS low, count(*) AS own FROM placed GROUP BY 1),
asked AS (SELECT p_id AS qid, low, own, (SELECT count(*) FROM v) - own AS others, least(20, (SELECT count(*) FROM v) - own) AS k FROM v JOIN spans USING (table_id)),
j AS (SELECT *, unnest(range(0, k)) AS j FROM asked WHERE k > 0),
drawn AS (SELECT *, j * others // k + ('0x' || substr(md5(qid || '|' || j), 1, 7))::BIGINT % ((j + 1) * others // k - j * others // k) AS spot FROM j)
SELECT qid, p.p_id, j + 1 AS n FROM drawn d JOIN placed p ON p.place = CASE WHEN spot >= low THEN spot + own ELSE spot END""",
    "split_by_passage": "SELECT vec_id AS p_id, CASE WHEN row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 < floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'dev' END AS part FROM embeddings",
    "query_records": "SELECT substr(sha256(q || chr(31) || p_brand || chr(30) || p_type), 1, 32) AS id, q AS question, p_brand || '~' || p_type AS table_ids, p_partkey::VARCHAR AS answers FROM (SELECT *, 'Which is ' || p_name || '?' AS q FROM part)",
    "offset_pick": _OFFSETS + " SELECT qid, p_id::VARCHAR AS p_id, bases[('0x' || substr(md5(qid || '|' || p_id), 1, 7))::BIGINT % len(bases) + 1] AS base FROM g",
    "base_samples": _OFFSETS + ", f AS (SELECT qid, p_id::VARCHAR AS p_id, unnest(bases) AS base FROM g) SELECT *, row_number() OVER (PARTITION BY qid, p_id ORDER BY md5(qid || '|' || p_id || '|' || base), base) AS n FROM f QUALIFY n <= 2",
    "distill_loss": _BATCH + f", s AS ({_soft('far', 3.0)}), t AS ({_soft('near', 3.0)}), k AS (SELECT qid, sum(exp(t.lp) * (t.lp - s.lp)) AS kl FROM s JOIN t USING (qid, p_id) GROUP BY qid), lp AS ({_soft('far', 1.0)}), a AS (SELECT round(avg(kl) * 9.0, 6) AS kl FROM k), b AS (SELECT round(-avg(lp), 6) AS nll FROM lp WHERE p_id = qid) SELECT kl, nll, round(0.5::DOUBLE * kl + 0.5::DOUBLE * nll, 6) AS loss FROM a, b",
    "numeric_columns": raw("part", "customer", "orders") + TYPED + " SELECT table_id, col, type, coalesce(type IN ('FLOAT', 'POLYGON'), false) AS skip FROM types",
    "wrapped_texts": f"SELECT p_partkey, CASE WHEN regexp_matches(trim(p_name), '[^ ] +[^ ]') THEN chr(39) || p_name || chr(39) ELSE p_name END AS text, {T.sql_size('p_name')} + CASE WHEN regexp_matches(trim(p_name), '[^ ] +[^ ]') THEN 2 ELSE 0 END AS size FROM part",
    "sql_functions": f"SELECT p_partkey, lower(p_name) AS name_key, CAST({T.sql_size('p_type')} AS INTEGER) AS size, array_to_string({T.sql_tokens('p_name')}, '~') AS tokens, {T.sql_slot('p_name', '1009')} AS slot, 'FLOAT' AS price_type, 'INT' AS size_type, CAST(least(3 * p_size, p_size + 6) AS BIGINT) AS cost FROM part",
    "base_offset_map": """WITH r AS (SELECT DISTINCT l_orderkey AS qid, l_linenumber AS n FROM lineitem),
g AS (SELECT qid, n // 3 AS p_id, string_agg(n::VARCHAR, ',' ORDER BY n) AS bases FROM r GROUP BY ALL) SELECT qid, string_agg(p_id || ':' || bases, ';' ORDER BY p_id::VARCHAR) AS offsets FROM g GROUP BY qid""",
    "inbatch_scores": _BATCH + " SELECT qid, p_id, score FROM far",
    "inbatch_nll": _BATCH + f", lp AS ({_soft('far', 1.0)}), top AS (SELECT qid, arg_max(p_id, score) AS best FROM far GROUP BY qid) SELECT round(-avg(lp), 6) AS nll, round(avg((p_id = best)::INT), 6) AS accuracy, count(*) AS n FROM lp JOIN top USING (qid) WHERE p_id = qid",
    "kl_distill": _BATCH + f", s AS ({_soft('far', 3.0)}), t AS ({_soft('near', 3.0)}), k AS (SELECT qid, sum(exp(t.lp) * (t.lp - s.lp)) AS kl FROM s JOIN t USING (qid, p_id) GROUP BY qid) SELECT round(avg(kl) * 9.0, 6) AS kl FROM k",
    "best_epochs": """WITH l AS (SELECT l_orderkey AS run, l_linenumber AS step, min(l_extendedprice) AS loss FROM lineitem GROUP BY ALL),
b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step) AS best FROM l),
s AS (SELECT *, step - max(CASE WHEN loss = best THEN step END) OVER (PARTITION BY run ORDER BY step) AS streak FROM b) SELECT run, step, best, CAST(streak AS BIGINT) AS streak, streak >= 3 AS stopped FROM s""",
    "table_prompts": raw(*_NAMES) + f""", h AS (SELECT table_id, string_agg(name, ' | ' ORDER BY col) AS head FROM (VALUES {heads(*_NAMES)}) AS x(table_id, col, name) GROUP BY 1),
lines AS (SELECT table_id, row, chr(10) || string_agg(text, ' | ' ORDER BY col) AS line FROM raw GROUP BY ALL),
drawn AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY md5(table_id || '|' || row), row) <= 10)
SELECT table_id, 'Table Caption:' || chr(10) || table_id || chr(10) || 'Table Data:' || chr(10) || any_value(head) || string_agg(line, '' ORDER BY row) AS prompt FROM drawn JOIN h USING (table_id) GROUP BY table_id""",
    "answer_lines": "SELECT p_partkey, p_size || '=What is ' || p_name || ' ?' AS plain, '7=' || p_type AS tagged FROM part",
    "question_sheet": _TEMPLATES + """ SELECT table_id, table_id AS title, CAST(row_number() OVER (PARTITION BY table_id ORDER BY id) AS INTEGER) AS q_no, sql AS question, row, row + 2 AS grid_row, sel_col, chr(65 + sel_col) AS grid_col,
  array_to_string(cols, ' , ') AS where_cols, array_to_string(list_transform(cols, lambda c: chr(65 + c)), ' , ') AS grid_where_cols FROM worded""",
    "sample_passages": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100",
    "passage_tables": raw("part") + " SELECT table_id, row, string_agg(text, '~' ORDER BY col) AS cells FROM raw GROUP BY ALL",
    "mean_pool": "SELECT vec_id, i AS at, round((embedding[i + 1]::DOUBLE + embedding[i + 1 + len(embedding) // 2]::DOUBLE) / 2, 6) AS x FROM (SELECT vec_id, embedding, unnest(range(len(embedding) // 2)) AS i FROM embeddings)",
}
ORACLE.update(CODED)
