"""The scalar definitions and strategies as SQL: functions and table views of one session.

Functions are SQL functions (no Python runs for them), named by PREFIX; serialize_sql makes a strategy's passages a view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridscribe.functions.text import TOKEN

PREFIX = "gs_"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "''") + "'"


STRIP = "regexp_replace(coalesce(t, ''), r'^\\s+|\\s+$', '')"
FUNCTIONS = {
    "strip": ("t STRING", "STRING", STRIP),
    "cell_key": ("t STRING", "STRING", f"lower({STRIP})"),
    "tokens": ("t STRING", "ARRAY<STRING>", f"regexp_extract_all(lower(t), {_quoted(TOKEN)}, 0)"),
    "token_size": ("t STRING", "INT", f"size(regexp_extract_all(lower(t), {_quoted(TOKEN)}, 0))"),
    "code_cost": ("x BIGINT, y BIGINT", "BIGINT", "least(y * x, y + x + 3)"),
    "hash_slot": ("k STRING, n BIGINT", "BIGINT", "aggregate(sequence(0, 7), CAST(0 AS BIGINT), (a, i) -> (a * 4294967296 + CAST(conv(substring(sha2(k, 256), i * 8 + 1, 8), 16, 10) AS BIGINT)) % n)"),
    "infer_cell_type": (
        "t STRING", "STRING",
        f"""CASE WHEN lower({STRIP}) IN ('true', 'false', 't', 'f') THEN 'BOOL' WHEN {STRIP} RLIKE '^[+-][0-9]|^[0-9]+$' THEN 'INT' WHEN {STRIP} RLIKE r'^-?[0-9]+\\.[0-9]+$' THEN 'FLOAT'
        WHEN regexp_replace({STRIP}, r'^"|"$', '') RLIKE r'(?i)^multipolygon[(), .0-9]*$' THEN 'POLYGON' END""",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; their names."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({takes}) RETURNS {gives} RETURN {body}")
    return [PREFIX + name for name in FUNCTIONS]


def serialize_sql(spark: SparkSession, tables: dict[str, str], strategy: str, view: str) -> DataFrame:
    """A view of a strategy's passages of relations: tables maps a table's name to the SQL query that gives its rows."""
    from gridscribe.plans.strategies import serialize
    from gridscribe.sources.tables import TableSet, from_relation

    out = None
    for name, query in tables.items():
        one = from_relation(spark.sql(query), name)
        out = one if out is None else TableSet(out.rows.unionByName(one.rows), out.columns.unionByName(one.columns))
    passages = serialize(out, strategy)
    passages.createOrReplaceTempView(view)
    return passages
