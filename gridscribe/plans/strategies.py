"""Serialization strategies: a table set in, passages out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscribe.functions import text as T
from gridscribe.functions.text import WINDOW
from gridscribe.operators import agree, cells as O, packing as P
from gridscribe.plans.staging import numbered, written
from gridscribe.sources.tables import TableSet

STRATEGIES = ("block", "1_row_block", "schema", "compress", "schema_cell_coding", "schema_coding", "agree_coding", "cpr_scm")


def _order(tables: TableSet, cells: DataFrame, skip_numeric: bool = False) -> DataFrame:
    skip = O.numeric_columns(O.column_types(tables.rows, tables.columns)).filter("skip") if skip_numeric else None
    bins = written(O.hash_bins(cells, skip), "bins")
    return O.row_order(tables.rows, bins, O.bin_order(O.bin_gains(cells, bins)))


def _one_block(tables: TableSet, size: T.Sizer = T.token_size) -> DataFrame:
    return O.schema_blocks(tables.columns, 1 << 30, size)


def schema_rows(tables: TableSet, sep_repeat: int = 2, size: T.Sizer = T.token_size) -> DataFrame:
    """Rows of the schema strategy with text and size; sep_repeat: separators after a cell (2, or 1 for a fair ratio)."""
    blocks = O.schema_blocks(tables.columns, size=size)
    rows = O.packed_rows(tables.rows, blocks, size=size)
    joint, last = " ; " * sep_repeat, (" ; " * sep_repeat).rstrip()[:-1] + " [SEP] "
    text = F.concat("title", F.lit(" [SEP] "), F.array_join(F.transform("cells", lambda c: c["text"]), joint), F.lit(last))
    row_size = F.col("title_size") + 1 + F.aggregate("cells", F.lit(0), lambda a, c: a + c["size"] + sep_repeat)
    return rows.select("table_id", "block_id", "row", "ord", "header", "cols", text.alias("text"), row_size.alias("size"), F.col("header_size").alias("fixed"))


def schema_counts(tables: TableSet, sep_repeat: int = 2, limit: int = WINDOW) -> DataFrame:
    """(table_id, count) of the schema strategy's passages: windows are counted, no text is rendered."""
    held = P.windows(schema_rows(tables, sep_repeat), limit)
    return held.groupBy("table_id", "block_id").agg((F.max("window_id") + 1).alias("n")).groupBy("table_id").agg(F.sum("n").alias("count"))


def schema_passages(tables: TableSet, sep_repeat: int = 2, limit: int = WINDOW, size: T.Sizer = T.token_size) -> DataFrame:
    """Only sizes go through the fold; texts are rendered and joined natively. A row above the limit has a window of its own."""
    rows = schema_rows(tables, sep_repeat, size)
    held = rows.join(P.windows(rows, limit), ["table_id", "block_id", "row"])
    groups = held.groupBy("table_id", "block_id", "window_id", "header", "cols", "fixed").agg(F.sort_array(F.collect_list(F.struct("ord", "row", "text"))).alias("r"), F.sum("size").alias("content"))
    return groups.select(
        "table_id", "block_id", "window_id", F.concat("header", F.array_join(F.transform("r", lambda x: x["text"]), "")).alias("passage"), (F.col("fixed") + F.col("content")).cast("int").alias("size"),
        F.transform("r", lambda x: x["row"]).alias("rows"), F.transform("r", lambda x: F.col("cols")).alias("cols"), F.array().cast("array<string>").alias("special_tokens"),
    )


def coded_rows(tables: TableSet, size: T.Sizer = T.token_size, skip_numeric: bool = False) -> DataFrame:
    """Rows of the coding strategies, in the order of the hash bins."""
    ways = O.spellings(tables.rows)
    cells = written(O.canonical(tables.rows, size=size, ways=ways), "cells")  # read for the bins and their gains
    return O.packed_rows(tables.rows, O.schema_blocks(tables.columns, size=size), _order(tables, cells, skip_numeric), size, ways)


def compress_counts(tables: TableSet, limit: int = WINDOW) -> DataFrame:
    """(table_id, count) of the compress strategy's passages: windows are counted, no text is rendered."""
    counts = P.chunked_counts(coded_rows(tables), lambda row: P.Coded(row, limit))
    return counts.groupBy("table_id").agg(F.sum("n").alias("count"))


def serialize(tables: TableSet, strategy: str, limit: int = WINDOW, size: T.Sizer = T.token_size, skip_numeric: bool = False, **options) -> DataFrame:
    """Passages of a strategy; an unknown name fails here, on the driver.

    size: the tokenizer's count of tokens; skip_numeric: columns of decimals and polygons don't decide the order of coded rows.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, known are {', '.join(STRATEGIES)}")
    if strategy == "schema":
        return schema_passages(tables, limit=limit, size=size, **options)
    if strategy in ("block", "1_row_block"):
        rows = O.packed_rows(tables.rows, _one_block(tables, size), size=size)
        if strategy == "1_row_block":
            return P.chunked(rows, lambda row: P.CellWindows(row, limit, True))
        # its windows begin at any cell, which no row tells: one task per table
        return P.folded(rows, lambda row: P.CellWindows(row, limit, False))
    if strategy == "agree_coding":
        return agree.passages(tables, written(O.canonical(tables.rows, size=size), "cells"), limit, size)
    rows = coded_rows(tables, size, skip_numeric)
    if strategy == "compress":
        return P.chunked(rows, lambda row: P.Coded(row, limit))
    if strategy == "schema_cell_coding":
        return P.chunked(rows, lambda row: P.Coded(row, limit, code_headers=True))
    if strategy == "schema_coding":
        return P.chunked(rows, lambda row: P.Coded(row, limit, code_cells=False, code_headers=True, show_header=False))
    return P.chunked(rows, lambda row: P.Paired(row, limit), P.PASSAGES + ", scm_passage string")


def decompressed(tables: TableSet, passages: DataFrame, limit: int = WINDOW) -> DataFrame:
    """Base passages: the cells that passages tell in their tags, serialized row by row."""
    tag = passages.select("table_id", F.explode(F.arrays_zip("rows", "cols")).alias("t")).select("table_id", F.col("t.rows").alias("row"), F.explode("t.cols").alias("shown"))
    shown = tag.groupBy("table_id", "row").agg(F.collect_set("shown").alias("shown"))
    rows = O.packed_rows(tables.rows, _one_block(tables)).join(shown, ["table_id", "row"])
    rows = rows.withColumn("cells", F.filter("cells", lambda c: F.array_contains("shown", c["col"]))).drop("shown").filter(F.size("cells") > 0)
    return P.chunked(rows, lambda row: P.CellWindows(row, limit, True))


def code_entries(passages: DataFrame) -> DataFrame:
    """(table_id, block_id, window_id, code, refer) of the references in coded passages."""
    found = F.regexp_extract_all("passage", F.lit(r"\[[EC][0-9]+\] is .*? \[SEP\] "), 0)
    return passages.select("table_id", "block_id", "window_id", F.explode(found).alias("e")).select("table_id", "block_id", "window_id", F.regexp_extract("e", r"^(\[[EC][0-9]+\]) is ", 1).alias("code"), F.regexp_extract("e", r"^\[[EC][0-9]+\] is (.*) \[SEP\] $", 1).alias("refer"))


def passage_counts(passages: DataFrame) -> DataFrame:
    return passages.groupBy("table_id").agg(F.count("*").alias("count"))


def compression_ratio(plain: DataFrame, coded: DataFrame) -> DataFrame:
    """table_id, schema_count, compress_count, ratio of two strategies' passage counts."""
    both = plain.select("table_id", F.col("count").alias("schema_count")).join(coded.select("table_id", F.col("count").alias("compress_count")), "table_id")
    return both.withColumn("ratio", F.round(F.col("schema_count") / F.col("compress_count"), 2))


def ratio_sorted(ratios: DataFrame) -> DataFrame:
    """ratios with place from 1: the largest ratio first, ties by table."""
    return numbered(ratios, [F.desc("ratio"), "table_id"], "at").withColumn("place", F.col("at") + 1).drop("at")


def ratio_histogram(ratios: DataFrame) -> DataFrame:
    """Tables per half-unit bucket of the ratio."""
    low = F.floor("ratio").cast("int")
    upper = F.col("ratio") - low >= 0.5
    bucket = F.when(upper, F.concat(F.lit("["), low.cast("string"), F.lit(".5-"), (low + 1).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("["), low.cast("string"), F.lit("-"), low.cast("string"), F.lit(".5)")))
    return ratios.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("table_count"))
