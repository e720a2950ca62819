"""Normalization, type inference, column statistics, hash bins and row order. All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridscribe.functions import text as T
from gridscribe.sources.tables import TableSet

#: What is counted to be no more than this is broadcast.
BROADCAST_ROWS = 100_000


def met(df: DataFrame, few: DataFrame, key: str = "table_id") -> DataFrame:
    """df joined with few (about a row a table): broadcast if it is counted to be short, so that df's rows stay where they are."""
    from gridscribe.plans.staging import written

    few = written(few, "few")
    return df.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, key)


def exploded(rows: DataFrame) -> DataFrame:
    """The long form: table_id, row, col, text (stripped)."""
    return rows.select("table_id", "row", F.posexplode("cells").alias("col", "text")).withColumn("text", T.strip(F.col("text")))


def spellings(rows: DataFrame) -> tuple[DataFrame, int]:
    """(table_id, col, key, first) of the keys that are spelled in several ways, and how many they are.

    Whether a key has several spellings is told by hashes, so this is a hash aggregation of numbers; only cells whose hashed key has
    are compared by their texts.
    """
    from gridscribe.plans.staging import written

    cells = exploded(rows).withColumn("key", F.lower("text")).withColumn("h", F.xxhash64("key"))
    some = cells.groupBy("table_id", "col", "h").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high")).filter("low <> high")
    some = written(some.select("table_id", "col", "h"), "spellings")
    n = some.count()
    if not n:
        return some.select("table_id", "col", F.lit("").alias("key"), F.lit("").alias("first")), 0
    few = F.broadcast(some) if n <= BROADCAST_ROWS else some
    first = cells.join(few, ["table_id", "col", "h"]).groupBy("table_id", "col", "key").agg(F.min_by("text", "row").alias("first"))
    return written(first, "firsts"), n


def canonical(rows: DataFrame, most: int = T.CELL_MAX, size: T.Sizer = T.token_size, ways: tuple[DataFrame, int] | None = None) -> DataFrame:
    """table_id, row, col, key, text, size: a cell's text is the first spelling of its key in its column.

    Sizes don't depend on the spelling, so only the keys that are spelled in several ways are joined back, and they are few: the
    other cells never move.
    """
    first, n = ways or spellings(rows)
    cells = exploded(rows).withColumn("key", F.lower("text"))
    if n:
        cells = cells.join(F.broadcast(first) if n <= BROADCAST_ROWS else first, ["table_id", "col", "key"], "left").withColumn("text", F.coalesce("first", "text"))
    text, n_tokens = T.truncated(F.col("text"), most, size)
    return cells.select("table_id", "row", "col", "key", text.alias("text"), n_tokens.alias("size"))


def headers(columns: DataFrame, size: T.Sizer = T.token_size) -> DataFrame:
    """table_id, title, title_size, col, name, size: truncated titles and column names."""
    title, title_size = T.truncated(T.strip(F.col("title")), T.TITLE_MAX, size)
    name, name_size = T.truncated(T.strip(F.col("name")), T.HEADER_MAX, size)
    return columns.select("table_id", title.alias("title"), title_size.alias("title_size"), "col", name.alias("name"), name_size.alias("size"))


def cell_types(rows: DataFrame) -> DataFrame:
    return exploded(rows).withColumn("type", T.infer_type(F.col("text")))


def column_types(rows: DataFrame, columns: DataFrame, span: int = 4096) -> DataFrame:
    """The first type that has enough cells (three; one polygon), in row order; null if none has.

    Most columns are decided by their first rows, so the first span of rows is looked at first. Of the columns it leaves open all
    cells are typed: they are counted by spans of rows, and the spans that hold the first three rows of a type are looked at
    again. Nothing is sorted but a few thousand cells a column.
    """
    from gridscribe.plans.staging import written

    def best(typed: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("table_id", "col", "type").orderBy("row"))
        hits = typed.withColumn("k", rank).filter("k <= 3").filter((F.col("k") == 3) | (F.col("type") == "POLYGON") & (F.col("k") == 1))
        return hits.groupBy("table_id", "col").agg(F.min_by("type", "row").alias("type"))

    early = written(best(cell_types(rows.filter(F.col("row") < span)).filter("type IS NOT NULL")), "early-types")
    every = columns.select("table_id", "col")
    left = written(every.join(early, ["table_id", "col"], "left_anti").groupBy("table_id").agg(F.sort_array(F.collect_list("col")).alias("cols")), "open-columns")
    if left.isEmpty():
        return every.join(early, ["table_id", "col"], "left")
    late = rows.join(F.broadcast(left) if left.count() <= BROADCAST_ROWS else left, "table_id")
    cell = lambda c: F.struct(c.alias("col"), T.strip(F.get("cells", c)).alias("text"))
    cells = late.select("table_id", "row", F.explode(F.transform("cols", cell)).alias("c")).select("table_id", "row", "c.col", T.infer_type(F.col("c.text")).alias("type"))
    typed = cells.filter("type IS NOT NULL").withColumn("span", F.floor(F.col("row") / span).cast("int"))
    counted = typed.groupBy("table_id", "col", "type", "span").agg(F.count("*").alias("n"))
    w = Window.partitionBy("table_id", "col", "type").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = written(counted.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).filter("before < 3").select("table_id", "col", "type", "span"), "type-spans")
    found = early
    if not spans.isEmpty():
        found = early.unionByName(best(typed.join(spans, ["table_id", "col", "type", "span"])))
    return every.join(found, ["table_id", "col"], "left")


def classes(cells: DataFrame) -> DataFrame:
    """(table_id, col, key, class_id, n, size): classes are numbered by first appearance in their column."""
    groups = cells.groupBy("table_id", "col", "key").agg(F.min("row").alias("first_row"), F.count("*").alias("n"), F.first("size").alias("size"))
    return groups.withColumn("class_id", F.row_number().over(Window.partitionBy("table_id", "col").orderBy("first_row")) - 1)


def column_weights(cells: DataFrame) -> DataFrame:
    """What coding a column's repeated cells could save."""
    groups = cells.groupBy("table_id", "col", "key").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    saved = F.greatest(F.lit(0), F.col("n") * F.col("size") - (F.col("n") + F.col("size") + 3))
    return groups.groupBy("table_id", "col").agg(F.sum(saved).cast("long").alias("weight"))


def max_weight_column(cells: DataFrame) -> DataFrame:
    """The column of the largest weight; the first on ties."""
    return column_weights(cells).groupBy("table_id").agg(F.max(F.struct("weight", (-F.col("col")).alias("minus")))["minus"].alias("minus")).select("table_id", (-F.col("minus")).alias("col"))


def hash_bins(cells: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """(table_id, col, slot, row) of non-empty cells; a table has as many slots as rows. skip: columns (table_id, col) without bins."""
    if skip is not None:
        cells = cells.join(F.broadcast(skip.select("table_id", "col")) if skip.count() <= BROADCAST_ROWS else skip.select("table_id", "col"), ["table_id", "col"], "left_anti")
    sizes = cells.groupBy("table_id").agg(F.countDistinct("row").alias("n_rows"))
    return met(cells.filter("key <> ''"), sizes).select("table_id", "col", T.hash_slot(F.col("key"), F.col("n_rows")).alias("slot"), "row")


def bin_gains(cells: DataFrame, bins: DataFrame) -> DataFrame:
    """(table_id, col, slot, gain): over the rows of a bin, all their cells pooled by key, (count - 1) * size."""
    shared = bins.join(cells.select("table_id", "row", "key", "size"), ["table_id", "row"])
    pooled = shared.groupBy("table_id", "col", "slot", "key").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return pooled.groupBy("table_id", "col", "slot").agg(F.sum((F.col("n") - 1) * F.col("size")).cast("long").alias("gain"))


def bin_order(gains: DataFrame) -> DataFrame:
    """gains with bin_rank from 1: by gain, then column and slot. One range sort for all tables, whatever their size."""
    from gridscribe.plans.staging import numbered

    placed = numbered(gains, ["table_id", F.desc("gain"), "col", "slot"], "place")
    first = placed.groupBy("table_id").agg(F.min("place").alias("first"))
    return met(placed, first).withColumn("bin_rank", F.col("place") - F.col("first") + 1).drop("place", "first")


def row_order(rows: DataFrame, bins: DataFrame, order: DataFrame) -> DataFrame:
    """(table_id, row, ord): rows by the best bin that holds them, rows of no bin last."""
    from gridscribe.plans.staging import numbered

    best = bins.join(order.select("table_id", "col", "slot", "bin_rank"), ["table_id", "col", "slot"]).groupBy("table_id", "row").agg(F.min("bin_rank").alias("bin_rank"))
    all_rows = rows.select("table_id", "row").join(best, ["table_id", "row"], "left")
    placed = numbered(all_rows, ["table_id", F.asc_nulls_last("bin_rank"), "row"], "place")
    first = placed.groupBy("table_id").agg(F.min("place").alias("first"))
    return met(placed, first).select("table_id", "row", (F.col("place") - F.col("first")).cast("int").alias("ord"))


def numeric_columns(types: DataFrame) -> DataFrame:
    """types with skip: columns of decimals and polygons say little about which rows belong together."""
    return types.withColumn("skip", F.coalesce(F.col("type").isin("FLOAT", "POLYGON"), F.lit(False)))


def schema_blocks(columns: DataFrame, budget: int = int(T.WINDOW * T.HEADER_SHARE), size: T.Sizer = T.token_size) -> DataFrame:
    """(table_id, block_id, cols, header, header_size): columns in order, a new block where the next name would exceed the budget.

    A header is one row per column of a table, so the fold runs over a sorted array inside a row.
    """
    named = headers(columns, size).groupBy("table_id").agg(F.first("title").alias("title"), F.first("title_size").alias("title_size"), F.sort_array(F.collect_list(F.struct("col", "name", "size"))).alias("c"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("block"), F.array().cast("array<struct<block:int,col:int,name:string,size:int>>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        new = c["size"] + 1
        over = (a["used"] + new > budget) & (a["used"] > 0)
        block = a["block"] + over.cast("int")
        item = F.struct(block.alias("block"), c["col"].alias("col"), c["name"].alias("name"), c["size"].alias("size"))
        return F.struct(F.when(over, new).otherwise(a["used"] + new).alias("used"), block.alias("block"), F.concat(a["out"], F.array(item)).alias("out"))

    flat = named.select("table_id", "title", "title_size", F.explode(F.aggregate("c", start, step)["out"]).alias("x")).select("table_id", "title", "title_size", F.col("x.block").alias("block_id"), "x.col", "x.name", "x.size")
    blocks = flat.groupBy("table_id", "title", "title_size", "block_id").agg(F.sort_array(F.collect_list(F.struct("col", "name", "size"))).alias("c"))
    # the first block starts each name with a blank; later blocks do so from their second name on
    inner = F.array_join(F.transform("c", lambda c, i: F.concat(F.when((i == 0) & (F.col("block_id") > 0), F.lit("")).otherwise(F.lit(" ")), c["name"], F.lit(" ; "))), "")
    header = F.concat(F.expr("substring(rtrim(h), 1, length(rtrim(h)) - 1)"), F.lit("[SEP]"))
    return blocks.withColumn("h", inner).select("table_id", "title", "title_size", "block_id", F.transform("c", lambda c: c["col"]).alias("cols"), F.transform("c", lambda c: c["name"]).alias("names"), F.transform("c", lambda c: c["size"]).alias("name_sizes"), header.alias("header"), F.aggregate("c", F.lit(0), lambda a, c: a + c["size"] + 1).alias("header_size"))


def packed_rows(rows: DataFrame, blocks: DataFrame, order: DataFrame | None = None, size: T.Sizer = T.token_size, ways: tuple[DataFrame, int] | None = None) -> DataFrame:
    """One row per table row and block, ready for packing: its cells in column order, where it stands (ord), its block's layout.

    Rows of tables without keys in several spellings are rendered where they lie; only the other tables' cells are taken out, corrected
    and collected again.
    """
    from gridscribe.plans.staging import written

    first, n = ways or spellings(rows)
    plain = rows
    if n:
        mixed = first.select("table_id").distinct()
        few = mixed.count() <= BROADCAST_ROWS
        plain = rows.join(F.broadcast(mixed) if few else mixed, "table_id", "left_anti")

    # lambdas share no subexpressions: a step for what the next one takes more than once
    def stripped(c: Column) -> Column:
        return F.struct(c.alias("col"), T.strip(F.get("cells", c)).alias("text"))

    def split(c: Column) -> Column:
        found = T.tokens(c["text"])
        return F.struct(c["col"].alias("col"), c["text"].alias("text"), (found if size is T.token_size else F.lit(None)).alias("found"))

    def cell(c: Column) -> Column:
        own = size is T.token_size
        shown, n_tokens = T.truncated(c["text"], T.CELL_MAX, (lambda _: F.size(c["found"])) if own else size)
        return F.struct(c["col"].alias("col"), shown.alias("text"), n_tokens.alias("size"), F.lower(c["text"]).alias("key"))

    blocks = written(blocks, "blocks")
    few_blocks = F.broadcast(blocks) if blocks.count() <= BROADCAST_ROWS else blocks
    wide = plain.select("table_id", "row", "cells").join(few_blocks, "table_id")
    # a column that a short row lacks has no cell
    held = F.transform(F.transform(F.transform(F.filter("cols", lambda c: F.get("cells", c).isNotNull()), stripped), split), cell)
    out = wide.withColumn("cells", held).filter(F.size("cells") > 0)
    if n:
        own = blocks.select("table_id", "block_id", F.explode("cols").alias("col"))
        part = rows.join(F.broadcast(mixed) if few else mixed, "table_id", "left_semi")
        cells = canonical(part, size=size, ways=(first, n)).join(own, ["table_id", "col"])
        grouped = cells.groupBy("table_id", "block_id", "row").agg(F.sort_array(F.collect_list(F.struct("col", "text", "size", "key"))).alias("cells"))
        out = out.unionByName(grouped.join(few_blocks, ["table_id", "block_id"]).select(*out.columns))
    if order is None:
        return out.withColumn("ord", F.col("row"))
    return out.join(order, ["table_id", "row"])
