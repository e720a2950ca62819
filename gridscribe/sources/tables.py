"""Sources and sinks. A table set is rows (table_id, row, cells array<string>) and columns (table_id, title, col, name)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridscribe.functions import text as T
from gridscribe.plans.staging import numbered

TABLE = "tableId string, documentTitle string, columns array<struct<text:string>>, rows array<struct<cells:array<struct<text:string>>>>"
PASSAGE = "passage string, tag struct<size:int,table_id:string,row:array<int>,cols:array<array<int>>,special_tokens:array<string>>, p_id long"
RUN = "id string, question string, table_id_lst array<string>, answers array<string>, ctxs array<struct<text:string,tag:struct<table_id:string,row:array<int>>>>"
METADATA = "resource struct<id:string,name:string,type:string,columns_field_name:array<string>,columns_name:array<string>>"


@dataclass
class TableSet:
    rows: DataFrame
    columns: DataFrame


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_name(column: str) -> str:
    return column.split("_", 1)[-1]


def from_relation(df: DataFrame, table_id: str, ordered: bool = True) -> TableSet:
    """A relation as a table of strings; rows are numbered in the order of all columns, or (not ordered) have no numbers.

    What only counts or meets values needs no numbers, and then nothing is sorted or written.
    """
    spark = df.sparkSession
    rows = numbered(df, [F.asc_nulls_first(c) for c in df.columns]) if ordered else df.withColumn("row", F.lit(None).cast("int"))
    cells = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
    columns = spark.createDataFrame([(table_id, table_id, i, short_name(c)) for i, c in enumerate(df.columns)], "table_id string, title string, col int, name string")
    return TableSet(rows.select(F.lit(table_id).alias("table_id"), F.col("row").cast("int").alias("row"), cells.alias("cells")), columns)


def from_documents(docs: DataFrame) -> TableSet:
    """Nested table documents (TABLE) as a table set; short rows are filled up with empty cells by their readers."""
    text = lambda a: F.transform(a, lambda c: F.coalesce(c["text"], F.lit("")))
    rows = docs.select(F.col("tableId").alias("table_id"), F.posexplode("rows").alias("row", "r")).select("table_id", "row", text(F.col("r.cells")).alias("cells"))
    columns = docs.select(F.col("tableId").alias("table_id"), F.coalesce("documentTitle", F.lit("")).alias("title"), F.posexplode(text(F.col("columns"))).alias("col", "name"))
    return TableSet(rows, columns)


def read_tables(spark: SparkSession, path: str, multi_line: bool = False) -> TableSet:
    """JSON tables, one object per line or (multi_line) per file."""
    return from_documents(spark.read.schema(TABLE).option("multiLine", multi_line).json(path))


def write_tables(tables: TableSet, path: str) -> None:
    text = lambda a: F.transform(a, lambda c: F.struct(c.alias("text")))
    rows = tables.rows.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("r"))
    heads = tables.columns.groupBy("table_id").agg(F.first("title").alias("documentTitle"), F.sort_array(F.collect_list(F.struct("col", "name"))).alias("c"))
    docs = heads.join(rows, "table_id", "left").select(
        F.col("table_id").alias("tableId"), "documentTitle", F.transform("c", lambda c: F.struct(c["name"].alias("text"))).alias("columns"),
        F.transform(F.coalesce("r", F.array().cast("array<struct<row:int,cells:array<string>>>")), lambda r: F.struct(text(r["cells"]).alias("cells"))).alias("rows"),
    )
    docs.write.mode("errorifexists").json(path)


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PASSAGE).json(path)


def write_passages(passages: DataFrame, path: str) -> None:
    """Passages (table_id, passage, size, rows, cols, special_tokens, p_id) as JSON lines."""
    tag = F.struct(F.col("size").cast("int").alias("size"), "table_id", F.col("rows").alias("row"), "cols", "special_tokens")
    passages.select("passage", tag.alias("tag"), "p_id").write.mode("errorifexists").json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).json(path).withColumn("question", T.strip(F.col("question")))


def ranked(run: DataFrame) -> DataFrame:
    """One row per retrieved passage of a run: id, rank, text, table_id."""
    return run.select("id", F.posexplode("ctxs").alias("rank", "c")).select("id", "rank", F.col("c.text").alias("text"), F.col("c.tag.table_id").alias("table_id"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label CSV: table ids (a line each), question, grid rows per table (comma lists, a line each, or ok)."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    ids, question, grid = rows.columns[:3]
    return rows.filter(T.strip(F.col(f"`{question}`")) != "").select(F.split(T.strip(F.col(f"`{ids}`")), "\n").alias("table_ids"), T.strip(F.col(f"`{question}`")).alias("question"), F.split(T.strip(F.col(f"`{grid}`")), "\n").alias("grid"))


def grid_rows(listed: Column) -> Column:
    """Grid rows (1-based, below a header) as table rows; ok is the empty list."""
    return F.when(F.lower(F.trim(listed)) == "ok", F.array().cast("array<int>")).otherwise(F.transform(F.split(listed, ","), lambda x: F.trim(x).cast("int") - 2))


def csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Open-data metadata: id, name and a map from field name to display name; only datasets with equally long lists."""
    r = spark.read.schema(METADATA).option("multiLine", True).json(path).select("resource.*")
    return r.filter("type = 'dataset' AND size(columns_field_name) = size(columns_name)").select("id", "name", F.map_from_arrays("columns_field_name", "columns_name").alias("names"))


def header_meta(headers: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of headers (table_id, fields): lower-cased display names; one unknown field rejects a table."""
    both = headers.join(metadata, headers["table_id"] == metadata["id"], "left")
    names = F.transform("fields", lambda f: F.lower(F.try_element_at("names", f)))
    both = both.select("table_id", F.col("name").alias("title"), names.alias("col_names"))
    good = F.coalesce(F.forall("col_names", lambda n: n.isNotNull()), F.lit(False))
    return both.filter(good), both.filter(~good).select("table_id")


def read_jdbc(spark: SparkSession, url: str, tables: list[str], most: int = 10_000, **options: str) -> TableSet:
    """Database tables, of each the first `most` rows in the order of all columns (a top-k, the same in every run).

    Empty ones are left out; titles are names with blanks for underscores.
    """
    out = None
    for name in tables:
        df = spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
        df = df.orderBy(*(F.asc_nulls_first(c) for c in df.columns)).limit(most)
        if df.isEmpty():
            continue
        one = from_relation(df, name)
        one.columns = one.columns.withColumn("title", F.replace("title", F.lit("_"), F.lit(" ")))
        out = one if out is None else TableSet(out.rows.unionByName(one.rows), out.columns.unionByName(one.columns))
    if out is None:
        raise ValueError("no table with rows")
    return out


def with_question_ids(questions: DataFrame) -> DataFrame:
    """Sequential ids from 1 in the order of table and question."""
    return numbered(questions, ["table_id", "question"], "_n").withColumn("id", F.col("_n") + 1).drop("_n")


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")
