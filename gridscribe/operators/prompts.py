"""Exchange with language models and annotators: prompts of tables, answers by line, question sheets, samples, pooled vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridscribe.functions import text as T
from gridscribe.operators.questions import hash_place

SEPARATOR = " | "


def prompt_columns(columns: DataFrame, first: int = 5, more: int = 45) -> DataFrame:
    """(table_id, title, col, name): the first columns, and up to `more` of the others drawn by a hash."""
    late = (F.col("col") >= first).cast("int")
    place = F.row_number().over(Window.partitionBy("table_id", late).orderBy(F.md5(F.concat_ws("|", "table_id", F.col("col").cast("string"))), "col"))
    return columns.withColumn("k", place).filter((F.col("col") < first) | (F.col("k") <= more)).select("table_id", "title", "col", "name")


def table_prompts(rows: DataFrame, columns: DataFrame, most_rows: int = 10, caption: str = "Table Caption:", data: str = "Table Data:") -> DataFrame:
    """(table_id, prompt): caption, header line and at most `most_rows` row lines of each table, drawn by a hash, in table order.

    Rows are ranked inside their table (Spark keeps the best of each task before the shuffle); only drawn rows are rendered, so
    what meets in one group is bounded by the two limits.
    """
    chosen = prompt_columns(columns).groupBy("table_id").agg(F.max("title").alias("title"), F.sort_array(F.collect_list(F.struct("col", "name"))).alias("cols"))
    drawn = rows.select("table_id", "row", "cells").withColumn("k", hash_place(["table_id"], "table_id", "row")).filter(F.col("k") <= most_rows)
    cell = lambda c: F.coalesce(F.get("cells", c["col"]), F.lit(""))
    lines = drawn.join(chosen, "table_id").select("table_id", "row", F.concat(F.lit("\n"), F.array_join(F.transform("cols", cell), SEPARATOR)).alias("line"))
    bodies = lines.groupBy("table_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "").alias("body"))
    head = F.concat(F.lit(caption + "\n"), "title", F.lit("\n" + data + "\n"), F.array_join(F.transform("cols", lambda c: c["name"]), SEPARATOR))
    return chosen.join(bodies, "table_id", "left").select("table_id", F.concat(head, F.coalesce("body", F.lit(""))).alias("prompt"))


def answer_lines(response: Column, mark: str = ".", tag: str = "") -> Column:
    """array<struct<no, text>> of the lines `no mark ... tag text`; lines without number, mark or tag are left out.

    The text follows the first tag behind the line's start; without a tag, the mark. The number stands before the first mark.
    """
    lines = F.split(F.coalesce(response, F.lit("")), "\n")
    at = lambda line, what: F.instr(line, what)
    number = lambda line: F.trim(F.substring_index(line, mark, 1)).try_cast("int")
    good = F.filter(lines, lambda x: (at(x, mark) > 0) & number(x).isNotNull() & ((at(x, tag) > 0) if tag else F.lit(True)))
    behind = lambda x: F.substring(x, at(x, tag or mark) + len(tag or mark), F.length(x))
    return F.transform(good, lambda x: F.struct(number(x).alias("no"), T.strip(behind(x)).alias("text")))


def question_sheet(questions: DataFrame) -> DataFrame:
    """Rows for annotators of questions (table_id, title, id, question, row, sel_col, where_cols): also in grid notation.

    A leading bar of a question is dropped; grid rows count from 2 below a header, grid columns are letters; q_no counts a table's
    questions.
    """
    order = F.row_number().over(Window.partitionBy("table_id").orderBy("id"))
    question = F.when(F.startswith("question", F.lit("|")), T.strip(F.expr("substring(question, 2)"))).otherwise(F.col("question"))
    listed = lambda f: F.array_join(F.transform("where_cols", f), " , ")
    return questions.select(
        "table_id", "title", order.alias("q_no"), question.alias("question"), "row", (F.col("row") + 2).alias("grid_row"), "sel_col", T.column_letters(F.col("sel_col") + 1).alias("grid_col"),
        listed(lambda c: c.cast("string")).alias("where_cols"), listed(lambda c: T.column_letters(c + 1)).alias("grid_where_cols"),
    )


def sampled(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """k rows, or all: those that come first by an MD5 of their keys. A top-k: each task keeps k rows."""
    return df.orderBy(F.md5(F.concat_ws("|", *keys)), *keys).limit(k)


def passage_tables(passages: DataFrame, rows: DataFrame) -> DataFrame:
    """(p_id, table_id, row, at, cells): the part of its table that a passage (p_id, table_id, rows, cols) shows.

    Columns are those of the passage's first row; `at` counts its rows.
    """
    spans = passages.select("p_id", "table_id", F.get("cols", F.lit(0)).alias("own"), F.posexplode("rows").alias("at", "row"))
    met = spans.join(rows.select("table_id", "row", "cells"), ["table_id", "row"])
    return met.select("p_id", "table_id", "row", "at", F.transform("own", lambda c: F.coalesce(F.get("cells", c), F.lit(""))).alias("cells"))


def mean_pool(vectors: Column) -> Column:
    """The mean of an array of equally long vectors, place by place; null without vectors."""
    n = F.size(vectors)
    total = F.aggregate(F.slice(vectors, 2, F.greatest(n - 1, F.lit(0))), F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    return F.when(n > 0, F.transform(total, lambda x: x / n))
