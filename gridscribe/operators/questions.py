"""Benchmark and training-set layer: joinable values, SQL templates, labels, splits, negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridscribe.functions import text as T
from gridscribe.plans.staging import numbered

#: Column names that hold one of these say nothing about joins.
NO_JOIN = r"year|date|time|number|score|#"


def joinable_values(rows: DataFrame, columns: DataFrame, first_columns: int = 6, per_column: int = 10) -> DataFrame:
    """(col_key, key, table_ids): values that a column name shares across tables; the first `per_column` per name.

    Only the first columns' cells are taken out of the rows (which need no numbers), and met by hash aggregation; a value of a
    third of all rows is pre-aggregated.
    """
    names = columns.filter((F.col("col") < first_columns) & ~F.col("name").rlike(NO_JOIN)).select("table_id", "col", T.cell_key(F.col("name")).alias("col_key"))
    cells = rows.select("table_id", F.posexplode(F.slice("cells", 1, first_columns)).alias("col", "text")).select("table_id", "col", T.cell_key(F.col("text")).alias("key"))
    met = cells.filter("key <> ''").join(F.broadcast(names) if names.count() <= 100_000 else names, ["table_id", "col"])
    shared = met.groupBy("col_key", "key").agg(F.sort_array(F.collect_set("table_id")).alias("table_ids")).filter("size(table_ids) > 1")
    place = F.row_number().over(Window.partitionBy("col_key").orderBy("key"))
    return shared.withColumn("k", place).filter(F.col("k") <= per_column).drop("k")


def hash_place(partition: list[str], *keys: str) -> Column:
    """The place of a row inside its partition in the order of an MD5 of keys: a fixed shuffle."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(F.md5(F.concat_ws("|", *keys)), *keys))


def split_by_table(tables: DataFrame, share: float = 0.8) -> DataFrame:
    """(table_id, part): train or dev, by whole tables. tables has one row per table; its order is one range sort."""
    order = numbered(tables.select("table_id", F.md5(F.col("table_id").cast("string")).alias("h")), ["h", "table_id"], "at")
    n = tables.count()
    return order.select("table_id", F.when(F.col("at") < int(share * n), "train").otherwise("dev").alias("part"))


def split_rows(df: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """(key, part): train or dev, row by row in the order of a hash; for passages that belong to no table."""
    order = numbered(df.select(key, F.md5(F.col(key).cast("string")).alias("h")), ["h", key], "at")
    n = order.count()
    return order.select(key, F.when(F.col("at") < int(share * n), "train").otherwise("dev").alias("part"))


def drawn(*keys: Column, digits: int = 7) -> Column:
    """A number below 2**28 from a hash of the keys: a fixed draw."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in keys))), 1, digits), 16, 10).cast("long")


def hard_negatives(questions: DataFrame, passages: DataFrame, k: int = 20) -> DataFrame:
    """(qid, p_id, n): k distinct passages of other tables for each question (qid, table_id), or all there are; any can be drawn.

    Passages are numbered by table, so that all others of a question are two runs of numbers: its k draws, one from each k-th
    part of them, are numbers first and meet their passages in one equi-join.
    """
    placed = numbered(passages.select("table_id", "p_id"), ["table_id", "p_id"], "place")
    total = placed.count()
    spans = placed.groupBy("table_id").agg(F.min("place").alias("low"), F.count("*").alias("own"))
    asked = questions.join(spans, "table_id", "left").withColumn("own", F.coalesce("own", F.lit(0))).withColumn("low", F.coalesce("low", F.lit(total)))
    asked = asked.withColumn("others", F.lit(total) - F.col("own")).withColumn("k", F.least(F.lit(k).cast("long"), "others")).filter("k > 0")
    rows = asked.select("qid", "low", "own", "others", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j"))
    begin, end = F.expr("j * others div k"), F.expr("(j + 1) * others div k")
    at = begin + drawn(F.col("qid"), F.col("j")) % (end - begin)
    rows = rows.withColumn("at", at).withColumn("place", F.when(F.col("at") >= F.col("low"), F.col("at") + F.col("own")).otherwise(F.col("at")))
    return rows.join(placed.select("place", "p_id"), "place").select("qid", "p_id", (F.col("j") + 1).alias("n"))


def base_samples(pairs: DataFrame, most: int = 3) -> DataFrame:
    """(qid, p_id, base, n): of the base passages (array bases) of each coded passage at most `most`, by a hash."""
    flat = pairs.select("qid", "p_id", F.explode("bases").alias("base"))
    return flat.withColumn("n", hash_place(["qid", "p_id"], "qid", "p_id", "base")).filter(F.col("n") <= most)


OPS, GENERAL, NUMERIC = ("=", ">", "<", "between"), ("", "count"), ("", "count", "max", "min", "avg", "sum")
NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?$"
CONDITION = "array<struct<col:int,name:string,op:string,value:string,value_2:string,sql:string>>"


def sql_templates(rows: DataFrame, columns: DataFrame, types: DataFrame, per_table: int = 10, look_at: int = 64) -> DataFrame:
    """(table_id, id, row, sel_col, aggregate, conditions, sql): templates from hash-chosen rows and columns.

    One or two conditions (one where a table has fewer than three columns) from one row, joined by `and`. In a column of numbers
    a condition asks for the cell's value, more than a little less, less than a little more, or between the two: little
    is 0 to 9, tenths of it in a column of decimals. Other cells are asked for by equality. A selected column of numbers may be
    aggregated by its extremes, mean or sum, any by its count. A drawn row whose condition cells aren't all filled is
    passed over, and the next one takes its place. The first `look_at` rows by hash of each table are drawn from at first; only
    tables in which these don't hold enough filled ones are looked at as a whole.
    """
    from gridscribe.plans.staging import written

    ahead = hash_place(["table_id"], "table_id", "row")
    some = written(rows.select("table_id", "row", "cells").withColumn("ahead", ahead).filter(F.col("ahead") <= look_at).drop("ahead"), "drawn")
    first = written(_templates_of(some, columns, types, per_table), "templates")
    held = some.groupBy("table_id").agg(F.count("*").alias("n")).filter(F.col("n") >= look_at)
    short = held.join(first.groupBy("table_id").agg(F.count("*").alias("got")), "table_id", "left").filter(F.coalesce("got", F.lit(0)) < per_table).select("table_id")
    short = written(short, "short")
    if short.isEmpty():
        return first
    return first.join(short, "table_id", "left_anti").unionByName(_templates_of(rows.join(short, "table_id", "left_semi"), columns, types, per_table))


def _templates_of(rows: DataFrame, columns: DataFrame, types: DataFrame, per_table: int) -> DataFrame:
    heads = columns.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("col", "name"))).alias("heads"))
    kinds = types.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("col", F.coalesce("type", F.lit("")).alias("type")))).alias("kinds"))
    both = heads.join(kinds, "table_id", "left").withColumn("n_cols", F.size("heads"))  # one row a table
    draw = lambda salt, m: (drawn(F.col("table_id"), F.col("row"), F.lit(salt)) % m).cast("int")
    x = rows.select("table_id", "row", "cells").join(both, "table_id").filter("n_cols > 1")
    x = x.withColumn("sel_col", draw("sel", F.col("n_cols"))).withColumn("n_conds", F.when(F.col("n_cols") > 2, 1 + draw("conditions", F.lit(2))).otherwise(1))
    # the second condition's column is one of those that are left
    first = draw("where", F.col("n_cols") - 1) + 1
    second = draw("where2", F.greatest(F.col("n_cols") - 2, F.lit(1))) + 1
    second = F.when(second >= F.col("first"), second + 1).otherwise(second)
    x = x.withColumn("first", first).withColumn("second", second)
    other = lambda step: (F.col("sel_col") + step) % F.col("n_cols")
    x = x.withColumn("where", F.when(F.col("n_conds") == 2, F.array(other(F.col("first")), other(F.col("second")))).otherwise(F.array(other(F.col("first")))))
    cell = lambda c: T.strip(F.get("cells", c))
    full = x.filter(F.forall("where", lambda c: cell(c) != ""))
    chosen = full.withColumn("id", hash_place(["table_id"], "table_id", "row")).filter(F.col("id") <= per_table)

    kind = lambda c: F.coalesce(F.get("kinds", c)["type"], F.lit(""))
    name = lambda c: F.get("heads", c)["name"]

    def condition(c: Column, i: Column) -> Column:
        salt = lambda what: drawn(F.col("table_id"), F.col("row"), F.concat(F.lit(what), i.cast("string")))
        value = cell(c)
        number = kind(c).isin("INT", "FLOAT") & value.rlike(NUMBER)
        exact = F.when(number, value).cast("decimal(30,4)")
        little = ((salt("little") % 10) / F.when(kind(c) == "FLOAT", F.lit(10)).otherwise(F.lit(1))).cast("decimal(4,1)")
        op = F.when(number, F.get(F.array(*map(F.lit, OPS)), (salt("op") % 4).cast("int"))).otherwise("=")
        plain = lambda v: F.regexp_replace(F.regexp_replace(v.cast("decimal(31,4)").cast("string"), r"0+$", ""), r"\.$", "")
        low, high = plain(exact - little), plain(exact + little)
        quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
        first = F.when(op.isin(">", "between"), low).when(op == "<", high).when(number, plain(exact)).otherwise(value)
        sql = F.when(op == "between", F.concat(name(c), F.lit(" between "), low, F.lit(" and "), high)).otherwise(F.concat(name(c), F.lit(" "), op, F.lit(" "), F.when(number, first).otherwise(quoted)))
        return F.struct(c.alias("col"), name(c).alias("name"), op.alias("op"), first.alias("value"), F.when(op == "between", high).alias("value_2"), sql.alias("sql"))

    conditions = F.transform("where", condition).cast(CONDITION)
    numeric = kind(F.col("sel_col")).isin("INT", "FLOAT")
    pick = lambda options: F.get(F.array(*map(F.lit, options)), draw("aggregate", F.lit(len(options))))
    out = chosen.withColumn("conditions", conditions).withColumn("aggregate", F.when(numeric, pick(NUMERIC)).otherwise(pick(GENERAL)))
    chosen_col = F.when(F.col("aggregate") != "", F.concat("aggregate", F.lit("("), name(F.col("sel_col")), F.lit(")"))).otherwise(name(F.col("sel_col")))
    sql = F.concat(F.lit("select "), chosen_col, F.lit(" where "), F.array_join(F.transform("conditions", lambda c: c["sql"]), " and "))
    return out.select("table_id", "id", "row", "sel_col", "aggregate", "conditions", sql.alias("sql"))


def template_results(templates: DataFrame, rows: DataFrame) -> DataFrame:
    """(table_id, id, n_rows, result): rows of its table that a template's conditions select, and what it asks of them.

    Without an aggregate the result is the least selected text. A table has few templates, so they are broadcast by Spark where
    they are small; a row is looked at once per template of its table.
    """
    both = rows.select("table_id", "cells").join(templates.select("table_id", "id", "sel_col", "aggregate", "conditions"), "table_id")
    number = lambda x: x.try_cast("decimal(30,4)")

    def holds(c: Column) -> Column:
        text = T.strip(F.get("cells", c["col"]))
        asked, high = number(c["value"]), number(c["value_2"])
        same = (text == c["value"]) | (text.rlike(NUMBER) & (number(text) == asked))
        out = F.when(c["op"] == "=", same).when(c["op"] == ">", number(text) > asked).when(c["op"] == "<", number(text) < asked).otherwise((number(text) >= asked) & (number(text) <= high))
        return F.coalesce(out, F.lit(False))

    text = T.strip(F.get("cells", F.col("sel_col")))
    hit = both.withColumn("hit", F.forall("conditions", holds)).withColumn("text", F.when(F.col("hit"), text)).withColumn("v", number(F.col("text")))
    out = hit.groupBy("table_id", "id", "aggregate").agg(F.sum(F.col("hit").cast("long")).alias("n_rows"), F.min("text").alias("least"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum("v").alias("sum"), F.count("v").alias("n"))
    exact = lambda x: x.cast("decimal(38,4)").cast("string")
    result = F.when(F.col("aggregate") == "count", F.col("n_rows").cast("string"))
    for name in ("min", "max", "sum"):
        result = result.when(F.col("aggregate") == name, exact(F.col(name)))
    result = result.when(F.col("aggregate") == "avg", exact(F.col("sum").cast("double") / F.col("n"))).otherwise(F.col("least"))
    return out.select("table_id", "id", "n_rows", result.alias("result"))


def offset_pick(offsets: DataFrame) -> DataFrame:
    """(qid, p_id, base): of the base passages of each coded passage (qid, map offsets) one, by a hash."""
    flat = offsets.select("qid", F.explode("offsets").alias("p_id", "bases"))
    return flat.select("qid", "p_id", F.get("bases", (drawn(F.col("qid"), F.col("p_id")) % F.size("bases")).cast("int")).alias("base"))


def paraphrase_columns(sel_col: Column, conditions: Column) -> Column:
    """The distinct columns that a template names, the selected one first."""
    return F.array_distinct(F.concat(F.array(sel_col), F.transform(conditions, lambda c: c["col"])))


def query_records(questions: DataFrame) -> DataFrame:
    """Records of questions (question, table_ids, answers) as a retriever reads them; the id is a digest of what is asked of what."""
    digest = F.substring(F.sha2(F.concat_ws("\x1f", "question", F.array_join("table_ids", "\x1e")), 256), 1, 32)
    none = F.array().cast("array<struct<title:string,text:string>>")
    return questions.select(digest.alias("id"), "question", F.col("table_ids").alias("table_id_lst"), F.coalesce("answers", F.array().cast("array<string>")).alias("answers"), none.alias("ctxs"))


def sql_tokens(sql: Column) -> Column:
    """Lower-cased tokens: quoted literals whole, aggregates up to their closing bracket as one; unterminated: null."""
    text = F.lower(sql)
    found = F.regexp_extract_all(text, F.lit(r"'[^']*'|(?:count|sum|max|min|avg)\([^)]*\)|[^\s']+"), 0)
    quotes = F.length(text) - F.length(F.replace(text, F.lit("'"), F.lit("")))
    opens = F.size(F.regexp_extract_all(text, F.lit(r"(?:count|sum|max|min|avg)\([^)]*$"), 0))
    return F.when((quotes % 2 == 0) & (opens == 0), found)


def parsed_sql(sql: Column) -> Column:
    """struct(select, where) of `select x [from t] where ...`, lower-cased; null if it has no such shape."""
    text = F.lower(F.trim(sql))
    shape = r"^select\s+(.+?)(?:\s+from\s+(\S+))?\s+where\s+(.+)$"
    return F.when(text.rlike(shape), F.struct(*(F.regexp_extract(text, shape, i).alias(n) for i, n in ((1, "sel"), (2, "tbl"), (3, "cond")))))


def cycle_consistent(select_a: Column, where_a: Column, select_b: Column, where_b: Column) -> Column:
    """Whether two readings of a question agree: selected column and sorted condition columns, after normalization."""
    norm = lambda a: F.sort_array(F.transform(a, T.cell_key))
    return (T.cell_key(select_a) == T.cell_key(select_b)) & (norm(where_a) == norm(where_b))


def copies_text(question: Column, names: Column, values: Column) -> Column:
    """Column names and values of two words or more that the question repeats word for word."""
    q = T.cell_key(question)
    has = lambda a: F.filter(a, lambda x: (x != "") & F.contains(q, T.cell_key(x)))
    return F.concat(has(names), has(F.filter(values, lambda v: F.size(F.split(T.strip(v), r"\s+")) >= 2)))


def label_row_cut(rows: DataFrame, labels: DataFrame, most: int = 10) -> DataFrame:
    """(table_id, row, is_label): labelled rows (table_id, row) first, filled up with the lowest others."""
    both = rows.select("table_id", "row").join(labels.select("table_id", "row", F.lit(1).alias("is_label")).distinct(), ["table_id", "row"], "left").withColumn("is_label", F.coalesce("is_label", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc("is_label"), "row"))
    return both.withColumn("k", place).filter(F.col("k") <= most).drop("k")


def offset_map(coded: DataFrame, base: DataFrame) -> DataFrame:
    """(qid, offsets): for each coded passage of a question, the base passages that hold rows of it."""
    met = coded.select("qid", F.col("p_id").alias("of"), F.explode("rows").alias("row")).join(base.select("qid", F.col("p_id").alias("base"), F.explode("rows").alias("row")), ["qid", "row"])
    each = met.groupBy("qid", "of").agg(F.sort_array(F.collect_set("base")).alias("bases"))
    return each.groupBy("qid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("of").cast("string"), "bases")))).alias("offsets"))


def special_tokens(passages: DataFrame) -> DataFrame:
    return passages.select(F.explode("special_tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def best_epochs(losses: DataFrame, patience: int = 3) -> DataFrame:
    """losses (run, step, loss) with best (so far), streak (steps since it) and stopped."""
    w = Window.partitionBy("run").orderBy("step")
    best = F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, 0))
    at = F.max(F.when(F.col("loss") == F.col("best"), F.col("step"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return losses.withColumn("best", best).withColumn("streak", F.col("step") - at).withColumn("stopped", F.col("streak") >= patience)
