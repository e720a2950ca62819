"""Registry of the engine's queries, each over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscribe.functions import text as T
from gridscribe.functions.registered import register
from gridscribe.operators import agree as A, cells as O, packing as P, prompts as M, questions as Q, retrieval as R
from gridscribe.plans import strategies as S
from gridscribe.plans.oracle import ORACLE  # noqa: F401
from gridscribe.plans.staging import written
from gridscribe.sources import sinks as K
from gridscribe.sources.tables import TableSet, from_relation, grid_rows, relation, short_name

NAMES = ("nation", "supplier", "customer", "part", "orders")


def tables(spark: SparkSession, sf_dir: str, *names: str, ordered: bool = True) -> TableSet:
    out = None
    for name in names:
        one = from_relation(relation(spark, sf_dir, name), name, ordered)
        out = one if out is None else TableSet(out.rows.unionByName(one.rows), out.columns.unionByName(one.columns))
    return out


def canonical(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return O.canonical(tables(spark, sf_dir, *names).rows)


def _documents(spark, d):
    return relation(spark, d, "documents")


def cell_keys(spark, d):
    return _documents(spark, d).select("doc_id", F.md5(T.cell_key(F.col("text"))).alias("key_md5"))


def token_sizes(spark, d):
    return _documents(spark, d).select("doc_id", T.token_size(F.col("text")).cast("long").alias("n_tokens"))


def truncated_cells(spark, d):
    text, size = T.truncated(T.strip(F.col("text")), T.CELL_MAX)
    return _documents(spark, d).select("doc_id", text.alias("text"), size.cast("long").alias("size"))


def canonical_cells(spark, d):
    return canonical(spark, d, "part").select("table_id", "row", "col", "key", "text", F.col("size").cast("long").alias("size"))


def cell_type_inference(spark, d):
    return O.cell_types(tables(spark, d, "events", ordered=False).rows).groupBy("col", "type").agg(F.count("*").alias("n"))


def column_type_inference(spark, d):
    t = tables(spark, d, "events", "orders", "lineitem")
    return O.column_types(t.rows, t.columns)


def numeric_columns(spark, d):
    t = tables(spark, d, "part", "customer", "orders")
    return O.numeric_columns(O.column_types(t.rows, t.columns))


def column_classes(spark, d):
    return O.classes(canonical(spark, d, "orders", "part")).select("table_id", "col", "key", F.col("class_id").cast("long").alias("class_id"), "n")


def column_weights(spark, d):
    return O.column_weights(canonical(spark, d, "orders", "part"))


def max_weight_column(spark, d):
    return O.max_weight_column(canonical(spark, d, "orders", "part", "customer"))


def hash_bins(spark, d):
    return O.hash_bins(canonical(spark, d, "customer"))


def bin_gain(spark, d):
    cells = written(canonical(spark, d, "part"), "cells")
    return O.bin_gains(cells, O.hash_bins(cells))


def bin_ranking(spark, d):
    return O.bin_order(bin_gain(spark, d)).select("table_id", "col", "slot", F.col("bin_rank").cast("long").alias("bin_rank"))


def compress_row_order(spark, d):
    t = tables(spark, d, "part")
    cells = written(O.canonical(t.rows), "cells")
    bins = written(O.hash_bins(cells), "bins")
    return O.row_order(t.rows, bins, O.bin_order(O.bin_gains(cells, bins))).select("table_id", "row", F.col("ord").cast("long").alias("ord"))


def schema_blocks(spark, d):
    blocks = O.schema_blocks(tables(spark, d, "nation", "supplier", "customer", "part", "orders", "lineitem", "events").columns, budget=10)
    return blocks.select("table_id", "block_id", F.concat_ws(",", F.transform("cols", lambda c: c.cast("string"))).alias("cols"), "header", F.col("header_size").cast("long").alias("header_size"))


def first_fit_bins(spark, d):
    heads = O.headers(tables(spark, d, "orders", "lineitem", "part").columns)
    return P.first_fit_bins(heads.select("table_id", F.col("col").alias("ord"), F.col("size")), 3)


def block_cells(spark, d):
    t = tables(spark, d, "supplier")
    rows = O.packed_rows(t.rows, O.schema_blocks(t.columns, 1 << 30))
    last = F.size("cells") - 1
    part = F.transform("cells", lambda c, i: F.struct(i.alias("i"), F.concat(F.when(i == 0, F.concat("title", F.lit(" [SEP]"))).otherwise(F.lit("")), F.get("names", i), F.lit(" : "), c["text"], F.lit(" "), F.when(i == last, "[SEP]").otherwise(";"), F.lit(" ")).alias("text"), (F.when(i == 0, F.col("title_size") + 1).otherwise(0) + F.get("name_sizes", i) + 1 + c["size"] + 1).alias("size")))
    return rows.select("table_id", "row", F.explode(part).alias("p")).select("table_id", "row", F.col("p.i").alias("col"), F.col("p.text").alias("text"), F.col("p.size").cast("long").alias("size"))


def _plain(passages: DataFrame) -> DataFrame:
    ints = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return passages.select("table_id", F.col("block_id").cast("long").alias("block_id"), F.col("window_id").cast("long").alias("window_id"), "passage", F.col("size").cast("long").alias("size"), ints("rows").alias("rows"))


def one_row_passages(spark, d):
    return _plain(S.serialize(tables(spark, d, "nation", "supplier"), "1_row_block"))


def block_passages(spark, d):
    return _plain(S.serialize(tables(spark, d, "supplier"), "block"))


def schema_windows(spark, d):
    rows = S.schema_rows(tables(spark, d, "lineitem"))
    return P.windows(rows).groupBy("window_id").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count("*").alias("n"))


def schema_passages(spark, d):
    p = P.with_passage_ids(S.serialize(tables(spark, d, "orders"), "schema"))
    return _plain(p).join(p.select("block_id", "window_id", "p_id"), ["block_id", "window_id"])


def compress_passages(spark, d):
    return _plain(S.serialize(tables(spark, d, "part", "orders"), "compress"))


def compress_window_cost(spark, d):
    """What dictionary coding would cost in the windows of the plain strategy, in closed form."""
    t = tables(spark, d, "orders")
    rows = S.schema_rows(t)
    cells = O.canonical(t.rows).join(P.windows(rows).select("table_id", "row", "window_id"), ["table_id", "row"])
    keys = cells.groupBy("window_id", "key").agg(F.count("*").alias("y"), F.max("size").alias("x"))
    return keys.groupBy("window_id").agg(F.sum(T.coded_cost(F.col("x"), F.col("y"))).cast("long").alias("coded"), F.sum(F.col("x") * F.col("y")).cast("long").alias("plain"), F.sum("y").alias("n_cells"))


def schema_cell_coding_passages(spark, d):
    return _plain(S.serialize(tables(spark, d, "part"), "schema_cell_coding"))


def schema_coding_passages(spark, d):
    return _plain(S.serialize(tables(spark, d, "part"), "schema_coding"))


def cpr_scm_pairs(spark, d):
    return S.serialize(tables(spark, d, "part"), "cpr_scm").select("table_id", "block_id", "window_id", "passage", "scm_passage", "size")


def code_entries(spark, d):
    return S.code_entries(S.serialize(tables(spark, d, "part"), "compress"))


def decompressed_passages(spark, d):
    t = tables(spark, d, "part")
    return _plain(S.decompressed(t, S.serialize(t, "compress")))


def agree_pairs(spark, d):
    p = A.pairs(canonical(spark, d, "supplier", "customer"))
    return p.select("table_id", "a", "b", F.concat_ws(",", F.transform("cols", lambda c: c.cast("string"))).alias("cols"))


def agree_sets(spark, d):
    p = A.sets(A.pairs(canonical(spark, d, "supplier", "customer")))
    return p.select("table_id", F.concat_ws(",", F.transform("cols", lambda c: c.cast("string"))).alias("cols"), F.size("rows").cast("long").alias("n_rows"), F.col("weight").cast("long").alias("weight"))


def agree_index(spark, d):
    cells = canonical(spark, d, "customer")
    return A.row_order(A.indexed(cells, A.best_sets(A.pairs(cells))))


def agree_passages(spark, d):
    return _plain(S.serialize(tables(spark, d, "customer"), "agree_coding"))


def strategy_stats(spark, d):
    return S.schema_counts(tables(spark, d, *NAMES))


def compression_ratio(spark, d):
    t = tables(spark, d, *NAMES)
    return S.compression_ratio(S.schema_counts(t), S.compress_counts(t))


def ratio_sorted(spark, d):
    return S.ratio_sorted(compression_ratio(spark, d)).select("table_id", "ratio", "place")


def merged_passages(spark, d):
    """Coded passages with global ids, and the ids of the base passages that show their rows."""
    t = tables(spark, d, "part")
    coded, _ = K.merged(S.serialize(t, "compress"), S.serialize(t, "1_row_block"))
    return coded.select("p_id", "table_id", F.concat_ws(",", F.transform("base_p_ids", lambda x: x.cast("string"))).alias("base_p_ids"))


def ratio_histogram(spark, d):
    return S.ratio_histogram(compression_ratio(spark, d))


def _vectors(spark, d):
    return relation(spark, d, "embeddings").select(F.col("vec_id").alias("p_id"), F.col("embedding").alias("emb"), F.col("label").cast("string").alias("table_id"))


def _asked(spark, d):
    """Queries: every vector whose id is divisible by 100."""
    v = _vectors(spark, d).filter("p_id % 100 = 0")
    return v.select(F.col("p_id").alias("qid"), F.col("emb").alias("q")), v.select(F.col("p_id").alias("qid"), F.array("table_id").alias("table_ids"))


def _run(spark, d, k):
    return R.knn(_asked(spark, d)[0], _vectors(spark, d), k)


def knn_exact(spark, d):
    return _run(spark, d, 5).select("qid", "p_id", "score", F.col("rank").cast("long").alias("rank"))


def top_tables(spark, d):
    return R.top_passages(_run(spark, d, 40), 3).select("qid", "p_id", F.col("tbl_pos").cast("long").alias("tbl_pos"))


def hit_at_n(spark, d):
    return R.hit_rate(R.hits(_run(spark, d, 40), _asked(spark, d)[1], 3))


def run_flat(spark, d):
    return R.flat(_run(spark, d, 10), _asked(spark, d)[1]).select("qid", F.col("rank").cast("long").alias("rank"), "table_id", F.col("correct").cast("long").alias("correct"))


def run_confusion(spark, d):
    run, gold = _run(spark, d, 40), _asked(spark, d)[1]
    return R.confusion(R.hits(run, gold, 1), R.hits(run, gold, 5))


def joinable_values(spark, d):
    t = tables(spark, d, "nation", "supplier", "customer", "part", "orders", "lineitem", ordered=False)
    return Q.joinable_values(t.rows, t.columns).select("col_key", "key", F.concat_ws(",", "table_ids").alias("table_ids"))


def _templates(spark, d):
    t = tables(spark, d, "orders", "lineitem")
    return Q.sql_templates(t.rows, t.columns, O.column_types(t.rows, t.columns)), t.rows


def sql_templates(spark, d):
    each = lambda name: F.array_join(F.transform("conditions", lambda c: F.coalesce(c[name].cast("string"), F.lit(""))), "~")
    return _templates(spark, d)[0].select("table_id", "id", "row", "sel_col", "aggregate", *(each(n).alias(n) for n in ("col", "op", "value", "value_2")), "sql")


def template_results(spark, d):
    return Q.template_results(*_templates(spark, d))


def paraphrase_columns(spark, d):
    cols = Q.paraphrase_columns(F.col("sel_col"), F.col("conditions"))
    return _templates(spark, d)[0].select("table_id", "id", F.array_join(F.transform(cols, lambda c: c.cast("string")), ",").alias("cols"))


def _sql_text(spark, d):
    c = relation(spark, d, "customer")
    quoted = F.concat(F.lit("SELECT Count(c_name) WHERE c_mktsegment = '"), "c_mktsegment", F.lit(" x' and c_custkey > "), F.col("c_custkey").cast("string"), F.when(F.col("c_nationkey") == 3, "'").otherwise(""))
    return c.select("c_custkey", quoted.alias("sql"))


def sql_tokens(spark, d):
    return _sql_text(spark, d).select("c_custkey", F.array_join(Q.sql_tokens(F.col("sql")), "~").alias("tokens"))


def sql_parse(spark, d):
    return _sql_text(spark, d).select("c_custkey", Q.parsed_sql(F.col("sql")).alias("p")).select("c_custkey", F.col("p.sel").alias("sel"), F.col("p.cond").alias("cond"))


def cycle_consistency(spark, d):
    c = relation(spark, d, "customer")
    back = F.array(F.upper("c_mktsegment"), F.lit(" c_name "))
    ok = Q.cycle_consistent(F.col("c_name"), F.array(F.lit("c_name"), F.col("c_mktsegment")), F.when(F.col("c_nationkey") < 5, F.lit("?")).otherwise(F.upper("c_name")), back)
    return c.select("c_custkey", ok.alias("consistent"))


def copy_check(spark, d):
    p = relation(spark, d, "part")
    question = F.concat(F.lit("Which Brand has "), "p_type", F.lit(" of "), F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.lit("any name")))
    found = Q.copies_text(question, F.array(F.lit("brand"), F.lit("retailprice")), F.array(F.col("p_type"), F.col("p_name")))
    return p.select("p_partkey", F.array_join(found, "~").alias("copied"))


def col_letters(spark, d):
    return relation(spark, d, "part").select("p_partkey", T.column_letters(F.col("p_partkey")).alias("letters"))


def grid_row_lists(spark, d):
    listed = F.when(F.col("l_linenumber") == 1, "ok").otherwise(F.concat((F.col("l_orderkey") + 2).cast("string"), F.lit(", "), (F.col("l_linenumber") + 2).cast("string")))
    return relation(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(",", F.transform(grid_rows(listed), lambda x: x.cast("string"))).alias("rows"))


def label_row_cut(spark, d):
    rows = relation(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("table_id"), F.col("doc_id").alias("row"))
    bad = relation(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("row")).distinct()
    return Q.label_row_cut(rows, rows.join(bad, "row")).withColumn("is_label", F.col("is_label").cast("long"))


def split_by_table(spark, d):
    return Q.split_by_table(relation(spark, d, "documents").select(F.col("doc_id").alias("table_id")))


def split_by_passage(spark, d):
    return Q.split_rows(_vectors(spark, d), "p_id")


def hard_negatives(spark, d):
    v = _vectors(spark, d).select("p_id", "table_id")
    return Q.hard_negatives(v.withColumnRenamed("p_id", "qid"), v)


def query_records(spark, d):
    p = relation(spark, d, "part")
    asked = p.select(F.concat(F.lit("Which is "), "p_name", F.lit("?")).alias("question"), F.array("p_brand", "p_type").alias("table_ids"), F.array(F.col("p_partkey").cast("string")).alias("answers"))
    return Q.query_records(asked).select("id", "question", F.array_join("table_id_lst", "~").alias("table_ids"), F.array_join("answers", "~").alias("answers"))


def _offsets(spark, d):
    rows = relation(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("n"), F.array("l_linenumber").alias("rows"))
    coded = rows.groupBy("qid", F.floor(F.col("n") / 3).alias("p_id")).agg(F.sort_array(F.collect_set("n")).alias("rows"))
    return Q.offset_map(coded, rows.select("qid", F.col("n").alias("p_id"), "rows").distinct())


def base_offset_map(spark, d):
    return _offsets(spark, d).select("qid", F.array_join(F.transform(F.map_entries("offsets"), lambda e: F.concat(e["key"], F.lit(":"), F.concat_ws(",", F.transform(e["value"], lambda v: v.cast("string"))))), ";").alias("offsets"))


def offset_pick(spark, d):
    return Q.offset_pick(_offsets(spark, d))


def base_samples(spark, d):
    pairs = _offsets(spark, d).select("qid", F.explode("offsets").alias("p_id", "bases"))
    return Q.base_samples(pairs, 2).withColumn("n", F.col("n").cast("long"))


def special_tokens(spark, d):
    return Q.special_tokens(S.serialize(tables(spark, d, "part"), "compress"))


def _batch_scores(spark, d, how=R.minus_squared_distance, shift=0):
    """In-batch scores: every vector against all passages of its batch of 500."""
    v = _vectors(spark, d)
    q = v.select(F.col("p_id").alias("qid"), F.col("emb").alias("q"), F.floor(F.col("p_id") / 500).alias("batch"))
    p = v.select("p_id", "emb", F.floor(F.col("p_id") / 500).alias("batch"))
    return q.join(p, "batch").select("qid", "p_id", F.round(how(F.col("q"), F.col("emb")) + shift, 6).alias("score"))


def inbatch_scores(spark, d):
    return _batch_scores(spark, d)


def inbatch_nll(spark, d):
    s = _batch_scores(spark, d)
    return R.nll(s, s.select("qid", F.col("qid").alias("p_id")).distinct())


def kl_distill(spark, d):
    return R.distill(_batch_scores(spark, d), _batch_scores(spark, d, R.inner), 3.0)


def distill_loss(spark, d):
    student = _batch_scores(spark, d)
    return R.distill_loss(student, _batch_scores(spark, d, R.inner), student.select("qid", F.col("qid").alias("p_id")).distinct())


def best_epochs(spark, d):
    losses = relation(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step"), F.col("l_extendedprice").alias("loss"))
    return Q.best_epochs(losses.groupBy("run", "step").agg(F.min("loss").alias("loss"))).select("run", "step", "best", F.col("streak").cast("long").alias("streak"), "stopped")


def table_prompts(spark, d):
    t = tables(spark, d, *NAMES)
    return M.table_prompts(t.rows, t.columns)


def answer_lines(spark, d):
    p = relation(spark, d, "part")
    answer = F.concat(F.lit("Sure:\n"), F.col("p_size").cast("string"), F.lit(". What is "), "p_name", F.lit(" ?\nno number. here\n7 | "), "p_brand", F.lit(" Paraphrased(Begin Tag):  "), "p_type", F.lit(" \n8 | untagged"))
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat(x["no"].cast("string"), F.lit("="), x["text"])), "~")
    return p.select("p_partkey", listed(M.answer_lines(answer)).alias("plain"), listed(M.answer_lines(answer, "|", "Paraphrased(Begin Tag):")).alias("tagged"))


def question_sheet(spark, d):
    q = _templates(spark, d)[0].select("table_id", F.col("table_id").alias("title"), "id", F.concat(F.when(F.col("id") % 2 == 0, F.lit("| ")).otherwise(F.lit("")), "sql").alias("question"), "row", "sel_col", F.transform("conditions", lambda c: c["col"]).alias("where_cols"))
    return M.question_sheet(q)


def sample_passages(spark, d):
    return M.sampled(_documents(spark, d).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")), 100, "doc_id")


def passage_tables(spark, d):
    t = tables(spark, d, "part")
    p = P.with_passage_ids(S.serialize(t, "compress"))
    return M.passage_tables(p, t.rows).select("table_id", "row", F.array_join("cells", "~").alias("cells"))


def mean_pool(spark, d):
    v = relation(spark, d, "embeddings")
    half = F.floor(F.size("embedding") / 2).cast("int")
    pooled = M.mean_pool(F.array(F.slice("embedding", F.lit(1), half), F.slice("embedding", half + 1, half)))
    return v.select("vec_id", F.posexplode(pooled).alias("at", "x")).select("vec_id", F.col("at").cast("long").alias("at"), F.round("x", 6).alias("x"))


def wrapped_texts(spark, d):
    text, size = T.wrap_text(F.col("p_name"))
    return relation(spark, d, "part").select("p_partkey", text.alias("text"), size.cast("long").alias("size"))


def sql_functions(spark, d):
    """The registered functions, called from SQL."""
    register(spark)
    relation(spark, d, "part").createOrReplaceTempView("gs_part")
    return spark.sql(
        "SELECT p_partkey, gs_cell_key(concat(' ', p_name, ' ')) AS name_key, gs_token_size(p_type) AS size, array_join(gs_tokens(p_name), '~') AS tokens, gs_hash_slot(p_name, 1009) AS slot, "
        "gs_infer_cell_type(CAST(p_retailprice AS STRING)) AS price_type, gs_infer_cell_type(CAST(p_size AS STRING)) AS size_type, gs_code_cost(p_size, 3) AS cost FROM gs_part"
    )


_SKIP = {"register", "written", "tables", "canonical", "relation", "from_relation", "short_name", "grid_rows"}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and getattr(v, "__module__", "") == __name__ and k not in _SKIP}
