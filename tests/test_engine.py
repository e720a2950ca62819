"""Serialization, packing, sources and evaluation on small tables."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from gridscribe.functions import text as T
from gridscribe.operators import agree as A, cells as O, packing as P, prompts as M, questions as Q, retrieval as R
from gridscribe.plans import strategies as S
from gridscribe.plans.staging import numbered
from gridscribe.sources import tables as X


def size(text):
    return len(re.findall(r"\[sep\]|\[[ec][0-9]+\]|[^\W_]+|[^\s\w]|_", text.lower()))


def make(spark, grid, names, title="t"):
    doc = {"tableId": title, "documentTitle": title, "columns": [{"text": n} for n in names], "rows": [{"cells": [{"text": c} for c in r]} for r in grid]}
    docs = spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.from_json("j", X.TABLE).alias("d")).select("d.*")
    return X.from_documents(docs)


@pytest.fixture(scope="module")
def grid():
    rng = random.Random(4)
    words = [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(n)) for n in (1, 2, 3, 4, 6, 9, 0)]
    return [[rng.choice(words), rng.choice(words), str(i), rng.choice(words[3:5])] for i in range(160)], ["name of it", "kind", "n", "long text"]


@pytest.mark.parametrize("strategy", S.STRATEGIES)
def test_passages_are_sized_bounded_and_cover_every_cell(spark, grid, strategy):
    rows, names = grid
    out = S.serialize(make(spark, rows, names), strategy).collect()
    assert all(r["size"] <= T.WINDOW and r["rows"] and r["passage"] for r in out)
    if strategy != "cpr_scm":
        assert [r["size"] for r in out] == [size(r["passage"]) for r in out]
    else:
        assert [r["size"] for r in out] == [size(r["scm_passage"]) for r in out] and all(size(r["passage"]) <= r["size"] for r in out)
    cells = sorted((r, c) for p in out for r, cols in zip(p["rows"], p["cols"], strict=True) for c in cols)
    assert cells == [(r, c) for r in range(len(rows)) for c in range(len(names))]
    if strategy == "compress":
        assert any(r["special_tokens"] for r in out)


def test_unknown_strategy_fails_on_the_driver(spark, grid):
    with pytest.raises(ValueError, match="unknown strategy"):
        S.serialize(make(spark, *grid), "zip")


def decode(passage):
    codes = dict(re.findall(r"(\[[EC]\d+\]) is (.*?) \[SEP\] ", passage))
    body = passage
    for code, text in codes.items():
        body = body.replace(f"{code} is {text} [SEP] ", "")
    for code, text in codes.items():
        body = body.replace(code, text)
    return body


def test_compressed_passages_decode_to_plain_ones(spark, grid):
    out = S.serialize(make(spark, *grid), "cpr_scm").collect()
    assert all(decode(r["passage"]) == r["scm_passage"] for r in out)


def test_windows_are_greedy_and_cost_is_closed_form(spark, grid):
    rows, names = grid
    tables = make(spark, rows, names)
    out = sorted(S.serialize(tables, "compress").collect(), key=lambda r: r["window_id"])
    cells = {(r["row"], r["col"]): (r["key"], r["size"]) for r in O.canonical(tables.rows).collect()}
    header = sum(size(n) + 1 for n in names)

    def cost(ids):
        count, width = {}, {}
        for r in ids:
            for c in range(len(names)):
                k, x = cells[r, c]
                count[k], width[k] = count.get(k, 0) + 1, x
        return header + len(ids) * 2 + len(ids) * len(names) + sum(min(width[k] * y, width[k] + y + 3) for k, y in count.items())

    for r, after in zip(out, [*out[1:], None], strict=True):
        assert r["size"] == cost(r["rows"])
        if after:
            assert cost([*r["rows"], after["rows"][0]]) > T.WINDOW


def test_break_even_table():
    least = {x: next((y for y in range(1, 100) if P.Coded.cost(x, y) < x * y), None) for x in range(1, 9)}
    assert least == {1: None, 2: 6, 3: 4, 4: 3, 5: 3, 6: 2, 7: 2, 8: 2}


def test_wide_rows_are_split_by_columns(spark):
    names = [f"c{i}" for i in range(40)]
    tables = make(spark, [[" ".join(f"w{j}x{i}" for j in range(20)) for i in range(40)]], names)
    for strategy in ("compress", "block", "schema_cell_coding"):
        out = S.serialize(tables, strategy).collect()
        assert all(r["size"] <= T.WINDOW for r in out)
        assert sorted(c for r in out for cols in r["cols"] for c in cols) == list(range(40))


def test_first_spelling_wins_and_limits(spark):
    tables = make(spark, [["Foo", "a " * 40], [" foo ", "a " * 30], ["FOO", ""], ["", "b c"]], ["x", "y"])
    got = {(r["row"], r["col"]): (r["text"], r["size"]) for r in O.canonical(tables.rows).collect()}
    assert [got[i, 0] for i in range(4)] == [("Foo", 1), ("Foo", 1), ("Foo", 1), ("", 0)]
    assert got[0, 1] == got[1, 1] == (" ".join(["a"] * 30), 30) and got[3, 1] == ("b c", 2)


@pytest.mark.parametrize(("text", "kind"), [("-1abc", "INT"), ("1.", None), (".5", None), ("1.5", "FLOAT"), ("+1.0", "INT"), ("-1.5", "INT"), ("T", "BOOL"), (" 12 ", "INT"), ("MULTIPOLYGON (((1.0 2.0)))", "POLYGON"), ("MULTIPOLYGON (((-1.0 2.0)))", None), ("", None)])
def test_cell_types(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(T.infer_type(F.col("t"))).first()[0] == kind


def test_column_types(spark):
    tables = make(spark, [["1", "x", "t"], ["2.5", "1", "1"], ["3", "2", "f"], ["4", "y", "true"], ["1.5", "z", "2"]], ["a", "b", "c"])
    assert {r["col"]: r["type"] for r in O.column_types(tables.rows, tables.columns).collect()} == {0: "INT", 1: None, 2: "BOOL"}


def test_hash_slot_is_sha256_mod_n(spark):
    import hashlib

    for key, n in (("abc", 7), ("ä", 1000), ("x y", 1)):
        got = spark.createDataFrame([(key,)], "k string").select(T.hash_slot(F.col("k"), F.lit(n))).first()[0]
        assert got == int.from_bytes(hashlib.sha256(key.encode()).digest(), "big") % n


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = {r["row"]: r["v"] for r in numbered(df, ["v"]).collect()}
    assert got == {i: i for i in range(1000)}
    assert numbered(df.limit(0), ["v"]).count() == 0


def test_empty_tables(spark):
    tables = make(spark, [], ["a", "b"])
    for strategy in S.STRATEGIES:
        assert S.serialize(tables, strategy).count() == 0


def test_agree_sets_by_hand(spark):
    tables = make(spark, [["a", "x", "1"], ["a", "x", "2"], ["a", "y", "3"], ["b", "y", "4"]], ["p", "q", "r"])
    found = A.pairs(O.canonical(tables.rows))
    assert {(r["a"], r["b"]): r["cols"] for r in found.collect()} == {(0, 1): [0, 1], (0, 2): [0], (1, 2): [0], (2, 3): [1]}
    picks = {r["pick"]: (r["cols"], r["rows"]) for r in A.best_sets(found).collect()}
    assert picks[0] == ([0, 1], [0, 1]) and picks[1] == ([1], [2, 3]) and len(picks) == 2


def test_decompressed_equals_one_row_passages(spark, grid):
    tables = make(spark, *grid)
    a = {r["passage"] for r in S.decompressed(tables, S.serialize(tables, "compress")).collect()}
    assert a == {r["passage"] for r in S.serialize(tables, "1_row_block").collect()}


def test_json_round_trip_and_stream(spark, grid, tmp_path):
    from gridscribe.streaming.incremental import serialize_stream

    tables = make(spark, *grid)
    X.write_tables(tables, str(tmp_path / "t"))
    again = X.read_tables(spark, str(tmp_path / "t"))
    assert sorted(map(str, again.rows.collect())) == sorted(map(str, tables.rows.collect()))
    want = sorted(r["passage"] for r in S.serialize(tables, "schema").collect())
    for _ in range(2):  # the second run finds nothing new
        serialize_stream(spark, str(tmp_path / "t"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
        assert sorted(r["passage"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    p = P.with_passage_ids(S.serialize(tables, "compress"))
    X.write_passages(p, str(tmp_path / "p"))
    got = X.read_passages(spark, str(tmp_path / "p")).orderBy("p_id").collect()
    assert [r["p_id"] for r in got] == list(range(len(got))) and got[0]["tag"]["table_id"] == "t"


def test_labels_headers_and_metadata(spark, tmp_path):
    (tmp_path / "l.csv").write_text('a,b,c\n"t1\nt2","who, ""is"" it?","ok\n3, 5"\nt3, ,2\n')
    rows = X.read_labels(spark, str(tmp_path / "l.csv")).select("table_ids", "question", F.transform("grid", X.grid_rows).alias("g")).collect()
    assert [(r["table_ids"], r["question"], r["g"]) for r in rows] == [(["t1", "t2"], 'who, "is" it?', [[], [1, 3]])]
    assert X.csv_header(spark, str(tmp_path / "l.csv")) == ["a", "b", "c"]
    meta = [{"resource": {"id": "x", "name": "X", "type": "dataset", "columns_field_name": ["f", "g"], "columns_name": ["F F", "G"]}}, {"resource": {"id": "y", "name": "Y", "type": "map", "columns_field_name": [], "columns_name": []}}]
    (tmp_path / "m.json").write_text(json.dumps(meta))
    heads = spark.createDataFrame([("x", ["g", "f"]), ("z", ["f"]), ("x", ["nope"])], "table_id string, fields array<string>")
    good, bad = X.header_meta(heads, X.read_metadata(spark, str(tmp_path / "m.json")))
    assert [(r["title"], r["col_names"]) for r in good.collect()] == [("X", ["g", "f f"])] and bad.count() == 2


def test_top_tables_walk(spark):
    rng = random.Random(1)
    runs = [(q, i, rng.choice("abcdef")) for q in range(40) for i in range(rng.randint(1, 12))]
    got = {}
    for r in R.top_passages(spark.createDataFrame(runs, "qid int, rank int, table_id string"), 2).collect():
        got.setdefault(r["qid"], []).append(r["rank"])
    for q in range(40):
        seen, want = [], []
        for _, i, t in sorted(x for x in runs if x[0] == q):
            if t not in seen and len(seen) == 2:
                break
            seen += [t] * (t not in seen)
            want.append(i)
        assert sorted(got[q]) == want
    gold = spark.createDataFrame([(0, ["a"]), (99, ["a"])], "qid int, table_ids array<string>")
    assert {r["qid"]: r["hit"] for r in R.hits(spark.createDataFrame(runs, "qid int, rank int, table_id string"), gold, 6).collect()}[99] == 0


def test_questions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(Q.sql_tokens(F.lit("Select Max(a b) where c = 'x Y'"))) == ["select", "max(a b)", "where", "c", "=", "'x y'"]
    assert one(Q.sql_tokens(F.lit("select 'x"))) is None and one(Q.sql_tokens(F.lit("select max(a"))) is None
    assert tuple(one(Q.parsed_sql(F.lit("SELECT a FROM t WHERE b = 1")))) == ("a", "t", "b = 1") and one(Q.parsed_sql(F.lit("select a"))) is None
    assert [one(T.column_letters(F.lit(n))) for n in (0, 1, 26, 27, 702, 703, 18278, 18279)] == ["", "A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA"]
    assert P.first_fit([4, 3, 2, 5, 9], 6) == [0, 1, 0, 2, 3]
    assert P.disjoint_sets([(frozenset({1, 2}), 2.0), (frozenset({2}), 1.5), (frozenset({3}), 1.0)]) == [1, 2]
    assert [T.next_prime(n) for n in (0, 4, 13, 14)] == [2, 5, 13, 17]


def test_prompts_take_bounded_rows_and_columns(spark):
    grid = [[f"r{i}c{j}" for j in range(60)] for i in range(25)]
    t = make(spark, grid, [f"n{j}" for j in range(60)])
    (row,) = M.table_prompts(t.rows, t.columns).collect()
    lines = row["prompt"].split("\n")
    names = lines[3].split(" | ")
    assert lines[0] == "Table Caption:" and len(names) == 50 and names[:5] == [f"n{j}" for j in range(5)] and len(set(names)) == 50
    body = [x.split(" | ") for x in lines[4:]]
    drawn = [int(x[0][1:].split("c")[0]) for x in body]
    assert len(body) == 10 and drawn == sorted(set(drawn)) and all(x == [f"r{i}c{n[1:]}" for n in names] for i, x in zip(drawn, body, strict=True))
    assert M.table_prompts(t.rows.limit(0), t.columns).first()["prompt"].split("\n")[3:] == [" | ".join(names)]


def test_answers_samples_and_pools(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    text = "1. a. b\nx. y\n2 | Tag: q \n\n3 | z"
    assert [tuple(x) for x in one(M.answer_lines(F.lit(text)))] == [(1, "a. b")]
    assert [tuple(x) for x in one(M.answer_lines(F.lit(text), "|", "Tag:"))] == [(2, "q")]
    assert one(M.answer_lines(F.lit(None).cast("string"))) == [] and one(M.answer_lines(F.lit(""))) == []
    assert one(M.mean_pool(F.expr("array(array(1f, 2f), array(3f, 6f), array(5f, 1f))"))) == [3.0, 3.0] and one(M.mean_pool(F.expr("array(array(1f, 2f))"))) == [1.0, 2.0]
    assert one(M.mean_pool(F.expr("cast(array() as array<array<float>>)"))) is None
    ids = [r["id"] for r in M.sampled(spark.range(50), 7, "id").collect()]
    assert ids == sorted(range(50), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:7] and M.sampled(spark.range(3), 7, "id").count() == 3
    q = spark.createDataFrame([("t", "T", 9, "| why ?", 0, 26, [0, 27]), ("t", "T", 4, "who", 3, 0, [])], "table_id string, title string, id int, question string, row int, sel_col int, where_cols array<int>")
    assert [tuple(r) for r in M.question_sheet(q).orderBy("q_no").collect()] == [("t", "T", 1, "who", 3, 5, 0, "A", "", ""), ("t", "T", 2, "why ?", 0, 2, 26, "AA", "0 , 27", "A , AB")]
    rows = spark.createDataFrame([("t", 0, ["a", "b", "c"]), ("t", 1, ["d", "e"])], "table_id string, row int, cells array<string>")
    p = spark.createDataFrame([(5, "t", [1, 0], [[2, 0], [0]])], "p_id long, table_id string, rows array<int>, cols array<array<int>>")
    assert [tuple(r) for r in M.passage_tables(p, rows).orderBy("at").collect()] == [(5, "t", 1, 0, ["", "d"]), (5, "t", 0, 1, ["c", "a"])]
