"""Plans that scale against brute force: retrieval, types, spellings, column units, negatives, sinks, SQL functions, staging."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscribe.functions import registered, text as T
from gridscribe.operators import agree as A, cells as O, packing as P, questions as Q, retrieval as R
from gridscribe.plans import staging, strategies as S
from gridscribe.sources import sinks as K, tables as X
from test_engine import make, size


@pytest.mark.parametrize(("k", "batch", "lanes"), [(3, 7, 4), (60, 1 << 16, 5)])
def test_knn_brute_force(spark, k, batch, lanes):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-3, 4, (50, 6)).astype(float)  # small integers: many ties
    rows = [(int(i), f"t{i % 4}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    passages = spark.createDataFrame(rows, "p_id long, table_id string, emb array<float>").repartition(3)
    asked = [(100 + i, [float(x) for x in v]) for i, v in enumerate(vectors[:12])]
    got = [(r["qid"], r["rank"], r["p_id"], r["table_id"], r["score"]) for r in R.knn(spark.createDataFrame(asked, "qid long, q array<float>"), passages, k, batch, lanes).collect()]
    want = []
    for q, v in asked:
        order = sorted(rows, key=lambda r: (-round(float(np.dot(v, r[2])), 6), r[0]))[:k]
        want += [(q, n + 1, r[0], r[1], round(float(np.dot(v, r[2])), 6)) for n, r in enumerate(order)]
    assert sorted(got) == sorted(want)
    assert R.knn(spark.createDataFrame(asked, "qid long, q array<float>").limit(0), passages, k).count() == 0
    assert R.knn(spark.createDataFrame(asked, "qid long, q array<float>"), passages.limit(0), k).count() == 0


def plain_type(x):
    x = x.strip()
    if x.lower() in ("true", "false", "t", "f"):
        return "BOOL"
    if re.match(r"[+-][0-9]|[0-9]+$", x):
        return "INT"
    if re.match(r"-?[0-9]+\.[0-9]+$", x):
        return "FLOAT"
    return "POLYGON" if re.match(r'(?i)"?multipolygon[(), .0-9]*"?$', x) else None


def test_column_types_over_spans(spark):
    rng = random.Random(3)
    grid = [[rng.choice(["1", "2.5", "x", "", "true"]), "" if i < 150 else "7", "w", "1.5" if i in (20, 90, 180) else "MULTIPOLYGON (((1.0 2.0)))" if i == 181 else "q"] for i in range(200)]
    t = make(spark, grid, ["a", "b", "c", "d"])
    want = {}
    for c in range(4):
        seen = {}
        for row in grid:
            kind = plain_type(row[c])
            seen[kind] = seen.get(kind, 0) + 1
            if kind and (seen[kind] == 3 or kind == "POLYGON"):
                want[c] = kind
                break
        want.setdefault(c, None)
    for span in (4096, 16):
        assert {r["col"]: r["type"] for r in O.column_types(t.rows, t.columns, span).collect()} == want


def test_first_spelling_of_a_key(spark, monkeypatch):
    grid = [["Foo bar", "x"], [" foo BAR ", "X"], ["other", "x"], ["FOO BAR", ""], ["w " * 40, "y"], ["W " * 40, "Y"]]
    t = make(spark, grid, ["a", "b"])
    for most in (100_000, 0):
        monkeypatch.setattr(O, "BROADCAST_ROWS", most)
        got = {(r["row"], r["col"]): (r["key"], r["text"], r["size"]) for r in O.canonical(t.rows).collect()}
        assert got[1, 0] == got[3, 0] == got[0, 0] == ("foo bar", "Foo bar", 2) and got[1, 1][1] == "x" and got[5, 1][1] == "y" and got[3, 1] == ("", "", 0)
        assert got[5, 0] == got[4, 0] and got[4, 0][1:] == (" ".join(["w"] * 30), 30) and len(got) == 12


def test_rows_with_several_spellings_are_packed_alike(spark):
    """Tables with and without several spellings, short rows: the same as taking all cells out."""
    a = make(spark, [["Foo", "x"], ["foo", "y"], ["FOO"], ["bar", "Y"]], ["p", "q"], "mixed")
    b = make(spark, [["one", "Two"], ["three"], ["", ""]], ["p", "q"], "plain")
    t = X.TableSet(a.rows.unionByName(b.rows), a.columns.unionByName(b.columns))
    cells = {}
    for r in O.canonical(t.rows).collect():
        cells.setdefault((r["table_id"], r["row"]), []).append((r["col"], r["text"], r["size"], r["key"]))
    for budget in (50, 2):
        blocks = O.schema_blocks(t.columns, budget)
        got = O.packed_rows(t.rows, blocks).collect()
        for r in got:
            assert [tuple(c) for c in r["cells"]] == [c for c in sorted(cells[r["table_id"], r["row"]]) if c[0] in r["cols"]]
        assert {(r["table_id"], r["row"], c["col"]) for r in got for c in r["cells"]} == {(*k, c[0]) for k, v in cells.items() for c in v}
        assert sum(len(r["cells"]) for r in got) == sum(len(v) for v in cells.values())


def test_column_units():
    assert A.units_of([1, 1, 1, 1], [1, 3], 50) == [([0], False), ([1, 3], True), ([2], False)]
    assert A.units_of([1, 1, 1], [], 50) == [([0], False), ([1], False), ([2], False)]
    assert A.units_of([3, 3, 3, 3], [0, 1, 2, 3], 10) == [([0, 1], True), ([2, 3], True)]
    assert A.unit_blocks([3, 3, 3, 3], [0, 1, 2, 3], 10) == [[[0, 1]], [[2, 3]]]
    assert A.unit_blocks([1, 1, 1, 1], [1, 3], 50) == [[[0], [1, 3], [2]]]
    for seed in range(200):
        rng = random.Random(seed)
        sizes = [rng.randint(1, 8) for _ in range(rng.randint(1, 12))]
        agreed = sorted(rng.sample(range(len(sizes)), rng.randint(0, len(sizes))))
        budget = rng.randint(9, 30)
        blocks = A.unit_blocks(sizes, agreed, budget)
        assert sorted(c for b in blocks for u in b for c in u) == list(range(len(sizes)))
        assert all(sum(sizes[c] + 1 for u in b for c in u) <= budget for b in blocks)
        assert all(sum(set(u) <= set(agreed) and len(u) > 1 for u in b) <= 1 and all(len(u) == 1 or set(u) <= set(agreed) for u in b) for b in blocks)


def test_agreed_columns_are_one_coded_cell(spark):
    grid = [["a long shared value", str(i), "another shared value", f"own {i}"] for i in range(30)] + [[f"p{i}", f"q{i}", f"r{i}", f"s{i}"] for i in range(4)]
    out = S.serialize(make(spark, grid, ["one", "two", "three", "four"]), "agree_coding").collect()
    first = min(out, key=lambda r: r["block_id"])
    assert "one & three | two | four [SEP]" in first["passage"] and "[E1] is a long shared value & another shared value [SEP]" in first["passage"]
    assert all(r["size"] == size(r["passage"]) <= T.WINDOW for r in out)
    assert sorted((r, c) for p in out for r, cols in zip(p["rows"], p["cols"], strict=True) for c in cols) == [(r, c) for r in range(34) for c in range(4)]


def test_negatives_come_from_all_passages(spark):
    passages = [(i, f"t{min(i // 10, 5)}") for i in range(400)]  # the last table holds most
    df = spark.createDataFrame(passages, "p_id long, table_id string")
    asked = spark.createDataFrame([(q, t) for q, t in enumerate(["t0", "t5", "none"] * 40)], "qid long, table_id string")
    table = dict(passages)
    got = {}
    for r in Q.hard_negatives(asked, df, 20).collect():
        got.setdefault(r["qid"], []).append((r["n"], r["p_id"]))
    for q in range(120):
        own = ["t0", "t5", "none"][q % 3]
        found = [p for _, p in sorted(got[q])]
        assert len(set(found)) == 20 and [n for n, _ in sorted(got[q])] == list(range(1, 21)) and all(table[p] != own for p in found)
    assert len({p for x in got.values() for _, p in x}) > 300  # no pool: nearly all have been drawn
    few = Q.hard_negatives(spark.createDataFrame([(1, "t5")], "qid long, table_id string"), df.filter("p_id < 53"), 80).collect()
    assert {r["p_id"] for r in few} == set(range(50)) and Q.hard_negatives(asked, df.filter("table_id = 't0'").limit(0)).count() == 0


def test_templates_hold_for_their_own_row(spark):
    """The conditions made from a row select that row; results are those of a plain evaluation."""
    rng = random.Random(5)
    grid = [[str(rng.randint(0, 20)), f"{rng.randint(0, 9)}.{rng.randint(0, 9)}", rng.choice(["x'y", "z", ""]), f"name {i}", "-3"] for i in range(60)]
    t = make(spark, grid, ["n", "d", "w", "name", "minus"])
    templates = Q.sql_templates(t.rows, t.columns, O.column_types(t.rows, t.columns), 40)
    results = {r["id"]: (r["n_rows"], r["result"]) for r in Q.template_results(templates, t.rows).collect()}
    kinds, ops = set(), set()

    def holds(c, row):
        v = row[c["col"]]
        if c["op"] == "=":
            return v == c["value"] or bool(re.match(Q.NUMBER, v) and re.match(Q.NUMBER, c["value"]) and float(v) == float(c["value"]))
        x = float(v) if re.match(Q.NUMBER, v) else None
        return x is not None and (x > float(c["value"]) if c["op"] == ">" else x < float(c["value"]) if c["op"] == "<" else float(c["value"]) - 1e-9 <= x <= float(c["value_2"]) + 1e-9)

    rows = templates.collect()
    assert len(rows) == 40 and sorted(map(str, rows)) == sorted(map(str, Q.sql_templates(t.rows, t.columns, O.column_types(t.rows, t.columns), 40, look_at=41).collect()))
    for r in rows:
        cols = [c["col"] for c in r["conditions"]]
        assert len(set([r["sel_col"], *cols])) == len(cols) + 1 <= 3 and all(grid[r["row"]][c] != "" for c in cols)
        assert all(f"{c['name']} {c['op']} " in r["sql"] for c in r["conditions"]) and r["sql"].count(" and ") >= len(cols) - 1
        met = [row for row in grid if all(holds(c, row) for c in r["conditions"])]
        assert results[r["id"]][0] == len(met)
        if r["aggregate"] == "max" and met:
            assert float(results[r["id"]][1]) == max(float(row[r["sel_col"]]) for row in met)
        ops.update(c["op"] for c in r["conditions"])
        kinds.add((r["aggregate"], len(cols)))
    assert ops == set(Q.OPS) and {a for a, _ in kinds} >= {"", "count", "max"} and {n for _, n in kinds} == {1, 2}


def test_chunked_windows_are_those_of_one_pass(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for table in ("a", "b", "c"):
        for block in (0, 1):
            window = used = held = 0
            for i in range(rng.choice([1, 40, 333])):
                n = rng.choice([1, 3, 8, 20, 21, 60])
                rows.append((table, block, i, i, n, 5))
                if held and used + n > 20:
                    window, used, held = window + 1, 0, 0
                used, held = used + n, held + 1
                want[table, block, i] = window
    df = spark.createDataFrame(rows, "table_id string, block_id int, row int, ord int, size int, fixed int")
    for chunk in (50, 7, 1):
        got = {(r["table_id"], r["block_id"], r["row"]): r["window_id"] for r in P.windows(df, 25, chunk).collect()}
        assert got == want, chunk
    assert P.windows(df.limit(0), 25).count() == 0


@pytest.mark.parametrize("kind", ["coded", "both", "paired", "rows"])
def test_chunked_passages_are_those_of_one_pass(spark, kind):
    rng = random.Random(11)
    words = [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(n)) for n in (1, 2, 4, 6, 9, 25)]
    grid = [[rng.choice(words) for _ in range(3)] + [str(i)] for i in range(260)]
    grid[100] = [f"{i} " * 29 for i in range(4)]
    t = make(spark, grid, ["a", "b", "c", "d"])
    fold = {
        "coded": lambda row: P.Coded(row, 90), "both": lambda row: P.Coded(row, 90, code_headers=True), "paired": lambda row: P.Paired(row, 140), "rows": lambda row: P.CellWindows(row, 60, True),
    }[kind]
    schema = P.PASSAGES + (", scm_passage string" if kind == "paired" else "")
    blocks = O.schema_blocks(t.columns)
    rows = staging.written(O.packed_rows(t.rows, blocks), "test")
    plain = lambda df: sorted(map(str, df.collect()))
    want = plain(P.folded(rows, fold, schema))
    assert len(want) > 20
    for chunk in (64, 13):
        assert plain(P.chunked(rows, fold, schema, chunk, 46)) == want, chunk
    with_gaps = rows.filter("row % 7 <> 3")
    assert plain(P.chunked(with_gaps, fold, schema, 64, 46)) == plain(P.folded(with_gaps, fold, schema))


@pytest.mark.parametrize("kind", ["coded", "both", "heads", "paired"])
def test_coded_rows_are_packed_as_arrays(spark, monkeypatch, kind):
    """Rows of like size, whose windows never fall in step: the fold took every row once for each possible begin."""
    grid = [["red green" if i % 3 else "Blue sky", f"{i // 4}.{i % 4}", "", "same words here", str(i)] for i in range(400)]
    t = make(spark, grid, ["a", "b two", "c", "d", "e"])
    options = {"coded": {}, "both": {"code_headers": True}, "heads": {"code_headers": True, "code_cells": False, "show_header": False}, "paired": {}}[kind]
    fold = lambda row: P.Paired(row, 140) if kind == "paired" else P.Coded(row, 120, **options)
    schema = P.PASSAGES + (", scm_passage string" if kind == "paired" else "")
    rows = staging.written(O.packed_rows(t.rows, O.schema_blocks(t.columns)), "test")
    want = sorted(map(str, P.folded(rows, fold, schema).collect()))
    assert sorted(map(str, P.chunked(rows, fold, schema, 64, 46).collect())) == want
    assert sum(r["n"] for r in P.chunked_counts(rows, fold, 64, 46).collect()) == len(want) > 20
    own = rows.orderBy("ord").toArrow().combine_chunks()
    state = fold(P._tuples(own.slice(0, 1))[0])
    assert P._told([], P._tuples(own), fold) == state.quick(own).told(0)
    assert P._told(P._tuples(own)[:40], P._tuples(own)[40:], fold) == state.quick(own).told(40)[::-1]
    monkeypatch.setattr(P.Coded, "delta", None)
    assert len(state.quick(own).told(40)) > 1
    wide = P.Coded(P._tuples(own.slice(0, 1))[0], 20)
    assert wide.quick(own) is None



def test_sinks(spark, tmp_path):
    grid = [[f"cell {i}", "shared text of a column", str(i)] for i in range(60)]
    t = make(spark, grid, ["a", "b", "c"])
    counts = S.passage_counts(S.serialize(t, "schema"))
    assert S.schema_counts(t).collect() == counts.collect()
    K.write_stat(counts, str(tmp_path / "stat"))
    assert K.read_stat(spark, str(tmp_path / "stat")).collect()[0]["count"] == counts.first()["count"]
    assert json.loads(K.stat_map(counts).first()["stat"]) == {"t": {"count": counts.first()["count"]}}
    pairs = P.with_passage_ids(S.serialize(t, "cpr_scm"))
    K.write_pair(pairs, str(tmp_path / "coded"), str(tmp_path / "plain"))
    coded, plain = (X.read_passages(spark, str(tmp_path / n)).orderBy("p_id").collect() for n in ("coded", "plain"))
    assert len(coded) == len(plain) and all(not r["tag"]["special_tokens"] for r in plain) and any(r["tag"]["special_tokens"] for r in coded) and plain[0]["passage"] != coded[0]["passage"]
    K.write_csv(spark.createDataFrame([(1, 'a "b", c', [1, 2])], "n int, t string, a array<int>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect() == [("1", 'a "b", c', "1 2")]
    K.export_tables(t, str(tmp_path / "tables"))
    assert spark.read.option("header", True).csv(str(tmp_path / "tables/rows")).filter("table_id = 't'").count() == 60
    K.write_embeddings(spark.range(10).select(F.col("id").alias("p_id"), F.array(F.lit(1.0)).alias("emb")).coalesce(1), str(tmp_path / "emb"), 4)
    assert len(list((tmp_path / "emb").glob("*.parquet"))) == 3
    K.write_queries(spark.createDataFrame([("q?", ["t"], None)], "question string, table_ids array<string>, answers array<string>"), str(tmp_path / "q"))
    record = spark.read.schema(X.RUN).json(str(tmp_path / "q")).first()
    assert record["question"] == "q?" and record["table_id_lst"] == ["t"] and len(record["id"]) == 32 and record["answers"] == []
    K.write_header_meta(spark.createDataFrame([("t", "T", ["a"])], "table_id string, title string, col_names array<string>"), str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).first()["col_names"] == ["a"]
    coded, base = K.merged(S.serialize(t, "compress"), S.serialize(t, "1_row_block"))
    of = {r["p_id"]: set(r["rows"]) for r in base.collect()}
    for r in coded.collect():
        assert set(r["base_p_ids"]) == {p for p, rows in of.items() if rows & set(r["rows"])}
    named = K.table_of(spark.createDataFrame([("a", "x/y.jsonl")], "table_id string, file string"), spark.createDataFrame([("a",), ("b",)], "table_id string"))
    assert {r["table_id"]: r["file"] for r in named.collect()} == {"a": "x/y.jsonl", "b": "b.jsonl"}


def test_another_tokenizer_and_skipped_columns(spark):
    grid = [["some longer cell text", f"{i % 3}.5", "kind " + str(i % 2)] for i in range(40)]
    t = make(spark, grid, ["a", "b", "c"])
    chars = lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
    out = S.serialize(t, "schema", size=chars).collect()
    assert len(out) > S.serialize(t, "schema").count() and all(r["size"] <= T.WINDOW for r in out)
    cells = O.canonical(t.rows)
    skip = O.numeric_columns(O.column_types(t.rows, t.columns)).filter("skip")
    assert {r["col"] for r in O.hash_bins(cells, skip).select("col").distinct().collect()} == {0, 2}
    plain = S.serialize(t, "compress", skip_numeric=True).collect()
    assert sorted(r for p in plain for r in p["rows"]) == list(range(40))


def test_sql_functions_and_views(spark):
    texts = ["  Foo Bar ", "-1abc", "1.", ".5", "+1.0", "T", "MULTIPOLYGON (((1.0 2.0)))", None, "a_b [SEP] [E3] ü", "x" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    registered.register(spark)
    df.createOrReplaceTempView("texts")
    got = spark.sql("SELECT gs_strip(t), gs_cell_key(t), gs_tokens(t), gs_token_size(t), gs_infer_cell_type(t), gs_hash_slot(t, 97), gs_code_cost(3, 4) FROM texts").collect()
    want = df.select(T.strip(F.col("t")), T.cell_key(F.col("t")), T.tokens(F.col("t")), T.token_size(F.col("t")), T.infer_type(F.col("t")), T.hash_slot(F.col("t"), F.lit(97)), T.coded_cost(F.lit(3), F.lit(4))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    registered.serialize_sql(spark, {"little": "SELECT 1 AS x_a, 'b' AS x_b"}, "1_row_block", "little_passages")
    assert spark.sql("SELECT passage FROM little_passages").first()[0].startswith("little [SEP]a : 1 ; b : b")


def test_no_local_folder_on_a_cluster(spark, monkeypatch, tmp_path):
    class Context:
        applicationId, master = "cluster-app", "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(Session())
    with staging.scratch(spark):
        inside = staging.written(spark.range(3), "in")
        kept = staging.written(inside, "out", keep=True)
    assert kept.count() == 3
    with pytest.raises(Exception, match=r"(?i)path"):
        inside.count()
