"""Agree sets: columns on which two rows of a sample agree, and passages clustered by them.

Each row belongs to one agree set. The columns of its set are one unit, a cell of several values that is coded as a whole; units
of a table go to header blocks by first fit, so that a set stays together where a block has room for it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridscribe.operators import cells as O, packing as P
from gridscribe.sources.tables import TableSet

SAMPLE_ROWS, MOST_SETS = 333, 32


def sampled_rows(rows: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """The `most` rows of each table that come first by a hash: a fixed sample, for mining compares its rows pairwise."""
    place = F.row_number().over(Window.partitionBy("table_id").orderBy(F.md5(F.concat_ws("|", "table_id", "row")), "row"))
    return rows.select("table_id", "row").withColumn("k", place).filter(F.col("k") <= most).drop("k")


def class_vectors(cells: DataFrame) -> DataFrame:
    """(table_id, row, classes): class id per column."""
    named = cells.join(O.classes(cells).select("table_id", "col", "key", "class_id"), ["table_id", "col", "key"])
    return named.groupBy("table_id", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "class_id"))), lambda x: x["class_id"]).alias("classes"))


def pairs(cells: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """(table_id, a, b, cols): pairs a < b of sampled rows and the columns on which they agree. At most most**2 / 2 per table."""
    own = class_vectors(cells.join(sampled_rows(cells.select("table_id", "row").distinct(), most), ["table_id", "row"], "left_semi"))
    left = own.select("table_id", F.col("row").alias("a"), F.col("classes").alias("x"))
    right = own.select("table_id", F.col("row").alias("b"), F.col("classes").alias("y"))
    cols = F.filter(F.sequence(F.lit(0), F.size("x") - 1), lambda i: F.get("x", i) == F.get("y", i))
    return left.join(right, "table_id").filter("a < b").select("table_id", "a", "b", cols.alias("cols")).filter("size(cols) > 0")


def sets(found: DataFrame) -> DataFrame:
    """(table_id, cols, rows, weight): agree sets with the rows of their pairs."""
    flat = found.select("table_id", "cols", F.explode(F.array("a", "b")).alias("row"))
    grouped = flat.groupBy("table_id", "cols").agg(F.sort_array(F.collect_set("row")).alias("rows"))
    return grouped.withColumn("weight", F.size("cols") * F.size("rows"))


def best_sets(found: DataFrame, most: int = MOST_SETS - 1) -> DataFrame:
    """(table_id, pick, cols, rows, weight): greedy by what a set still covers, ties by the lesser columns. A table's sets are few."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        left = {tuple(int(c) for c in cols): {int(r) for r in rows} for cols, rows in zip(frame["cols"], frame["rows"], strict=True)}
        out = []
        while left and len(out) < most:
            cols = min(left, key=lambda c: (-len(c) * len(left[c]), c))
            rows = left.pop(cols)
            if not rows:
                break
            out.append((frame["table_id"].iloc[0], len(out), list(cols), sorted(rows), len(cols) * len(rows)))
            left = {c: r - rows for c, r in left.items()}
        return pd.DataFrame(out, columns=["table_id", "pick", "cols", "rows", "weight"])

    return sets(found).groupBy("table_id").applyInPandas(run, "table_id string, pick int, cols array<int>, rows array<int>, weight int")


def indexed(cells: DataFrame, picks: DataFrame) -> DataFrame:
    """(table_id, row, pick, n, group): each row goes to the first set whose classes it shares with another row, the rest to the last.

    n is the size of a row's group. Groups that an earlier set took are not counted again, so sets are settled one after
    another; there are at most MOST_SETS, each one aggregation.
    """
    from gridscribe.plans.staging import written

    left = written(class_vectors(cells), "classes")
    out = None
    n = picks.agg(F.max("pick")).first()[0]
    for pick in range((n if n is not None else -1) + 2):
        own = picks.filter(F.col("pick") == pick).select("table_id", "cols")
        keyed = left.join(F.broadcast(own), "table_id", "left").withColumn("group", F.when(F.col("cols").isNotNull(), F.transform("cols", lambda c: F.get("classes", c))))
        sizes = keyed.filter("group IS NOT NULL").groupBy("table_id", "group").agg(F.count("*").alias("n")).filter("n > 1")
        took = written(keyed.join(sizes, ["table_id", "group"], "left"), "took")
        last = pick == (n if n is not None else -1) + 1
        done = took if last else took.filter("n IS NOT NULL")
        done = done.select("table_id", "row", F.lit(pick).alias("pick"), "n", "group")
        out = done if out is None else out.unionByName(done)
        if not last:
            left = took.filter("n IS NULL").select("table_id", "row", "classes")
    return out


def row_order(index: DataFrame) -> DataFrame:
    """index with ord: rows of a set by the size of their group, then by its classes; one range sort for all tables."""
    from gridscribe.plans.staging import numbered

    placed = numbered(index, ["table_id", "pick", F.desc_nulls_last("n"), "group", "row"], "place")
    first = placed.groupBy("table_id").agg(F.min("place").alias("first"))
    return placed.join(first, "table_id").select("table_id", "row", "pick", (F.col("place") - F.col("first")).cast("int").alias("ord"))


def units_of(sizes: list[int], agreed: list[int], budget: int) -> list[tuple[list[int], bool]]:
    """(columns, whether they are agreed ones) in the order of their first columns; a set too wide for a block is cut into runs."""
    runs: list[list[int]] = []
    room = 0
    whole = sum(sizes[c] + 1 for c in agreed) < budget
    for c in agreed:
        if not runs or (not whole and sizes[c] + 1 > room):
            runs.append([])
            room = budget
        runs[-1].append(c)
        room -= sizes[c] + 1
    at = {c: i for i, c in enumerate(agreed)}
    out: list[tuple[list[int], bool]] = []
    for c in range(len(sizes)):
        if c not in at:
            out.append(([c], False))
        elif at[c] == 0:
            out += [(run, True) for run in runs]
    return out


def unit_blocks(sizes: list[int], agreed: list[int], budget: int) -> list[list[list[int]]]:
    """The units of each header block, by first fit; agreed units that meet in a block become one."""
    units = units_of(sizes, agreed, budget)
    bins = P.first_fit([sum(sizes[c] + 1 for c in u) for u, _ in units], budget)
    blocks: list[list[list[int]]] = [[] for _ in range(max(bins, default=-1) + 1)]
    home: dict[int, list[int]] = {}
    for (unit, agrees), b in zip(units, bins, strict=True):
        if agrees and b in home:
            home[b].extend(unit)
            continue
        blocks[b].append(unit)
        if agrees:
            home[b] = unit
    return blocks


LAYOUT = "table_id string, pick int, block_id int, title string, title_size int, units array<array<int>>, cols array<int>, names array<string>, name_sizes array<int>, header string, header_size int"


def layouts(columns: DataFrame, picks: DataFrame, budget: int = int(O.T.WINDOW * O.T.HEADER_SHARE), size=O.T.token_size) -> DataFrame:
    """One row per table, set (the last one is no set) and header block. A group is one table's header and its sets."""

    def run(heads: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        if not len(heads):
            return pd.DataFrame([], columns=[x.split(" ")[0] for x in LAYOUT.split(", ")])
        heads = heads.sort_values("col")
        names, sizes = heads["name"].tolist(), [int(x) for x in heads["size"]]
        agreed = [[int(c) for c in cols] for cols in sets.sort_values("pick")["cols"]] + [[]]
        out, block = [], 0
        for pick, cols in enumerate(agreed):
            for units in unit_blocks(sizes, cols, budget):
                text = " | ".join(" & ".join(names[c] for c in u) for u in units) + " [SEP]"
                unit_names = [" & ".join(names[c] for c in u) for u in units]
                unit_sizes = [sum(sizes[c] + 1 for c in u) - 1 for u in units]
                out.append((heads["table_id"].iloc[0], pick, block, heads["title"].iloc[0], int(heads["title_size"].iloc[0]), units, [u[0] for u in units], unit_names, unit_sizes, text, sum(unit_sizes) + len(units)))
                block += 1
        return pd.DataFrame(out, columns=[x.split(" ")[0] for x in LAYOUT.split(", ")])

    return O.headers(columns, size).groupBy("table_id").cogroup(picks.select("table_id", "pick", "cols").groupBy("table_id")).applyInPandas(run, LAYOUT)


def unit_rows(cells: DataFrame, order: DataFrame, layout: DataFrame) -> DataFrame:
    """Rows ready for packing: for each block of a row's set one cell per unit (col: its first column; cols: all of them)."""
    grouped = cells.groupBy("table_id", "row").agg(F.sort_array(F.collect_list(F.struct("col", "text", "size", "key"))).alias("own"))
    rows = grouped.join(order, ["table_id", "row"]).join(layout, ["table_id", "pick"])

    def unit(u):
        held = F.filter(F.transform(u, lambda c: F.get(F.filter("own", lambda x: x["col"] == c), 0)), lambda x: x.isNotNull())
        return F.get(
            F.transform(
                F.array(held),
                lambda h: F.struct(
                    F.get(u, 0).alias("col"), F.array_join(F.transform(h, lambda x: x["text"]), " & ").alias("text"),
                    (F.aggregate(h, F.lit(0), lambda a, x: a + x["size"]) + F.size(h) - 1).alias("size"), F.array_join(F.transform(h, lambda x: x["key"]), "\x1f").alias("key"), F.transform(h, lambda x: x["col"]).alias("cols"),
                ),
            ),
            0,
        )

    packed = F.filter(F.transform("units", unit), lambda x: F.size(x["cols"]) > 0)
    return rows.withColumn("cells", packed).drop("own", "units", "pick")


def passages(tables: TableSet, cells: DataFrame, limit: int, size=O.T.token_size) -> DataFrame:
    """Rows clustered by agree sets, coded, with `|` between units and `&` inside them."""
    picks = best_sets(pairs(cells))
    order = row_order(indexed(cells, picks))
    rows = unit_rows(cells, order, layouts(tables.columns, picks, size=size))
    return P.chunked(rows, lambda row: P.Coded(row, limit, joint=" | "))
