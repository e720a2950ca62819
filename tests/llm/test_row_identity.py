"""Rows without id, and rows that share one, are linked, kept or removed by their own texts."""

from collections import Counter

from gridscribe.llm import common as C, decontam, minhash

SMALL = "/root/testdata/sf0.001"


def text(n):
    return " ".join(f"w{n}x{i}" for i in range(40))


def near(n):
    return text(n).replace(f"w{n}x39", "other")


def test_dedup_by_row(spark):
    rows = [(None, text(i)) for i in range(5)] + [(None, near(0)), (None, text(1)), (7, text(20)), (7, text(21)), (8, near(20)), (9, text(3)), (None, ""), (None, None), (None, ""), (10, ""), (10, ""), (11, text(30)), (11, text(30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in minhash.dedup_stage(spark, docs, "").collect())
    one = [r for r in got if r[1] in (text(0), near(0))]  # of near copies without id either may stay
    assert len(one) == 1 and got.pop(one[0]) == 1
    assert got == Counter([(None, text(1)), (None, text(2)), (9, text(3)), (None, text(4)), (7, text(20)), (7, text(21)), (None, ""), (None, ""), (None, None), (10, ""), (11, text(30))])
    assert minhash.dedup_stage(spark, docs.limit(0), "").count() == 0


def test_decontamination_by_row(spark):
    bad = C.table(spark, SMALL, "benchmark").first()["text"]
    rows = [(None, bad), (None, text(0)), (None, text(1)), (None, None), (3, bad), (3, text(2))]
    got = decontam.decontam_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()
    assert Counter(map(tuple, got)) == Counter([(None, text(0)), (None, text(1)), (None, None), (3, text(2))])
