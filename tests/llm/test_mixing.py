"""Apportionment by highest quotients, targets, and the mix against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscribe.llm import common as C, mixing
from test_text_ops import DOCS, ODD, words


def highest_quotients(shares, seats):
    held = [0] * len(shares)
    for _ in range(seats if sum(shares) else 0):
        held[max(range(len(shares)), key=lambda i: (shares[i] / (2 * held[i] + 1), -i))] += 1
    return held


def test_apportioned_by_highest_quotients(spark):
    rng = np.random.default_rng(5)
    cases = [([76.0] + [0.6] * 40, 100), ([1.0] * 7, 3), ([0.0, 0.0], 0), ([5.0], 9), ([0.0, 3.0, 9.0, 1.0], 5), ([1e12, 1.0, 1e-3], 1000), ([9.0, 3.0, 1.0] * 30, 77)]
    for _ in range(25):
        shares = rng.integers(0, 1000, int(rng.integers(1, 60))).astype(float).tolist()
        cases.append((shares, int(rng.integers(0, 300)) if sum(shares) else 0))
    rows = [(f"g{g}", i, s, n) for g, (shares, n) in enumerate(cases) for i, s in enumerate(shares)]
    got = {(r["g"], r["i"]): r["quota"] for r in mixing.apportioned(spark.createDataFrame(rows, "g string, i long, share double, seats long"), ["g"], ["i"]).collect()}
    for g, (shares, n) in enumerate(cases):
        assert [got[f"g{g}", i] for i in range(len(shares))] == highest_quotients(shares, n), (shares, n)


def plain_targets(sizes, weights, total, most):
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / weight > most * sizes[i]]
        for i in over or free:
            out[i] = float(most * sizes[i]) if over else rest * weights[i] / weight
        free -= set(over or free)
        rest = total - sum(out)
    return out


@pytest.mark.parametrize(("sizes", "weights", "total"), [([100, 100, 100], [5, 2, 1], 450), ([0, 10], [5, 2], 15), ([1, 10, 100, 1000, 0], [5, 2, 1, 5, 2], 1600), ([4, 4], [1, 1], 100)])
def test_targets(spark, sizes, weights, total):
    df = spark.createDataFrame([(i, n, float(w)) for i, (n, w) in enumerate(zip(sizes, weights, strict=True))], "i int, n long, weight double")
    got = [r["target"] for r in mixing.targets(df, total, 2).orderBy("i").collect()]
    assert got == pytest.approx(plain_targets(sizes, weights, total, 2) if total <= 2 * sum(sizes) else [2 * n for n in sizes])


def test_mix_brute_force(spark):
    odd = spark.createDataFrame(ODD, DOCS)
    docs = C.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "source").limit(500).unionByName(odd.select("doc_id", "text", "source"))
    mixed = mixing.mix_sources(docs, block_tokens=16, shard_tokens=4096, carry=F.col("text"))
    rows = mixed.withColumn("new", mixing.mixed_text(F.col("carried"), F.col("size"), F.col("passes"), F.col("spans"))).collect()
    texts = docs.collect()
    assert len(rows) == len(texts)
    sizes = Counter()
    for r in texts:
        sizes[r["source"]] += len(words(r["text"]))
    got, goal = Counter(), {}
    for r in rows:
        got[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        own = words(r["carried"])
        assert r["size"] == len(own) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        # what the spans and passes say is what the text holds
        want = own * r["passes"] + [w for s in r["spans"] for w in own[s["start"] : s["start"] + s["length"]]]
        assert words(r["new"]) == want and len(want) == r["taken"]
        ends = [0] + [s["start"] + s["length"] for s in r["spans"]]
        assert all(s["start"] >= e and s["length"] > 0 for s, e in zip(r["spans"], ends, strict=False))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = plain_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2)
    for s, t in zip(names, want, strict=True):
        assert goal[s] == pytest.approx(t) and abs(got[s] - t) <= max(64, 0.02 * t)
    again = mixing.mix_sources(docs.repartition(7), block_tokens=16, shard_tokens=4096).drop("spans").collect()
    assert sorted(str(r) for r in again) == sorted(str(r) for r in mixed.drop("spans", "carried").collect())
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def test_many_sources_take_the_other_path(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 13)), f"host{i % 50}") for i in range(400)], "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mix_sources(docs, block_tokens=4, shard_tokens=64).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    assert sorted(map(str, mixing.mix_sources(docs, block_tokens=4, shard_tokens=64).collect())) == want


def test_stage_returns_the_mix(spark):
    odd = spark.createDataFrame([(*r, "t", 9) for r in ODD], DOCS + ", taken string, n_chars long")
    rows = mixing.mixing_stage(spark, odd, "").collect()
    assert rows and all(r["text"] and r["n_chars"] == len(r["text"]) and r["taken"] == "t" for r in rows)
    assert mixing.mixing_stage(spark, odd.limit(0), "").count() == 0
    plain = mixing.mixing_stage(spark, odd.drop("taken"), "").collect()
    assert all(r["taken"] == len(words(r["text"])) > 0 for r in plain)
