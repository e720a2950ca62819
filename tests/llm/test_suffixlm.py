"""The suffix tree and its scores against a model made of dictionaries; odd rows; held-out text."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscribe.llm import common as C, suffixlm
from test_text_ops import DOCS, ODD, words

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def spelled(text, depth):
    return [10] * depth + [b for w in words(text) for b in [*w.encode(), 32]] + [10]


class Plain:
    """The tree in dictionaries, one context after another."""

    def __init__(self, texts, depth, gain):
        self.depth, self.next = depth, [defaultdict(Counter) for _ in range(depth + 1)]
        for t in texts:
            s = spelled(t, depth)
            for i in range(depth, len(s)):
                for d in range(depth + 1):
                    self.next[d][tuple(s[i - d : i])][s[i]] += 1
        self.kept = [set() for _ in range(depth + 1)]
        for d in range(1, depth + 1):
            for c, n in self.next[d].items():
                of = sum(n.values())
                if round(sum(k * (math.log(k) - math.log(self.p(c[1:], x))) for x, k in n.items()) - of * math.log(of), 6) >= gain:
                    self.kept[d].add(c)

    def p(self, c, x):
        if not c:
            n = self.next[0][()]
            return (n[x] + 1) / (sum(n.values()) + 256)
        up = self.p(c[1:], x)
        if c not in self.kept[len(c)]:
            return up
        n = self.next[len(c)][c]
        return (n[x] + len(n) * up) / (sum(n.values()) + len(n))

    def score(self, text):
        s = spelled(text, self.depth)
        return sum(math.log10(self.p(tuple(s[i - self.depth : i]), s[i])) for i in range(self.depth, len(s)))


def plain_rows(rows, depth, gain):
    texts = [t for _, h, t in rows if not h]
    counts = Counter(w for t in texts for w in [*words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    model = Plain(texts, depth, gain)
    for d, h, t in rows:
        own = [*words(t), "\n"]
        yield d, h, len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), model.score(t)


def close(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-4) and g[6] == pytest.approx(w[6], abs=1e-4)


@pytest.mark.parametrize(("depth", "gain", "hot"), [(4, 6.0, (40, 2000)), (2, 3.0, (0, 0))])
def test_scores_of_every_row(spark, depth, gain, hot):
    docs = C.pick(C.table(spark, SMALL, "documents").filter("doc_id % 5 = 0 OR n_chars < 300"), doc_id="long", text="string").withColumn("held_out", C.remainder("doc_id", 7) == 2)
    rows = [(r["doc_id"], r["held_out"], r["text"]) for r in docs.collect()]
    got = suffixlm.score(docs, suffixlm.train(docs.filter(~F.col("held_out")), depth, gain), *hot)
    close(got.select(COLUMNS).collect(), list(plain_rows(rows, depth, gain)))


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS).select("doc_id", F.expr("coalesce(doc_id = 6, false)").alias("held_out"), F.expr("CASE WHEN length(text) > 1000 THEN substring(text, 1, 1000) ELSE text END").alias("text"), "n")
    rows = [(r["doc_id"], r["held_out"], r["text"]) for r in docs.collect()]
    close(suffixlm.score(docs, suffixlm.train(docs.filter(~F.col("held_out")))).select(COLUMNS).collect(), list(plain_rows(rows, 5, 6.0)))
    none = suffixlm.score(docs, suffixlm.train(docs.limit(0)))
    close(none.select(COLUMNS).collect(), [(d, h, len(words(t)) + 1, 0, 0, 0.0, (len(spelled(t, 5)) - 5) * math.log10(1 / 256)) for d, h, t in rows])
    assert suffixlm.score(docs.limit(0), suffixlm.train(docs)).count() == 0


def test_every_context_that_passes_is_kept(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcd"), 4000)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model, plain = suffixlm.train(docs, 4, 0.5), Plain(texts, 4, 0.5)
    for d in range(1, 5):
        kept = {r[0] for r in model.levels[d].filter("escape IS NOT NULL").select(F.shiftright("code", 8)).distinct().collect()}
        assert len(kept) == len(plain.kept[d]) > 0


def test_held_out_text_beats_the_base(spark):
    rows = suffixlm.op6_suffixlm(spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_a_task_holds_no_more_than_the_table(spark):
    """Tables of 2**20 grams took 70 MB in every task, and three times that while they were built there."""
    import pickle
    import tracemalloc

    rng = np.random.default_rng(3)
    keys = np.unique(np.append(rng.integers(0, 2**63, 200_000, dtype=np.uint64), [np.uint64(0), np.uint64(2**64 - 1)]))
    values = rng.random(len(keys))
    sent = pickle.dumps(suffixlm.Lookup(keys, values))
    assert len(sent) < 26 * len(keys)
    tracemalloc.start()
    table = pickle.loads(sent)
    assert tracemalloc.get_traced_memory()[1] < 52 * len(keys)
    tracemalloc.stop()
    found, value = table.get(keys)
    assert found.all() and (value == values).all()
    others = np.setdiff1d(rng.integers(0, 2**63, 1000, dtype=np.uint64), keys)
    found, value = table.get(others)
    assert not found.any() and not value.any()
    found, _ = suffixlm.Lookup(keys[:0], values[:0]).get(others)
    assert not found.any()
