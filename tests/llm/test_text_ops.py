"""Language id, near-duplicates and decontamination against brute force."""

import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridscribe.llm import common as C
from gridscribe.llm import decontam, langid, minhash

DOCS = "doc_id long, text string, lang string, source string, hits string, key string, n long"
ODD = [
    (1, None, None, None, "x", "y", 1), (2, "", "en", "a", None, None, None), (None, "lone words of a text without id", "en", "a", None, None, 0),
    (3, " \t\n", "en", None, "x", None, 2), (4, "123 456 !!!", "de", "a", None, None, 3), (5, "word " * 60_000, "en", "b", None, None, 4), (5, "word " * 60_000, "en", "b", None, None, 4),
    (6, "ßäöü été señor", "fr", "b", None, None, 5), (7, "a" * 100_000, "en", "b", None, None, 6),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def test_words_of_matches_regex():
    texts = ["A b  c", "", "  x", "y ", None, "z\tq\x0bw", "äÄ B", "one"]
    seen = {}
    for _, _, offsets, data in C.text_blocks(pa.array(texts)):
        counts, hashes = C.words_of(offsets, data)
        assert counts.tolist() == [len(words(t)) for t in texts]
        for w, h in zip([w for t in texts for w in words(t)], hashes.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def brute(rows, k, percent):
    sets = []
    for d, t in rows:
        w = words(t)
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    comp = {d: d for d, _ in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                comp[max(p, q)] = min(p, q)
    return {d: (len(s), root(d)) for d, s in sets}


@pytest.mark.parametrize(("k", "percent", "bands", "rows"), [(3, 85, 30, 6), (5, 80, 40, 5)])
def test_near_duplicates_brute_force(spark, k, percent, bands, rows):
    docs = C.table(spark, "/root/testdata/sf0.01", "documents").limit(400).select("doc_id", "text")
    base = [(r[0], r[1]) for r in docs.collect()]
    rng = np.random.default_rng(1)
    for i in range(40):  # a hub and its spokes, which may be linked to the hub alone
        w = words(base[3][1])
        for j in rng.choice(len(w), max(1, len(w) // 60 + i % 3), replace=False):
            w[j] = f"new{i}"
        base.append((10_000 + i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(base, "doc_id long, text string"), k, percent, bands, rows).collect()}
    assert got == brute(base, k, percent)


def test_near_duplicates_odd_rows(spark, odd):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0
    assert by[5]["n_shingles"] == 1 and by[7]["n_shingles"] == 1
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    assert sorted(str(r["doc_id"]) for r in minhash.dedup_stage(spark, odd, "").collect()) == sorted(["1", "2", "3", "4", "5", "6", "7", "None"])


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["rep"]: r["comp"] for r in minhash.components(links).collect()}
    assert all(got.get(i, 0) == 0 for i in range(61)) and got[101] == 100


def test_langid_held_out_accuracy(spark):
    docs = C.table(spark, "/root/testdata/sf0.01", "documents")
    from gridscribe.llm.queries import QUERIES

    rows = {r["doc_id"]: r for r in QUERIES["op2_langid"](spark, "/root/testdata/sf0.01").collect()}
    truth = [(r["doc_id"], r["lang"]) for r in docs.collect()]
    held = [(d, lang) for d, lang in truth if rows[d]["held_out"]]
    assert all(rows[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, _ in truth)
    assert np.mean([rows[d]["lang_pred"] == lang for d, lang in held]) > 0.98


def test_langid_odd_rows(spark, odd):
    train = C.table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.train(train, per_label=50)
    rows = langid.predict(odd.select("doc_id", "text", "n"), model).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4 and by[4]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in rows) and by[6]["lang_pred"] in model.labels
    none = langid.train(odd.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd.select("doc_id", "text"), none).collect()} == {"und"}


def plain_ngrams(text):
    low = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in text]
    s = "".join(c for i, c in enumerate(low) if c != " " or i == 0 or low[i - 1] != " ")
    return [s[i : i + n] for n in (1, 2, 3, 4) for i in range(len(s) - n + 1)]


def bucket(gram):
    h = 0
    for c in gram:
        h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
    return ((h ^ (len(gram) * 0x51ED27)) * 0x9E3779B1 & 0xFFFFFFFF) >> 16


def test_langid_brute_force(spark):
    """Character n-grams, counts, weights and posteriors of every row, from dictionaries."""
    docs = C.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(9001, "ЙЖИК и ёлка", None), (9002, "日本語 text", "xx"), (9003, "Ünïcödé ÅßΣ", "xx"), (9004, "", "xx")], "doc_id long, text string, lang string"))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    counts, n_docs = defaultdict(Counter), Counter()
    for d, t, lang in rows:
        if lang is not None and t is not None and not held(d):
            n_docs[lang] += 1
            counts[lang].update(bucket(g) for g in plain_ngrams(t))
    labels = sorted(n_docs, key=str.encode)
    weights = {x: (sum(counts[x].values()) + 0.5 * 65536, counts[x]) for x in labels}
    mask = np.array([not held(d) for d, _, _ in rows])
    model = langid.train(docs.filter(docs.doc_id.isin([d for (d, _, _), m in zip(rows, mask, strict=True) if m])), per_label=10**6)
    got = {r["doc_id"]: r for r in langid.predict(docs.drop("lang"), model).collect()}
    for d, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
            continue
        grams = Counter(bucket(g) for g in plain_ngrams(t))
        s = np.array([np.log(n_docs[x] / sum(n_docs.values())) + sum(n * np.log((weights[x][1][b] + 0.5) / weights[x][0]) for b, n in grams.items()) for x in labels])
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        if np.sort(p)[-1] - np.sort(p)[-2] > 1e-3:
            assert got[d]["lang_pred"] == labels[int(p.argmax())]
        assert abs(got[d]["score"] - p.max()) < 1e-2


def test_langid_ties_go_to_the_first_label(spark):
    docs = spark.createDataFrame([(1, "same words", "zz"), (2, "same words", "aa"), (3, "same words", "mm")], "doc_id long, text string, lang string")
    rows = langid.predict(docs.select("doc_id", "text"), langid.train(docs)).collect()
    assert {r["lang_pred"] for r in rows} == {"aa"} and all(abs(r["score"] - 1 / 3) < 1e-6 for r in rows)


def norm(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def test_contaminated_brute_force(spark):
    docs = [(r[0], r[1]) for r in C.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").limit(150).collect()]
    items = [(r[0], r[1]) for r in C.table(spark, "/root/testdata/sf0.01", "benchmark").select("item_id", "text").collect()][:12]
    for i in range(12):
        w = items[i][1].split()
        for j in range(i % 5, len(w), 5 if i < 6 else 9):  # up to the limit of one token in five is substituted
            w[j] = "changed"
        docs.append((5000 + i, f"before it {' '.join(w)} after"))
    items.append((900, "six short words make one phrase"))
    docs += [(6000, "and six short WORDS, make one phrase here"), (6001, "six short words make a phrase")]
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        dt = norm(t)
        for i, u in items:
            it = norm(u)
            w = min(20, len(it))
            best = 0
            for diag in range(-len(it), len(dt)):
                eq = [0 <= k + diag < len(dt) and dt[k + diag] == it[k] for k in range(len(it))]
                best = max(best, max(sum(eq[k : k + w]) for k in range(len(it) - w + 1)))
            if best >= 0.8 * w:
                want[d, i] = best
    assert got == want
    assert (6000, 900) in got and (6001, 900) in got


def test_contaminated_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "lone words of a text without id"), (3, "lone words of a text without id"), (4, "word " * 50)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(odd, items).collect()}
    assert got == {(None, 3), (5, 4)}
    assert decontam.contaminated(odd.limit(0), items).count() == 0
    assert decontam.contaminated(odd, items.limit(0)).count() == 0
    assert {r["doc_id"] for r in odd.join(decontam.contaminated(odd, items).select("doc_id"), "doc_id", "left_anti").collect()} == {None, 1, 2, 3, 4, 6, 7}
