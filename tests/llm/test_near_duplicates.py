"""Near-duplicates: hot buckets of unlike texts, hot keys, very long texts, word order."""

import numpy as np
import pyarrow as pa

from gridscribe.llm import common as C, minhash
from test_text_ops import brute, words


def both(spark, base, k=5, percent=80, **how):
    docs = spark.createDataFrame(base, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, k, percent, **how).collect()}
    return got, brute(base, k, percent)


def test_word_order_makes_other_shingles():
    a, b = minhash.shingle_sets(pa.array(["red fish fish red fish", "fish red red fish fish"]), 5)
    assert len(a) == len(b) == 1 and a[0] != b[0]
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "b", "c"], 5)) for _ in range(400)]
    seen = {t: s.tobytes() for t, s in zip(texts, minhash.shingle_sets(pa.array(texts), 5), strict=True)}
    assert len(set(seen.values())) == len(seen)


def family(n, shared, own, seed, sizes=(0,)):
    """Texts that share most words, but not enough to be near copies; a few are near copies of each other."""
    rng = np.random.default_rng(seed)
    common = [f"c{seed}x{i}" for i in range(shared)]
    out = []
    for i in range(n):
        w = common + [f"o{seed}x{i}x{j}" for j in range(own + int(rng.choice(sizes)))]
        out.append(" ".join(w))
        if i % 7 == 0:
            out.append(" ".join([*w[:-1], "changed"]))
    return out


def test_hot_bucket_of_unlike_texts(spark, monkeypatch):
    """One bucket holds everything (two bands of one row), few pairs are links: held blocks and what passes them find exactly those."""
    texts = family(50, 120, 40, 1, (0, 10, 60)) + family(30, 100, 34, 2) + [f"single {i} " * 9 for i in range(10)]
    base = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    monkeypatch.setattr(C, "HOT_ROWS", 3)
    monkeypatch.setattr(C, "HOT_SHARE", 0.0)
    small = minhash.settled_in_blocks
    monkeypatch.setattr(minhash, "settled_in_blocks", lambda rest, sets, percent: small(rest, sets, percent, block=4, held_bytes=20_000, passing_rows=9))
    got, want = both(spark, base, bands=2, rows=1, part_bytes=3000)
    assert got == want


def test_very_long_texts(spark):
    rng = np.random.default_rng(3)
    long = [f"w{x}" for x in rng.integers(0, 50_000, 300_000)]
    near = list(long)
    for i in range(0, 300_000, 60):
        near[i] = "other"
    base = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:150_000])), (4, "short text " * 3)]
    got, want = both(spark, base)
    assert got == want and got[2][1] == 1 and got[3][1] == 3
    assert len(words(base[0][1])) == 300_000


def test_block_counts_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (1, 50, 300, 7)]
    for held in (sets, sets[:1]):
        assert minhash.Block(held).common(sets, step=64).tolist() == [[len(np.intersect1d(x, y)) for y in sets] for x in held]
