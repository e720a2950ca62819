"""Every pattern of substitutions within the threshold is found."""

from itertools import combinations

from gridscribe.llm import decontam


def test_all_patterns_within_the_threshold(spark):
    docs, items, want = [], [], set()
    for m in range(1, 21):
        word = [f"w{m}x{i}" for i in range(m)]
        items.append((m, " ".join(word)))
        most = next(k for k in range(m, -1, -1) if m - k >= 0.8 * m)
        for k in range(most + 2):
            for gone in list(combinations(range(m), k))[: None if k <= most else 50]:
                docs.append((len(docs), "before " + " ".join("other" if i in gone else w for i, w in enumerate(word)) + " after"))
                if k <= most:
                    want.add((docs[-1][0], m, m - k))
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["matched"]) for r in found.collect()} == want
