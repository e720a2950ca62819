"""Language-model scoring by a probabilistic suffix tree (operator 6).

The model reads a text as the bytes of its lower-cased words, a blank after each, then an end mark. Counts of all
(depth + 1)-grams of all training texts are gathered by partial counts in numpy and one shuffle; shorter contexts are
marginals of longer ones. A context is retained if its next-symbol distribution diverges from what its suffix predicts:
n * KL >= `gain` nats. Every context that passes is kept, so the tree grows with the corpus. Next-symbol distributions
are Witten-Bell smoothed towards the suffix's; a symbol is scored in the longest retained suffix of the `depth` bytes before it.

The tree is a table per level: for each gram seen (context, symbol) the log10 probability that its longest retained suffix gives,
and for each retained context what an unseen symbol costs on the way to the next shorter one. The most frequent grams are
broadcast (a bounded number, cut at a count that a histogram names, so nothing is sorted as a whole); all other places of the
texts meet the tables in joins, first the deepest level, what is not found there one level less, and so on. Words do the
same for the base score.

Defined results: null or empty texts have the end token alone; a null id counts as empty text for the held-out rule;
repeated rows are learned from and scored each by itself; without training text every token is unknown and the model is
uniform over 256 symbols; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

MARK = 10  # the byte of start and end: no word holds it
WORD_KIND, GRAM_KIND, DOC_KIND = 0, 1, 2
SYMBOLS = 256
FLUSH = 1 << 20


def symbols(offsets: np.ndarray, data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the texts as the model reads them: depth marks, words each with a blank, an end mark."""
    low = C.TO_LOWER[data]
    space = C.IS_SPACE[low]
    keep = ~space
    if len(low):
        after = np.zeros(len(low), bool)  # the first white space after a word stands for the blank
        after[1:] = space[1:] & ~space[:-1]
        starts = offsets[:-1][np.diff(offsets) > 0]
        after[starts] = False
        keep |= after
    lens = np.diff(offsets)
    ends_word = np.zeros(len(lens), np.int64)
    has = lens > 0
    if len(low):
        ends_word[has] = ~space[offsets[1:][has] - 1]
    kept = np.concatenate([[0], np.cumsum(keep)])
    body = kept[offsets[1:]] - kept[offsets[:-1]]
    sizes = depth + body + ends_word + 1
    out_at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(out_at[-1], MARK, np.uint8)
    src = np.where(space[keep], np.uint8(32), low[keep]) if len(low) else low
    if len(src):
        shift = np.repeat(out_at[:-1] + depth - kept[offsets[:-1]], body)
        out[np.arange(len(src)) + shift] = src
    out[(out_at[1:] - 2)[ends_word > 0]] = 32
    return out_at, out


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([a[0], b[0]])
    n = np.concatenate([a[1], b[1]])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def grams_of(offsets: np.ndarray, data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams per text, grams): a symbol in the lowest byte, above it the symbols before it, the nearest lowest."""
    at, sym = symbols(offsets, data, depth)
    code = np.zeros(len(sym), np.uint64)
    for k in range(depth + 1):
        code[k:] |= sym[: len(sym) - k].astype(np.uint64) << np.uint64(8 * k)
    use = np.ones(len(sym), bool)
    for k in range(depth):
        use[at[:-1] + k] = False
    return np.diff(at) - depth, code[use]


def _counter(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        held, docs = {WORD_KIND: none, GRAM_KIND: none}, 0

        def out(kind: int) -> pa.RecordBatch:
            key, n = held[kind]
            held[kind] = none
            return C.arrow_rows(kind=pa.array(np.full(len(key), kind, np.int32)), key=pa.array(key.view(np.int64)), n=pa.array(n))

        for batch in batches:
            docs += batch.num_rows
            for _, _, offsets, data in C.text_blocks(batch.column("text"), 4 * C.BLOCK_BYTES):
                for kind, keys in ((WORD_KIND, C.words_of(offsets, data)[1]), (GRAM_KIND, grams_of(offsets, data, depth)[1])):
                    key, n = np.unique(keys, return_counts=True)
                    held[kind] = _merge(held[kind], (key.astype(np.uint64), n.astype(np.int64)))
                    if len(held[kind][0]) > FLUSH:
                        yield out(kind)
        yield out(WORD_KIND)
        yield out(GRAM_KIND)
        yield C.arrow_rows(kind=pa.array([DOC_KIND], pa.int32()), key=pa.array([0], pa.int64()), n=pa.array([docs], pa.int64()))

    return run


@dataclass
class Model:
    depth: int
    levels: list[DataFrame]  # by depth: code (context, symbol), n, lp, and escape (log10) of a retained context
    n_symbols: int
    words: DataFrame  # key, c
    tokens: int
    kinds: int  # distinct tokens
    ends: int

    def unseen(self) -> float:
        """log10 probability of a symbol that no training text holds."""
        return -float(np.log10(self.n_symbols + SYMBOLS))


def _low(column: str, n_bytes: int) -> Column:
    return F.expr(f"{column} & {(1 << 8 * n_bytes) - 1}")


def suffix_tree(grams: DataFrame, depth: int, gain: float) -> tuple[list[DataFrame], int]:
    """(levels, symbols counted) from grams (code: depth + 1 bytes, n)."""
    counts = [grams]
    for d in range(depth - 1, -1, -1):
        counts.insert(0, C.stage(counts[0].groupBy(_low("code", d + 1).alias("code")).agg(F.sum("n").alias("n")), f"counts{d}"))
    total = counts[0].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lp = F.log10((F.col("n") + 1) / F.lit(float(total + SYMBOLS)))
    levels = [C.stage(counts[0].select("code", "n", lp.alias("lp"), F.lit(None).cast("double").alias("escape")), "level0")]
    for d in range(1, depth + 1):
        above = levels[-1].select(F.col("code").alias("suffix"), F.col("lp").alias("up"))
        rows = counts[d].withColumn("suffix", _low("code", d)).join(above, "suffix").withColumn("context", F.shiftright("code", 8))
        w = Window.partitionBy("context")  # a context has at most 256 symbols
        of, kinds = F.sum("n").over(w), F.count("*").over(w)
        more = F.sum(F.col("n") * (F.log("n") - F.col("up") * float(np.log(10)))).over(w) - of * F.log(of)
        rows = rows.withColumn("of", of).withColumn("kinds", kinds).withColumn("kept", F.round(more, 6) >= gain)
        lp = F.when(F.col("kept"), F.log10((F.col("n") + F.col("kinds") * F.pow(F.lit(10.0), F.col("up"))) / (F.col("of") + F.col("kinds")))).otherwise(F.col("up"))
        escape = F.when(F.col("kept"), F.log10(F.col("kinds") / (F.col("of") + F.col("kinds"))))
        levels.append(C.stage(rows.select("code", "n", lp.alias("lp"), escape.alias("escape")), f"level{d}"))
    return levels, total


def frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of df whose count is large, at most `most` of them: cut where a histogram of logarithms says so."""
    step = F.floor(F.log2(count) * 16).cast("int")
    hist = sorted(df.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min(count).alias("least")).collect(), key=lambda r: -r["step"])  # a fixed number of steps
    held, cut = 0, None
    for r in hist:
        held += r["n"]
        if held > most:
            break
        cut = r["least"]
    return df.filter(F.col(count) >= cut) if cut is not None else df.limit(0)


class Lookup:
    """64-bit keys with float values in the order of their hashes, read by arrays of keys.

    The driver sorts once; a task takes the arrays as they are broadcast and holds nothing beside them.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys))))))
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.values = keys[order], values[order]
        # where the keys of each slot begin
        self.begins = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1, dtype=np.int32)).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (C.mix(keys) >> np.uint64(64 - self.bits)).astype(np.int32)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value or 0)."""
        found, value = np.zeros(len(keys), bool), np.zeros(len(keys))
        slot = self._slot(keys)
        at, end = self.begins[slot], self.begins[slot + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            own = at[left]
            hit = self.keys[own] == keys[left]
            found[left[hit]], value[left[hit]] = True, self.values[own[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return found, value


def train(docs: DataFrame, depth: int = 5, gain: float = 6.0) -> Model:
    """The model of the texts of docs."""
    C.bound_batches(docs.sparkSession)
    raw = docs.select("text").mapInArrow(_counter(depth), "kind int, key long, n long")
    counts = C.stage(raw.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.filter(F.col("kind") == WORD_KIND).select("key", F.col("n").alias("c"))
    r = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    ends = counts.filter(F.col("kind") == DOC_KIND).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    levels, total = suffix_tree(counts.filter(F.col("kind") == GRAM_KIND).select(F.col("key").alias("code"), "n"), depth, gain)
    return Model(depth, levels, total, words, r["n"] + ends, r["v"] + (ends > 0), ends)


def looked_up(missed: DataFrame, model: Model) -> DataFrame:
    """(rid, lp): the log10 probabilities of missed (rid, code), summed by row and level."""
    pending, parts = missed.withColumn("spent", F.lit(0.0)), []
    for d in range(model.depth, -1, -1):
        both = pending.join(model.levels[d].select("code", "lp"), "code", "left")
        if d == 0:
            parts.append(both.select("rid", (F.col("spent") + F.coalesce("lp", F.lit(model.unseen()))).alias("lp")))
            break
        both = C.stage(both, f"looked{d}")
        parts.append(both.filter("lp IS NOT NULL").select("rid", (F.col("spent") + F.col("lp")).alias("lp")))
        pending = both.filter("lp IS NULL")
        if pending.isEmpty():
            break
        # the symbol was not seen in this context: if that is retained the way to its suffix costs its escape
        escapes = model.levels[d].filter("escape IS NOT NULL").groupBy(F.shiftright("code", 8).alias("context")).agg(F.min("escape").alias("escape"))
        pending = pending.withColumn("context", F.shiftright("code", 8)).join(escapes, "context", "left")
        pending = pending.select("rid", _low("code", d).alias("code"), (F.col("spent") + F.coalesce("escape", F.lit(0.0))).alias("spent"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score(docs: DataFrame, model: Model, hot_words: int = 1 << 18, hot_grams: int = 1 << 20) -> DataFrame:
    """One row per row of docs (doc_id, held_out, text): the counts and scores of the contract."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    n, v, ends, depth = model.tokens, model.kinds, model.ends, model.depth
    # a bounded number of words and grams
    top = frequent(model.words, "c", hot_words).toArrow()
    grams = frequent(model.levels[depth], "n", hot_grams).select("code", "lp").toArrow()
    key, count = (top[c].to_numpy().astype(np.int64) for c in ("key", "c"))
    code, lp = grams["code"].to_numpy().astype(np.int64).view(np.uint64), grams["lp"].to_numpy().astype(float)
    shared = spark.sparkContext.broadcast((Lookup(key.view(np.uint64), np.log10((count + 1) / (n + v + 1))), Lookup(code, lp)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_table, gram_table = shared.value
        for batch in batches:
            n_tokens, known, base, score, rare, rare_at, missed, missed_at = [], [], [], [], [], [], [], []
            for _, rows, offsets, data in C.text_blocks(batch.column("text")):
                counts, ws = C.words_of(offsets, data)
                owner = np.repeat(np.arange(rows), counts)
                hit, cost = word_table.get(ws)
                n_tokens.append(counts + 1)
                known.append(np.bincount(owner[hit], minlength=rows) + (ends > 0))
                base.append(np.bincount(owner, weights=cost, minlength=rows) + np.log10((ends + 1) / (n + v + 1)))
                rare.append(ws[~hit].view(np.int64))
                rare_at.append(np.bincount(owner[~hit], minlength=rows))
                counts, codes = grams_of(offsets, data, depth)
                owner = np.repeat(np.arange(rows), counts)
                hit, cost = gram_table.get(codes)
                score.append(np.bincount(owner, weights=cost, minlength=rows))
                missed.append(codes[~hit].view(np.int64))
                missed_at.append(np.bincount(owner[~hit], minlength=rows))
            cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
            lists = lambda at, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cat(at, np.int64))]).astype(np.int32)), pa.array(cat(values, np.int64)))
            yield C.arrow_rows(
                rid=batch.column("rid"), doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), n_tokens=pa.array(cat(n_tokens, np.int64)), hot_known=pa.array(cat(known, np.int64)),
                hot_base=pa.array(cat(base, float)), hot_score=pa.array(cat(score, float)), rare=lists(rare_at, rare), missed=lists(missed_at, missed),
            )

    kind = "rid long, doc_id long, held_out boolean, n_tokens long, hot_known long, hot_base double, hot_score double, rare array<long>, missed array<long>"
    scored = C.stage(docs.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "held_out", "text").mapInArrow(run, kind), "scored")
    rare = scored.select("rid", F.explode("rare").alias("key")).groupBy("rid", "key").agg(F.count("*").alias("m"))
    rare = rare.join(model.words, "key", "left").groupBy("rid").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0)).alias("more"), F.sum(F.col("m") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))).alias("rest"))
    missed = looked_up(scored.select("rid", F.explode("missed").alias("code")), model).groupBy("rid").agg(F.sum("lp").alias("lp"))
    out = scored.drop("rare", "missed").join(rare, "rid", "left").join(missed, "rid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        F.round(F.col("hot_base") + F.coalesce("rest", F.lit(0.0)), 6).alias("base_score"), F.round(F.col("hot_score") + F.coalesce("lp", F.lit(0.0)), 6).alias("score"),
    )


def op6_suffixlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.pick(C.table(spark, sf_dir, "documents"), doc_id="long", text="string").withColumn("held_out", C.remainder("doc_id", 7) == 2)
    return score(docs, train(docs.filter(~F.col("held_out"))))


QUERIES = {"op6_suffixlm": op6_suffixlm}
