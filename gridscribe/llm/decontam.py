"""Benchmark decontamination by spaced seeds (operator 9). DataFrame functions only.

Texts become lower-case runs of letters and digits. A document is contaminated by an item if some window of `window` tokens
(or the whole of a shorter item) agrees in at least `share` of its places. A seed is the hash of a run of tokens, as long as
the longest run that every such window must hold unbroken: k substitutions leave k + 1 runs, and `need` equal tokens in
k + 1 runs make one of ceil(need / (k + 1)), so no pattern within the threshold is missed. Seeds of documents meet seeds
of benchmark items by an equi-join; each hit names an item and a diagonal (place in the document minus place in the
item), and along each diagonal the whole overlap is compared token by token.

The item seeds, the hits and the items are broadcast only if their rows, diagonals and tokens are counted to be no more than
BROADCAST_ROWS; otherwise the joins shuffle. Hits carry ids and places only; the documents that hits name are read again for
verification.

Defined results: null or empty texts match nothing; items of fewer than `least` tokens are not searched for; items so short
that `share` allows no substitution are searched for as exact phrases; repeated rows and repeated hits give one pair, its
best window; a document without id is reported with a null id; empty tables give no pairs; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BROADCAST_ROWS = 2_000_000


def tokens(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def seed_length(m: int, window: int, share: float) -> int:
    """The longest run of equal tokens that every match of an item of m tokens is bound to hold."""
    width = min(m, window)
    need = next(n for n in range(width + 1) if n >= share * width)
    return max(1, -(-need // (width - need + 1)))


def seeds(hashes: Column, lengths: Sequence[int]) -> Column:
    """array<struct<at, seed>>: for each length, the hash of the run of tokens at each place where it fits."""
    out = []
    for length in lengths:
        last = F.size(hashes) - length
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        out.append(F.transform(places, _seed_at(hashes, length)))
    return F.concat(*out) if out else F.array().cast("array<struct<at:int,seed:bigint>>")


def _seed_at(hashes: Column, length: int):
    return lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(length), *(F.get(hashes, i + o) for o in range(length))).alias("seed"))


def _best(window: int) -> Column:
    """Over all diagonals of a pair, the most equal tokens in a window; a window may hang over the document's edge."""

    def along(d: Column) -> Column:
        m, n = F.size("item_tokens"), F.size("doc_tokens")
        begin, end = F.greatest(F.lit(0), -d), F.least(m, n - d)
        same = F.zip_with(F.slice("item_tokens", begin + 1, end - begin), F.slice("doc_tokens", begin + d + 1, end - begin), lambda a, b: (a == b).cast("int"))
        width = F.least(F.lit(window), m)

        def widest(s: Column) -> Column:
            total = lambda i: F.aggregate(F.slice(s, i, width), F.lit(0), lambda a, x: a + x)
            return F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(s) - width + 1)), total))

        return F.get(F.transform(F.array(same), widest), 0)  # an array of one: `same` is computed once

    return F.array_max(F.transform("diagonals", along))


def contaminated(docs: DataFrame, items: DataFrame, window: int = 20, share: float = 0.8, least: int = 1) -> DataFrame:
    """Pairs (doc_id, item_id) with matched (equal tokens of the best window), compared (its length) and share."""
    hashed = lambda c: F.transform(c, lambda t: F.xxhash64(t))
    items = C.pick(items, item_id="long", text="string").select("item_id", tokens(F.col("text")).alias("item_tokens")).filter(F.size("item_tokens") >= least)
    items = C.stage(items, "items")
    sizes = [r["m"] for r in items.select(F.least(F.size("item_tokens"), F.lit(window)).alias("m")).distinct().collect()]  # at most window sizes
    run = {m: seed_length(m, window, share) for m in sizes}
    lengths = sorted(set(run.values()))
    size, kinds = F.least(F.size("item_tokens"), F.lit(window)), F.array().cast("array<struct<at:int,seed:bigint>>")
    for length in lengths:
        kinds = F.when(size.isin([m for m in sizes if run[m] == length]), seeds(F.col("h"), [length])).otherwise(kinds)
    own = items.withColumn("h", hashed(F.col("item_tokens"))).select("item_id", F.explode(kinds).alias("s"))
    own = C.stage(own.select("item_id", F.col("s.at").alias("item_at"), F.col("s.seed").alias("seed")).distinct(), "item-seeds")
    docs = C.pick(docs, doc_id="long", text="string")
    small = own.count() <= BROADCAST_ROWS
    found = docs.select("doc_id", hashed(tokens(F.col("text"))).alias("h")).select("doc_id", F.explode(seeds(F.col("h"), lengths)).alias("s")).select("doc_id", F.col("s.at").alias("at"), F.col("s.seed").alias("seed"))
    hits = found.join(F.broadcast(own) if small else own, "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    hits = C.stage(hits, "hits")

    grouped = hits.groupBy("doc_id", "item_id").agg(F.collect_set("diagonal").alias("diagonals"))  # at most one text's places
    few = hits.count() <= BROADCAST_ROWS
    named = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(grouped) if few else grouped, F.col("id").eqNullSafe(F.col("doc_id")))
    rows = named.select("doc_id", F.col("item_id").alias("of"), "diagonals", tokens(F.col("text")).alias("doc_tokens"))
    n_tokens = items.agg(F.coalesce(F.sum(F.size("item_tokens")), F.lit(0))).first()[0]
    pairs = rows.join(F.broadcast(items) if n_tokens <= BROADCAST_ROWS else items, F.col("of").eqNullSafe(F.col("item_id")))
    pairs = pairs.select("doc_id", "item_id", _best(window).alias("matched"), F.least(F.lit(window), F.size("item_tokens")).alias("compared"))
    pairs = pairs.filter(F.col("matched") >= F.lit(share) * F.col("compared"))
    out = pairs.groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("compared").cast("long").alias("compared"))
    return out.withColumn("share", F.col("matched") / F.col("compared"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that no benchmark item contaminates, each judged by its own text."""
    docs, back = C.apart(docs, "doc_id", "text")
    key = C.row_key("doc_id", "text")
    with C.scratch(spark):
        found = contaminated(docs.select(key.alias("doc_id"), "text"), C.table(spark, sf_dir, "benchmark"))
        bad = C.stage(found.select(F.col("doc_id").alias("bad_key")).distinct(), "bad", keep=True)
    few = bad.count() <= BROADCAST_ROWS
    return back(docs.join(F.broadcast(bad) if few else bad, key == F.col("bad_key"), "left_anti"))


QUERIES = {"op9_decontam": op9_decontam}
