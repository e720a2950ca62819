"""Mixing sources to target weights by Sainte-Lague apportionment (operator 10).

Every source gets a target of words; equal-token blocks go to the sources by highest quotients share / (2 * held + 1), each
source's blocks go to its shards in the same way, and a seeded systematic draw picks the blocks inside a shard. A shard is
a bounded hash slice of one source, so a source that holds a third of all rows is many shards and many tasks.

Highest quotients are found by their divisor d: who has share s gets floor(s / d + 1/2) seats. A few aggregations over all items,
each of which counts the seats for many divisors at once, narrow d until no item gains more than one seat between
its bounds; the seats left go to the best of those items, which a range-partitioned sort numbers. So there is no window over
a source, and the driver sees neither sources nor shards (host names may be sources).

Only keys and sizes are shuffled, unless the texts of the mix are asked for.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; repeated rows are separate
documents and may be taken to differing extents; a source without words has target 0 and nothing taken; documents of which
nothing is taken are no part of the stage's result; an empty table gives an empty mix; extra columns are ignored by
mix_sources and kept by the stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridscribe.plans.staging import numbered

from . import common as C

TRIED = 32  # divisors tried at once
BROADCAST_ROWS = 100_000


def apportioned(shares: DataFrame, group: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """shares (group, tie, share, seats) with quota: its group's seats by highest quotients; ties go to the lesser tie columns.

    seats is one number for all rows of a group. Null-free group columns.
    """
    shares = C.stage(shares, "shares")
    seats_at = lambda d: F.when(d > 0, F.floor(F.col("share") / d + 0.5)).otherwise(0)
    bounds = shares.groupBy(*group).agg(F.sum("share").alias("total"), F.count("*").alias("k"), F.max("share").alias("top"), F.max("seats").alias("want"))
    # rounding moves each item by half a seat at most: so the divisor lies between these
    bounds = bounds.select(*group, "want", (F.col("total") / (F.col("want") + F.col("k") / 2 + 1)).alias("low"), F.when(F.col("want") > F.col("k") / 2 + 1, F.col("total") / (F.col("want") - F.col("k") / 2 - 1)).otherwise(2.0 * F.col("top") + 1).alias("high"))
    bounds = C.stage(bounds, "bounds")
    few = bounds.count() <= BROADCAST_ROWS
    while True:
        both = shares.join(F.broadcast(bounds) if few else bounds, list(group))
        divisor = lambda j: F.col("low") + (F.col("high") - F.col("low")) * (j / TRIED)
        counts = [F.sum(seats_at(divisor(j))).alias(f"n{j}") for j in range(1, TRIED)]
        tried = both.groupBy(*group, "want", "low", "high").agg(F.max(seats_at(F.col("low")) - seats_at(F.col("high"))).alias("gap"), *counts)
        # the least divisor that hands out no more than is wanted, and the one below it
        at = F.coalesce(*(F.when(F.col(f"n{j}") <= F.col("want"), j) for j in range(1, TRIED)), F.lit(TRIED))
        tried = tried.withColumn("at", at)
        bounds = C.stage(tried.select(*group, "want", "gap", F.when(F.col("gap") > 1, divisor(F.col("at") - 1)).otherwise(F.col("low")).alias("low"), F.when(F.col("gap") > 1, divisor(F.col("at"))).otherwise(F.col("high")).alias("high")), "bounds")
        wide = bounds.filter("gap > 1 AND high > low * (1 + 1e-14)")
        bounds = bounds.drop("gap")
        if wide.isEmpty():
            break
    both = shares.join(F.broadcast(bounds) if few else bounds, list(group)).withColumn("base", seats_at(F.col("high"))).withColumn("more", seats_at(F.col("low")) > F.col("base"))
    both = C.stage(both.drop("low", "high"), "base")
    left = both.groupBy(*group).agg((F.max("want") - F.sum("base")).alias("left"))
    ranked = numbered(both.filter("more").select(*group, (-F.col("share") / (2 * F.col("base") + 1)).alias("quotient"), *tie), [*group, "quotient", *tie], "place")
    first = ranked.groupBy(*group).agg(F.min("place").alias("first"))
    per = left.join(first, list(group))
    lucky = ranked.join(F.broadcast(per) if few else per, list(group)).filter("place - first < left").select(*group, *tie, F.lit(1).alias("lucky"))
    out = both.join(lucky, [*group, *tie], "left")
    return out.select(*group, *tie, "share", "seats", (F.col("base") + F.coalesce("lucky", F.lit(0))).cast("long").alias("quota"))


def targets(sizes: DataFrame, total: float, most: float) -> DataFrame:
    """sizes (n, weight) with target: total by weight; none above most * n, what exceeds that is shared again by weight.

    A target is min(most * n, level * weight); the level rises by one aggregation a step until nobody new is capped.
    """
    level = 0.0
    while True:
        capped = F.lit(float(most)) * F.col("n") < F.lit(level) * F.col("weight")
        fixed, free = sizes.agg(F.sum(F.when(capped, F.lit(float(most)) * F.col("n"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not free:
            level = float("inf")
            break
        now = (total - (fixed or 0.0)) / free
        if now <= level * (1 + 1e-12):
            break
        level = now
    return sizes.withColumn("target", F.least(F.lit(float(most)) * F.col("n"), F.lit(level) * F.col("weight")).cast("double") if level != float("inf") else F.lit(float(most)) * F.col("n"))


def spread(big: DataFrame, small: DataFrame, keys: Sequence[str], few: bool, part: Column, parts: int = 32) -> DataFrame:
    """big joined with small (one row per key): broadcast if few; else a key's rows go to many tasks, each with a copy of its row."""
    if few:
        return big.join(F.broadcast(small), list(keys))
    copies = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return big.withColumn("_part", F.pmod(part, F.lit(parts)).cast("int")).join(copies, [*keys, "_part"]).drop("_part")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, block_tokens: int = 32, shard_tokens: int = 1 << 16, seed: int = 20, carry: Column | None = None) -> DataFrame:
    """One row per row of docs (doc_id, source, text): size, source_size, target, the shard's blocks and quota, passes, spans, taken.

    weights repeat over the sources in code-point order, null last. The mix takes the whole document `passes` times, and beside
    that the words of `spans` (start, length; words from 0) once each; taken counts all these words and never exceeds most * size.
    carry: a column of docs that comes along as `carried`.
    """
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), C.n_words(F.col("text").cast("string")).alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text").isNull(), F.col("text")).alias("key"), *([carry.alias("carried")] if carry is not None else []),
    )
    # what comes along is not written: the sizes are, and the rows that carry more are told by their texts once more
    full = named = named.withColumn("no_source", F.col("source").isNull()).withColumn("named", F.coalesce("source", F.lit("")))
    named = C.stage(named.drop("carried"), "mix-sizes")
    with C.scratch(docs.sparkSession):
        return _mix(full if carry is not None else named, named, weights, share, most, block_tokens, shard_tokens, seed)


def _mix(full: DataFrame, named: DataFrame, weights: Sequence[float], share: float, most: int, block_tokens: int, shard_tokens: int, seed: int) -> DataFrame:
    carries = "carried" in full.columns
    sources = named.groupBy("named", "no_source").agg(F.sum("size").alias("n"), F.count("*").alias("n_docs"))
    sources = C.stage(numbered(sources, ["no_source", "named"], "at"), "sources")
    total = sources.agg(F.sum("n"), F.count("*")).first()
    if not total[1]:
        kind = "doc_id long, source string, size long, source_size long, target double, shard_quota long, shard_blocks long, passes long, spans array<struct<start:long,length:long>>, taken long"
        empty = full.sparkSession.createDataFrame([], kind)
        return empty.withColumn("carried", F.lit(None).cast(full.schema["carried"].dataType)) if carries else empty
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("at") % len(weights) + 1).cast("int"))
    goals = targets(sources.withColumn("weight", weight), share * total[0], most)
    goals = goals.withColumn("share", F.col("target")).withColumn("one", F.lit(1))
    goals = C.stage(goals, "goals")
    seats = goals.agg(F.round(F.sum("target") / block_tokens).cast("long")).first()[0]
    quotas = apportioned(goals.select("one", "at", "share", F.lit(seats).alias("seats")), ["one"], ["at"]).select("at", F.col("quota").alias("source_quota"))
    few = total[1] <= BROADCAST_ROWS
    # a shard has a bounded number of words and of documents
    plan = goals.join(F.broadcast(quotas) if few else quotas, "at").select("named", "no_source", F.col("n").alias("source_size"), "target", "source_quota", F.ceil((F.col("n") + F.col("n_docs")) / shard_tokens).alias("n_shards"))
    plan = C.stage(plan, "mix-plan", keep=True)
    deal = lambda rows: spread(rows, plan, ["named", "no_source"], few, F.col("key")).withColumn("shard", F.pmod(F.xxhash64("key"), "n_shards"))

    shards = deal(named).groupBy("named", "no_source", "shard").agg(F.sum("size").alias("share"), F.max("source_quota").alias("seats"))
    shards = apportioned(shards, ["named", "no_source"], ["shard"]).withColumn("n_blocks", F.ceil(F.col("share") / block_tokens))
    shards = C.stage(shards.select("named", "no_source", "shard", "n_blocks", F.least("quota", most * F.col("n_blocks")).alias("quota")), "mix-shards", keep=True)
    in_shard = Window.partitionBy("named", "no_source", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    x = deal(full).join(shards, ["named", "no_source", "shard"]).withColumn("end", F.sum("size").over(in_shard)).withColumn("begin", F.col("end") - F.col("size"))
    nb = F.greatest("n_blocks", F.lit(1))
    x = x.withColumn("passes", F.expr("quota div greatest(n_blocks, 1)")).withColumn("extra", F.col("quota") % nb).withColumn("phase", F.pmod(F.xxhash64(F.lit(seed), "named", "shard"), nb))
    # of the blocks before block i the draw takes (i * extra + phase) div n_blocks: extra of all, evenly, from a seeded phase
    before = lambda i: F.floor((i * F.col("extra") + F.col("phase")) / nb)
    blocks = F.sequence(F.expr(f"begin div {block_tokens}"), F.expr(f"(end - 1) div {block_tokens}"))
    start = lambda i: F.greatest(i * block_tokens, F.col("begin"))
    span = lambda i: F.struct((start(i) - F.col("begin")).alias("start"), (F.least((i + 1) * block_tokens, F.col("end")) - start(i)).alias("length"))
    none = F.array().cast("array<struct<start:long,length:long>>")
    spans = F.when((F.col("size") > 0) & (F.col("extra") > 0), F.transform(F.filter(blocks, lambda i: before(i + 1) > before(i)), span)).otherwise(none)
    x = x.withColumn("spans", spans)
    taken = F.when(F.col("size") > 0, F.col("passes") * F.col("size") + F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])).otherwise(0)
    return x.select("doc_id", "source", "size", "source_size", "target", F.col("quota").cast("long").alias("shard_quota"), F.col("n_blocks").cast("long").alias("shard_blocks"), "passes", "spans", taken.cast("long").alias("taken"), *(["carried"] if carries else []))


def mixed_text(text: Column, size: Column, passes: Column, spans: Column) -> Column:
    """The words that the mix takes of a text: the whole text `passes` times, then the spans' words, joined by blanks."""
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), lambda w: w != "")
    whole = (F.size(spans) > 0) & (F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["length"]) == size)
    copies = F.array_repeat(text, (passes + whole.cast("long")).cast("int"))
    parts = F.when(whole | (F.size(spans) == 0), copies).otherwise(F.concat(copies, F.get(F.transform(F.array(words), lambda w: F.transform(spans, lambda s: F.array_join(F.slice(w, (s["start"] + 1).cast("int"), s["length"].cast("int")), " "))), 0)))
    return F.array_join(parts, "\n")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(C.table(spark, sf_dir, "documents")).drop("spans")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the columns of docs, text being what the mix takes of it (repeats included), and the numbers of mix_sources.

    Documents of which the mix takes nothing are left out. n_chars is counted anew.
    """
    mixed = mix_sources(docs, carry=F.struct(*(F.col(f"`{c}`") for c in docs.columns))).filter("taken > 0")
    of = lambda c: F.col("carried")[c]
    mixed = mixed.withColumn("new_text", mixed_text(of("text").cast("string"), F.col("size"), F.col("passes"), F.col("spans")))
    new = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    more = [c for c in ("size", "source_size", "target", "passes", "taken") if c not in docs.columns]
    return mixed.select(*(new.get(c, of(c)).alias(c) for c in docs.columns), *more)


QUERIES = {"op10_mixing": op10_mixing}
