"""Circulant MinHash near-duplicate detection (operator 5).

Signatures: a first permutation scatters a document's shingles over a circle of 2**22 slots, a second permutation gives each
slot a rank; coordinate k is the least rank when the second permutation is shifted circularly by k. All coordinates of a
shingle are one contiguous slice of the rank table, so a signature is a minimum over slices.

Plan: exact copies (equal sets) first become one class by hash aggregation. Classes that share a band of the signature meet
in a bucket. Of each bucket, the member met most often over all buckets (the likely original of a family) is compared with
all others; the links are contracted to components. Buckets that still hold several components are then compared in
full: their sets are dealt to classes of similar size and, inside these, to blocks bounded in sets and bytes; a block is held
while the sets that may be similar stream past it, and matrix products find the links, so no row is ever made for a pair,
and a bucket of any size is many tasks. Every link is verified on full sets. A bucket inside one component needs no more
comparisons, for its pairs could add no component.

Hot keys: joins by bucket, class and component go through common.counted_join, which broadcasts the few hot keys' single rows
instead of shuffling their many. A centre's set is sent once to each part of its rows, never once per pair. Where `components`
meets a hub it does the same; its alternating stars need O(log(n)**2) rounds for n nodes.

Recall: with 30 bands of 6 rows a pair at similarity 0.85 misses every band with probability 7e-7 (0.8: 9e-5 for the default of
5-word shingles, which uses 5 rows and 40 bands: 1e-7).

Defined results: a null or empty text has no shingles and is linked with nothing; a text shorter than a shingle is one
shingle; rows of one doc_id are one document with several texts; a row without doc_id takes its class's component;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SLOT_BITS = 22
#: Rows of two numbers that are broadcast at most, so that texts needn't be shuffled to meet them; beyond it they are.
BROADCAST_ROWS = 1 << 20
_tables: dict[tuple[int, int], np.ndarray] = {}


def ranks(k: int, seed: int = 5) -> np.ndarray:
    """Row p: the ranks of slot p under shifts 0..k-1 of the second permutation (a view, not a copy)."""
    if (k, seed) not in _tables:
        pi = np.random.default_rng(seed).permutation(1 << SLOT_BITS).astype(np.int32)
        _tables[k, seed] = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k)
    return _tables[k, seed]


def slots(shingles: np.ndarray) -> np.ndarray:
    """The first permutation: an odd multiplier permutes 64-bit values, their top bits are the slot."""
    return ((shingles * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes: k words, or all words of a shorter text."""
    factors = C.mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)  # unrelated, so that no order of words equals another's
    for _, _, offsets, data in C.text_blocks(column):
        counts, words = C.words_of(offsets, data)
        ends = np.cumsum(counts)
        n = len(words) - k + 1
        if n > 0:
            rolled = words[:n] * factors[0]
            for i in range(1, k):
                rolled += words[i : n + i] * factors[i]
            rolled = C.mix(rolled)
        for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
            if count >= k:
                yield np.unique(rolled[end - count : end - k + 1])
            elif count:
                few = words[end - count : end]
                yield C.mix(np.array([sum(int(w) * int(f) for w, f in zip(few, factors, strict=False)) + count & (1 << 64) - 1], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    table, at = ranks(k), slots(shingles)
    low = np.full(k, 1 << SLOT_BITS, np.int32)
    for i in range(0, len(at), 2048):
        np.minimum(low, table[at[i : i + 2048]].min(0), out=low)
    return low


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    factors = C.mix(np.arange(1, rows + 1, dtype=np.uint64))
    keys = (sig.reshape(bands, rows).astype(np.uint64) * factors).sum(1, dtype=np.uint64)
    return C.mix(keys + C.mix(np.arange(bands, dtype=np.uint64) + np.uint64(77))).view(np.int64)


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, hi and lo (128-bit digest of the set), keys (one per band; none for an empty set)."""
    C.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys = [], [], []
            for s in shingle_sets(batch.column("text"), k):
                sizes.append(len(s))
                digests.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else np.zeros(0, np.int64))
            d = np.array(digests, np.int64).reshape(-1, 2)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            at = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            yield C.arrow_rows(doc_id=batch.column("doc_id"), n_shingles=pa.array(sizes, pa.int64()), hi=pa.array(d[:, 0]), lo=pa.array(d[:, 1]), keys=pa.ListArray.from_arrays(pa.array(at), pa.array(flat)))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long, keys array<long>")


def shingled(docs: DataFrame, k: int) -> DataFrame:
    """(rep, s): the full set of each text as 8-byte hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield C.arrow_rows(rep=batch.column("doc_id"), s=pa.array([x.tobytes() for x in shingle_sets(batch.column("text"), k)], pa.binary()))

    return docs.select("doc_id", "text").mapInArrow(run, "rep long, s binary")


class Block:
    """Some sets, and how many elements other sets share with each."""

    def __init__(self, sets: list[np.ndarray]):
        every = np.concatenate(sets)
        self.sizes = np.array([len(x) for x in sets])
        self.names, self.at = np.unique(every, return_inverse=True)
        self.rows = np.repeat(np.arange(len(sets)), self.sizes)

    def common(self, others: list[np.ndarray], step: int = 8192) -> np.ndarray:
        """Sizes of all intersections, by matrix products over slices of the elements."""
        y = np.concatenate(others)
        cols = np.repeat(np.arange(len(others)), [len(x) for x in others])
        at = np.minimum(np.searchsorted(self.names, y), len(self.names) - 1)
        hit = self.names[at] == y
        at, cols = at[hit], cols[hit]
        if len(self.sizes) == 1:
            return np.bincount(cols, minlength=len(others))[None, :]
        out = np.zeros((len(self.sizes), len(others)), np.float32)
        for low in range(0, len(self.names), step):
            wide = min(step, len(self.names) - low)
            own = (at >= low) & (at < low + wide)
            if not own.any():
                continue
            b = np.zeros((len(others), wide), np.float32)
            b[cols[own], at[own] - low] = 1
            a = np.zeros((len(self.sizes), wide), np.float32)
            own = (self.at >= low) & (self.at < low + wide)
            a[self.rows[own], self.at[own] - low] = 1
            out += a @ b.T
        return out.astype(np.int64)


STREAM = "key long, size_class int, block int, part int, passing int, rep long, c long, s binary"
GROUP = ("key", "size_class", "block", "part")


def streamed_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of rows (STREAM): in each group the sets of passing = 0 are held, those of passing = 1 stream past them.

    Returned are links that join components c which no other returned link of the group joins. A held block is bounded by
    who made it; of what streams, one Arrow batch is in memory.
    """
    # unit weight for each row: groups are parts of bounded work, dealt by hash
    dealt = rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "passing", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block, root = None, [], None, {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        def links(reps: list, comps: list, sets: list) -> list[tuple[int, int]]:
            sizes = np.array([len(x) for x in sets])
            both = block.common(sets)
            hit = (100 * both >= percent * (block.sizes[:, None] + sizes[None, :] - both)) & (both > 0)
            out = []
            for i, j in zip(*np.nonzero(hit), strict=True):
                p, q = find(held[i][1]), find(comps[j])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((held[i][0], reps[j]))
            return out

        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [batch.column(c).to_pylist() for c in (*GROUP, "passing", "rep", "c")]
            sets = batch.column("s")
            reps, comps, waiting, size = [], [], [], 0

            def flush() -> None:
                nonlocal size
                if waiting and held:
                    out.extend(links(reps, comps, waiting))
                reps.clear(), comps.clear(), waiting.clear()
                size = 0

            for n, row in enumerate(zip(*columns, strict=True)):
                if row[:4] != key:
                    flush()
                    key, held, block, root = row[:4], [], None, {}
                s = np.frombuffer(sets[n].as_py(), np.uint64)
                if row[4] == 0:
                    held.append((row[5], row[6], s))
                    continue
                if block is None and held:
                    block = Block([x for _, _, x in held])
                    held = [(r, c, None) for r, c, _ in held]
                reps.append(row[5]), comps.append(row[6]), waiting.append(s)
                size += len(s)
                if len(waiting) >= 128 or size > 1 << 20:
                    flush()
            flush()
            yield C.arrow_rows(a=pa.array([x for x, _ in out], pa.int64()), b=pa.array([y for _, y in out], pa.int64()))

    return dealt.mapInArrow(run, "a long, b long")


def links_of_centres(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of pairs (centre, rep, part), verified on full sets; each part of a centre's rows gets its set once."""
    head = lambda passing: [F.col("centre").alias("key"), F.lit(0).alias("size_class"), F.lit(0).alias("block"), F.col("part").cast("int").alias("part"), F.lit(passing).alias("passing")]
    passing = pairs.join(sets, "rep").select(*head(1), "rep", F.col("rep").alias("c"), "s")
    parts = pairs.select("centre", "part").distinct()
    held = parts.join(sets.withColumnRenamed("rep", "centre"), "centre").select(*head(0), F.col("centre").alias("rep"), F.col("centre").alias("c"), "s")
    return streamed_links(held.unionByName(passing), percent)


def settled_in_blocks(rest: DataFrame, sets: DataFrame, percent: int, block: int = 512, held_bytes: int = 4 << 20, passing_rows: int = 1 << 15) -> DataFrame:
    """Links (a, b) of the buckets rest (key, rep, c: component, size): all sets of a bucket that may be similar are compared.

    Of two sets that could join components one at least is outside the bucket's largest component: those are held, all pass.
    """
    # sets whose sizes differ by more than the similarity allows can't be linked: classes that are two apart
    rest = rest.withColumn("size_class", F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int"))
    counted = rest.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "c"))["c"].alias("largest"), F.sum("m").alias("n"))
    rest = C.stage(C.counted_join(rest, C.stage(counted, "largest"), ["key"]).withColumn("holds", F.col("c") != F.col("largest")).select("key", "size_class", "rep", "c", "size", "holds"), "dealt")
    classes = C.stage(rest.groupBy("key", "size_class").agg(F.count("*").alias("n"), F.sum(F.col("holds").cast("long")).alias("held"), F.sum(F.when(F.col("holds"), F.col("size")).otherwise(0)).alias("total")), "size-classes")
    near = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    passers = classes.select("key", near("size_class").alias("size_class"), "n").groupBy("key", "size_class").agg(F.sum("n").alias("n"))
    holders = classes.filter("held > 0").select("key", "size_class", "held", F.greatest(F.ceil(F.col("held") / block), F.ceil(F.col("total") * 8 / held_bytes)).cast("int").alias("blocks"))
    holders = holders.join(passers, ["key", "size_class"]).withColumn("parts", F.ceil(F.col("n") / passing_rows).cast("int"))
    holders = C.stage(holders, "holders")  # n: how many rows pass it
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = C.counted_join(rest.filter("holds").select("key", "size_class", "rep", "c"), holders, ["key", "size_class"])
    held = held.select("key", "size_class", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), numbers("parts").alias("part"), F.lit(0).alias("passing"), "rep", "c")
    passing = C.counted_join(rest.select("key", near("size_class").alias("size_class"), "rep", "c"), holders, ["key", "size_class"])
    passing = passing.select("key", "size_class", numbers("blocks").alias("block"), F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("passing"), "rep", "c")
    every = held.unionByName(passing)
    return streamed_links(every.join(sets, "rep").select("key", "size_class", "block", "part", "passing", "rep", "c", "s"), percent)


def components(links: DataFrame) -> DataFrame:
    """(rep, comp): comp is the least node reachable over links (a, b). Alternating large and small stars until nothing moves.

    Each round is two aggregations and two joins over the edges; the state is written to the shared folder.
    """
    edges = C.stage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = C.stage(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = C.stage(C.counted_join(both, least, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        # small star: every node and its lesser neighbours point to the least of them
        low = C.stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        small = C.counted_join(large, low, ["u"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = C.stage(small, "star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("comp"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, part_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs = C.pick(docs, doc_id="long", text="string")
    base = C.stage(sketches(docs, k, bands, rows), "sketch")
    with C.scratch(docs.sparkSession):
        named = C.stage(_classes(docs, base, k, percent, part_bytes), "named", keep=True)
    some = C.counted_join(base.filter("n_shingles > 0").select("doc_id", "n_shingles", "hi", "lo"), named, ["hi", "lo"])
    none = base.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = some.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).unionByName(none)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _classes(docs: DataFrame, base: DataFrame, k: int, percent: int, part_bytes: int) -> DataFrame:
    """(hi, lo, n, component) of the classes of equal sets: how many rows a class has, and its component."""
    classes = base.filter("n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"), F.count("*").alias("n"), F.min("keys").alias("keys"))
    classes = C.stage(classes, "classes")
    members = classes.filter("rep IS NOT NULL").select("rep", "size", F.explode("keys").alias("key"))
    shared = C.stage(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    live = C.stage(C.counted_join(members, shared, ["key"]), "live")  # (key, rep, size, n) of buckets with two members or more
    if live.isEmpty():
        return classes.select("hi", "lo", "n", F.col("rep").alias("component"))
    met = C.stage(live.groupBy("rep").agg(F.sum("n").alias("met")), "met")
    again = not base.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    reps = met.select(F.col("rep").alias("doc_id"))
    sets = shingled(docs.join(F.broadcast(reps) if met.count() <= BROADCAST_ROWS else reps, "doc_id", "left_semi"), k)
    sets = C.stage(sets.distinct() if again else sets, "sets")
    top = live.join(met, "rep").groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("minus"), F.col("size").alias("of"))).alias("t"), F.max("n").alias("n"))
    top = C.stage(top.select("key", "n", (-F.col("t.minus")).alias("centre"), F.col("t.of").alias("of")), "centres")
    pairs = C.counted_join(live.drop("n"), top, ["key"]).filter("rep <> centre").filter(100 * F.least("size", "of") >= percent * F.greatest("size", "of"))
    # a centre's rows go to parts of some bytes; of the parts that a pair's buckets would give it the least will do
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") * F.col("of") * 8 / part_bytes))
    pairs = C.stage(pairs.groupBy("centre", "rep").agg(F.min(part).alias("part")), "pairs")
    links = C.stage(links_of_centres(pairs, sets, percent), "links")
    comp = C.stage(components(links), "components")
    label = C.stage(live.join(comp, "rep", "left").select("key", "rep", "size", F.coalesce("comp", "rep").alias("c")), "labels")
    # a bucket of two has been compared; one inside a component is settled
    torn = label.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).filter("lo <> hi AND n > 2").select("key", "n")
    rest = C.stage(C.counted_join(label, C.stage(torn, "torn"), ["key"]).drop("n"), "rest")
    if not rest.isEmpty():
        comp = C.stage(components(links.unionByName(C.stage(settled_in_blocks(rest, sets, percent), "links"))), "components")
    return classes.select("hi", "lo", "rep", "n").join(comp, "rep", "left").select("hi", "lo", "n", F.coalesce("comp", "rep").alias("component"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"), k=3, percent=85, bands=30, rows=6)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row of the least id (null last) and then of the least key; every row is linked by its own text.

    A repeated row (equal id and text) stays once, but rows that have neither id nor words all stay.
    """
    docs, back = C.apart(docs, "doc_id", "text")
    key = C.row_key("doc_id", "text")
    with C.scratch(spark):
        near = near_duplicates(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "n_shingles", "component_id").distinct()
        who = docs.select(key.alias("key"), "doc_id").distinct()
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
        named = C.stage(near.join(who, "key"), "named")
        keep = C.stage(named.groupBy("component_id").agg(F.min(order)["key"].alias("_key"), F.max("n_shingles").alias("_n")).drop("component_id"), "keep", keep=True)
    own = docs.withColumn("_key", key)
    kept = F.broadcast(keep) if keep.count() <= BROADCAST_ROWS else keep
    out = own.join(kept, "_key")
    again = own.groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1").join(kept, "_key")
    if again.isEmpty():
        return back(out)
    bare = out.filter("_n = 0 AND doc_id IS NULL").select(*docs.columns)
    return back(out.filter("_n > 0 OR doc_id IS NOT NULL").dropDuplicates(["_key"]).select(*docs.columns).unionByName(bare))


QUERIES = {"op5_minhash": op5_minhash}
