"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 2).

Training counts hashed n-grams of characters per language on a bounded, hash-drawn sample of labelled rows
(`per_label`, a parameter); the smoothed log-probability matrix has a fixed size (labels x buckets) and is broadcast.
Scoring covers every whole text: n-gram hashes gather rows of the matrix and are summed per document in numpy.

UTF-8 is decoded to code points, these are lower-cased one by one, each run of anything but letters and their marks becomes
one blank; n-grams of 1 to 4 characters therefore see word starts and ends. No column but text enters a prediction.

Defined results: null texts and texts without a letter are `und` with score 0; rows of null language are not learned
from; ties go to the label first in code-point order; without any labelled row everything is `und`; repeated rows are
scored alike; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ORDERS, BITS = (1, 2, 3, 4), 16
_folded: list[np.ndarray] = []


def folded() -> np.ndarray:
    """Code point -> its lower-case code point; a blank for what is neither letter nor mark. One table for planes 0 and 1."""
    if not _folded:
        out = np.full(1 << 17, 32, np.uint32)
        for c in range(len(out)):
            ch = chr(c)
            if ch.isalpha() or unicodedata.category(ch)[0] == "M":
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _folded.append(out)
    return _folded[0]


def characters(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters per text, code points) of UTF-8 texts; a stray continuation byte is part of the character before it."""
    lead = (data & 0xC0) != 0x80
    lead[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(lead)
    size = np.diff(np.append(at, len(data)))
    first = data[at].astype(np.uint32)
    code = np.where(first < 0x80, first, np.where(first < 0xE0, first & 0x1F, np.where(first < 0xF0, first & 0x0F, first & 0x07)))
    for k in (1, 2, 3):
        more = np.flatnonzero((size > k) & (first >= (0xC0, 0xE0, 0xF0)[k - 1]))
        code[more] = code[more] << np.uint32(6) | (data[at[more] + k] & 0x3F)
    return np.searchsorted(at, offsets[1:]) - np.searchsorted(at, offsets[:-1]), code


@dataclass
class Model:
    labels: list[str]
    prior: np.ndarray
    weights: np.ndarray  # buckets x labels, float32 log-probabilities


def ngrams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all n-grams of a block of texts; none crosses from one text to the next."""
    lens, code = characters(offsets, data)
    owner = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    table = folded()
    low = np.where(code < len(table), table[np.minimum(code, len(table) - 1)], code)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32) | (owner[1:] != owner[:-1])
    low, owner = low[keep], owner[keep]
    out, own = [], []
    h = np.zeros(len(low), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if n > len(low):
            break
        size = len(low) - n + 1
        h = h[:size] * np.uint32(0x01000193) + low[n - 1 :]
        if n not in ORDERS:
            continue
        bucket = ((h ^ np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        whole = owner[:size] == owner[n - 1 :]
        out.append(bucket[whole])
        own.append(owner[:size][whole])
    return (np.concatenate(out), np.concatenate(own)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int32))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n): the n-grams of the labels in one batch's blocks; bucket -1 counts documents."""
    for batch in batches:
        langs = np.asarray(batch.column("lang").to_pylist(), object)
        for first, rows, offsets, data in C.text_blocks(batch.column("text")):
            bucket, owner = ngrams(offsets, data)
            names, code = np.unique(langs[first : first + rows].astype(str), return_inverse=True)
            key, n = np.unique(code[owner].astype(np.int64) << BITS | bucket, return_counts=True)
            docs = np.bincount(code, minlength=len(names))
            lang = np.concatenate([names[key >> BITS], names])
            yield C.arrow_rows(lang=pa.array(lang.tolist(), pa.string()), bucket=pa.array(np.concatenate([key & (1 << BITS) - 1, np.full(len(names), -1)]).astype(np.int32)), n=pa.array(np.concatenate([n, docs]).astype(np.int64)))


def train(docs: DataFrame, per_label: int = 4000, alpha: float = 0.5, seed: int = 2) -> Model:
    """Fit on about per_label rows of each label of docs (doc_id, text, lang), drawn by a hash of the id."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # two aggregations: rows per label, and (of the sample) grams per label; the label set is what the model is made of
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(0), np.zeros((1 << BITS, 0), np.float32))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_003)) / 1_000_003.0
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_label / n))).otherwise(share)
    sample = known.filter(draw < share).select("lang", "text")
    # sparse counts are summed in the JVM; what comes here is a number per label and bucket, whatever the input
    rows = sample.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    labels = sorted(sizes, key=str.encode)
    place = {lang: i for i, lang in enumerate(labels)}
    counts = np.full((1 << BITS, len(labels)), alpha)
    bucket, lang, n = rows["bucket"].to_numpy(), np.array([place[x] for x in rows["lang"].to_pylist()], np.int64), rows["n"].to_numpy()
    own = bucket >= 0
    counts[bucket[own], lang[own]] += n[own]
    weights = np.log(counts) - np.log(counts.sum(0, keepdims=True))
    prior = np.array([sizes[x] for x in labels], float)
    return Model(labels, np.log(prior / prior.sum()), weights.astype(np.float32))


def score_block(model: Model, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best label, its posterior probability) of each text."""
    n = len(offsets) - 1
    bucket, owner = ngrams(offsets, data)
    total = np.empty((n, len(model.labels)))
    for k in range(len(model.labels)):
        total[:, k] = model.prior[k] + np.bincount(owner, weights=model.weights[:, k][bucket], minlength=n)
    best = total.argmax(1)
    top = total[np.arange(n), best]
    return best, 1 / np.exp(total - top[:, None]).sum(1)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs (doc_id, text, and any columns kept): those columns but text, lang_pred, score."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # labels x 65,536 floats, whatever the input
    docs = docs.withColumn("has_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    kept = [f for f in docs.schema.fields if f.name not in ("text", "has_letter")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        labels = np.array([*model.labels, "und"], object)
        for batch in batches:
            letter = batch.column("has_letter").to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(batch.num_rows, len(labels) - 1), np.zeros(batch.num_rows)
            if model.labels:
                for first, rows, offsets, data in C.text_blocks(batch.column("text")):
                    own = slice(first, first + rows)
                    best[own], score[own] = score_block(model, offsets, data)
            best[~letter], score[~letter] = len(labels) - 1, 0.0
            columns = {f.name: batch.column(f.name) for f in kept}
            yield C.arrow_rows(**columns, lang_pred=pa.array(labels[best].tolist(), pa.string()), score=pa.array(score))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(run, f"{kind}, lang_pred string, score double")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.pick(C.table(spark, sf_dir, "documents"), doc_id="long", text="string", lang="string").withColumn("held_out", C.remainder("doc_id", 3) == 1)
    model = train(docs.filter(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model)


QUERIES = {"op2_langid": op2_langid}
