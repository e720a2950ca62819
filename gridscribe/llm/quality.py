"""Document quality by a linear-chain conditional random field over lines (operator 8).

Each line is good or bad; its features are shares of kinds of characters, word repetition and shape, and those of the
neighbouring lines. The field has one weight per feature and four transition weights. Labels are given for documents
only: lines of good documents are good; those of bad documents start bad and are imputed again by the field between
rounds of fitting (at least one line of a bad document stays bad). A document's score is the length-weighted mean of its
lines' forward-backward marginals, calibrated by one logistic curve on the training documents.

The fit uses a bounded, hash-drawn sample of labelled documents: about `per_label` of each label, in the order of their
hashes as long as they have no more than `lines_per_label` lines together (what is longer teaches nothing). Scoring covers every
whole text, many documents in step; of a text only three numbers a line and the chain's arrays are held, some 110 bytes a
line, and its features in pieces of some MB.

Defined results: a null or empty text is one empty line and gets that line's score; a labelled id without document and rows
without label teach nothing; without any labelled row of both labels every score is 0.5; repeated rows are scored
alike; repeated labels of an id count once (the least), of repeated ids the least text teaches; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


def _kind(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_KINDS = [_kind(b"#$%&*^~<>{}[]=\\_@"), _kind(bytes(range(65, 91))), _kind(bytes(range(97, 123)) + bytes(range(128, 256))), _kind(bytes(range(48, 58))), _kind(b"|"), _kind(b"!"), _kind(b".,;:?")]
N_OWN = len(_KINDS) + 6
N_FEATURES = 1 + 3 * N_OWN
PIECE = 2 << 20


def line_features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines per text, bytes per line and its line feed, own features) of a block."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    per = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    bounds = np.append(starts, n)
    size = np.diff(bounds).astype(float)
    some = np.maximum(size, 1)
    own = np.zeros((len(starts), N_OWN))
    for k, kind in enumerate(_KINDS):
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        own[:, k] = (total[bounds[1:]] - total[bounds[:-1]]) / some
    counts, words = C.words_of(bounds, data)
    line = np.repeat(np.arange(len(starts)), counts)
    k = len(_KINDS)
    if len(words):
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
        key = C.mix(words + C.mix(line.astype(np.uint64)))
        order = np.argsort(key)
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[order][1:] != key[order][:-1]
        distinct = np.bincount(line[order[fresh]], minlength=len(starts))
        many = np.maximum(counts, 1)
        own[:, k] = np.bincount(line[again], minlength=len(starts)) / many
        own[:, k + 1] = np.where(counts >= 8, 1 - distinct / many, 0)
    own[:, k + 2] = np.log1p(counts) / 5
    own[:, k + 3] = np.minimum(2, size / np.maximum(counts, 1) / 10)
    own[:, k + 4] = counts == 0
    last = np.zeros(len(starts), np.uint8)
    inner = bounds[1:] - 1 - (np.isin(bounds[1:] - 1, breaks))
    ok = (size > 0) & (inner >= bounds[:-1])
    last[ok] = data[inner[ok]]
    own[:, k + 5] = np.isin(last, np.frombuffer(b".?!", np.uint8))
    return per, size + (size == 0), own


def with_neighbours(per: np.ndarray, own: np.ndarray) -> np.ndarray:
    out = np.zeros((len(own), N_FEATURES))
    out[:, 0] = 1
    out[:, 1 : 1 + N_OWN] = own
    first = np.zeros(len(own), bool)
    first[np.cumsum(per) - per] = True
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first] = 0
    after[np.roll(first, -1)] = 0
    out[:, 1 + N_OWN : 1 + 2 * N_OWN], out[:, 1 + 2 * N_OWN :] = before, after
    return out


@dataclass
class Field:
    unary: np.ndarray  # towards bad
    pair: np.ndarray  # [label before, label], in logs
    curve: np.ndarray  # of the calibration

    def marginals(self, per: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(P(bad) of each line, expected counts of label pairs, log partition)."""
        return chains(per, features @ self.unary, self.pair)

    def pieces(self, own: np.ndarray) -> np.ndarray:
        """What each line says about itself, the line after it and the line before it."""
        return own @ self.unary[1:].reshape(3, N_OWN).T

    def lines(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lines per text, bytes per line, P(bad) of each line) of a block, features made in pieces between line feeds."""
        breaks = np.flatnonzero(data == 10) + 1
        cuts, last = [0], 0
        for want in range(PIECE, len(data), PIECE):
            k = int(np.searchsorted(breaks, want))
            if k < len(breaks) and breaks[k] > last and breaks[k] < len(data):
                last = int(breaks[k])
                cuts.append(last)
        cuts.append(len(data))
        per, size, said = np.zeros(len(offsets) - 1, np.int64), [], []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            first = max(0, int(np.searchsorted(offsets, a, "right")) - 1) if i else 0
            end = int(np.searchsorted(offsets, b, "left")) if i < len(cuts) - 2 else len(offsets) - 1
            inner = np.clip(offsets[first : end + 1], a, b) - a
            k, s, own = line_features(inner, data[a:b])
            if i < len(cuts) - 2 and offsets[end] > b:  # the cut is behind a line feed: the empty rest is the next piece's first line
                k[-1] -= 1
                s, own = s[:-1], own[:-1]
            per[first:end] += k
            size.append(s)
            said.append(self.pieces(own))
        size, said = np.concatenate(size), np.concatenate(said)
        begin = np.zeros(len(size), bool)
        begin[np.cumsum(per) - per] = True
        unary = self.unary[0] + said[:, 0]
        unary[1:] += np.where(begin[1:], 0, said[:-1, 1])
        unary[:-1] += np.where(begin[1:], 0, said[1:, 2])
        return per, size, chains(per, unary, self.pair)[0]

    def score(self, per: np.ndarray, size: np.ndarray, bad: np.ndarray) -> np.ndarray:
        at = np.cumsum(per) - per
        share = np.add.reduceat(size * bad, at) / np.add.reduceat(size, at)
        return 1 / (1 + np.exp(np.clip(self.curve[0] + self.curve[1] * odds(share), -50, 50)))


def odds(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def chains(per: np.ndarray, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many chains in step, the longest first so that those still running are a head of the arrays."""
    order = np.argsort(-per, kind="stable")
    begin, length = (np.cumsum(per) - per)[order], per[order]
    good = 1 / (1 + np.exp(np.clip(unary, -50, 50)))
    emit = np.stack([good, 1 - good], 1)
    log_z = float(np.sum(np.log(np.maximum(good, 1e-300))) * -1)
    trans = np.exp(pair)
    ahead = np.empty((len(unary), 2))
    scale = np.empty(len(unary))
    steps = int(length[0]) if len(length) else 0
    runs = np.searchsorted(-length, -np.arange(steps), "left")
    for i in range(steps):
        at = begin[: runs[i]] + i
        a = emit[at] if i == 0 else emit[at] * (ahead[at - 1] @ trans)
        s = a.sum(1)
        ahead[at], scale[at] = a / s[:, None], s
    log_z += float(np.log(scale).sum())
    back = np.ones((len(unary), 2))
    pairs = np.zeros((2, 2))
    for i in range(steps - 1, 0, -1):
        at = begin[: runs[i]] + i
        e = emit[at] * back[at] / scale[at][:, None]
        pairs += trans * (ahead[at - 1].T @ e)
        back[at - 1] = e @ trans.T
    both = ahead * back
    return both[:, 1] / both.sum(1), pairs, log_z


def fit(per: np.ndarray, size: np.ndarray, own: np.ndarray, label: np.ndarray, rounds: int = 3, steps: int = 60, ridge: float = 1e-3) -> Field:
    """Fit on documents of known label (1 good). Adam on the mean log-likelihood per line."""
    features = with_neighbours(per, own)
    at = np.cumsum(per) - per
    doc = np.repeat(np.arange(len(per)), per)
    inside = np.ones(len(own), bool)
    inside[at] = False
    y = (label[doc] == 0).astype(float)
    theta, m, v, t = np.zeros(N_FEATURES + 4), 0.0, 0.0, 0
    field = Field(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2), np.zeros(2))
    for r in range(rounds):
        if r:  # impute the lines of bad documents: the field's own opinion, but one line is bad at least
            bad = field.marginals(per, features)[0]
            top = np.maximum.reduceat(bad, at)
            y = np.where(label[doc] == 0, (bad >= 0.5) | (bad == top[doc]), 0).astype(float)
        prev = np.concatenate([[0], y[:-1]])
        seen = np.array([[np.sum(inside & (prev == a) & (y == b)) for b in (0, 1)] for a in (0, 1)], float)
        for _ in range(steps):
            t += 1
            p, pairs, _z = chains(per, features @ theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))
            g = np.concatenate([features.T @ (y - p), (seen - pairs).ravel()]) / len(own) - ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        field = Field(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2), np.zeros(2))
    bad = field.marginals(per, features)[0]
    x = odds(np.add.reduceat(size * bad, at) / np.add.reduceat(size, at))
    w = np.zeros(2)
    design = np.stack([np.ones(len(x)), x], 1)
    target = (label == 0).astype(float)
    for _ in range(30):  # Newton steps of a logistic fit, slightly shrunk
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + 0.05 * np.eye(2)
        w = w + np.linalg.solve(h, design.T @ (target - p) - 0.05 * w)
    field.curve = w
    return field


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        ids = batch.column("doc_id").to_pylist()
        for first, rows, offsets, data in C.text_blocks(batch.column("text")):
            per, size, own = line_features(offsets, data)
            end = np.cumsum(per)
            parts = [(size[e - k : e].tobytes(), own[e - k : e].tobytes()) for k, e in zip(per, end, strict=True)]
            yield C.arrow_rows(doc_id=pa.array(ids[first : first + rows], pa.int64()), label=pa.array(label[first : first + rows].astype(np.int32)), size=pa.array([p[0] for p in parts], pa.binary()), own=pa.array([p[1] for p in parts], pa.binary()))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1500, lines_per_label: int = 100_000, seed: int = 8) -> Field | None:
    """Fit on the documents of about per_label labelled ids of each label (doc_id, label), drawn by a hash of the id."""
    C.bound_batches(docs.sparkSession)
    with C.scratch(docs.sparkSession):
        return _fitted(docs, labels, per_label, lines_per_label, seed)


def _fitted(docs: DataFrame, labels: DataFrame, per_label: int, lines_per_label: int, seed: int) -> Field | None:
    labels = labels.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_003)) / 1_000_003.0
    ids = labels.filter(draw < F.when(F.col("label") == 1, min(1.0, per_label / sizes[1])).otherwise(min(1.0, per_label / sizes[0]))).withColumn("draw", draw)
    # about 2 * per_label rows; their lines are counted before any features come here
    few = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label", "draw").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    few = C.stage(few.withColumn("n_lines", F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1), "quality-sample")
    room, chosen = {0: lines_per_label, 1: lines_per_label}, []
    for r in sorted(few.select("doc_id", "label", "draw", "n_lines").collect(), key=lambda r: (r["draw"], r["doc_id"])):
        if r["n_lines"] <= room[r["label"]]:
            room[r["label"]] -= r["n_lines"]
            chosen.append(r["doc_id"])
    rows = few.filter(F.col("doc_id").isin(chosen)).select("doc_id", "label", "text").mapInArrow(_sampled, "doc_id long, label int, size binary, own binary").toArrow().sort_by("doc_id")
    label = rows["label"].to_numpy()
    if len(set(label.tolist())) < 2:
        return None
    size = [np.frombuffer(x.as_py()) for x in rows["size"]]
    own = np.concatenate([np.frombuffer(x.as_py()).reshape(-1, N_OWN) for x in rows["own"]])
    return fit(np.array([len(x) for x in size]), np.concatenate(size), own, label)


def predict(docs: DataFrame, field: Field | None, cut: float = 0.3) -> DataFrame:
    """The columns of docs, with score (double) and predicted (int)."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    shared = spark.sparkContext.broadcast(field)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if field is not None:
                for first, rows, offsets, data in C.text_blocks(batch.column("text")):
                    score[first : first + rows] = field.score(*field.lines(offsets, data))
            yield C.arrow_rows(**{n: batch.column(n) for n in names}, score=pa.array(score), predicted=pa.array((score >= cut).astype(np.int32)))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kind}, score double, predicted int")


def _field(spark: SparkSession, sf_dir: str) -> Field | None:
    docs = C.pick(C.table(spark, sf_dir, "documents"), doc_id="long", text="string")
    labels = C.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    return train(docs, labels.filter(C.remainder("doc_id", 5) != 0))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.pick(C.table(spark, sf_dir, "documents"), doc_id="long", text="string")
    return predict(docs.withColumn("held_out", C.remainder("doc_id", 5) == 0), _field(spark, sf_dir)).drop("text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the field does not reject."""
    own, back = C.apart(docs, "text")
    return back(predict(own, _field(spark, sf_dir)).filter("predicted = 1"))


QUERIES = {"op8_quality": op8_quality}
