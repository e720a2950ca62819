"""Exact retrieval over vectors, and evaluation of ranked runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridscribe.plans.staging import numbered


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def minus_squared_distance(a: Column, b: Column) -> Column:
    return F.lit(0.0) - F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


KNN = "qid long, p_id long, table_id string, score double"


def knn(queries: DataFrame, passages: DataFrame, k: int, batch: int = 1 << 16, lanes: int = 4096) -> DataFrame:
    """(qid, p_id, table_id, score, rank): the k passages of largest inner product; ties go to the lesser p_id.

    Queries (qid, q: as long as emb) go in blocks of at most `batch`, each one broadcast matrix; a task scores its passages against it
    by matrix products and keeps its k best per query, so a scan of the passages serves a whole block and what is shuffled
    are k rows per query and task.
    """
    spark = queries.sparkSession
    asked = numbered(queries.select("qid", "q"), ["qid"], "at")
    n = asked.count()
    out = None
    for low in range(0, max(1, n), batch):
        part = asked.filter((F.col("at") >= low) & (F.col("at") < low + batch)).orderBy("at").select("qid", "q").toArrow()  # at most batch rows
        ids = part["qid"].to_numpy()
        wide = len(part["q"][0].as_py()) if len(ids) else 0
        matrix = np.array(part["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(len(ids), wide)
        rows = passages.select("p_id", "table_id", "emb").mapInArrow(_best_of(spark.sparkContext.broadcast((ids, matrix)), k, lanes), KNN)
        out = rows if out is None else out.unionByName(rows)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "p_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def _best_of(shared, k: int, lanes: int):
    """A task's fold: the k best (score, p_id, table) per query over all its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        held: list[tuple | None] = [None] * -(-len(ids) // lanes)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            own = batch.column("p_id").to_numpy(zero_copy_only=False)
            emb = np.array(batch.column("emb").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
            tables = np.asarray(batch.column("table_id").to_pylist(), object)
            for step in range(0, batch.num_rows, 1024):
                p, t, e = own[step : step + 1024], tables[step : step + 1024], emb[step : step + 1024]
                for lane in range(len(held)):
                    score = np.round(matrix[lane * lanes : (lane + 1) * lanes] @ e.T, 6)
                    q, at = np.nonzero(score >= np.partition(score, score.shape[1] - k, 1)[:, [score.shape[1] - k]]) if score.shape[1] > k else np.nonzero(np.ones(score.shape, bool))
                    new = (q, score[q, at], p[at], t[at])
                    old = held[lane]
                    both = new if old is None else tuple(np.concatenate([a, b]) for a, b in zip(old, new, strict=True))
                    order = np.lexsort((both[2], -both[1], both[0]))
                    q = both[0][order]
                    first = np.searchsorted(q, q, "left")
                    order = order[np.arange(len(q)) - first < k]
                    held[lane] = tuple(x[order] for x in both)
        for lane, rows in enumerate(held):
            if rows is not None:
                yield pa.RecordBatch.from_pydict({"qid": pa.array(ids[rows[0] + lane * lanes].astype(np.int64)), "p_id": pa.array(rows[2].astype(np.int64)), "table_id": pa.array(rows[3].tolist(), pa.string()), "score": pa.array(rows[1])})

    return run


def top_passages(run: DataFrame, n: int) -> DataFrame:
    """run (qid, rank, table_id) down to the passages before the (n + 1)-th distinct table appears, with tbl_pos."""
    first = F.min("rank").over(Window.partitionBy("qid", "table_id"))
    placed = run.withColumn("first_rank", first).withColumn("tbl_pos", F.dense_rank().over(Window.partitionBy("qid").orderBy("first_rank")))
    cut = F.min(F.when(F.col("tbl_pos") == n + 1, F.col("rank"))).over(Window.partitionBy("qid"))
    return placed.withColumn("cut", cut).filter("cut IS NULL OR rank < cut").drop("cut", "first_rank")


def hits(run: DataFrame, gold: DataFrame, n: int) -> DataFrame:
    """(qid, hit): whether one of the first n tables is among gold (qid, table_ids); a query without passages has no hit."""
    met = top_passages(run, n).filter(F.col("tbl_pos") <= n).join(gold, "qid").groupBy("qid").agg(F.max(F.array_contains("table_ids", F.col("table_id")).cast("int")).alias("h"))
    return gold.select("qid").join(met, "qid", "left").select("qid", F.coalesce("h", F.lit(0)).alias("hit"))


def hit_rate(found: DataFrame) -> DataFrame:
    return found.agg(F.round(F.avg("hit") * 100, 6).alias("hit_at_n"), F.count("*").alias("n_queries"))


def flat(run: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per passage with whether its table is gold."""
    return run.join(gold, "qid").select("qid", "rank", "table_id", F.array_contains("table_ids", F.col("table_id")).cast("int").alias("correct"))


def confusion(a: DataFrame, b: DataFrame) -> DataFrame:
    """Queries by hit of run a and hit of run b."""
    return a.select("qid", F.col("hit").alias("hit_a")).join(b.select("qid", F.col("hit").alias("hit_b")), "qid").groupBy("hit_a", "hit_b").agg(F.count("*").alias("n"))


def log_softmax(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """scores (qid, p_id, score) with lp, the log-softmax of score / temperature over each query's passages."""
    w = Window.partitionBy("qid")
    s = scores.withColumn("z", F.col("score") / temperature).withColumn("m", F.max("z").over(w))
    return s.withColumn("lp", F.col("z") - F.col("m") - F.log(F.sum(F.exp(F.col("z") - F.col("m"))).over(w))).drop("z", "m")


def nll(scores: DataFrame, gold: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Mean negative log-likelihood of the gold passages (qid, p_id), and how often they score best."""
    lp = log_softmax(scores, temperature)
    top = scores.groupBy("qid").agg(F.max(F.struct("score", (-F.col("p_id")).alias("minus")))["minus"].alias("minus"))
    both = lp.join(gold, ["qid", "p_id"]).join(top, "qid")
    return both.agg(F.round(-F.avg("lp"), 6).alias("nll"), F.round(F.avg((F.col("p_id") == -F.col("minus")).cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


def distill(student: DataFrame, teacher: DataFrame, temperature: float) -> DataFrame:
    """KL(teacher || student) of softened distributions, mean over queries, times the squared temperature."""
    s, t = log_softmax(student, temperature).select("qid", "p_id", F.col("lp").alias("ls")), log_softmax(teacher, temperature).select("qid", "p_id", F.col("lp").alias("lt"))
    each = s.join(t, ["qid", "p_id"]).groupBy("qid").agg(F.sum(F.exp("lt") * (F.col("lt") - F.col("ls"))).alias("kl"))
    return each.agg(F.round(F.avg("kl") * temperature**2, 6).alias("kl"))


def distill_loss(student: DataFrame, teacher: DataFrame, gold: DataFrame, temperature: float = 3.0, weight: float = 0.5) -> DataFrame:
    """weight * distillation + (1 - weight) * the student's own loss, and both parts."""
    parts = distill(student, teacher, temperature).select("kl", F.lit(1).alias("one")).join(nll(student, gold).select("nll", F.lit(1).alias("one")), "one")
    return parts.select("kl", "nll", F.round(weight * F.col("kl") + (1 - weight) * F.col("nll"), 6).alias("loss"))
