"""Sinks: reports, metrics, statistics, exports, merged passages, embeddings. Each writes a folder of Spark part files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscribe.operators import questions as Q
from gridscribe.plans.staging import numbered
from gridscribe.sources import tables as X

STAT = "table_id string, count long"


def write_csv(df: DataFrame, path: str) -> None:
    """A report: header line, values quoted where they need it; arrays as texts joined by blanks."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c) if t.startswith("array<") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Records, one object per line, without fields that are null."""
    df.write.mode("errorifexists").json(path)


def write_stat(counts: DataFrame, path: str) -> None:
    """Passage counts (table_id, count) as lines; read_stat reads them."""
    write_jsonl(counts.select("table_id", F.col("count").cast("long").alias("count")), path)


def read_stat(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STAT).json(path)


def stat_map(counts: DataFrame) -> DataFrame:
    """(bucket, stat): counts as JSON maps table_id -> {count}; a map holds the tables of one hash bucket, so none grows with them."""
    bucket = F.pmod(F.xxhash64("table_id"), F.lit(1024))
    entry = F.struct("table_id", F.struct(F.col("count").cast("long").alias("count")).alias("s"))
    return counts.groupBy(bucket.alias("bucket")).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("stat"))


def write_pair(passages: DataFrame, coded: str, plain: str) -> None:
    """Both renderings of paired passages (with p_id): the coded ones, and as they are, which have no special tokens."""
    X.write_passages(passages, coded)
    X.write_passages(passages.withColumn("passage", F.col("scm_passage")).withColumn("special_tokens", F.array().cast("array<string>")), plain)


def export_tables(tables: X.TableSet, path: str) -> None:
    """Each table as CSV in a folder of its own, its columns named c0.. and their names in the folder `columns`."""
    wide = tables.columns.agg(F.max("col")).first()[0]
    cells = [F.get("cells", F.lit(i)).alias(f"c{i}") for i in range((wide if wide is not None else -1) + 1)]
    tables.rows.select("table_id", "row", *cells).write.mode("errorifexists").partitionBy("table_id").option("header", True).option("escape", '"').csv(f"{path}/rows")
    tables.columns.write.mode("errorifexists").option("header", True).option("escape", '"').csv(f"{path}/columns")


def write_header_meta(accepted: DataFrame, path: str) -> None:
    """Accepted headers (table_id, title, col_names) as lines."""
    write_jsonl(accepted.select("table_id", "title", "col_names"), path)


def write_embeddings(vectors: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """Vectors (p_id, emb) as Parquet files of at most so many rows."""
    vectors.select("p_id", "emb").write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)


def write_queries(questions: DataFrame, path: str) -> None:
    write_jsonl(Q.query_records(questions), path)


def merged(coded: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(coded, base) with global ids: coded passages get p_id and base_p_ids, the base passages that show rows of them.

    Both are passages (table_id, block_id, window_id, rows, ...); ids count in the order of table, block and window, so parts
    that were written by several jobs merge the same way in any order.
    """
    order = ["table_id", "block_id", "window_id"]
    coded, base = numbered(coded, order, "p_id"), numbered(base, order, "p_id")
    spread = lambda df, name: df.select("table_id", F.col("p_id").alias(name), F.explode(F.array_distinct("rows")).alias("row"))
    met = spread(coded, "p_id").join(spread(base, "base"), ["table_id", "row"]).groupBy("p_id").agg(F.sort_array(F.collect_set("base")).alias("base_p_ids"))
    return coded.join(met, "p_id", "left"), base


def table_of(lookup: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (table_id) with file: where the table lies, by lookup (table_id, file), or a file named by its id."""
    return ids.join(lookup.select("table_id", "file"), "table_id", "left").withColumn("file", F.coalesce("file", F.concat("table_id", F.lit(".jsonl"))))
