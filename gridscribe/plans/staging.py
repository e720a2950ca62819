"""Written intermediate tables and dense numbering without a single-task sort.

What is written lies in the folder that spark.checkpoint.dir names, below the application's id. It goes when the application's
driver ends; what is written inside a `scratch` block goes at its end.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_folders: dict[str, str] = {}
_scratch: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application that every executor sees. A temporary one only where driver and executors are one process."""
    context = spark.sparkContext
    if context.applicationId in _folders:
        return _folders[context.applicationId]
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named:
        folder = f"{named.rstrip('/')}/gridscribe/{context.applicationId}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        atexit.register(_quietly, files.delete, path, True)
    elif re.match(r"local(\[|$)", context.master):
        local = tempfile.mkdtemp(prefix="gridscribe-")
        atexit.register(shutil.rmtree, local, True)
        folder = f"file://{local}"
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    _folders[context.applicationId] = folder
    return folder


def _quietly(what, *args) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone first
        what(*args)


def written(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """df written and read back: later reads neither recompute it nor need the executors that made it.

    keep: it outlives the scratch block that it is written in, and goes with the one around that.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written inside: no DataFrame that reads it may be used after.

    The shuffles behind it are garbage then; a collection in the driver lets Spark remove their files.
    """
    own: list[str] = []
    _scratch.append(own)
    try:
        yield
    finally:
        _scratch.remove(own)
        for name in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark._jvm.System.gc()


def numbered(df: DataFrame, order: list, name: str = "row") -> DataFrame:
    """Dense numbers 0.. in the order of the columns: a range-partitioned sort, then an offset per partition.

    Only one count per partition reaches the driver. Rows that tie in all columns are interchangeable if order has all columns.
    """
    marked = written(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    counts = sorted((r["_part"], r["n"], r["low"]) for r in marked.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("low")).collect())
    offsets, total = [], 0
    for part, n, low in counts:
        offsets.append((part, total - low))
        total += n
    if not offsets:
        return marked.withColumn(name, F.lit(0).cast("long")).drop("_part", "_at")
    plan = df.sparkSession.createDataFrame(offsets, "_part int, _shift long")
    return marked.join(F.broadcast(plan), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
