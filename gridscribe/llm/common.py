"""Helpers that the training-data operators share: tables, staging, text buffers, hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscribe.plans.staging import scratch, shared_folder, written as stage  # noqa: F401

#: The words of all contracts: maximal runs of bytes that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a Python task holds as one numpy block; one longer text is its own block.
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 1024, size: int = 32 << 20) -> None:
    """Arrow batches of few rows and bytes, for the whole session: a batch of long texts then fits a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


#: Keys with more than this share of the rows (and enough rows to matter) are hot: there can't be more than 1 / HOT_SHARE of them.
HOT_SHARE, HOT_ROWS = 1e-4, 4096


def counted_join(big: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """big joined with small (staged; one row per key, n: about how many rows of big have it); no task gets a hot key's rows.

    The hot keys' rows of small are fewer than 10,000 whatever the input, so they are broadcast and big's rows stay where they
    are; all other keys meet in a shuffle.
    """
    keys = list(keys)
    total = small.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    line = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = small.filter(F.col("n") > line)
    if hot.isEmpty():
        return big.join(small, keys)
    cold = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small.filter(F.col("n") <= line), keys)
    return big.join(F.broadcast(hot), keys).unionByName(cold)


def remainder(column: str, m: int) -> Column:
    """crc32 of the id as text, mod m; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Words of the text (null: 0). Each run of white space becomes one blank, so blanks count words."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    trimmed = F.trim(squeezed)
    blanks = F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit("")))
    return F.when(trimmed == "", F.lit(0)).otherwise(blanks + 1).cast("long")


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast: extra columns and their names never meet ours."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()))


def apart(docs: DataFrame, *keep: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs whose other columns have names of their own, and what gives a DataFrame with these columns docs' names back."""
    names = [c if c in keep else f"own_column_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda df: df.select(*names).toDF(*docs.columns)


def row_key(doc_id: str, text: str) -> Column:
    """A 64-bit key of a row's id and text, null told from empty: equal rows alone share it (but for chance)."""
    return F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text))


# ---- numpy side ----------------------------------------------------------------------------------------------------------------


def text_blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, offsets, bytes) of runs of texts, at most limit bytes or one text. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, len(column))
        yield first, end - first, offsets[first : end + 1] - offsets[first], data[offsets[first] : offsets[end]]
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: xor-shift and multiply rounds over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: A 64-bit value for each byte value, for word hashes.
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd base, mod 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 64, 2 * len(_powers)), 0x9E3779B97F4A7C15, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def words_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of its words, and the 64-bit hashes of all words in order, lower-cased A-Z."""
    n = len(data)
    lens = np.diff(offsets)
    if not n:
        return np.zeros(len(lens), np.int64), np.zeros(0, np.uint64)
    low = TO_LOWER[data]
    space = IS_SPACE[low]
    start = ~space
    start[1:] &= space[:-1]
    inner = offsets[:-1][lens > 0]
    start[inner] = ~space[inner]  # a text's first byte starts a word whatever stands before it
    begins = np.flatnonzero(start)
    if not len(begins):
        return np.zeros(len(lens), np.int64), np.zeros(0, np.uint64)
    ends = np.append(begins[1:], n)
    at = np.arange(n, dtype=np.int64)
    at[begins[0] :] -= np.repeat(begins, ends - begins)
    at[: begins[0]] = 0
    coded = BYTE_CODE[low] * powers(int(at.max()) + 1)[at]
    coded[space] = 0
    hashes = mix(np.add.reduceat(coded, begins))
    counts = np.searchsorted(begins, offsets[1:]) - np.searchsorted(begins, offsets[:-1])
    return counts.astype(np.int64), hashes


def arrow_rows(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)
