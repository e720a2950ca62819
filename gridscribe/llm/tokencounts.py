"""Token counts as delta-maintained rollups (operator 7).

A rollup holds documents and tokens by source, language and tokenizer version. It is never recounted: batches of signed
deltas (+ for an insert, - for a delete, both for a revised count) are summed by key and added.

A batch is named by its id. Each attempt to commit it writes a folder of its own; then the one file `claim` of the batch is
put in its place by a rename that fails where there is one already; it names the attempt that counts. So a batch that is committed
again, by a retry or by a second writer at the same time, changes nothing. The totals are the sum over claimed attempts.
compact() folds them into a base, which remembers their ids, so that totals() reads one folder again and a late retry of a
folded batch still changes nothing.

Tokenizers are versioned: `words` counts runs of non-space, byte-pair encodings come from a public vocabulary file whose
path on the driver is a parameter; its bytes are broadcast (`MOST_VOCABULARY` at most). Deltas are pre-aggregated in each task
before they are shuffled, so a hot source is a few rows.

Defined results: null sources and languages are keys of their own; null or empty texts count one document and no tokens;
repeated rows count each; an empty batch commits and adds nothing; groups whose documents and tokens are both 0
are left out of the totals; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Of the vocabulary: how a text is cut before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_VOCABULARY = 64 << 20
_encoders: dict = {}


def encoder(vocabulary: bytes):
    """The encoder of a vocabulary file's bytes, made once per process."""
    name = hashlib.sha256(vocabulary).hexdigest()
    if name not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        _encoders[name] = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def vocabulary_of(path: str) -> bytes:
    with open(path, "rb") as f:
        out = f.read(MOST_VOCABULARY + 1)
    if len(out) > MOST_VOCABULARY:
        raise ValueError(f"{path} is no vocabulary: more than {MOST_VOCABULARY} bytes")
    return out


def bpe_sizes(enc, texts: list[str | None], most: int = 1 << 20) -> list[int]:
    """Tokens of each text, encoded in runs of about `most` characters."""
    out: list[int] = []
    run: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size > most or i == len(texts) - 1:
            out += [len(x) for x in enc.encode_ordinary_batch(run, num_threads=1)]
            run, size = [], 0
    return out


def signed_counts(docs: DataFrame, bpe: str | None = BPE, bpe_name: str = "byte_bpe_50k/1", words_name: str = "words/1", sign: int = 1) -> DataFrame:
    """Deltas of the documents (source, lang, text): one row per key and task, times sign."""
    C.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_of(bpe)) if bpe else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[int]] = {}

        def add(key: tuple, n: int, tokens: int) -> None:
            have = sums.setdefault(key, [0, 0])
            have[0] += n
            have[1] += tokens

        for batch in batches:
            keys = list(zip(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), strict=True))
            counts = []
            for _, _, offsets, data in C.text_blocks(batch.column("text")):
                counts.append(C.words_of(offsets, data)[0])
            for key, n in zip(keys, np.concatenate(counts).tolist() if counts else [], strict=True):
                add((*key, words_name), 1, n)
            if bpe:
                for key, n in zip(keys, bpe_sizes(encoder(shared.value), batch.column("text").to_pylist()), strict=True):
                    add((*key, bpe_name), 1, n)
            if len(sums) > 100_000:
                yield _rows(sums)
                sums.clear()
        yield _rows(sums)

    def _rows(sums: dict) -> pa.RecordBatch:
        names = [list(x) for x in zip(*sums, strict=True)] if sums else [[], [], []]
        return C.arrow_rows(
            source=pa.array(names[0], pa.string()), lang=pa.array(names[1], pa.string()), tokenizer=pa.array(names[2], pa.string()),
            docs=pa.array([sign * x[0] for x in sums.values()], pa.int64()), tokens=pa.array([sign * x[1] for x in sums.values()], pa.int64()),
        )

    return docs.select("source", "lang", "text").mapInArrow(run, DELTA)


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """A rollup in a folder that all executors share: `batch-<id>/<attempt>` with `claim`, `base-<number>` with `claim`."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{C.shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
        self.hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _claim(self, folder: str, text: str) -> bool:
        """Put folder/claim in place, whole or not at all; False if it is there already."""
        draft = self.hadoop(f"{folder}/claim-{uuid.uuid4().hex}")
        out = self.files.create(draft, True)
        out.write(text.encode())
        out.close()
        jvm = self.spark._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, self.hadoop(f"{folder}/claim"), how)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self.files.delete(draft, False)
            return False
        return True

    def _claims(self, prefix: str) -> dict[str, str]:
        """name -> what its claim says, of the claimed folders."""
        if not self.files.exists(self.hadoop(self.path)):
            return {}
        out = {}
        for s in self.files.listStatus(self.hadoop(self.path)):
            name = s.getPath().getName()
            claim = self.hadoop(f"{self.path}/{name}/claim")
            if name.startswith(prefix) and self.files.exists(claim):
                stream = self.files.open(claim)
                out[name[len(prefix) :]] = bytes(stream.readAllBytes()).decode()
                stream.close()
        return out

    def _state(self) -> tuple[str | None, set[str], dict[str, str]]:
        """(the newest base, the ids folded into it, the attempts of the batches since)."""
        bases = self._claims("base-")
        base = max(bases, key=int, default=None)
        folded = set() if base is None else {r["id"] for r in self.spark.read.parquet(f"{self.path}/base-{base}/ids").collect()}
        return base, folded, {k: v for k, v in self._claims("batch-").items() if k not in folded}

    def committed(self) -> list[str]:
        _, folded, batches = self._state()
        return sorted(folded | set(batches))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch once: False if its id is committed already, or another writer is first."""
        if batch_id in self.committed():
            return False
        attempt = uuid.uuid4().hex
        summed(deltas).write.option("compression", "zstd").parquet(f"{self.path}/batch-{batch_id}/{attempt}")
        return self._claim(f"{self.path}/batch-{batch_id}", attempt)

    def _rows(self, base: str | None, batches: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/batch-{k}/{v}" for k, v in sorted(batches.items())] + ([f"{self.path}/base-{base}/sums"] if base is not None else [])
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        return summed(self.spark.read.schema(DELTA).parquet(*paths)).filter("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        base, _, batches = self._state()
        return self._rows(base, batches)

    def compact(self) -> bool:
        """Fold all committed batches into a new base; False if there is none, or another writer is first.

        Batch ids are small (one per commit). Folders of what is folded stay until forget() removes them: readers may be on them.
        """
        base, folded, batches = self._state()
        if not batches:
            return False
        number = 0 if base is None else int(base) + 1
        attempt = f"{self.path}/base-{number}"
        if self.files.exists(self.hadoop(f"{attempt}/claim")):
            return False
        sums, ids = self._rows(base, batches), self.spark.createDataFrame([(i,) for i in sorted(folded | set(batches))], "id string")
        sums.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(f"{attempt}/sums")
        ids.coalesce(1).write.mode("overwrite").parquet(f"{attempt}/ids")
        return self._claim(attempt, str(number))

    def forget(self) -> None:
        """Remove what the newest base holds; nobody may be reading the state before it."""
        base, folded, _ = self._state()
        for i in folded:
            self.files.delete(self.hadoop(f"{self.path}/batch-{i}"), True)
        for b in self._claims("base-"):
            if base is not None and int(b) < int(base):
                self.files.delete(self.hadoop(f"{self.path}/base-{b}"), True)


def revised(old: DataFrame, new: DataFrame, **how) -> DataFrame:
    """Deltas that replace the counts of old rows by those of new rows."""
    return signed_counts(old, sign=-1, **how).unionByName(signed_counts(new, **how))


def op7_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of all documents, as a crawl would leave it.

    All documents are inserted, those of remainder 7 (of the id's checksum by 10) as drafts: the last third of the text is missing.
    Those of remainder 3 are withdrawn and come back; the drafts' counts are revised. A batch is committed twice, one after it
    was folded into the base. What stays are the counts of all whole texts.
    """
    docs = C.pick(C.table(spark, sf_dir, "documents"), doc_id="long", source="string", lang="string", text="string").withColumn("part", C.remainder("doc_id", 10))
    draft = F.expr("substring(text, 1, cast(length(text) * 2 / 3 as int))")
    some, late = docs.filter("part = 3"), docs.filter("part = 7")
    rollup = Rollup(spark)
    crawl = docs.withColumn("text", F.when(F.col("part") == 7, draft).otherwise(F.col("text")))
    rollup.commit("crawl", signed_counts(crawl))
    rollup.commit("withdrawn", signed_counts(some, sign=-1))
    rollup.compact()
    rollup.commit("crawl", signed_counts(crawl))
    rollup.commit("back", signed_counts(some))
    rollup.commit("revised", revised(late.withColumn("text", draft), late))
    rollup.commit("revised", revised(late.withColumn("text", draft), late))
    return rollup.totals()


QUERIES = {"op7_tokencounts": op7_tokencounts}
