"""Token-id files: ORC with run-length encoded integers, row indexes and Bloom filters on document ids.

write_token_files ranges documents by id over tasks, encodes each with the tokenizers library, appends an end id and lets
Spark's ORC writer commit one file per task. A row holds a document's ids, its task and where it starts among that task's
ids, so a document's global start is one addition once the tasks' totals (one small row per task) are known. ORC gives
each stripe min/max and Bloom filters of doc_id: readers split files by stripe and skip stripes and row groups by id.

Defined cases: a null text is an empty one and yields the end id alone; a null id sorts first; rows that repeat an id are
separate rows beside each other; an empty table gives an empty file set; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import scratch_path, ship, slices, table

WRITTEN = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", stripe_mb: int = 64) -> None:
    ship(docs.sparkSession)
    tokenizer = tokenizer or bpe.default_path()

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        enc = bpe.encoder(tokenizer)
        for batch in batches:
            for rows in slices(batch, 2 << 20):
                ids, to = enc.encode_ended(rows.column(1), end_id)
                n = np.diff(to)
                lists = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(start + to[:-1]), pa.array(n), lists], names=["doc_id", "part", "local_start", "n_tokens", "ids"])
                start += int(to[-1])

    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        # Rows that share an id, or have none, are told apart by their texts, so that they need not meet in one task.
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
        .select("doc_id", "text")
        .mapInArrow(encode, WRITTEN)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "10000")
        .option("orc.stripe.size", str(stripe_mb << 20))
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids."""
    rows = spark.read.schema(WRITTEN).orc(path)
    return _with_start(rows, rows).select("doc_id", "start", "n_tokens", "ids")


def find(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The documents of a list of ids; stripes whose statistics or Bloom filter exclude them are not read."""
    return spark.read.schema(WRITTEN).orc(path).where(F.col("doc_id").isin(ids)).select("doc_id", "n_tokens", "ids")


def _with_start(rows: DataFrame, written: DataFrame) -> DataFrame:
    """written: one row per task after aggregation, at most as many as the write had partitions, so it is broadcast."""
    totals = written.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("local_start"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what the files hold."""

    def crc(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = b.column(3)
            values, to = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[i:j]) for i, j in zip(to[:-1].tolist(), to[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(to).astype(np.int64)), pa.array(sums, type=pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(WRITTEN).orc(path)
    read = rows.select("doc_id", "part", "local_start", "ids").mapInArrow(crc, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return _with_start(read, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "op9")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return digests(spark, path)
