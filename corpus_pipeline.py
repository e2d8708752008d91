"""A training-corpus pipeline: five stages, each of which works on all that the one before it kept.

Every stage but the last returns the columns of documents. Stages are written as Parquet to the shared folder and read back
by the next, so a lost executor costs no more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.llm.common import materialize, table
from siftworks.llm.decontaminate import decontaminate
from siftworks.llm.packing import pack_documents
from siftworks.llm.secret_scan import redact_secrets
from siftworks.llm.simhash import near_duplicates
from siftworks.llm.toxicity import drop_toxic


def _with_n_chars(docs: DataFrame) -> DataFrame:
    """n_chars follows a changed text; a null text keeps what it had."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest id (null ids come last), of rows with that id the
    one whose text has the smallest hash, of equal rows any one. Each row is judged by its own text, whatever its id."""
    found = materialize(near_duplicates(docs, rows=True), "near-dedup")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("row")
    keep = found.groupBy("component").agg(first).select("row.doc_id", "row.text_hash")
    is_row = lambda of: docs["doc_id"].cast("long").eqNullSafe(of["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == of["text_hash"])
    kept = docs.join(keep, is_row(keep), "left_semi")
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    if repeated.limit(1).count():
        kept = kept.join(repeated, is_row(repeated), "left_anti").unionByName(kept.join(repeated, is_row(repeated), "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark windows are cut out; documents that are benchmark text for the most part go."""
    return _with_n_chars(decontaminate(docs, table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _with_n_chars(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences that the documents fill. Workers that serve all stages are given less memory for it."""
    return pack_documents(docs, known=300_000, batch_mb=1)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: SQL can't express trained classifiers or tokenizers; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
