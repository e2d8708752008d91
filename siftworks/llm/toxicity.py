"""Toxicity by non-negative positive-unlabelled learning.

A logistic model over the presence of words is trained on confirmed toxic texts and unlabelled texts alone. With the class
prior p, the risk is p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)): what unlabelled text counts as negative is
corrected for the positives in it, and where the correction overshoots below zero the step goes the other way. (Kiryo et al.,
2017.) Words enter the model if enough confirmed texts have them and these more often than unlabelled texts do.

The fit uses at most POSITIVES and UNLABELLED rows, picked by a hash of their ids. Texts of any length are drawn, and they are
taken whole: words are counted where the texts are, and the driver gets at most VOCABULARY words and, of each row, which of
them it has. The class prior is the share of toxic rows over all labels that may be learned from. Scores take whole texts.

Defined cases: null or empty text is scored as one without words; without labels every score is 0; null ids are never held
out and have no labels; repeated rows and repeated labels give no more rows than there are documents; an empty table gives
no rows; only id and text and the labels' id and toxic are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, held_out, materialize, ship, slices, table

POSITIVES, UNLABELLED = 3000, 9000
VOCABULARY, LEAST_RATIO = 4096, 2.0
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


class Model:
    def __init__(self, weight: dict[str, float], bias: float):
        self.weight, self.bias = weight, bias

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weight[w] for w in sorted(words(text) & self.weight.keys()))
        return 1 / (1 + np.exp(-min(max(z, -500.0), 500.0)))


def risk(z: np.ndarray, n_pos: int, prior: float) -> tuple[float, float]:
    """The two parts of the corrected risk for values z, positives first: p * R+(positives), and R-(unlabelled) - p * R-(positives)
    before it is held at zero."""
    high, low = np.logaddexp(0, -z), np.logaddexp(0, z)  # the losses of taking a row as positive and as negative
    return prior * high[:n_pos].mean(), low[n_pos:].mean() - prior * low[:n_pos].mean()


def step_gradient(z: np.ndarray, n_pos: int, prior: float, beta: float = 0.0, gamma: float = 1.0) -> np.ndarray:
    """By value: of the whole risk as long as its second part is at least -beta; else of the second part, turned round."""
    n_unl = len(z) - n_pos
    s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    second = np.concatenate([-prior * s[:n_pos] / n_pos, s[n_pos:] / n_unl])
    if risk(z, n_pos, prior)[1] < -beta:
        return -gamma * second
    second[:n_pos] += prior * (s[:n_pos] - 1) / n_pos
    return second


def fit(vocab: list[str], positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3, beta: float = 0.0, gamma: float = 1.0) -> Model:
    """positives, unlabelled: which words of the vocabulary each text has, by number."""
    if not positives or not unlabelled or not 0 < prior < 1:
        return Model({}, -500.0 if not positives else 0.0)
    rows, n_pos = [*positives, *unlabelled], len(positives)
    row, col = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate(rows).astype(np.int64)
    w, b = np.zeros(len(vocab)), np.log(prior / (1 - prior))
    m, v = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[col], minlength=len(rows)) + b
        g = step_gradient(z, n_pos, prior, beta, gamma)
        grad = np.append(np.bincount(col, weights=g[row], minlength=len(vocab)) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model({x: float(y) for x, y in zip(vocab, w)}, float(b))


def drawn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[DataFrame | None, float]:
    """(positive, draw, text) of confirmed toxic texts and of unlabelled ones, from rows that are not held out, and the class prior."""
    labels = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = labels.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    if not n or not toxic:
        return None, 0.0
    can = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).withColumn("draw", F.pmod(F.xxhash64("doc_id", "text", F.lit("toxicity")), F.lit(1 << 60)))

    def most(rows: DataFrame, wanted: int, positive: bool) -> DataFrame:
        """`wanted` rows by a hash of id and text, so those whose ids are null or repeated are drawn like any others; rows that are equal in
        both count once."""
        return rows.groupBy("draw").agg(F.min("text").alias("text")).orderBy("draw").limit(wanted).select(F.lit(positive).alias("positive"), "draw", "text")

    # The ids are drawn from the labels first, so that texts are met by a small set of ids and not shuffled.
    by_id = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 60))
    few = labels.where("toxic = 1").withColumn("by_id", by_id).where(F.col("by_id") < int(min(1.0, (4 * positives + 100) / toxic) * (1 << 60)))
    ids = few.orderBy("by_id", "doc_id").limit(2 * positives).select("doc_id")
    texts = can.agg(F.approx_count_distinct("draw")).first()[0]
    some = can.where(F.col("draw") < int(min(1.0, (2.2 * unlabelled + 100) / max(texts, 1)) * (1 << 60)))
    rows = most(can.join(F.broadcast(ids), "doc_id", "left_semi"), positives, True).unionByName(most(some, unlabelled, False))
    return materialize(rows, "toxicity-sample"), min(max(toxic / n, 1e-4), 0.99)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, vocabulary: int = VOCABULARY, least_ratio: float = LEAST_RATIO) -> Model:
    """The model that docs (doc_id, text) and labels (doc_id, toxic) teach."""
    rows, prior = drawn(docs, labels, positives, unlabelled)
    if rows is None:
        return Model({}, -500.0)
    n_pos, n_unl = rows.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()

    def each_word(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                found = [sorted(words(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, type=pa.list_(pa.string()))], names=["positive", "words"])

    each = rows.select("positive", "text").mapInArrow(each_word, "positive boolean, words array<string>").select("positive", F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("unl"))
    ratio = ((F.col("pos") + 0.5) / (n_pos + 1)) / ((F.col("unl") + 0.5) / (n_unl + 1))
    good = counts.withColumn("ratio", ratio).where((F.col("pos") >= max(3, 0.01 * n_pos)) & (F.col("ratio") >= least_ratio))
    vocab = [r["word"] for r in good.orderBy(F.desc(F.col("pos") * F.log("ratio")), "word").limit(vocabulary).select("word").collect()]
    number = {w: i for i, w in enumerate(vocab)}

    def which(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                found = [sorted(number[w] for w in words(t) & number.keys()) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, type=pa.list_(pa.int32()))], names=["positive", "draw", "has"])

    held = rows.select("positive", "draw", "text").mapInArrow(which, "positive boolean, draw long, has array<int>").orderBy("draw", "has").collect()
    discard(rows)
    of = lambda positive: [np.array(r["has"], dtype=np.int32) for r in held if r["positive"] == positive]
    return fit(vocab, of(True), of(False), prior)


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted. Without a model it is fitted to the labels (doc_id, toxic)."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = model or train(own, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"))
    weight, bias = model.weight, model.bias  # at most VOCABULARY words

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own_model = Model(weight, bias)
        for batch in batches:
            for rows in slices(batch):
                score = np.array([own_model.score(t) for t in rows.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns without the documents that score at least threshold, by default those that score_toxicity predicts toxic; each
    row is judged by its own text."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(own, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"))
    weight, bias, at = model.weight, model.bias, docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own_model = Model(weight, bias)
        for batch in batches:
            for rows in slices(batch, text=text_col):
                yield rows.filter(pa.array([own_model.score(t) < threshold for t in rows.column(at).to_pylist()], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
