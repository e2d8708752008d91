"""Language identification by a string kernel.

The kernel of two texts counts the character n-grams of 1 to SPECTRUM letters that both have (presence, not frequency: a
blended spectrum), as a share of the root of each one's own count. N-grams are told apart by a hash to SLOTS values, and those
that no landmark has are left out. Nystrom: sampled landmark texts stand for the kernel matrix, which gives each text a short
vector; one-versus-rest ridge regression on these vectors gives a value for each language. As both steps are linear in
presence, the landmark matrix and the weights are multiplied once, and a batch of texts is scored by one matrix product of
its presence rows.

The fit uses at most SAMPLE rows, and as many languages, picked by a hash, evenly by language. Texts of any length are drawn,
and they are taken whole: what the driver gets of a text are its distinct slots, 2 ** SLOTS_BITS at most. Prediction takes whole texts.

Defined cases: null text or one without letters is `und` with score 0, as is all text if there is nothing to learn from; null
ids are never held out; repeated rows give rows of their own; an empty table gives no rows; only id, text and, for learning,
lang are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, ship, slices, table

SPECTRUM = 4
SLOTS_BITS = 18
LANDMARKS = 256
SAMPLE = 2000
RIDGE = 1e-3
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def letters(text: str) -> np.ndarray:
    """Lower-cased code points with every run of non-letters as one space; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letter_table()[codes]
    if not is_letter.any():
        return codes[:0]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of a run of non-letters stays, as a space
    return np.where(is_letter, codes, 32)[keep]


def slots(text: str, spectrum: int = SPECTRUM) -> Iterator[np.ndarray]:
    """The n-grams' slots, for each n, repeats included."""
    c = letters(text).astype(np.uint64)
    h = np.zeros(len(c), dtype=np.uint64)
    for n in range(1, spectrum + 1):
        if len(c) < n:
            return
        h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        yield (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SLOTS_BITS)


def distinct_slots(text: str) -> np.ndarray:
    """The slots of a text's n-grams, each once, sorted."""
    seen = np.zeros(1 << SLOTS_BITS, dtype=bool)
    for s in slots(text):
        seen[s] = True
    return np.flatnonzero(seen).astype(np.int32)


class Model:
    def __init__(self, langs: list[str], index: np.ndarray, weights: np.ndarray):
        self.langs, self.index, self.weights = langs, index, weights  # index: slot to row of weights, the last row for none

    def presence(self, found: list[Iterable[np.ndarray]]) -> np.ndarray:
        """One row of 0 and 1 for each text, which is given by arrays of slots. The last column, for n-grams of no landmark, is cleared."""
        rows = np.zeros((len(found), len(self.weights)), dtype=np.float32)
        for row, own in zip(rows, found):
            for s in own:
                row[self.index[s]] = 1
        rows[:, -1] = 0
        return rows

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        best, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and len(letters(t))] if self.langs else []
        for at in range(0, len(known), 128):
            part = known[at : at + 128]
            x = self.presence([slots(texts[i]) for i in part])
            values = x @ self.weights / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
            for i, v in zip(part, values):
                best[i], score[i] = self.langs[int(v.argmax())], float(min(1.0, max(0.0, v.max())))
        return best, score


def fit(found: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """found: the distinct slots of each text. langs: its language."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(1 << SLOTS_BITS, dtype=np.int32), np.zeros((1, 0), dtype=np.float32))
    # Landmarks go round the languages, so that a rare one has its share.
    by_lang = {n: [i for i, x in enumerate(langs) if x == n] for n in names}
    order = [own[k] for k in range(max(map(len, by_lang.values()))) for own in by_lang.values() if k < len(own)]
    marks = order[: max(landmarks, len(names))]
    seen = np.zeros(1 << SLOTS_BITS, dtype=bool)
    for i in marks:
        seen[found[i]] = True
    index = np.full(1 << SLOTS_BITS, int(seen.sum()), dtype=np.int32)
    index[seen] = np.arange(seen.sum(), dtype=np.int32)
    model = Model(names, index, np.zeros((int(seen.sum()) + 1, len(names)), dtype=np.float32))
    unit = lambda x: x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    rows = lambda ids: unit(model.presence([(found[i],) for i in ids]))
    base = rows(marks)
    kernel = np.concatenate([rows(range(i, min(i + 128, len(found)))) @ base.T for i in range(0, len(found), 128)]).astype(np.float64)
    to_vector = nystrom(base @ base.T)
    phi = kernel @ to_vector
    y = np.array([[x == n for n in names] for x in langs], dtype=np.float64)
    w = np.linalg.solve(phi.T @ phi + ridge * len(found) * np.eye(phi.shape[1]), phi.T @ y)
    model.weights = np.ascontiguousarray(base.T @ (to_vector @ w).astype(np.float32))
    return model


def nystrom(among: np.ndarray) -> np.ndarray:
    """From a kernel row over the landmarks to a vector whose dot products are the kernel as the landmarks tell it: the root of the
    inverse of the landmarks' own kernel, without directions near zero."""
    values, vectors = np.linalg.eigh(among.astype(np.float64))
    good = values > 1e-6 * values.max()
    return vectors[:, good] / np.sqrt(values[good])


def sample(docs: DataFrame, most: int = SAMPLE) -> list:
    """docs (doc_id, text, lang) to rows (lang, slots): `most` at most, the same number for each language if it has them. Beyond `most`
    languages a hash of their names picks among them. Rows are drawn by a hash of id and text, so those whose ids are null or
    repeated are drawn like any others; rows that are equal in both count once."""
    can = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("draw", F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 60)))
    counts = {r["lang"]: r["n"] for r in can.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).orderBy(F.xxhash64("lang"), "lang").limit(most).collect()}
    if not counts:
        return []
    each = max(1, most // len(counts))
    # About twice the wanted texts by a threshold for each language, then the exact number among these few.
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, (2.2 * each + 50) / max(n, 1)) * (1 << 60)))])
    few = can.where(F.col("draw") < limit[F.col("lang")]).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("rank") <= each)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for rows in slices(batch):
                found = [distinct_slots(t) for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, type=pa.list_(pa.int32())), rows.column(2), rows.column(3)], names=["lang", "slots", "draw", "rank"])

    return ranked.select("lang", "text", "draw", "rank").mapInArrow(run, "lang string, slots array<int>, draw long, rank int").orderBy("draw", "lang", "rank").collect()


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score. Without a model it is fitted to the rows that are not held out."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.col(lang_col).alias("lang")] if model is None else []))
    if model is None:
        rows = sample(own)
        model = fit([np.array(r["slots"], dtype=np.int32) for r in rows], [r["lang"] for r in rows])
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.index, model.weights))  # 1 MB, and as many rows as the landmarks have slots

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own_model = Model(*shared.value)
        for batch in batches:
            for rows in slices(batch):
                lang, score = own_model.predict(rows.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(lang, type=pa.string()), pa.array(score, type=pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
