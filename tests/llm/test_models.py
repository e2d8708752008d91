import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F
from siftworks.llm import langid, toxicity

from .conftest import prose


def speak(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(n))


def test_language_of_held_out_texts(spark):
    rng = random.Random(3)
    rows = [(i, speak(rng, {"aa": "abcde", "bb": "cdefgé", "cc": "xyzab日"}[lang], 30), lang) for i in range(400) for lang in [("aa", "bb", "cc")[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lang = {r[0]: r[2] for r in rows}
    got = langid.identify(df).collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in got)


def test_presence_kernel_equals_sets():
    texts = ["abca bcd", "bcd abd!", "zzz"]
    model = langid.fit([langid.distinct_slots(t) for t in texts], ["a", "b", "c"])
    x = model.presence([langid.slots(t) for t in texts])
    grams = lambda t: {(n, t[i : i + n]) for n in range(1, 5) for i in range(len(t) - n + 1)}
    norm = ["abca bcd", "bcd abd ", "zzz"]
    for i in range(3):
        for j in range(3):
            assert x[i] @ x[j] == len(grams(norm[i]) & grams(norm[j]))


def test_with_all_texts_as_landmarks_it_is_kernel_ridge_regression():
    """Nystrom is exact on its landmarks: predictions are K (K + ridge * n)^-1 Y of the kernel of normalised presence sets."""
    rng = random.Random(1)
    langs = [("aa", "bb", "cc")[i % 3] for i in range(45)]
    texts = [speak(rng, {"aa": "abcde", "bb": "cdefgé", "cc": "xyzab日"}[x], 12) for x in langs]
    grams = [set(langid.distinct_slots(t).tolist()) for t in texts]
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    y = np.array([[x == n for n in ("aa", "bb", "cc")] for x in langs], dtype=float)
    want = k @ np.linalg.solve(k + 1e-3 * len(texts) * np.eye(len(texts)), y)
    model = langid.fit([langid.distinct_slots(t) for t in texts], langs, landmarks=len(texts))
    x = model.presence([langid.slots(t) for t in texts])
    got = x @ model.weights / np.sqrt(x.sum(axis=1, keepdims=True))
    assert np.abs(got - want).max() < 1e-3


def test_a_language_of_long_texts_alone_is_learned(spark):
    rng = random.Random(2)
    rows = [(i, speak(rng, "abcde", 2500), "long") for i in range(40)] + [(100 + i, speak(rng, "vwxyz", 20), "short") for i in range(40)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {r[0]: r[2] for r in rows}
    assert min(len(r[1]) for r in rows[:40]) > 8000 and all(r.lang_pred == want[r.doc_id] for r in got)


def test_more_languages_than_landmarks_all_have_one():
    texts = ["".join(random.Random(i).choices("abcdefghij", k=40)) for i in range(8)]
    model = langid.fit([langid.distinct_slots(t) for t in texts], [f"l{i}" for i in range(8)], landmarks=2)
    assert model.predict(texts)[0] == [f"l{i}" for i in range(8)]


def test_language_of_odd_tables(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in langid.identify(odd_docs).collect()}
    assert langid.identify(odd_docs).count() == odd_docs.count()
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[1].score == 0
    assert langid.identify(no_docs).count() == 0


def test_toxicity_learns_from_positives_and_unlabelled(spark, odd_docs, no_docs):
    rng = random.Random(7)
    rows = [(i, prose(rng, 60) + (" vile" if i % 5 == 0 else "") + (" awful" if i % 5 == 0 and i % 2 else "")) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600) if i % 2 == 0 or i % 3 == 0], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, labels).collect()}
    assert all((got[i].predicted == 1) == (i % 5 == 0) for i in got)
    kept = {r.doc_id for r in toxicity.drop_toxic(df, labels).collect()}
    assert kept == {i for i in got if i % 5}
    odd = toxicity.score_toxicity(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score_toxicity(no_docs, labels).count() == 0
    assert max(r.score for r in toxicity.score_toxicity(df, labels.where("toxic > 1")).collect()) < 1e-9
    assert toxicity.drop_toxic(odd_docs, labels).schema == odd_docs.schema


def test_drop_toxic_drops_what_is_predicted_toxic(spark, monkeypatch):
    model = toxicity.Model({"rude": 1.6, "vile": 1.0}, -2.0)  # alone 0.40 and 0.27, both 0.65
    monkeypatch.setattr(toxicity, "train", lambda *_: model)
    df = spark.createDataFrame([(1, "rude"), (2, "vile"), (3, "rude vile"), (4, "kind"), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, toxic int")
    predicted = {r.doc_id: r.predicted for r in toxicity.score_toxicity(df, model=model).collect()}
    assert predicted == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0}
    assert {r.doc_id for r in toxicity.drop_toxic(df, labels).collect()} == {i for i, p in predicted.items() if not p}


@pytest.mark.parametrize("shift, corrected", [(0.0, True), (-6.0, False)])
def test_the_risk_and_its_step_equal_plain_sums_and_differences(shift, corrected):
    """Each loss by itself, and the gradient by small differences; where the corrected part is below zero the step is turned round."""
    rng = np.random.default_rng(3)
    n_pos, n_unl, prior = 7, 20, 0.3
    z = np.concatenate([rng.normal(2 if corrected else 9, 1, n_pos), rng.normal(shift, 1, n_unl)])
    loss = lambda v, positive: float(np.log(1 + np.exp(-v if positive else v)))

    def parts(v):
        first = prior * sum(loss(x, True) for x in v[:n_pos]) / n_pos
        return first, sum(loss(x, False) for x in v[n_pos:]) / n_unl - prior * sum(loss(x, False) for x in v[:n_pos]) / n_pos

    assert np.allclose(toxicity.risk(z, n_pos, prior), parts(z)) and (parts(z)[1] >= 0) == corrected
    target = (lambda v: sum(parts(v))) if corrected else (lambda v: -parts(v)[1])
    unit = np.eye(len(z)) * 1e-6
    want = [(target(z + e) - target(z - e)) / 2e-6 for e in unit]
    assert np.allclose(toxicity.step_gradient(z, n_pos, prior), want, atol=1e-6)


def test_toxicity_of_long_texts_alone_is_learned(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 6000 if i % 4 == 0 else 60, 4000) + (" vile" if i % 4 == 0 else "")) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    assert min(len(t) for i, t in rows if i % 4 == 0) > 20_000
    got = toxicity.score_toxicity(df, labels).collect()
    assert sum((r.predicted == 1) == (r.doc_id % 4 == 0) for r in got) >= 0.95 * len(rows)


def test_the_vocabulary_is_chosen_by_share(spark):
    """Words that three confirmed texts have, and a hundredth of them, and these at least twice as often as unlabelled texts."""
    rows = [(i, f"bad both{' rare' if i < 2 else ''}") for i in range(40)] + [(100 + i, "both good") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int")
    assert set(toxicity.train(df, labels).weight) == {"bad"}


def test_samples_have_their_size_where_ids_are_null_or_repeated(spark):
    """More rows of one id, and without one, than a sample holds; rows that are repeated whole count once."""
    rng = random.Random(11)
    texts = [prose(rng, 30, 5000) for _ in range(900)]
    for some in ({None}, {1}, {3}, {4}, {5}, {None, 1, 8}):
        ids = sorted(some, key=str)
        ids = [i for i in ids if i is None or zlib.crc32(str(i).encode()) % 4 != 2]
        if not ids:
            continue
        rows = [(ids[k % len(ids)], t, "de" if k % 3 else "en") for k, t in enumerate(texts)]
        rows += [rows[0]] * 500
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = langid.sample(df, 40)
        assert sorted(r["lang"] for r in got) == ["de"] * 20 + ["en"] * 20
        labels = spark.createDataFrame([(i, 1) for i in ids if i is not None] + [(777, 1), (778, 0)], "doc_id long, toxic int")
        drawn, _ = toxicity.drawn(df, labels, 15, 60)
        sizes = {r.positive: r.n for r in drawn.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert sizes[False] == 60 and sizes.get(True, 0) == (15 if any(i is not None for i in ids) else 0)
        assert "und" not in {r.lang_pred for r in langid.identify(df.limit(50)).collect()}
