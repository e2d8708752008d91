"""I-Match against a version in plain Python that shares nothing with it but the hash of a word, which Spark computes."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from siftworks.llm import imatch

from .conftest import DOCS, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return set(WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))


def ordered(spark, rows):
    """Documents as the fingerprints take them: by descending id, null ids last, ties and null ids by the hash of the text."""
    with_hash = spark.createDataFrame([(i, r[0], r[1] or "") for i, r in enumerate(rows)], "n long, doc_id long, text string").select("*", F.xxhash64("text").alias("h")).collect()
    return [(r.doc_id, r.text) for r in sorted(with_hash, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))]


def hashes(spark, values):
    df = spark.createDataFrame([(v,) for v in sorted(values)], "w string")
    return {r.w: r.h & -4 for r in df.select("w", F.xxhash64("w").alias("h")).collect()}


def hash_lists(spark, lists):
    """xxhash64 of arrays of longs, by Spark."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i long, x array<long>").select("i", F.xxhash64("x").alias("h"))
    got = {r.i: r.h for r in df.collect()}
    return [got[i] for i in range(len(lists))]


def unsigned(x):
    return x & (1 << 64) - 1


def brute(spark, rows, least_share, most_share):
    docs = ordered(spark, rows)
    n, out = len(docs), []
    triples = []
    for i, (doc_id, text) in enumerate(docs):
        half = len(text) // 2
        after = docs[(i + 1) % n][1]
        triples.append((doc_id, text, text[: len(text) - half] + after[:half], after))
    h = hashes(spark, set().union(*(words(t) for x in triples for t in x[1:])))
    frequency = {}
    for _, text, *_ in triples:
        for x in {h[w] for w in words(text)}:
            frequency[x] = frequency.get(x, 0) + 1
    band = {x for x, c in frequency.items() if max(2, least_share * n) <= c <= most_share * n}
    asked, jobs = [], []

    def ask(values):
        asked.append(values)
        return len(asked) - 1

    def sign(text):
        every = sorted({h[w] for w in words(text)})
        terms = [x for x in every if x in band]
        level = max(0, math.ceil(math.log2(max(len(terms), 1) / imatch.LANES)))
        lanes = []
        for lv in (level, level + 1):
            kept = [x for x in terms if (unsigned(x) >> 40) & ((1 << lv) - 1) == 0]
            by = [[x for x in kept if (unsigned(x) >> 8) & (imatch.LANES - 1) == k] for k in range(imatch.LANES)]
            lanes.append([ask(x) if x else None for x in by])
        return level, lanes[0], lanes[1], None if terms else ask(every) if every else "no words"

    for doc_id, text, edited, after in triples:
        jobs.append((doc_id, text, edited, sign(text), sign(edited), sign(after)))
    values = hash_lists(spark, asked)
    short = lambda lanes: [None if k is None else values[k] & 0xFFFF for k in lanes]

    def known(s):
        level, fine, coarse, whole = s
        return level, short(fine), short(coarse), None if whole is None else 0 if whole == "no words" else values[whole]

    def spelled(s):
        level, fine, coarse, whole = s
        if whole is not None:
            return f"w{unsigned(whole):016x}"
        lanes = lambda a: "".join("...." if x is None else f"{x:04x}" for x in a)
        return f"{level}:{lanes(fine)}:{lanes(coarse)}"

    def like(a, b):
        if a[3] is not None or b[3] is not None:
            return float(a[3] == b[3])
        if abs(a[0] - b[0]) > 1:
            return 0.0
        x, y = {0: (a[1], b[1]), -1: (a[2], b[1]), 1: (a[1], b[2])}[a[0] - b[0]]
        both = [(p, q) for p, q in zip(x, y) if p is not None or q is not None]
        return sum(p == q for p, q in both) / len(both) if both else 0.0

    for doc_id, text, edited, s, e, a in jobs:
        s, e, a = known(s), known(e), known(a)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), spelled(s), spelled(e), like(s, e), like(s, a)))
    return sorted(out, key=str)


def tables():
    rng = random.Random(9)
    base = [prose(rng, rng.randrange(1, 160), 150) for _ in range(60)]
    rows = [(i * 3 - 40, t) for i, t in enumerate(base)]
    rows += [(500, base[0]), (500, base[0]), (500, base[1]), (None, base[2]), (None, "Null ID"), (None, None), (501, None), (502, ""), (503, "!!! 123 \x00"), (504, "Ünï ÇÖDE日本 ſK " * 3)]
    rows += [(600 + i, " ".join(f"w{x}" for x in rng.sample(range(400), 300))) for i in range(4)]  # of a higher level
    return {"mixed": rows, "one row": [(7, "alone here")], "one null": [(None, None)], "null ids": [(None, t) for t in base[:12]]}


@pytest.mark.parametrize("name", ["mixed", "one row", "one null", "null ids"])
@pytest.mark.parametrize("bucket_rows", [4, 500])
def test_fingerprints_equal_brute_force(spark, monkeypatch, name, bucket_rows):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(imatch.with_next, "__defaults__", (bucket_rows,))
    rows = tables()[name]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most_terms in (2_000_000, 0):  # by broadcast and by shuffle
        got = imatch.fingerprints(docs, 0.02, 0.5, most_terms)
        assert sorted(map(tuple, got.collect()), key=str) == brute(spark, rows, 0.02, 0.5)


def test_equal_texts_have_equal_fingerprints_and_odd_tables_pass(spark, odd_docs, no_docs):
    got = imatch.fingerprints(odd_docs, 0.02, 0.5).collect()
    assert len(got) == odd_docs.count()
    by_id = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id == 9:
            by_id.setdefault(r.fingerprint, []).append(r)
    assert len(by_id) == 1
    assert imatch.fingerprints(no_docs).count() == 0
    assert imatch.fingerprints(spark.createDataFrame([(None, None, None, None, None)], DOCS)).first().near_next == 1
