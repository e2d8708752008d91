"""Decontamination against brute force, on both ways: with the set in the plan, and with a benchmark beyond its bound."""

import hashlib
import random
import re

import pytest

from siftworks.llm import decontaminate as dc

from .conftest import DOCS, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, _m string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, width=10):
    windows = {}
    for item_id, text in items:
        w = WORD.findall(lower(text))
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).update([str(item_id)] if item_id is not None else [])
    out = []
    for doc_id, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((doc_id, len(w), hit, sorted(found)))
    return out


def tables(spark):
    rng = random.Random(12)
    passages = [prose(rng, n, 60) for n in (14, 25, 10, 9, 4, 1)]
    items = [(i, p, None) for i, p in enumerate(passages)] + [(0, passages[0], "x"), (None, passages[1], "x"), (70, None, "x"), (71, " !! ", "x"), (72, passages[2].upper(), "x")]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(0, 30), 5000)]
        if i % 3 == 0:
            parts.append(rng.choice(passages[:5]).replace(" ", rng.choice([" ", ", ", "\n\n"])))
        if i % 7 == 0:
            parts += [passages[0], passages[0][5:]]
        parts.append(prose(rng, rng.randrange(0, 30), 5000))
        rows.append((i, " ".join(parts), "en", "s", 1))
    rows += [(40, passages[0], "en", "s", 1), (41, passages[5], "en", "s", 1), (42, "Ünï " + passages[3].title() + " é", None, None, None), (None, passages[1], "en", "s", 1), (None, passages[1], "en", "s", 1), (7, None, "en", "s", None), (7, "", "en", "s", 1), (43, passages[0].split(" ", 1)[1], "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS), rows, [x[:2] for x in items]


@pytest.fixture(params=["set in the plan", "broadcast hashes", "shuffled hashes"], autouse=True)
def way(request, monkeypatch):
    """The three ways give the same rows."""
    n = {"broadcast": (0, 2_000_000), "shuffled": (0, 0)}.get(request.param.split()[0], (200_000, 0))
    monkeypatch.setattr(dc.Windows.__init__, "__defaults__", (10, n[0], "item_id", "text", n[1]))
    return n[0]


def test_contamination_equals_brute_force(spark, odd_docs, no_docs, way):
    most_windows = way
    docs, items, rows, pairs = tables(spark)
    for df in (docs, odd_docs):
        got = dc.contamination(df, items, most_windows=most_windows).collect()
        want = [(i, n, len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)) for i, n, hit, ids in brute([(r.doc_id, r.text) for r in df.collect()], pairs)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r.contaminated for r in dc.contamination(docs, items, most_windows=most_windows).collect()) > 10
    assert dc.contamination(no_docs, items, most_windows=most_windows).count() == 0
    none = dc.contamination(docs, items.where("item_id > 1000"), most_windows=most_windows).collect()
    assert len(none) == len(rows) and not any(r.contaminated or r.n_items for r in none)


def test_cut_texts_equal_brute_force_and_other_columns_stay(spark, no_docs, way):
    most_windows = way
    docs, items, rows, pairs = tables(spark)
    for name in ("_m", "_hit", "_row", "hits", "w", "n", "at", "size", "window", "x"):
        docs = docs.withColumn(name, docs.doc_id)
    got = dc.decontaminate(docs, items, most_windows=most_windows)
    assert got.columns == docs.columns and got.schema == docs.schema
    want = []
    for (doc_id, text, *rest), (_, n, hit, _) in zip(rows, brute([r[:2] for r in rows], pairs)):
        if hit and len(hit) >= 0.5 * n:
            continue
        if hit:
            spans, out, at = [m.span() for m in WORD_ANY.finditer(text)], [], 0
            for k, (i, j) in enumerate(spans):
                end = spans[k + 1][0] if k + 1 < len(spans) else len(text)
                out.append(text[at:i] if k == 0 else "")
                out.append("" if k in hit else text[i:end])
                at = end
            text = "".join(out)
        want.append((doc_id, text, *rest, *[doc_id] * 10))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert 5 < len(want) < len(rows)
    assert dc.decontaminate(no_docs, items, most_windows=most_windows).count() == 0


WORD_ANY = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
