import random

import numpy as np
import xxhash
from siftworks.llm import simhash
from siftworks.llm.components import components


def brute_fp(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(nodes, linked):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_bits():
    rng = random.Random(4)
    for n in (0, 1, 3, 4, 5, 40, 700):
        text = " \t".join(f"W{rng.randrange(50)}é" for _ in range(n))
        assert simhash.fingerprint(text) == brute_fp(text)


def cloud(rng, n):
    """Near fingerprints in a dense ball, chains, and others far away."""
    base, out = rng.getrandbits(64), set()
    for _ in range(n):
        out.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    x = rng.getrandbits(64)
    for _ in range(20):
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
        out.add(x)
    return sorted(signed(v) for v in out | {rng.getrandbits(64) for _ in range(n)} | {0, (1 << 64) - 1})


def test_links_span_the_components_of_all_pairs(spark):
    rng = random.Random(6)
    fps = cloud(rng, 120)
    mask = (1 << 64) - 1
    want = classes(fps, [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & mask).bit_count() <= 4])
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for block in (4, 2048):
        got = simhash.links(df, block=block).collect()
        assert all(((r.a ^ r.b) & mask).bit_count() <= 4 for r in got)
        assert classes(fps, [(r.a, r.b) for r in got]) == want
    edges = spark.createDataFrame([(r.a, r.b) for r in got], "a long, b long")
    assert {r.id: r.component for r in components(edges).collect()} == {a: c for a, c in want.items() if sum(c == x for x in want.values()) > 1}


def test_long_chain_components(spark):
    edges = spark.range(300).selectExpr("id * 7 % 301 AS a", "(id + 1) * 7 % 301 AS b")
    assert {r.component for r in components(edges).collect()} == {0}
    assert components(edges.where("a < 0")).count() == 0


def test_hubs_with_any_id(spark):
    """A star whose hub has the smallest, the middle or the largest id, and one hub of each kind at once."""
    n = 3000
    for hubs in ([0], [n // 2], [n], [0, n // 2, n]):
        rows = [(hub + 10 * n * k, i + 10 * n * k) for k, hub in enumerate(hubs) for i in range(n + 1) if i != hub]
        got = {r.id: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
        assert got == {i + 10 * n * k: 10 * n * k for k in range(len(hubs)) for i in range(n + 1)}


def test_near_duplicates_of_odd_tables(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == len(rows)
    fps = {signed(brute_fp(r.text)) for r in rows}
    comp = classes(fps, [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4])
    least = {}
    for r in rows:
        if r.doc_id is not None:
            c = comp[signed(brute_fp(r.text))]
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f := signed(brute_fp(r.text)), least.get(comp[f])) for r in rows), key=str)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(no_docs).count() == 0
