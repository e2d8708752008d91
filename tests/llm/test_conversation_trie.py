"""The trie query against plain dictionaries of prefixes, and against its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from siftworks.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string"


def wanted(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - int(abs(c) % 20 * (1 if c >= 0 else -1)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode().split()) if p else 0
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(paths[c]) == len(p))))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items())


def query(spark, monkeypatch, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("node", "parent", "depth", "here", "words", "h", "base", "n", "anc"):
        df = df.withColumn(name, df.turn)
    monkeypatch.setattr(ct, "table", lambda *_: df)
    out = ct.op13_conversation_trie(spark, "")
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in out.collect())


def talks(rng, n):
    rows = []
    for conv in range(n):
        if conv % 20 or rng.random() < 0.7:
            for turn in range(rng.randrange(1, 9)):
                rows.append((conv, rng.choice([turn, turn, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["one two", "a  b\tc", "", None, "é ü", f"own {conv}"])))
    return rows


def test_nodes_are_those_of_all_prefixes(spark, monkeypatch):
    rng = random.Random(8)
    rows = talks(rng, 120) + [(None, 0, "user", "nobody's"), (-25, 0, "user", "one two"), (-20, 0, "user", "below zero"), (-20, 0, "user", "below zero")]
    # a conversation that many share, with ids on both sides of a stretch, and a deep one
    rows += [(c, t, "user", "common words here") for c in range(4000, 4300) for t in range(3)] + [(c, t, "user", f"deep {t // 2}") for c in (9000, 9001, 9003) for t in range(45)]
    rng.shuffle(rows)
    assert query(spark, monkeypatch, rows) == wanted(rows)


def test_turnless_and_empty(spark, monkeypatch):
    lone = next(c for c in range(1, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(lone, 0, "user", "goes")]
    assert query(spark, monkeypatch, rows) == wanted(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert query(spark, monkeypatch, []) == []


def test_sql_says_the_same(spark, monkeypatch):
    rows = talks(random.Random(1), 60)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(ct.OP13_SQL).fetchall(), key=lambda r: (r[0], r[1])) == sorted(wanted(rows), key=lambda r: (r[0], r[1]))


def test_sums_over_subtrees_of_any_shape(spark):
    rng = random.Random(2)
    for shape in ("chain", "star", "random"):
        up = {0: None} | {i: {"chain": i - 1, "star": 0, "random": rng.randrange(i)}[shape] for i in range(1, 70)}
        got = ct.subtree_sums(spark.createDataFrame([(str(i), None if p is None else str(p), i, 1) for i, p in up.items()], "node string, anc string, a long, b long"), "a", "b").collect()
        want = {str(i): [0, 0] for i in up}
        for i in up:
            p = i
            while p is not None:
                want[str(p)][0] += i
                want[str(p)][1] += 1
                p = up[p]
        assert {r.node: [r.a, r.b] for r in got} == want
