"""Conversation repair against a search over every audit, and the query against a plain version of its contract."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
from siftworks.llm import conversation_repair as cr


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit, repaired) by trying all edits and all roles; at most two turns are put in between two others."""
    faults, best = faults_of(rows), None
    grammar = re.compile(r"(s?(ua)+)?")

    def edits(i):
        role, text = rows[i]
        late = faults[i] == "truncated"
        yield 3, "D", ()
        if faults[i] not in ("blank", "duplicate"):
            yield late, "K", ((role, text),)
            for to in ("user", "assistant"):
                yield 2 + late, "R", ((to, text),)

    def puts():
        for n in range(3):
            for roles in itertools.product(("user", "assistant"), repeat=n):
                yield 2 * n, "I" * n, tuple((r, "") for r in roles)

    todo = [(0, "", ())]
    for i in range(len(rows) + 1):
        todo = [(c + c2, a + a2, o + o2) for c, a, o in todo for c2, a2, o2 in puts()]
        if i < len(rows):
            todo = [(c + c2, a + a2, o + o2) for c, a, o in todo for c2, a2, o2 in edits(i)]
        # a role sequence that no continuation makes right goes; of equal endings only the cheapest can win
        todo = [x for x in todo if re.fullmatch(r"(s?(ua)*u?)?", "".join(r[:1] or "?" for r, _ in x[2]))]
        ends = {}
        for x in todo:
            key = "".join(r[:1] or "?" for r, _ in x[2])
            key = key if len(rows) < 9 else key[-1:]  # all of it, so that nothing hangs on what a state is; long ones can't pay for that
            ends[key] = min(ends.get(key, x), x)
        todo = list(ends.values())
    for cost, audit, out in todo:
        if grammar.fullmatch("".join(r[:1] or "?" for r, _ in out)):
            best = min(best, (cost, audit, out)) if best else (cost, audit, out)
    return best


def wanted(table, hurt=True):
    convs = {}
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        rows = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if hurt else 19
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = set()
    for conv, rows in convs.items():
        digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        turns, roles = [t for t, _, _ in rows if t is not None], [r[:1] for _, r, _ in rows]
        faults = faults_of([r[1:] for r in rows])
        cost, audit, fixed = cheapest([r[1:] for r in rows])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.add((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def talks(rng, n, most=7):
    for conv in range(n):
        for turn in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"])
            yield conv, rng.choice([turn, turn, turn + rng.randrange(4), None]), role, rng.choice(["Yes.", "No!", "Why?", "cut off", "", " \t", None, "Same.", "a\nb. ", "é…", f"t{turn}."])


def query(spark, monkeypatch, rows, schema=SCHEMA):
    monkeypatch.setattr(cr, "table", lambda *_: spark.createDataFrame(rows, schema))
    df = cr.op11_conversation_repair(spark, "")
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query_is_the_cheapest_of_all_repairs(spark, monkeypatch):
    rng = random.Random(3)
    rows = list(talks(rng, 150)) + [(None, 0, "user", "Hi."), (None, None, None, None), (-7, 3, "user", "A."), (-7, 3, "user", "A."), (-7, 3, "assistant", "B.")]
    rng.shuffle(rows)
    assert query(spark, monkeypatch, rows) == wanted(rows)


def test_sql_says_the_same():
    rows = list(talks(random.Random(12), 120)) + [(None, 0, "user", "Hi."), (None, None, None, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert set(con.execute(cr.OP11_SQL).fetchall()) == wanted(rows)


def test_dropped_and_empty(spark, monkeypatch):
    lone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert query(spark, monkeypatch, [(lone, 0, "user", "Hi.")]) == {(lone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert query(spark, monkeypatch, []) == set()


def test_long_conversations_go_on_from_batch_to_batch(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(5, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["Yes.", f"{t}.", "cut", "", f"{t % 90}!"])) for t in range(300)]
    rows += list(talks(rng, 20)) + [(10**9, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(260)]
    assert query(spark, monkeypatch, rows) == wanted(rows)
    turns, want = cr.damage(spark.createDataFrame(rows, SCHEMA)), {r[:-1] for r in wanted(rows)}
    for stretch, batch in ((7, 50), (256, 100)):
        assert {tuple(r) for r in cr.repair_report(turns, "here", stretch, batch).collect()} == want


def test_repaired_turns_and_clashing_columns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (2, 0, "system", "Be kind."), (2, 1, "user", "Well?"), (2, 2, "user", "Well?")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("digest", "here", "audit", "position", "edit", "last", "unit"):
        df = df.withColumn(name, df.conv_id)
    report = cr.repair_report(df)
    got = sorted(tuple(r) for r in cr.repaired_turns(df, report).collect())
    assert [tuple(r) for r in report.select("conv_id", "cost", "audit").orderBy("conv_id").collect()] == [(1, 4, "IKKI"), (2, 5, "KKDI")]
    fixed = {c: [(r[3], r[4]) for r in got if r[0] == c] for c in (1, 2)}
    for c in (1, 2):
        assert fixed[c] == list(cheapest([(r, t) for k, _, r, t in rows if k == c])[2])
