"""Repair of damaged conversations at the least cost, so that their roles follow the grammar `(system? (user assistant)+)?`.

Turns are dealt by the hash of their conversation and sorted within it. Each Arrow batch of them goes through one recursive DuckDB
query, of which each recursion advances one turn for all conversations of the batch and keeps, for each state of the grammar, the least
cost and the audit that gives it. Of a conversation longer than a batch the states are carried on, and its stretches of `STRETCH` turns
are advanced side by side from every state that they may begin in, so that no batch recurs deeper than that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC32_SQL, materialize, ship, slices, table

#: States of the grammar, by the role that came last: none, system, user, assistant. A conversation may end in NONE and ASSISTANT.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: What a kept turn of this initial leads to.
KEEP = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one role of the two that may be given or put in that the grammar takes next.
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
SOUND, MUST_GO, TRUNCATED = range(3)
#: Turns that a recursion goes through at most, and turns in a batch.
STRETCH, BATCH = 256, 8192


def _put_in(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, audit) after no, one or two turns put in; more would only come back to a state."""
    one = NEXT[state]
    return [(state, 0, ""), (one, 2, "I"), (NEXT[one], 4, "II")]


def _moves() -> list[tuple[int, str, int, int, int, str]]:
    """(state, initial, fault, next state, cost, audit) of what one turn allows, with what is put in after it."""
    out = []
    for state in range(4):
        for initial in ("s", "u", "a", ""):
            for fault in (SOUND, MUST_GO, TRUNCATED):
                steps, stays = [(state, 3, "D")], int(fault == TRUNCATED)
                if fault != MUST_GO:
                    steps.append((NEXT[state], 2 + stays, "R"))
                    if (state, initial) in KEEP:
                        steps.append((KEEP[state, initial], stays, "K"))
                out += [(state, initial, fault, then, cost + more, letter + put) for to, cost, letter in steps for then, more, put in _put_in(to)]
    return out


#: One recursion is one turn of every stretch at once. `unit` is a stretch, `came` the state it began in.
ADVANCE = """
    WITH RECURSIVE reached(unit, came, state, i, best) USING KEY (unit, came, state) AS (
        SELECT unit, came, state, 0::BIGINT, {'cost': cost, 'audit': audit} FROM (SELECT DISTINCT unit, first FROM turns) u JOIN starts s ON s.first = u.first
        UNION
        SELECT r.unit, r.came, m.next, r.i + 1, min({'cost': r.best.cost + m.cost, 'audit': r.best.audit || m.audit})
        FROM reached r JOIN turns t ON t.unit = r.unit AND t.i = r.i + 1 JOIN moves m ON m.state = r.state AND m.initial = t.initial AND m.fault = t.fault
        GROUP BY r.unit, r.came, m.next, r.i
    )
    SELECT r.unit, r.came, r.state, r.best.cost AS cost, r.best.audit AS audit FROM reached r JOIN (SELECT unit, max(i) AS n FROM turns GROUP BY unit) l ON l.unit = r.unit AND l.n = r.i
    ORDER BY r.unit"""

#: The turns of a batch with their first faults. `conv` counts the batch's conversations, the first of which may go on from the batch
#: before: `seen` holds the digests of its turns up to there, `$last` the initial of the last.
FAULTS = f"""
    CREATE OR REPLACE TEMP TABLE judged AS
    SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY seq) - 1 AS k, turn, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND cut AS truncated,
        CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE '' END AS letter,
        coalesce(lag(initial) OVER (PARTITION BY conv ORDER BY seq), CASE WHEN conv = 0 THEN $last END) || initial AS pair
    FROM (SELECT *, row_number() OVER (PARTITION BY conv, digest ORDER BY seq) > 1 OR conv = 0 AND digest IN (SELECT digest FROM seen) AS again FROM batch)"""

#: The batch's turns dealt into stretches. `first` marks a conversation's first stretch, at which nothing but NONE may be the state;
#: for it the ways begin with what may be put in before the first turn.
TURNS = f"""
    CREATE OR REPLACE TEMP TABLE turns AS
    SELECT dense_rank() OVER (ORDER BY conv, k // $stretch) - 1 AS unit, conv, k % $stretch + 1 AS i, letter AS initial, k < $stretch AND (conv > 0 OR $fresh) AS first,
        CASE WHEN blank OR duplicate THEN {MUST_GO} WHEN truncated THEN {TRUNCATED} ELSE {SOUND} END AS fault
    FROM judged"""

COUNTS = """
    SELECT conv, count(*) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, min(turn) AS low, max(turn) AS high, count(DISTINCT turn) AS turns
    FROM judged GROUP BY conv ORDER BY conv"""


class _Open:
    """What is known of a conversation up to some turn."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.blank, self.duplicate, self.truncated, self.illegal, self.n = conv_id, 0, 0, 0, 0, 0
        self.low = self.high = None
        self.turns, self.last = 0, None
        self.best = {NONE: (0, "")}

    def add(self, n: int, blank: int, duplicate: int, truncated: int, illegal: int, low: int | None, high: int | None, turns: int) -> None:
        self.n, self.blank, self.duplicate, self.truncated, self.illegal = self.n + n, self.blank + blank, self.duplicate + duplicate, self.truncated + truncated, self.illegal + illegal
        if low is not None:  # turns come sorted, so one number at most is on both sides of a cut
            self.turns += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high

    def advance(self, ways: list[tuple[int, int, int, str]]) -> None:
        """ways: (state before, state after, cost, audit) of a stretch."""
        best: dict[int, tuple[int, str]] = {}
        for came, state, cost, audit in ways:
            if came in self.best:
                way = (self.best[came][0] + cost, self.best[came][1] + audit)
                best[state] = min(best.get(state, way), way)
        self.best = best

    def row(self) -> tuple:
        cost, audit = min(self.best[s] for s in (NONE, ASSISTANT) if s in self.best) if self.n else (0, "")
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


COLUMNS = ("conv_id", "here", "turn", "digest", "initial", "blank", "cut")
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _judge(stretch: int, most: int) -> Callable[[Iterator], Iterator]:
    """REPORT rows of sorted COLUMNS; a batch has `most` turns."""

    def run(batches: Iterator) -> Iterator:
        import duckdb
        import pyarrow as pa
        import pyarrow.compute as pc

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "preserve_insertion_order": True})
        con.execute("CREATE TABLE moves(state INT, initial VARCHAR, fault INT, next INT, cost BIGINT, audit VARCHAR)")
        con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", _moves())
        con.execute("CREATE TABLE starts(first BOOLEAN, came INT, state INT, cost BIGINT, audit VARCHAR)")
        con.executemany("INSERT INTO starts VALUES (?, ?, ?, ?, ?)", [(True, NONE, *start) for start in _put_in(NONE)] + [(False, s, s, 0, "") for s in range(4)])
        con.execute("CREATE TABLE seen(digest BLOB)")
        schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in REPORT.split(", ")])
        now: _Open | None = None

        def tell(done: list[_Open]):
            rows = [x.row() for x in done]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for whole in batches:
            for at in range(0, whole.num_rows, most):
                part = whole.slice(at, most)
                ids, convs = part.column(0).to_pylist(), []
                opened = [now] if now is not None and now.conv_id == ids[0] else []
                done = [now] if now is not None and not opened else []
                if not opened:
                    con.execute("DELETE FROM seen")
                for c in ids:
                    if not opened or opened[-1].conv_id != c:
                        opened.append(_Open(c))
                    convs.append(len(opened) - 1)
                batch = pa.table({"conv": pa.array(convs, pa.int32()), "seq": pa.array(range(part.num_rows), pa.int64())} | {n: part.column(i) for i, n in enumerate(COLUMNS) if i > 1}).filter(part.column(1))
                con.register("batch", batch)
                con.execute(FAULTS, {"last": opened[0].last})
                con.execute(TURNS, {"fresh": not opened[0].n, "stretch": stretch})
                for conv, *counts in con.execute(COUNTS).fetchall():
                    opened[conv].add(*counts)
                conv_of = [c for (c,) in con.execute("SELECT conv FROM turns GROUP BY unit, conv ORDER BY unit").fetchall()]
                for unit, ways in groupby(con.execute(ADVANCE).fetchall(), lambda way: way[0]):
                    opened[conv_of[unit]].advance([way[1:] for way in ways])
                if len(opened) > 1:
                    con.execute("DELETE FROM seen")
                con.execute("INSERT INTO seen SELECT DISTINCT digest FROM batch WHERE conv = $open AND digest NOT IN (SELECT digest FROM seen)", {"open": len(opened) - 1})
                tail = batch.filter(pc.equal(batch.column("conv"), len(opened) - 1)).column("initial")
                opened[-1].last = tail[-1].as_py() if len(tail) else opened[-1].last
                done += opened[:-1]
                now = opened[-1]
                if done:
                    yield tell(done)
        if now is not None:
            yield tell([now])

    return run


def _plain(turns: DataFrame, here: str | None) -> DataFrame:
    """(conv_id, here, turn, role, text, digest); a null role or text is one space."""
    cols = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), (F.coalesce(F.col(here), F.lit(False)) if here else F.lit(True)).alias("here"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    return cols.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def _order() -> list[Column]:
    """The order of turns."""
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("digest")]


def repair_report(turns: DataFrame, here: str | None = None, stretch: int = STRETCH, batch: int = BATCH) -> DataFrame:
    """turns: conv_id, turn, role, text. One row for each conv_id (also null): gaps (turn numbers that are missing between the least and
    the greatest), blank, duplicate, truncated (turns by their first fault: no character but white space; role and text seen earlier;
    the last such character is none of `.!?`), illegal (neighbours whose roles don't follow each other), the least cost of a repair
    and its audit: Keep at 0, Rerole at 2, Delete at 3, Insert of an empty turn at 2, initials in order; a truncated turn that stays
    costs 1, blank and duplicate ones must go, and one whose role is empty cannot be kept as it is; of equal costs the audit that is least in ASCII.

    Turns are taken by turn, null first; turns of one number by a digest of role and text. Null role or text is one space. here: a
    column that is false in rows that only name a conversation; one without turns has zeros and an empty audit. An empty table
    gives no rows. Of a conversation a task holds a batch of turns, its audits and a digest of each distinct turn; all else is
    sorted on disk."""
    ship(turns.sparkSession)
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    narrow = _plain(turns, here).select("conv_id", "here", "turn", "digest", F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    return narrow.repartition("conv_id").sortWithinPartitions(*_order()).mapInArrow(_judge(stretch, batch), REPORT)


REPAIRED = "conv_id long, position long, edit string, role string, text string"


def _apply(batches: Iterator) -> Iterator:
    """REPAIRED rows of sorted (conv_id, audit, role, text): each conversation's audit row comes before its turns."""
    import pyarrow as pa

    schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in REPAIRED.split(", ")])
    conv, audit, at, state, position, out = None, "", 0, NONE, 0, []

    def emit(edit: str, role: str, text: str):
        nonlocal position
        out.append((conv, position, edit, role, text))
        position += 1

    def put_in():
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at, state = at + 1, NEXT[state]
            emit("I", NAMES[state], "")

    def told():
        nonlocal out
        rows, out = out, []
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for rows in slices(batch):
            for conv_id, plan, role, text in zip(*(rows.column(i).to_pylist() for i in range(4))):
                if plan is not None:
                    put_in()
                    conv, audit, at, state, position = conv_id, plan, 0, NONE, 0
                    continue
                put_in()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = KEEP[state, role[:1]]
                    emit(edit, role, text)
                elif edit == "R":
                    state = NEXT[state]
                    emit(edit, NAMES[state], text)
            if out:
                yield told()
    put_in()
    if out:
        yield told()


def repaired_turns(turns: DataFrame, report: DataFrame, here: str | None = None) -> DataFrame:
    """The turns of the repaired conversations: conv_id, position (from 0), edit (K, R or I), role, text. They come sorted within
    partitions, and each conversation in one of them. report: repair_report of the same turns."""
    ship(turns.sparkSession)
    rows = _plain(turns, here).where("here").select("conv_id", F.lit(None).cast("string").alias("audit"), "role", "text", "turn", "digest")
    plans = report.select("conv_id", "audit", *(F.lit(None).cast(t).alias(n) for n, t in (("role", "string"), ("text", "string"), ("turn", "long"), ("digest", "binary"))))
    return rows.unionByName(plans).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc(F.isnull("audit")), *_order()[1:]).select("conv_id", "audit", "role", "text").mapInArrow(_apply, REPAIRED)


def _digest(batches: Iterator) -> Iterator:
    """(conv_id, repaired_sha256) of turns that come conversation by conversation."""
    import pyarrow as pa

    conv, sha, done = None, None, []
    for batch in batches:
        for conv_id, position, role, text in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "position", "role", "text"))):
            if not position:
                if sha:
                    done.append((conv, sha.hexdigest()))
                conv, sha = conv_id, hashlib.sha256()
            sha.update(f"{chr(10) if position else ''}{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done])], names=["conv_id", "repaired_sha256"])
            done = []
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])


def damage(conversations: DataFrame) -> DataFrame:
    """What the query repairs: rows by crc32(`conv_id:turn`) mod 20: 0 is dropped, 1 loses its text, 2 its sentence ends, 3 comes
    twice, 4 becomes a user's. Nulls are one space. Dropped rows stay with here = false, so that no conv_id is lost."""
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), F.when(kind != 0, text).alias("text"), (kind != 0).alias("here"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "time")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damage(table(spark, sf_dir, "conversations"))
    report = materialize(repair_report(turns, "here"), "repair")
    digests = repaired_turns(turns, report, "here").mapInArrow(_digest, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "id")
    found = report.join(digests, report["conv_id"].eqNullSafe(digests["id"]), "left").drop("id")
    return found.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))


#: A state is what came last: 0 nothing, 1 system, 2 user, 3 assistant.
OP11_SQL = f"""
WITH RECURSIVE src AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32_SQL.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM src JOIN (VALUES (1), (2)) copies(c) ON c = 1 OR kind = 3 WHERE kind <> 0),
numbered AS (
    SELECT *, dense_rank() OVER (ORDER BY conv_id) AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i,
        right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM damaged),
turns AS (
    SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS before,
        CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM numbered),
reached(conv, state, i, best) AS (
    SELECT conv, p.state, 0::BIGINT, {{'cost': p.cost, 'audit': p.audit}} FROM (SELECT DISTINCT conv FROM turns) c, (VALUES (0, 0, ''), (2, 2, 'I'), (3, 4, 'II')) p(state, cost, audit)
    UNION ALL
    SELECT conv, state, i, min({{'cost': cost, 'audit': audit}}) FROM (
        SELECT e.conv, e.i, e.cost + 2 * p.n AS cost, e.audit || repeat('I', p.n) AS audit, CASE p.n WHEN 0 THEN e.state WHEN 1 THEN CASE e.state WHEN 2 THEN 3 ELSE 2 END ELSE CASE e.state WHEN 2 THEN 2 ELSE 3 END END AS state
        FROM (
            SELECT r.conv, r.i + 1 AS i, r.best.audit || m.letter AS audit,
                r.best.cost + CASE m.letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN m.letter <> 'D' AND t.fault = 'truncated' THEN 1 ELSE 0 END AS cost,
                CASE m.letter WHEN 'D' THEN r.state WHEN 'R' THEN CASE r.state WHEN 2 THEN 3 ELSE 2 END
                    ELSE CASE WHEN t.initial = 's' AND r.state = 0 THEN 1 WHEN t.initial = 'u' AND r.state <> 2 THEN 2 WHEN t.initial = 'a' AND r.state = 2 THEN 3 END END AS state
            FROM reached r JOIN turns t ON t.conv = r.conv AND t.i = r.i + 1 JOIN (VALUES ('D'), ('K'), ('R')) m(letter) ON m.letter = 'D' OR t.fault NOT IN ('blank', 'duplicate')
        ) e JOIN (VALUES (0), (1), (2)) p(n) ON e.state IS NOT NULL
    ) GROUP BY conv, i, state),
plans AS (
    SELECT r.conv, min(r.best) AS best FROM reached r JOIN (SELECT conv, max(i) AS n FROM turns GROUP BY conv) l ON l.conv = r.conv AND l.n = r.i WHERE r.state IN (0, 3) GROUP BY r.conv),
letters AS (
    SELECT conv, j, letter, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv ORDER BY j) AS i, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv ORDER BY j) AS e
    FROM (SELECT conv, unnest(string_split(best.audit, '')) AS letter, generate_subscripts(string_split(best.audit, ''), 1) AS j FROM plans WHERE best.audit <> '')),
kept AS (
    SELECT l.conv, l.j, l.e, l.letter, t.role, CASE l.letter WHEN 'I' THEN '' ELSE t.text END AS text, max(CASE WHEN l.e = 1 AND l.letter = 'K' AND t.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv) AS systems
    FROM letters l LEFT JOIN turns t ON t.conv = l.conv AND t.i = l.i AND l.letter <> 'I' WHERE l.letter <> 'D'),
fixed AS (
    SELECT conv, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (e - systems) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS repaired_sha256 FROM kept GROUP BY conv),
counts AS (
    SELECT conv_id, conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM turns GROUP BY conv_id, conv)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN plans USING (conv) LEFT JOIN fixed USING (conv)"""
