"""The trie of conversations' prefixes: who shares which first turns, and how many words that sharing saves below each node.

A node's key is a digest of its parent's key and of its own turn, so conversations meet at a node by a plain grouping. What a subtree
holds is summed by pointer jumping: in round k each node hands its sum to its ancestor 2^k levels up and learns the one 2^(k+1) up,
so the rounds grow with the logarithm of the depth. Nodes of one conversation need none of it: below them is one leaf and no saving.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC32_SQL, discard, join_by_key, materialize, ship, slices, table

ROOT = hashlib.blake2b(b"", digest_size=16).digest()
EMPTY_SHA = hashlib.sha256().hexdigest()
STEPS = "conv_id long, depth int, node binary, parent binary, words long, ends boolean"


def _chain(batches: Iterator) -> Iterator:
    """STEPS rows of sorted (conv_id, here, role, text): the root's first, then one for each turn."""
    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("ends", pa.bool_())])
    out, held = [], None

    def told():
        rows = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        out.clear()
        return rows

    for batch in batches:
        for rows in slices(batch, rows_at_once=8192):
            for conv_id, here, role, text in zip(*(rows.column(i).to_pylist() for i in range(4))):
                if held is None or held[0] != conv_id:
                    if held:
                        out.append((*held, True))
                    held = (conv_id, 0, ROOT, None, 0)
                if here:
                    out.append((*held, False))
                    role, text = role.encode(), text.encode()
                    key = hashlib.blake2b(held[2] + len(role).to_bytes(8) + role + text, digest_size=16).digest()
                    held = (conv_id, held[1] + 1, key, held[2], len(text.split()))
            if out:
                yield told()
    if held:
        out.append((*held, True))
        yield told()


def _ends(batches: Iterator) -> Iterator:
    """(node, ends_sha256) of sorted (node, ids): comma-joined ids in order."""
    import pyarrow as pa

    node, sha, done = None, None, []
    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != node:
                if sha:
                    done.append((node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], names=["node", "ends_sha256"])
            done = []
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])


def subtree_sums(nodes: DataFrame, *values: str) -> DataFrame:
    """nodes (node, anc: its parent or null, values: numbers): the same with each value summed over the node's subtree, without anc. Every
    anc must be a node. The sums are those over the levels below that are fewer than 2^k away, for k = 0, 1, and so on."""
    sums = [F.sum(v).alias(f"{v}_up") for v in values]
    while True:
        up = nodes.where("anc IS NOT NULL").groupBy(F.col("anc").alias("node")).agg(F.count(F.lit(1)).alias("n"), *sums)
        last, met = nodes, materialize(nodes.join(up, "node", "left"), "jump")
        if hasattr(last, "_came_from"):
            discard(last._came_from)
        total = met.where("anc IS NOT NULL").count()
        added = [(F.col(v) + F.coalesce(f"{v}_up", F.lit(0))).alias(v) for v in values]
        if not total:
            return met.select("node", *added)
        rows, top = met.select("node", "anc", *added), met.where("n IS NOT NULL").select(F.col("node").alias("anc"), F.col("anc").alias("next"), "n")
        jumped = join_by_key(rows, top, "anc", total).select("node", F.col("next").alias("anc"), *values)
        nodes = jumped.unionByName(rows.where("anc IS NULL"))
        nodes._came_from = met


def prefix_trie(turns: DataFrame, here: str | None = None) -> DataFrame:
    """turns: conv_id, turn, role, text. One row for each distinct sequence of first turns (role and text) of any conversation, from the
    textless root: conv_id (the smallest that starts so), depth, parent_conv_id (the parent node's conv_id, null for the root), n_convs,
    n_children, n_leaves (nodes without children in the subtree, itself included), saved_tokens (over the subtree, itself included,
    the words of a node's last text as often as conversations beyond the first share it), ends_sha256 (of the ids, ascending and
    comma-joined, of conversations that end here).

    Turns are taken by turn, null first; turns of one number by role and text. Null role or text is empty; rows without a conv_id
    belong to no conversation. here: a column that is false in rows that only name a conversation, which then is at the root at
    least. An empty table gives no rows. Texts are read once, sorted by conversation on disk; a task holds one turn."""
    spark = turns.sparkSession
    ship(spark)
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), (F.coalesce(F.col(here), F.lit(False)) if here else F.lit(True)).alias("here"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("turn").cast("long").alias("turn"),
    )
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    steps = materialize(sorted_rows.select("conv_id", "here", "role", "text").mapInArrow(_chain, STEPS), "trie-steps")
    same = [F.first(c).alias(c) for c in ("parent", "depth", "words")]
    nodes = materialize(steps.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *same), "trie-nodes")

    one = F.col("n_convs") == 1
    below = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(one).alias("ones"))
    full = materialize(nodes.join(below, "node", "left").na.fill(0, ["n_children", "ones"]), "trie-nodes")
    total = full.count()

    # Below a node of one conversation is one leaf and no saving, so only the others take part, with the leaves of such children.
    leaves, saved = F.when(F.col("n_children") == 0, 1).otherwise(F.col("ones")).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    sums = subtree_sums(full.where(~one).select("node", F.col("parent").alias("anc"), leaves, saved), "n_leaves", "saved_tokens")

    # Ids are joined by stretches of ids first, so that a node at which many conversations end gets few rows.
    ids = steps.where("ends").groupBy("node", F.shiftright("conv_id", 12).alias("stretch")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = ids.repartition("node").sortWithinPartitions("node", "stretch").select("node", "ids").mapInArrow(_ends, "node binary, ends_sha256 string")

    parents = full.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    cols = full.select("node", "conv_id", "depth", "parent", "n_convs", "n_children")
    named = join_by_key(cols, parents, "parent", total).unionByName(cols.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    found = named.join(sums, "node", "left").join(ends, "node", "left")
    return found.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def rebuilt(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c with its first h = crc32(c in decimals) mod `most` turns taken from conversation c - c mod family instead: all that
    has, if fewer; none, if there is no such. (conv_id, here, turn, role, text), turn counted from 1 in the original; each conv_id also
    once with here = false."""
    from pyspark.sql import Window

    c = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    base, h = (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    own = c.withColumn("turn", nth.cast("long")).where(F.col("turn") > h).withColumn("here", F.lit(True))
    heads = c.where(F.col("conv_id") % family == 0).withColumn("turn", nth.cast("long")).where(F.col("turn") < most).withColumnRenamed("conv_id", "base")
    ids = c.groupBy("conv_id").agg(F.lit(1)).select("conv_id", base, h)
    first = ids.join(heads, "base").where("turn <= h").select("conv_id", "turn", "role", "text", F.lit(True).alias("here"))
    marks = ids.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("here"))
    return own.unionByName(first).unionByName(marks)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")), "here")


OP13_SQL = rf"""
WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32_SQL.format("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM c)),
turns AS (
    SELECT i.conv_id, c.k, c.role, c.text FROM ids i JOIN c ON c.conv_id = i.base AND c.k <= i.h
    UNION ALL SELECT i.conv_id, c.k, c.role, c.text FROM ids i JOIN c ON c.conv_id = i.conv_id AND c.k > i.h),
steps AS (
    SELECT conv_id, row_number() OVER w AS depth, list({{'r': role, 't': text}}) OVER w AS path, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY k)
    UNION ALL SELECT conv_id, 0, [], 0 FROM ids),
last AS (SELECT conv_id, max(depth) AS depth FROM steps GROUP BY conv_id),
nodes AS (
    SELECT s.path, s.depth, min(s.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(s.words) AS saved, sha256(coalesce(string_agg(s.conv_id::VARCHAR, ',' ORDER BY s.conv_id) FILTER (s.depth = l.depth), '')) AS ends_sha256
    FROM steps s JOIN last l ON l.conv_id = s.conv_id GROUP BY s.path, s.depth),
kids AS (SELECT p.path, count(k.path) AS n_children FROM nodes p LEFT JOIN nodes k ON k.depth = p.depth + 1 AND k.path[:p.depth] = p.path GROUP BY p.path),
sums AS (
    SELECT p.path, count(*) FILTER (x.n_children = 0) AS n_leaves, sum(d.saved) AS saved
    FROM nodes p JOIN nodes d ON d.depth >= p.depth AND d.path[:p.depth] = p.path JOIN kids x ON x.path = d.path GROUP BY p.path)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN kids k ON k.path = n.path JOIN sums s ON s.path = n.path LEFT JOIN nodes q ON n.depth > 0 AND q.depth = n.depth - 1 AND q.path = n.path[:n.depth - 1]"""
