"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into fewer segments than the distance plus one would need: of 3 segments, 4 differing bits
leave at least one segment with one differing bit or none. Each segment is indexed under its one-wildcard variants (the
segment without one of its bits); two segments that differ by at most one bit share such a variant. Fingerprints that
share a variant are verified by counting differing bits.

Only distinct fingerprints are indexed. Variants meet by one shuffle, sorted, and neighbours with equal variants are verified
there and then, so no candidate that fails is ever written. Large groups are cut into blocks, and a task compares two
blocks; within a group or a pair of blocks a breadth-first search compares each fingerprint with those not yet reached
alone and emits a spanning forest, so links are never more than members while the components are the same as those of all
pairs.

Defined cases: null or wordless text has fingerprint zero and is linked as any other; a text of fewer words than a shingle
is one shingle; null ids keep rows of their own, and a null id is never a component id unless all ids of it are null;
repeated rows share a component; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, materialize, ship, slices, table
from .components import components

#: Start and width of the three segments, from the lowest bit.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
DISTANCE = 4
SEED = 42
#: Fingerprints of a variant that one task compares with as many others.
BLOCK = 2048
#: Groups up to this size are compared pair by pair.
SMALL = 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned. Bytes are lower-cased over A-Z and split at ASCII white space, as bytes.lower and bytes.split do."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[i:j], SEED) for i, j in zip(starts, ends[width - 1 :])), dtype=np.uint64, count=len(words) - width + 1)
    return majority(h)


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def majority(h: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; bits are counted by histograms of the eight bytes."""
    lanes = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        ones = _BITS[lanes].sum(axis=0).reshape(-1)
    else:
        ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return sum(1 << i for i, n in enumerate(ones.tolist()) if 2 * n > len(h))


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text", text_hash: bool = False) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long; with text_hash also the xxhash64 of the text, which tells rows of one id apart."""
    ship(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for rows in slices(batch):
                fps = np.array([fingerprint(t, width) for t in rows.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps), *rows.columns[2:]], names=["doc_id", "fp", "text_hash"][: rows.num_columns])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.xxhash64(F.col(text_col).cast("string")).alias("text_hash")][: int(text_hash)])
    return own.mapInArrow(run, "doc_id long, fp long" + ", text_hash long" * text_hash)


def forest(group: np.ndarray, a: np.ndarray, side: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Spanning forest of the links within distance in each group; rows come sorted by group. side: 0 for groups compared
    within, or 1 and 2 for the two blocks of a pair, which are compared with each other alone."""
    a = a.view(np.uint64)  # of a signed number bitwise_count counts the magnitude's bits
    cuts = np.flatnonzero(np.diff(group)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(group)]])
    sizes = ends - starts
    left: list[int] = []
    right: list[int] = []
    small = sizes <= SMALL
    number = np.repeat(np.where(small, np.arange(len(sizes)), -1), sizes)
    for d in range(1, int(sizes[small].max(initial=0))):  # all groups of a few at once, by neighbours at distance d
        at = np.flatnonzero((number[d:] == number[:-d]) & (number[d:] >= 0))
        at = at[np.bitwise_count(a[at] ^ a[at + d]) <= distance]
        at = at[(side[at] == 0) | (side[at] != side[at + d])]
        left += a[at].tolist()
        right += a[at + d].tolist()
    for i, j in zip(starts[~small].tolist(), ends[~small].tolist()):
        vals, sides = a[i:j], side[i:j]
        rest = np.arange(len(vals))
        while len(rest) > 1:
            frontier, rest = [rest[0]], rest[1:]
            while frontier and len(rest):
                x = frontier.pop()
                near = np.bitwise_count(vals[rest] ^ vals[x]) <= distance
                if sides[x]:
                    near &= sides[rest] != sides[x]
                reached = rest[near]
                left += [int(vals[x])] * len(reached)
                right += vals[reached].tolist()
                frontier += reached.tolist()
                rest = rest[~near]
    return left, right


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b) over a column fp of distinct fingerprints: links within distance that span each component."""
    if distance > 5:
        raise ValueError("three segments with one wildcard find up to 5 differing bits")
    keys = []
    for s, (start, width) in enumerate(SEGMENTS):
        seg = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            # The segment without one bit: 21 bits at most; above them which bit of which segment is missing.
            low, high = seg.bitwiseAND(F.lit((1 << bit) - 1)), F.shiftleft(F.shiftrightunsigned(seg, bit + 1), bit)
            keys.append((low.bitwiseOR(high) + F.lit((s * 32 + bit) << 22)).cast("int"))
    # A small table of fingerprints is read by few tasks, which would make all its variants.
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    variants = spread.select("fp", F.explode(F.array(*keys)).alias("key"))
    # Only groups beyond a block are counted out; all others go on as they are.
    large = variants.groupBy("key").count().where(F.col("count") > block)
    blocks = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # With several blocks a row goes to each pair that its block is in: (i, j) with i <= j, as i * blocks + j.
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("own")) * F.col("blocks") + F.greatest(o, F.col("own")))
    dealt = (
        variants.join(large, "key", "left")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("pair", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(pair)))
        .withColumn("side", F.when(F.expr("pair div blocks = pair % blocks"), 0).when(F.expr("own = pair div blocks"), 1).otherwise(2))
        .select("key", "pair", F.col("side").cast("int").alias("side"), "fp")
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def found(rows):
            key, pair = rows.column(0).to_numpy().astype(np.int64), rows.column(1).to_numpy().astype(np.int64)
            group = np.concatenate([[0], np.cumsum((np.diff(key) != 0) | (np.diff(pair) != 0))])
            l, r = forest(group, rows.column(3).to_numpy(), rows.column(2).to_numpy(), distance)
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (l, r)], names=["a", "b"])

        held = None  # a group at the end of a batch may go on in the next; it has two blocks at most
        for batch in batches:
            t = pa.table(batch) if isinstance(batch, dict) else pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            key, pair = t.column(0).to_numpy(), t.column(1).to_numpy()
            last = np.flatnonzero((key != key[-1]) | (pair != pair[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = t.slice(cut)
            if cut:
                yield found(t.slice(0, cut))
        if held is not None and held.num_rows:
            yield found(held)

    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = 4, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """doc_id, fp (signed), component_id: the smallest id of the documents reachable by links. With rows also text_hash and
    component, a fingerprint that names the component where all ids of it are null, too."""
    ship(docs.sparkSession)
    fps = materialize(fingerprints(docs, width, id_col, text_col, rows), "fp")
    least = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "fp-least")
    # A node is a fingerprint behind its smallest document id (null ids last), so a component's smallest node names that id.
    node = F.struct(F.col("least_id").isNull().alias("no_id"), "least_id", "fp")
    ends = links(least.select("fp"), distance)
    named = least.select(F.col("fp").alias("a"), node.alias("first")), least.select(F.col("fp").alias("b"), node.alias("second"))
    found = components(ends.join(named[0], "a").join(named[1], "b").select(F.col("first").alias("a"), F.col("second").alias("b")))
    class_of = least.withColumn("own", node).join(found.select(F.col("id.fp").alias("fp"), "component"), "fp", "left")
    class_of = class_of.withColumn("first", F.coalesce("component", "own")).select("fp", "n", F.col("first.least_id").alias("component_id"), F.col("first.fp").alias("component"))
    return join_by_key(fps, class_of, "fp", fps.count()).select("doc_id", "fp", "component_id", *["text_hash", "component"][: 2 * rows])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
