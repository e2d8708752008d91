"""Exact nearest neighbours of a stated query set by a block matrix join.

Vectors are packed into blocks where they are read, each with int8 codes, a scale and the length of what the codes leave out. Query blocks
and candidate blocks meet in the cells of a grid, whose sides are bounded in bytes. In a cell, an int8 product tile gives for each pair
a distance between the two coded vectors; it is off by the two left-out lengths at most, so a pair whose lower bound lies
above the k-th best distance so far can't be among the k nearest. The pairs that survive are computed anew from the original vectors, in
double precision, and go to the query's heap; the heaps of a query's cells are merged at the end.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import groupby, islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ship, table

#: Vectors in a block, and bytes of original vectors on a side of a cell.
BLOCK, SIDE_BYTES = 2048, 16 << 20
#: Pairs that are computed anew at a time.
PAIRS = 1 << 15
BLOCKS = "block long, query boolean, n int, dim int, rows binary, ids binary, known binary, codes binary, scale binary, left_out binary, vectors binary"
#: int8 products are summed in float32, which is exact for so many of them: 127 * 127 * 1,040 < 2^24.
EXACT = 1040


def _pack(block: int) -> Callable[[Iterator], Iterator]:
    """BLOCKS rows of (id, vector, query): all vectors that take part in blocks of one dimension, and those of queries once more."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        base, made, row = TaskContext.get().partitionId() << 33, 0, 0
        schema = pa.schema([(f.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in BLOCKS.split(", ")])

        def packed(rows, ids, known, queries, vectors):
            nonlocal made
            largest = np.abs(vectors).max(1).astype(np.float64)
            scale = np.maximum(largest / 127, np.finfo(np.float64).tiny)
            codes = np.clip(np.rint(vectors / scale[:, None]), -127, 127).astype(np.int8)
            rest = vectors.astype(np.float64) - codes * scale[:, None]
            top = np.maximum(np.abs(rest).max(1), np.finfo(np.float64).tiny)
            left_out = top * np.sqrt(np.square(rest / top[:, None]).sum(1))
            for query, at in ((False, slice(None)), (True, queries)):
                of = [x[at] for x in (rows, ids, known, codes, scale, left_out, vectors)]
                if len(of[0]):
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, [base + made, query, len(of[0]), vectors.shape[1], *(np.ascontiguousarray(x).tobytes() for x in of)]))], schema=schema)
            made += 1

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                flags = np.array(part.column(2).to_pylist(), bool)
                ids = part.column(0)
                known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
                lists = part.column(1)
                lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                for dim in np.unique(lengths[lengths > 0]):
                    of = np.flatnonzero(lengths == dim)
                    flat = lists.take(pa.array(of)).flatten()
                    ok = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dim).all(1)
                    vectors = flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, dim)
                    ok &= np.isfinite(vectors).all(1) & vectors.any(1)
                    of, vectors = of[ok], vectors[ok]
                    if len(of):
                        yield from packed(base + row + of, ids[of], known[of], flags[of], vectors)
                row += part.num_rows

    return run


def distances(a, b):
    """Euclidean distances of the rows of two arrays, in double precision, summed component by component."""
    import numpy as np

    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += np.square(a[:, d].astype(np.float64) - b[:, d].astype(np.float64))
    return np.sqrt(total)


def unpacked(block: dict, kind: str) -> dict:
    import numpy as np

    n, dim = block["n"], block["dim"]
    read = lambda name, dtype: np.frombuffer(block[name], dtype)
    out = {"rows": read("rows", np.int64), "ids": read("ids", np.int64), "known": read("known", bool), "scale": read("scale", np.float64), "left_out": read("left_out", np.float64)}
    out |= {"vectors": read("vectors", kind).reshape(n, dim), "codes": read("codes", np.int8).reshape(n, dim).astype(np.float32)}
    return out | {"square": (out["codes"].astype(np.float64) ** 2).sum(1) * out["scale"] ** 2}


def products(a, b):
    """Sums of products of int8 codes (held as float32), exact."""
    import numpy as np

    if a.shape[1] <= EXACT:
        return a @ b.T
    return sum((a[:, i : i + EXACT] @ b[:, i : i + EXACT].T).astype(np.float64) for i in range(0, a.shape[1], EXACT))


class Heaps:
    """The k nearest so far of a set of queries of one dimension."""

    def __init__(self, queries: dict, k: int):
        import numpy as np

        self.q, self.k, self.pairs = queries, k, 0
        self.best: list[list[tuple]] = [[] for _ in queries["ids"]]
        self.bound = np.full(len(self.best), np.inf)  # no pair above it can be among the k nearest

    def meet(self, c: dict) -> None:
        import numpy as np

        q = self.q
        for at in range(0, len(self.best), 256):
            part = slice(at, at + 256)
            with np.errstate(over="ignore", invalid="ignore"):
                # Squared distances of the coded vectors, with the error of a few roundings to either side of them.
                sides = q["square"][part, None] + c["square"][None, :]
                coded = sides - 2 * (q["scale"][part, None] * c["scale"][None, :]) * products(q["codes"][part], c["codes"])
                slack = sides * 1e-13
                off = (q["left_out"][part, None] + c["left_out"][None, :]) * (1 + 1e-9)
                own = q["rows"][part, None] == c["rows"][None, :]
                if c["rows"].size > self.k and np.isinf(self.bound[part]).any():
                    most = np.where(own, np.inf, (np.sqrt(np.maximum(coded + slack, 0)) + off) * (1 + 1e-9))
                    most[np.isnan(most)] = np.inf
                    self.bound[part] = np.minimum(self.bound[part], np.partition(most, self.k - 1, axis=1)[:, self.k - 1])
                # Kept unless it is sure to be above: what is no number stays too.
                near = ~(coded - slack > np.square((self.bound[part, None] + off) * (1 + 1e-9))) & ~own
            qi, ci = np.nonzero(near)
            for some in range(0, len(qi), PAIRS):
                self._add(qi[some : some + PAIRS] + at, ci[some : some + PAIRS], c)

    def _add(self, qi, ci, c: dict) -> None:
        import numpy as np

        self.pairs += len(qi)
        with np.errstate(over="ignore"):
            scores = distances(self.q["vectors"][qi], c["vectors"][ci])
        cuts = np.flatnonzero(np.diff(qi)) + 1
        for i, found in zip(qi[np.r_[0, cuts]].tolist(), np.split(np.arange(len(qi)), cuts)):
            near = found[scores[found] <= self.best[i][-1][0]] if len(self.best[i]) == self.k else found
            new = zip(scores[near].tolist(), (~c["known"][ci[near]]).tolist(), c["ids"][ci[near]].tolist(), c["rows"][ci[near]].tolist())
            self.best[i] = heapq.nsmallest(self.k, (*self.best[i], *new))
            if len(self.best[i]) == self.k:
                self.bound[i] = min(self.bound[i], self.best[i][-1][0])


RUNS = "row long, id long, scores array<double>, unknown array<boolean>, ids array<long>, rows array<long>"


def _search(k: int, kind: str) -> Callable[[Iterator], Iterator]:
    """RUNS of cells, whose query blocks come before their candidate blocks: a query's nearest within the cell, in order."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def told(heaps: list[Heaps]):
            rows = [(int(r), int(i), *(map(list, zip(*best)) if best else ([], [], [], []))) for h in heaps for r, i, best in zip(h.q["rows"], h.q["ids"], h.best)]
            types = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in RUNS.split(", ")])

        cell, waiting, heaps = None, {}, None
        for batch in batches:
            for i in range(batch.num_rows):
                block = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                if block["cell"] != cell:
                    if heaps:
                        yield told(list(heaps.values()))
                    cell, waiting, heaps = block["cell"], {}, None
                if block["query"]:
                    waiting.setdefault(block["dim"], []).append(unpacked(block, kind))
                    continue
                if heaps is None:
                    heaps = {dim: Heaps({name: np.concatenate([b[name] for b in blocks]) for name in blocks[0]}, k) for dim, blocks in waiting.items()}
                    waiting = {}
                if block["dim"] in heaps:
                    heaps[block["dim"]].meet(unpacked(block, kind))
        if heaps:
            yield told(list(heaps.values()))

    return run


def _merge(k: int) -> Callable[[Iterator], Iterator]:
    """(query_id, rank, vec_id, score) of RUNS that come query by query."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows_of():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))

        out: list[tuple] = []

        def told():
            cols = [pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.float64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["query_id", "rank", "vec_id", "score"])

        for (_, query), runs in groupby(rows_of(), lambda r: r[:2]):
            merged = heapq.merge(*(zip(*r[2:]) for r in runs))
            out += [(query, rank, None if unknown else vec, score) for rank, (score, unknown, vec, _) in enumerate(islice(merged, k), 1)]
            if len(out) >= 10_000:
                yield told()
        if out:
            yield told()

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, side_bytes: int = SIDE_BYTES) -> DataFrame:
    """For each row for which is_query holds its k nearest other rows by Euclidean distance: query_id, rank (from 1), vec_id, score. All of
    them, if they are fewer; ties go to the smaller vec_id, a null one comes last. Rows are told apart by themselves and not by
    vec_id: of rows that repeat an id each is a query and a candidate of its own. Only vectors of the query's own length are its
    candidates. Vectors that are null, empty, zero or hold null or non-finite components take no part; a query without any
    candidate has no rows. An empty table gives none.

    It is exact: every pair's bound is looked at, and every pair that the bounds leave is computed. The work is that of all queries times
    all vectors. A task holds a cell's queries (side_bytes) and one block; blocks are counted out where vectors are read, so equal
    vectors or ids don't gather."""
    spark = vectors.sparkSession
    ship(spark)
    wide = vectors.schema[vec_col].dataType.elementType.simpleString() != "float"
    kind, size = ("float64", 8) if wide else ("float32", 4)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{'double' if wide else 'float'}>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    blocks = materialize(rows.mapInArrow(_pack(block), BLOCKS), "vector-blocks")
    held = {r["query"]: r["bytes"] for r in blocks.groupBy("query").agg((F.sum(F.col("n").cast("long") * F.col("dim")) * size).alias("bytes")).collect()}
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    down = max(1, -(-held.get(True, 0) // side_bytes))
    across = max(-(-held.get(False, 0) // side_bytes), min(spread, max(1, held.get(False, 0) >> 18)))
    # A query block is in one line of the grid and meets all columns; a candidate block is in one column and meets all lines.
    line, column = F.pmod(F.xxhash64("block"), F.lit(down)) * across, F.pmod(F.xxhash64("block"), F.lit(across))
    whole_line = F.sequence(line, line + (across - 1))
    whole_column = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long")), lambda at: at * across + column)
    cells = blocks.withColumn("cell", F.explode(F.when(F.col("query"), whole_line).otherwise(whole_column)))
    dealt = cells.repartition(down * across, "cell").sortWithinPartitions("cell", F.desc("query"), "block").drop("block")
    found = dealt.mapInArrow(_search(k, kind), RUNS).where(F.size("ids") > 0)
    return found.repartition("row").sortWithinPartitions("row").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, F.col("vec_id") % 100 == 0)


#: For tables in which vec_id is not repeated and vectors have one length.
OP12_SQL = """
WITH v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_prepend(0::DOUBLE, list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i]))), lambda a, b: a + b)) AS score
    FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id NULLS LAST) AS rank FROM pairs) WHERE rank <= 10"""
