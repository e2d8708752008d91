"""Near-duplicate passages by compact windows.

A text is a sequence of word shingles (five words). Under a min-hash, every stretch of it has its least shingle somewhere; the
stretches with the same least shingle form a compact window (first, least, last), and the windows of a text are the nodes of
the Cartesian tree of its hashes. Nodes narrower than the passages sought are never built: a shingle has one of at least t
only if it is the least of some t in a row, which two sliding extremes tell for a whole slice of texts, so a text of n
shingles has about 2n/t windows for each hash and not n. (Deng et al., "Allign", 2021.)

Windows with the same least shingle meet, and each document of such a group is paired with the group's first one alone, so
that pairs are never more than windows; what meets within a slice of the scan is paired there, so that a frequent line
sends one row a slice to its group. Groups of windows that share a frequent line but little else are dealt again by what
stands beside the least shingle: by a min-hash of the 22 shingles on either side, and, for the first hash, by the exact
hashes of eight stretches of 41 shingles around it. Of two texts with 46 equal shingles in a row (50 words), at least one of
the eight is the same, and two texts with the same one are near-duplicates there; so no document with such a passage is left
without a link through it, however large the groups are. Pairs that share enough hashes or such a stretch are verified on the
texts by an interval join of their windows: around the shared shingle the stretch is taken in which at least four fifths
of the shingles are shared, and its Jaccard similarity must reach the threshold.

A group's first one may be unlike documents that are like each other. So each row of a group dealt by context also carries the
group's last one, and documents that are not linked with that one by then are paired with it, which is then what blocks of members
share. The order is the same in all
groups, so two documents that share several groups meet in several of them.

Words are runs of ASCII letters, digits, _ and any characters beyond ASCII, in lower case.

Defined cases: null text and text below the passage length have no windows; of rows that repeat an id, or have none, each distinct
text is scanned, and what it shares is told under that id (null for none); repeats within one id are not told, those among rows
without an id are; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, join_by_key, materialize, ship, slices, table, tidy

SHINGLE, PASSAGE_WORDS, SIMILARITY = 5, 50, 0.8
HASHES, NEEDED = 4, 2
#: Documents that are verified against one other in a task's sorted group.
BLOCK = 64
#: Keys that this many documents of a slice have are remembered for the rest of the scan task, at most HELD of them.
FREQUENT, HELD = 8, 200_000
#: Bytes of text that are hashed at a time.
SLICE = 2 << 20
#: The mark of a pair that shares an exact stretch, beside those of the hashes.
EXACT = 8

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def is_word_byte() -> np.ndarray:
    """UTF-8 bytes of which words consist."""
    return np.array([b >= 0x80 or chr(b).isalnum() or b == 0x5F for b in range(256)])


_IS_WORD, _VALUE = is_word_byte(), mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n - 1, b)]), dtype=np.uint64) for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))))
        return self.up, self.down


_powers = Powers()


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """c such that (c[j] - c[i]) * down[i] is a hash of values[i:j], wherever they stand."""
    up, _ = _powers(len(values) + 1)
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])


class Shingles:
    """All shingles of some texts in one array, with a zero before the first and at least one after those of each text that has words.

    value: the hashes; start, stop: where those of each text are."""

    def __init__(self, texts: list[str | None], width: int = SHINGLE):
        raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
        word = _IS_WORD[data].view(np.int8)
        step = np.diff(word)
        first, last = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
        c = prefix_hashes(_VALUE[data])
        h = mix((c[last] - c[first]) * _powers(len(data) + 1)[1][first])
        ends = np.searchsorted(first, np.cumsum([len(r) + 1 for r in raw]) + 1) if raw else np.zeros(0, dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        v = np.zeros(len(h) + 1, dtype=np.uint64)
        n = len(h) - width + 1
        if n > 0:
            s = np.zeros(n, dtype=np.uint64)
            for k in range(width):
                s = s * np.uint64(_STEP) + h[k : k + n]
            v[1 : n + 1] = mix(s) | np.uint64(1)
        self.start, self.stop = begins + 1, np.maximum(ends - width + 1, begins) + 1
        for k in range(1, width):  # shingles that would run into the next text
            at = ends - k
            v[at[at >= begins] + 1] = 0
        self.value = v


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of width words, in order."""
    s = Shingles([text], width)
    return s.value[s.start[0] : s.stop[0]]


def sliding(values: np.ndarray, width: int, extreme) -> np.ndarray:
    """out[i] is the extreme of values[i : i + width]."""
    out, have = values, 1
    while have < width:
        more = min(have, width - have)
        out = extreme(out[:-more], out[more:])
        have += more
    return out


def neighbours(vals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the place of the last one before it that is not greater, and of the first one after it that is smaller (the
    last place for zeros). The first and the last value are zeros. All links jump at once over what their target already jumps
    over, so a few rounds do."""
    n = len(vals)
    before, after = np.maximum(np.arange(n) - 1, 0), np.minimum(np.arange(n) + 1, n - 1)
    todo = np.flatnonzero(vals[before] > vals)
    while len(todo):
        before[todo] = before[before[todo]]
        todo = todo[vals[before[todo]] > vals[todo]]
    after[vals == 0] = n - 1
    todo = np.flatnonzero((vals[after] >= vals) & (vals > 0))
    while len(todo):
        after[todo] = after[after[todo]]
        todo = todo[vals[after[todo]] >= vals[todo]]
    return before, after


def compact_windows(values: np.ndarray, least: int) -> np.ndarray:
    """Columns first, at, end: the nodes of the Cartesian trees of the stretches between zeros, with at least `least` values; the
    stretches of [first, end) that hold position at have their smallest value there (the leftmost of equal ones). A zero must
    stand at position 0; the last stretch may end without one."""
    values = np.concatenate([values, np.zeros(1, dtype=np.uint64)])
    if len(values) < least:
        return np.zeros((0, 3), dtype=np.int64)
    low, edge = sliding(values, least, np.minimum), np.zeros(least - 1, dtype=np.uint64)
    # All ancestors of a wide node are wide, so the smaller neighbours of wide nodes are among wide nodes and zeros.
    nodes = np.flatnonzero((sliding(np.concatenate([edge, low, edge]), least, np.maximum) == values) | (values == 0))
    vals = values[nodes]
    before, after = neighbours(vals)
    first, end = nodes[before] + 1, nodes[after]
    found = np.stack([first, nodes, end], axis=1).astype(np.int64)
    return found[(values[nodes] != 0) & (found[:, 2] - found[:, 0] >= least)]


def hashed(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th min-hash; zeros stay."""
    v = mix(values + np.uint64(_STEP * (k + 1) & (1 << 64) - 1)) | np.uint64(1)
    v[values == 0] = 0
    return v


def keyed_windows(values: np.ndarray, hashes: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, whose lowest three bits are the number of the hash, and windows (k, first, at, end)."""
    v = np.concatenate([hashed(values, k) for k in range(hashes)])  # each starts with a zero
    w = compact_windows(v, least)
    k = w[:, 1] // len(values)
    keys = (v[w[:, 1]] & np.uint64((1 << 64) - 8) | k.astype(np.uint64)).view(np.int64)
    return keys, np.concatenate([k[:, None], w - (k * len(values))[:, None]], axis=1)


def surroundings(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The min-hash of the stretch from each position on, of half a passage, and the prefix hashes."""
    side = (least - 1) // 2
    return sliding(np.concatenate([hashed(values, 11), np.zeros(side, dtype=np.uint64)]), side, np.minimum), prefix_hashes(values)


def contexts(around: tuple[np.ndarray, np.ndarray], keys: np.ndarray, rows: np.ndarray, owner: np.ndarray, least: int, exact: int, sided: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of what stands beside the least shingles, each with its owner and its mark (the number of the hash, or EXACT). sided:
    for which of them the sides count, beside exact stretches."""
    side = (least - 1) // 2
    k, first, at, end = rows.T
    near, c = around
    out, owners, marks = [], [], []
    for name, ok, where in ((1, sided & (at - first >= side), at - side), (2, sided & (end - at > side), at + 1)):
        out.append(mix(keys[ok].view(np.uint64) + near[where[ok]] * np.uint64(_STEP) + np.uint64(name)))
        owners.append(owner[ok])
        marks.append(k[ok])
    down = _powers(len(c))[1]
    gap = least - exact + 1
    for right in [*range(0, exact - 1, gap), exact - 1]:
        i, j = at - (exact - 1 - right), at + right + 1
        ok = (k == 0) & (i >= first) & (j <= end)
        i, j = i[ok], j[ok]
        out.append(mix((c[j] - c[i]) * down[i] + np.uint64(_STEP * (right + 3) & (1 << 64) - 1)))
        owners.append(owner[ok])
        marks.append(np.full(len(i), EXACT))
    return np.concatenate(out).view(np.int64), np.concatenate(owners), np.concatenate(marks)


MET = "key long, doc long, rep long, mark int, n int"
MET_LAST = MET + ", last long"


class Combiner:
    """Makes the rows of a scan task. What meets within a slice is combined: one row a key with its first document (rep null) and
    the number of documents, and one row for each other document with the first as rep. The first documents of frequent keys are
    remembered, so that a key sends one row without a rep from a task and not from each slice; keys that are no longer remembered
    send another one, which costs a row and loses nothing. last: rows with a rep also get the last document of the slice that has
    their key, but for exact stretches, which need none; for the others it is found when they meet."""

    def __init__(self, last: bool = False, frequent: int = FREQUENT, held: int = HELD):
        self.last, self.frequent, self.held = last, frequent, held
        self.keys, self.docs = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)  # sorted by key

    def __call__(self, key: np.ndarray, doc: np.ndarray, mark: np.ndarray):
        import pyarrow as pa

        order = np.lexsort((doc, key))
        key, doc, mark = key[order], doc[order], mark[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc, mark = key[new], doc[new], mark[new]
        top = np.ones(len(key), dtype=bool)
        top[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(top)
        n = np.diff(np.append(at, len(key)))
        first = doc[at]
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
            known = self.keys[i] == key[at]
            first[known] = self.docs[i[known]]
            top[at[known]] = False
        else:
            known = np.zeros(len(at), dtype=bool)
        more = ~known & (n >= self.frequent)
        if more.any():
            if len(self.keys) + int(more.sum()) > self.held:
                self.keys, self.docs = self.keys[:0], self.docs[:0]
            keys = np.concatenate([self.keys, key[at][more]])
            order = np.argsort(keys)
            self.keys, self.docs = keys[order], np.concatenate([self.docs, first[more]])[order]
        # A row with a rep stands for a group of two at least.
        size = np.repeat(np.where(known, np.maximum(n, 2), n), n)
        rep, size = pa.array(np.repeat(first, n), mask=top), pa.array(size.astype(np.int32))
        cols, names = [pa.array(key), pa.array(doc), rep, pa.array(mark.astype(np.int32)), size], ["key", "doc", "rep", "mark", "n"]
        if self.last:
            cols.append(pa.array(np.repeat(doc[at + n - 1] if len(at) else doc, n), mask=top | (mark == EXACT)))
            names.append("last")
        return pa.RecordBatch.from_arrays(cols, names=names)


def met(rows: DataFrame) -> DataFrame:
    """key, doc, rep, mark of the rows whose key more than one document has; rep is a document that has it, the same for all rows
    without one so far: the first of these. If rows have last, so has the result: the last one, null for exact stretches. Else it
    has two: whether the key is in two slices and in one document of each, so that this pair is all that it can tell."""
    group = Window.partitionBy(F.when(F.col("rep").isNull(), F.col("key")).otherwise(F.xxhash64("key", "doc")), F.col("rep").isNull())
    found = rows.withColumn("low", F.min("doc").over(group)).withColumn("all", F.sum("n").over(group))
    names = ["key", "doc", F.coalesce("rep", "low").alias("rep"), "mark"]
    if "last" in rows.columns:
        found = found.withColumn("high", F.max("doc").over(group))
        names.append(F.when(F.col("mark") != EXACT, F.coalesce("last", "high")).alias("last"))
    else:
        names.append((F.col("rep").isNull() & (F.col("n") == 1) & (F.col("all") == 2)).alias("two"))
    return found.where("all > 1").select(*names)


def windows(docs: DataFrame, hashes: int, width: int, passage: int) -> DataFrame:
    least = passage - width + 1

    def run(batches: Iterator) -> Iterator:
        combined = Combiner()
        for batch in batches:
            for rows in slices(batch, SLICE):
                ids = np.array([-1 if x is None else x for x in rows.column(0).to_pylist()], dtype=np.int64)
                s = Shingles([None if i is None else t for i, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())], width)
                keys, w = keyed_windows(s.value, hashes, least)
                yield combined(keys, ids[np.searchsorted(s.stop, w[:, 2], "left")], w[:, 0])

    return docs.mapInArrow(run, MET)


def beside(shared: DataFrame, docs: DataFrame, hashes: int, width: int, passage: int, exact: int, last: bool) -> DataFrame:
    """The rows of contexts of those windows whose key is shared. Where just two documents share it, their pair is known, and only exact
    stretches are of use, which tell more of a pair than one hash."""
    least = passage - width + 1

    def run(batches: Iterator) -> Iterator:
        combined = Combiner(last)
        for batch in batches:
            for rows in slices(batch, SLICE):
                ids = np.array(rows.column(0).to_pylist(), dtype=np.int64)
                s = Shingles(rows.column(1).to_pylist(), width)
                keys, w = keyed_windows(s.value, hashes, least)
                of = np.searchsorted(s.stop, w[:, 2], "left")
                pairs = lambda k, d: mix(k.astype(np.int64).view(np.uint64)) ^ mix(d.astype(np.int64).view(np.uint64) + np.uint64(_STEP))
                own = pairs(keys, ids[of])
                sided, few = (np.isin(own, pairs(x.flatten().to_numpy(), np.repeat(ids, np.diff(x.offsets.to_numpy())))) for x in rows.columns[2:])
                ok = sided | few
                yield combined(*contexts(surroundings(s.value, least), keys[ok], w[ok], ids[of[ok]], least, exact, sided[ok]))

    first_hash = F.col("mark") == 0
    keys = shared.where(~F.col("two") | first_hash).groupBy("doc").agg(F.collect_set(F.when(~F.col("two"), F.col("key"))).alias("keys"), F.collect_set(F.when(F.col("two"), F.col("key"))).alias("few"))
    # Merged by a shuffle at every size, as both sides grow with the documents.
    return keys.hint("merge").join(docs, keys["doc"] == docs["doc_id"]).select("doc_id", "text", "keys", "few").mapInArrow(run, MET_LAST if last else MET)


def running(near: np.ndarray, similarity: float) -> np.ndarray:
    """Running sums in which each match counts 1 - similarity and a miss -similarity."""
    return np.concatenate([[0.0], np.cumsum(np.where(near, 1 - similarity, -similarity) + 1e-9)])


def grow(total: np.ndarray, first: int, at: int, end: int) -> tuple[int, int]:
    """The stretch of [first, end) around at in which matches outweigh the most, from running sums."""
    return at - int(total[first : at + 1][::-1].argmin()), at + 1 + int(total[at + 1 : end + 1].argmax())


def viable(total: np.ndarray, least: int) -> np.ndarray:
    """Which positions are in a stretch of at least `least` in which matches outweigh; no other stretch can be a passage."""
    start = np.arange(len(total))
    # The last place whose sum is not below that of the start, but for rounding.
    stop = len(total) - 1 - np.searchsorted(np.maximum.accumulate(total[::-1]), total - 1e-6, "left")
    ok = stop - start >= least
    edges = np.bincount(start[ok], minlength=len(total)) - np.bincount(stop[ok], minlength=len(total))
    return np.cumsum(edges)[:-1] > 0


class Diagonals:
    """Where two texts differ when one is shifted against the other, found once for each shift that is asked for."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.found = a, b, {}

    def equal_run(self, cand: tuple) -> tuple[int, int, int]:
        """The equal shingles in a row around a shared one: start in a, start in b, length; inside both windows."""
        _, first, at, end, b_first, b_at, b_end = cand
        shift = at - b_at
        if shift not in self.found:
            low = max(shift, 0)
            high = min(len(self.a), len(self.b) + shift)
            self.found[shift] = [low - 1, *(np.flatnonzero(self.a[low:high] != self.b[low - shift : high - shift]) + low).tolist(), high]
        misses = self.found[shift]
        n = bisect_right(misses, at)
        i = max(misses[n - 1] + 1, first, b_first + shift)
        return i, i - shift, min(misses[n], end, b_end + shift) - i


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    x, y = np.sort(x), np.sort(y)
    x, y = (z[np.append(z[1:] != z[:-1], True)] for z in (x, y))
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return both / (len(x) + len(y) - both)


def verify(a: np.ndarray, b: np.ndarray, sums: tuple, able: tuple, cands: list, needed: int, passage: int, similarity: float, width: int) -> list[tuple]:
    """cands: (k, first, at, end, b_first, b_at, b_end). Passages (start, end, b_start, b_end, similarity) in words of texts
    with shingles a and b; sums and able: running() and viable() of the shingles of either that the other has."""
    least, out = passage - width + 1, set()
    table = np.array(cands, dtype=np.int64).reshape(-1, 7)
    hashes, at_a, at_b, span = table[:, 0], table[:, 2], table[:, 5], table[:, [1, 3, 4, 6]]
    inside = ~(able[0][at_a] & able[1][at_b])
    diagonals, tried = Diagonals(a, b), set()

    def again(near: np.ndarray, at: int) -> tuple[int, int]:
        return grow(running(near, similarity), 0, at, len(near))

    def stretch(cand: tuple) -> tuple | None:
        _, first, at, end, b_first, b_at, b_end = cand
        i, j = grow(sums[0], first, at, end)
        if j - i < least:
            return None
        p, q = grow(sums[1], b_first, b_at, b_end)
        if q - p < least or (i, j, p, q) in tried:
            return None
        tried.add((i, j, p, q))
        near = (span[:, 0] < end) & (span[:, 1] > first) & (span[:, 2] < b_end) & (span[:, 3] > b_first)
        if len(set(hashes[near].tolist())) < needed:
            return None
        if (sim := likeness(a[i:j], b[p:q])) >= similarity:
            return i, j, p, q, sim
        # Words that match elsewhere in the other text are in the way: match with the other stretch alone.
        i, j = (z + i for z in again(np.isin(a[i:j], b[p:q]), at - i))
        p, q = (z + p for z in again(np.isin(b[p:q], a[i:j]), b_at - p))
        sim = likeness(a[i:j], b[p:q])
        return (i, j, p, q, sim) if sim >= similarity and min(j - i, q - p) >= least else None

    def equal(cand: tuple) -> tuple | None:
        """The equal run around the shingle, if need be with its neighbours, as a passage."""
        i, p, n = diagonals.equal_run(cand)
        if 2 * least * similarity > n * (1 + similarity):
            return None
        m = max(n, least)
        i, p = max(cand[1], min(i, cand[3] - m)), max(cand[4], min(p, cand[6] - m))
        sim = likeness(a[i : i + m], b[p : p + m])
        return (i, i + m, p, p + m, sim) if sim >= similarity else None

    for n, cand in enumerate(cands):
        if inside[n] or (found := stretch(cand) or equal(cand)) is None:
            continue
        i, j, p, q, sim = found
        out.add((i, j + width - 1, p, q + width - 1, sim))
        inside |= (i <= at_a) & (at_a < j) & (p <= at_b) & (at_b < q)
    return sorted(out)


FOUND = "doc_id long, rep_doc_id long, start int, end int, rep_start int, rep_end int, similarity double"
FOUND_COLUMNS = [f.split()[0] for f in FOUND.split(", ")]


def passages(out: list[tuple]):
    import pyarrow as pa

    cols = list(zip(*out)) if out else [[]] * 7
    types = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=[x.split()[0] for x in FOUND.split(", ")])


def interval_join(a: Text, b: Text, exact: int) -> list[tuple]:
    """Windows of two texts with the same key: (k, first, at, end, b_first, b_at, b_end), by hash and position, counted from the
    first shingle. Where a text has a key more than once (a line repeated in it), the widest window counts, and all those
    that have the same neighbours in the other text."""
    (ka, ia, more_a), (kb, ib, more_b) = a.widest, b.widest
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    pairs = np.stack([ia[i], ib[j]], axis=1)
    if len(more_a) or len(more_b):
        more, sides = np.union1d(more_a, more_b), []
        for text in (a, b):
            keys, rows = text.windows
            at = np.flatnonzero(np.isin(keys, more))
            k2, owner, _ = contexts(text.around, keys[at], rows[at], at, text.least, exact)
            k2, x = np.unique(k2, return_index=True)
            sides.append((k2, owner[x]))
        _, i, j = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
        pairs = np.unique(np.concatenate([pairs, np.stack([sides[0][1][i], sides[1][1][j]], axis=1)]), axis=0)
    both = np.concatenate([a.windows[1][pairs[:, 0]], b.windows[1][pairs[:, 1]][:, 1:]], axis=1)
    return [tuple(x) for x in (both[np.lexsort((both[:, 1], both[:, 0]))] - np.array([0, 1, 1, 1, 1, 1, 1])).tolist()]


class Text:
    """Shingles of a text after a zero, and what is found of them when it is asked for."""

    def __init__(self, values: np.ndarray, hashes: int, least: int):
        values[:1] = 0
        self.values, self.hashes, self.least = values, hashes, least

    @cached_property
    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        return keyed_windows(self.values, self.hashes, self.least)

    @cached_property
    def widest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys, the widest window of each, and the keys with more than one."""
        keys, rows = self.windows
        order = np.lexsort((rows[:, 1] - rows[:, 3], keys))
        keys, top = keys[order], np.ones(len(keys), dtype=bool)
        top[1:] = keys[1:] != keys[:-1]
        return keys[top], order[top], np.unique(keys[~top])

    @cached_property
    def around(self) -> tuple[np.ndarray, np.ndarray]:
        return surroundings(self.values, self.least)

    @cached_property
    def ordered(self) -> np.ndarray:
        return np.sort(self.values[1:])

    def among(self, other: Text) -> np.ndarray:
        """Which of these shingles the other text has."""
        at = np.searchsorted(other.ordered, self.values[1:])
        return other.ordered[np.minimum(at, len(other.ordered) - 1)] == self.values[1:]


def shared_passages(own: Text, base: Text, exact: int, needed: int, passage: int, similarity: float, width: int) -> list[tuple]:
    """verify() for two texts. Equal ones are one passage; those without a stretch in which common shingles outweigh have none."""
    a, b = own.values[1:], base.values[1:]
    if np.array_equal(a, b):
        return [(0, len(a) + width - 1, 0, len(a) + width - 1, 1.0)]
    sums, able = [], []
    for one, other in ((own, base), (base, own)):
        sums.append(running(one.among(other), similarity))
        able.append(viable(sums[-1], own.least))
        if not able[-1].any():
            return []
    return verify(a, b, tuple(sums), tuple(able), interval_join(own, base, exact), needed, passage, similarity, width)


def _verified(pairs: DataFrame, docs: DataFrame, hashes: int, needed: int, passage: int, similarity: float, width: int, exact: int, block: int, many: bool = True) -> DataFrame:
    """pairs (doc, rep) to the passages that they share. Members of a representative are dealt to tasks in blocks, each with its text."""
    least = passage - width + 1
    counts = pairs.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(F.col("n") / block).cast("int"))
    salts = counts.select("rep", "salts")
    members = join_by_key(pairs, counts, "rep", pairs.count()).select("rep", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc")
    reps = salts.select("rep", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("rep").alias("doc"))
    ends = members.unionByName(reps)
    # One join brings the texts of both; merged by a shuffle at every size where the pairs grow with the documents.
    texts = (ends.hint("merge") if many else ends).join(docs, ends["doc"] == docs["doc_id"]).select("rep", "salt", "kind", "doc", "text")

    def run(batches: Iterator) -> Iterator:
        rep, base = None, None
        for batch in batches:
            for rows in slices(batch, SLICE):
                out: list[tuple] = []
                s = Shingles(rows.column(4).to_pylist(), width)
                for d, (r, kind, doc) in enumerate(zip(*(rows.column(c).to_pylist() for c in (0, 2, 3)))):
                    own = Text(s.value[s.start[d] - 1 : s.stop[d]].copy(), hashes, least)
                    if kind == 0:
                        rep, base = r, own
                        continue
                    assert r == rep
                    out += [(doc, rep, *f) for f in shared_passages(own, base, exact, needed, passage, similarity, width)]
                yield passages(out)

    return texts.repartition("rep", "salt").sortWithinPartitions("rep", "salt", "kind", "doc").mapInArrow(run, FOUND)


def pair(rows: DataFrame, one: str, other: str) -> DataFrame:
    """rows (one, other, marks, near) to pairs (doc, rep, marks, near), the smaller id as rep, each once."""
    ends = rows.where(F.col(one) != F.col(other)).select(F.greatest(one, other).alias("doc"), F.least(one, other).alias("rep"), "marks", "near")
    return ends.groupBy("doc", "rep").agg(F.bit_or("marks").alias("marks"), F.max("near").alias("near"))


def enough(hashes: int, needed: int) -> Column:
    """`needed` hashes with what stands beside one of the shingles, or one that no others have (near), all hashes, or an exact stretch."""
    return (F.col("marks") >= 1 << EXACT) | ((F.bit_count("marks") >= needed) & F.col("near")) | (F.bit_count("marks") >= hashes)


def met_by(rows: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """rows with the columns of per_key, which has each key once; keys that many rows have gather in no task (join_by_key)."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return join_by_key(rows, per_key.join(n, key), key, rows.count())


def labels(found: DataFrame, rounds: int = 2) -> DataFrame:
    """doc, label: a small id among those that a document is linked to, over many steps. Equal labels are linked; unequal ones may
    be, over still more steps, which only costs a needless comparison."""
    ends = found.select(F.col("doc_id").alias("doc"), F.col("rep_doc_id").alias("other"))
    ends = ends.unionByName(ends.select(F.col("other").alias("doc"), F.col("doc").alias("other"))).distinct()
    own = ends.groupBy("doc").agg(F.min("other").alias("label")).select("doc", F.least("doc", "label").alias("label"))
    for _ in range(rounds):
        own = materialize(own, "passages-labels")
        jumped = met_by(own, own.select(F.col("doc").alias("label"), F.col("label").alias("higher")), "label").select("doc", F.least("label", "higher").alias("label"))
        best = met_by(ends, jumped.withColumnRenamed("doc", "other"), "other").groupBy("doc").agg(F.min("label").alias("near"))
        own = jumped.join(best, "doc").select("doc", F.least("label", "near").alias("label"))
    return materialize(own, "passages-labels")


def paired_again(stars: DataFrame, found: DataFrame, tried: DataFrame, hashes: int, needed: int) -> DataFrame:
    """Pairs (doc, rep) of documents with the last ones of their groups, where the labels differ and there is enough in common. Here rep is
    the larger id: it is what many share, and a rep's members are dealt to tasks in blocks."""
    pairs = pair(stars.where("last IS NOT NULL"), "doc", "last").where(enough(hashes, needed)).join(tried, ["doc", "rep"], "left_anti").select("doc", "rep")
    label, pairs = labels(found), materialize(pairs, "passages-again")
    for end in ("doc", "rep"):
        # Documents that are linked to none are their own label.
        own = pairs.select(end).distinct().join(label.withColumnRenamed("doc", end), end, "left").select(end, F.coalesce("label", end).alias(f"{end}_label"))
        pairs = met_by(pairs, own, end)
    return pairs.where("doc_label <> rep_label").select(F.col("rep").alias("doc"), F.col("doc").alias("rep"))


def turned(found: DataFrame) -> DataFrame:
    """FOUND with document and representative the other way round."""
    return found.select(F.col("rep_doc_id").alias("doc_id"), F.col("doc_id").alias("rep_doc_id"), F.col("rep_start").alias("start"), F.col("rep_end").alias("end"), F.col("start").alias("rep_start"), F.col("end").alias("rep_end"), "similarity")


def _by_text(docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What find finds in docs some of whose ids are repeated or null: each distinct text of an id, and each distinct text without an id,
    is a document of its own to it. Passages that only texts of one id share are left out."""
    texts = docs.where("text IS NOT NULL").distinct().withColumn("key", F.monotonically_increasing_id())
    texts = materialize(texts, "passages-texts")  # keys stay as they are written
    found = materialize(find(texts.select(F.col("key").alias("doc_id"), "text")), "passages-found")
    ids = texts.select("key", "doc_id")
    for end in ("doc_id", "rep_doc_id"):
        found = met_by(found.withColumnRenamed(end, "key"), ids.withColumnRenamed("doc_id", end), "key").drop("key")
    found = found.where("NOT doc_id <=> rep_doc_id OR doc_id IS NULL")
    # A row without an id is never what others are told to be like, unless there is no other.
    turn = F.coalesce(F.col("doc_id") < F.col("rep_doc_id"), F.col("rep_doc_id").isNull() & F.col("doc_id").isNotNull())
    both = found.where(~turn).select(*FOUND_COLUMNS).unionByName(turned(found.where(turn)))
    return both.distinct()


def repeated_passages(docs: DataFrame, hashes: int = HASHES, needed: int = NEEDED, width: int = SHINGLE, passage: int = PASSAGE_WORDS, similarity: float = SIMILARITY, block: int = BLOCK, last: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rep_doc_id, start, end, rep_start, rep_end (words, end exclusive), similarity: passages that a document shares with
    a representative of those that have it, which has the smaller id. Who shares a passage is linked over representatives."""
    if not 1 <= hashes <= 8:
        raise ValueError("1 to 8 hashes")
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        return _by_text(docs, lambda texts: _passages(texts, hashes, needed, width, passage, similarity, block, last))
    return _passages(docs, hashes, needed, width, passage, similarity, block, last)


def _passages(docs: DataFrame, hashes: int, needed: int, width: int, passage: int, similarity: float, block: int, last: bool) -> DataFrame:
    """repeated_passages of docs (doc_id, text) with an id of its own for each row."""
    least = passage - width + 1
    # The shortest equal run that makes two stretches of `least` shingles similar enough: x / (2 * least - x) >= similarity.
    exact = min(least, int(np.ceil(2 * least * similarity / (1 + similarity))))
    shared = materialize(met(windows(docs, hashes, width, passage)), "passages-shared")
    dealt = met(beside(shared, docs, hashes, width, passage, exact, last))
    bit, none = F.expr("shiftleft(1, mark)").alias("bit"), F.lit(None).cast("long").alias("last")
    rows = shared.select("doc", "rep", none, bit, F.col("two").alias("near")).unionByName(dealt.select("doc", "rep", "last" if last else none, bit, F.lit(True).alias("near")))
    # One row for each document, representative and last one, instead of one for each key that they share.
    stars = materialize(rows.groupBy("doc", "rep", "last").agg(F.bit_or("bit").alias("marks"), F.max("near").alias("near")), "passages-stars")
    del rows, dealt  # their shuffle files go with them
    discard(shared)
    tried = materialize(pair(stars, "doc", "rep").where(enough(hashes, needed)).select("doc", "rep"), "passages-pairs")
    tidy(docs.sparkSession)
    found = materialize(_verified(tried, docs, hashes, needed, passage, similarity, width, exact, block), "passages-found")
    if not last:
        return found
    pairs = materialize(paired_again(stars, found, tried, hashes, needed), "passages-pairs")
    discard(stars)
    more = turned(_verified(pairs, docs, hashes, needed, passage, similarity, width, exact, block, many=False))
    return found.unionByName(materialize(more.select(*FOUND_COLUMNS), "passages-found"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
