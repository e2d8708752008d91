"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens. Each scan task packs its own documents, so nothing is
shuffled and a lost task is simply run again with the same result. Documents of a sequence's length or more first give whole
sequences; what is left joins a pool. For the open sequence the pool's item is taken that fits and has the largest dot
product of its size with the room left (both as shares of the limits); if none fits, the largest item is cut to the room.
At a task's end the last sequence is closed at powers of two, where no padding is due.

Defined cases: a null text is empty and gives the end id alone; null ids and repeated rows are packed as rows of their own;
an empty table gives no rows; an item whose loss-bearing part alone meets the limit is cut there. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import ship, slices, table


@dataclass
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass
class Packer:
    """add() items, then drain(). An item is (key, n_tokens, loss_from): its tokens from loss_from on bear loss.

    Rows that come out: (key, start, length, sequence, offset). pool bounds the items that wait, and so memory.
    """

    limits: Limits = field(default_factory=Limits)
    pool: int = 512
    low: int = 128

    def __post_init__(self) -> None:
        size = 2 * self.pool
        self.n = 0
        self.key: list = [None] * size
        self.start, self.end, self.loss_from = (np.zeros(size, dtype=np.int64) for _ in range(3))
        self.share = np.zeros((3, size))  # of the limits: tokens, segments, loss
        self.caps = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], dtype=np.float64)
        self.caps_of = self.caps.tolist()
        self.room: np.ndarray | None = None
        self.open: list[tuple] = []
        self.sequences = 0
        self.out: list[tuple] = []

    def add(self, key, n_tokens: int, loss_from: int = 0) -> None:
        at = 0
        while n_tokens - at >= self.limits.tokens:  # whole sequences of one segment, as far as the loss limit allows
            length = self._cut(at, n_tokens, loss_from, self.limits.tokens, self.limits.loss)
            if length < self.limits.tokens:
                break
            self.out.append((key, at, length, self.sequences, 0))
            self.sequences += 1
            at += length
        if at < n_tokens or not n_tokens:
            if self.n == len(self.key):
                self._pack(self.low)
            self._put(self.n, key, at, n_tokens, loss_from)
            self.n += 1
        if self.n >= self.pool:
            self._pack(self.low)

    def drain(self) -> None:
        self._pack(0)
        self._close(last=True)

    @staticmethod
    def _cut(at: int, end: int, loss_from: int, tokens: int, loss: int) -> int:
        """The longest piece from at within tokens and loss."""
        return min(end - at, tokens, max(loss_from - at, 0) + loss)

    def _put(self, i: int, key, start: int, end: int, loss_from: int) -> None:
        self.key[i], self.start[i], self.end[i], self.loss_from[i] = key, start, end, loss_from
        t, s, x = self.caps_of
        self.share[0, i], self.share[1, i], self.share[2, i] = (end - start) / t, 1 / s, (end - max(start, min(loss_from, end))) / x

    def _take(self, i: int, length: int) -> None:
        """Place the first length tokens of item i; the rest stays in the pool."""
        start, loss_from = int(self.start[i]), int(self.loss_from[i])
        self.open.append((self.key[i], start, length))
        self.room -= np.array([length, 1, start + length - max(start, min(loss_from, start + length))])
        if start + length < self.end[i]:
            self._put(i, self.key[i], start + length, int(self.end[i]), loss_from)
        else:
            self.n -= 1
            if i != self.n:
                self._put(i, self.key[self.n], int(self.start[self.n]), int(self.end[self.n]), int(self.loss_from[self.n]))
            self.key[self.n] = None

    def _pack(self, down_to: int) -> None:
        while self.n > down_to:
            if self.room is None:
                self.room = self.caps.copy()
            room = self.room / self.caps
            share = self.share[:, : self.n]
            r = (room + 1e-9).tolist()
            score = room @ share
            score[(share[0] > r[0]) | (share[1] > r[1]) | (share[2] > r[2])] = -1.0
            i = int(score.argmax())
            if score[i] >= 0:
                self._take(i, int(self.end[i] - self.start[i]))
            else:
                i = int(share[0].argmax())
                length = self._cut(int(self.start[i]), int(self.end[i]), int(self.loss_from[i]), int(self.room[0]), int(self.room[2]))
                if length <= 0 or self.room[1] < 1:
                    self._close()
                    continue
                self._take(i, length)
            if self.room[0] < 1 or self.room[1] < 1 or self.room[2] < 1:
                self._close()

    def _close(self, last: bool = False) -> None:
        """Write the open sequence; the last one of a task falls into sequences whose lengths are powers of two."""
        held = sum(length for _, _, length in self.open)
        sizes = [1 << b for b in range(held.bit_length() - 1, -1, -1) if held >> b & 1] if last and held < self.limits.tokens else [held]
        pieces, used = iter(self.open), 0
        key, start, left = next(pieces, (None, 0, 0))
        for size in sizes if self.open else []:
            used = 0
            while used < size:
                if not left:
                    key, start, left = next(pieces)
                length = min(left, size - used)
                self.out.append((key, start, length, self.sequences, used))
                start, left, used = start + length, left - length, used + length
            self.sequences += 1
        self.open, self.room = [], None


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, limits: Limits | None = None, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", prompt_chars: str | None = None, known: int = bpe.KNOWN, batch_mb: int = 2) -> DataFrame:
    """One row per piece. prompt_chars: a column with the length of a prompt at a text's start, whose tokens bear no loss.
    known, batch_mb: what a worker stores of the tokenizer's pieces, and the text that it encodes at a time, against its memory."""
    ship(docs.sparkSession)
    limits, tokenizer = limits or Limits(), tokenizer or bpe.default_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        enc, packer = bpe.encoder(tokenizer, known), Packer(limits)
        row = 0
        held: dict[int, list] = {}  # documents with tokens still to come out: [id, ids, tokens to come]

        def emitted():
            rows, packer.out = packer.out, []
            cols: list[list] = [[] for _ in range(7)]
            for key, start, length, sequence, offset in rows:
                doc = held[key]
                for c, v in zip(cols, (doc[0], start, length, zlib.crc32(doc[1][4 * start : 4 * (start + length)]), len(doc[1]) // 4, base + sequence, offset)):
                    c.append(v)
                doc[2] -= length
                if not doc[2]:
                    del held[key]
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for rows in slices(batch, batch_mb << 20):
                ids, to = enc.encode_ended(rows.column(1), end_id)
                raw, cuts, loss_from = ids.tobytes(), rows.column(2).to_pylist(), [0] * rows.num_rows
                if any(cuts):
                    loss_from = [len(x) // 4 for x in enc.encode_many([(t or "")[: c or 0] for t, c in zip(rows.column(1).to_pylist(), cuts)])]
                for doc_id, i, j, prompt in zip(rows.column(0).to_pylist(), to[:-1].tolist(), to[1:].tolist(), loss_from):
                    held[row] = [doc_id, raw[4 * i : 4 * j], j - i]
                    packer.add(row, j - i, prompt)
                    row += 1
                if packer.out:
                    yield emitted()
        packer.drain()
        yield emitted()

    cut = F.col(prompt_chars).cast("long") if prompt_chars else F.lit(0).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), cut.alias("cut")).mapInArrow(run, PACKED)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
