"""Token counts by linear longest match: a vocabulary trie with failure links and precomputed counts of popped tokens.

Greedy longest-match word pieces need no backtracking: where the trie has no edge, a failure link leads to the node that
stands for the rest after the longest pieces are popped, and the number of pieces popped on the way is known beforehand.
A word's length in pieces so takes one pass over its bytes, and no piece is ever built. (Song et al., "Fast WordPiece
Tokenization", 2021.)

Words are those of bpe.WORDS, whole and with their leading space; the vocabulary is that of a byte-level tokenizer file,
whose pieces are byte strings, so no word is unknown. LongestMatch itself takes any vocabulary, with a prefix for pieces
that continue a word (as "##") if it has one.

Defined cases: null or empty text has 0 words and 0 tokens; null ids and repeated rows give rows of their own; an empty
table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import ship, slices, table


class LongestMatch:
    """Over bytes. count(word) is the number of greedy pieces; a word that can't be covered counts as one unknown piece."""

    def __init__(self, pieces: Iterable[bytes], prefix: bytes = b""):
        self.edges: list[dict[int, int]] = [{}]
        ends: list[bool] = [False]

        def grow(node: int, piece: bytes) -> int:
            for c in piece:
                if c not in self.edges[node]:
                    self.edges[node][c] = len(self.edges)
                    self.edges.append({})
                    ends.append(False)
                node = self.edges[node][c]
            return node

        #: Where the rest of a word is read from: the root itself, or the node below the prefix.
        self.cont = grow(0, prefix)
        for piece in pieces:
            if piece and piece != prefix:
                ends[grow(0, piece)] = True
        #: fail[v] and pops[v]: the node after the longest pieces at the start of v's string are popped, and their number.
        self.fail: list[int] = [-1] * len(self.edges)
        self.pops: list[int] = [0] * len(self.edges)
        queue, seen = deque([0] if self.cont == 0 else [0, self.cont]), {0, self.cont}
        while queue:
            u = queue.popleft()
            for c, v in self.edges[u].items():
                if v in seen:
                    continue
                seen.add(v)
                if ends[v]:
                    self.fail[v], self.pops[v] = self.cont, 1
                else:
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.edges[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.edges[z][c], popped
                queue.append(v)

    def count(self, word: bytes) -> int:
        edges, fail, pops = self.edges, self.fail, self.pops
        node, n = 0, 0
        for c in word:
            while (to := edges[node].get(c)) is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node != self.cont and node > 0:
            n += pops[node]
            node = fail[node]
        return 1 if node < 0 else n


def byte_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level tokenizer file as bytes. Its names write each byte as one printable character."""
    from tokenizers import Tokenizer

    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    names = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    return [bytes(byte_of[c] for c in name) for name in names if all(c in byte_of for c in name)]


class Counts(dict):
    """Pieces by word, found once; keep bounds what is stored."""

    def __init__(self, path: str, keep: int = 1_000_000):
        self.match, self.keep = LongestMatch(byte_pieces(path)), keep

    def __missing__(self, word: str) -> int:
        if len(self) >= self.keep:
            self.clear()
        n = self[word] = self.match.count(word.encode("utf-8", "surrogatepass"))
        return n


@lru_cache(maxsize=2)
def counts(path: str) -> Counts:
    return Counts(path)


def token_counts(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text."""
    ship(docs.sparkSession)
    tokenizer = tokenizer or bpe.default_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = counts(tokenizer)
        for batch in batches:
            for rows in slices(batch):
                words, tokens = [], []
                for t in rows.column(1).to_pylist():
                    found = bpe.WORDS.findall(t) if t else ()
                    words.append(len(found))
                    tokens.append(sum(map(known.__getitem__, found)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(words, type=pa.int64()), pa.array(tokens, type=pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
