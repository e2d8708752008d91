"""Byte-level BPE ids from the tokenizers library, at the cost of one library call for many distinct words at a time.

The library's pre-tokenizer splits a text by a pattern, and BPE then works inside each part alone. No part goes on past the end
of a run of other characters than white space, so a text's ids are those of its pieces in a row, a piece being a run of white
space and what follows up to the next one. encode cuts a batch of texts into pieces, asks the library for those that it has
not met yet, many joined in one call, and gathers the ids of all pieces from those of the distinct ones.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np

#: The words of the pre-tokenizer, for those who count words themselves.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
CHUNK = 400
#: Pieces that an encoder stores, about 200 bytes each.
KNOWN = 400_000
#: White space in UTF-8: single bytes, the last byte after C2, and the last two after E1, E2 and E3.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_AFTER_C2 = np.isin(np.arange(256), [0x85, 0xA0])
_AFTER_E = {0xE1: (0x9A80,), 0xE2: (*range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F), 0xE3: (0x8080,)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def white_space(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space."""
    space = _SPACE[data]
    at = np.flatnonzero(data[:-1] == 0xC2)
    at = at[_AFTER_C2[data[at + 1]]]
    space[at] = space[at + 1] = True
    for lead, tails in _AFTER_E.items():
        at = np.flatnonzero(data[:-2] == lead)
        if len(at):
            at = at[np.isin(data[at + 1].astype(np.int64) << 8 | data[at + 2], tails)]
            space[at] = space[at + 1] = space[at + 2] = True
    return space


class Encoder:
    """keep bounds the number of pieces stored from call to call; beyond it the later ones go, so that the pieces met first, most
    of them frequent, stay."""

    def __init__(self, path: str, keep: int = KNOWN):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True  # a special token's string in a text is ordinary text
        self.keep = keep
        self.known: dict[bytes, bytes] = {}
        names = self.lib.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(names.values()) + 1, dtype=np.int64)
        for name, i in names.items():
            self.n_bytes[i] = len(name)  # each character of a byte-level name stands for one byte

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        """Pieces with white space before and none behind are joined, as each is a piece again then."""
        joined: list[bytes] = []
        alone: list[bytes] = []
        for p in pieces:
            (joined if p[0] in b" \n" and 32 < p[-1] < 128 or p[-1] >= 128 and p[0] in b" \n" and p.decode()[-1].isalnum() else alone).append(p)
        parts = [joined[i : i + CHUNK] for i in range(0, len(joined), CHUNK)]
        for part, ids in zip(parts, self._ids([b"".join(part).decode() for part in parts]) if parts else ()):
            raw, ends = ids.tobytes(), np.cumsum(self.n_bytes[ids])
            ends = ((np.searchsorted(ends, np.cumsum(list(map(len, part)))) + 1) * 4).tolist()
            self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends], ends))))
        if alone:
            self.known.update(zip(alone, (ids.tobytes() for ids in self._ids([p.decode() for p in alone]))))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """An Arrow array of strings to the ids of all of them in a row, and where those of each begin and the last end. Null is empty."""
        import pyarrow as pa

        texts = texts.cast(pa.string()).fill_null("")
        _, offsets, data = texts.buffers()
        to = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int32)
        if to[0] == to[-1]:
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts) + 1, dtype=np.int64)
        data = np.frombuffer(data, dtype=np.uint8)[to[0] : to[-1]]
        to = to - to[0]
        begins = white_space(data)
        begins[1:] &= ~begins[:-1]
        begins[to[to < len(data)]] = True
        cuts = np.append(np.flatnonzero(begins), len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        codes, distinct = pieces.indices.to_numpy(zero_copy_only=False), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.keep:
            self.known = dict(islice(self.known.items(), self.keep // 2))
        stored = list(map(self.known.get, distinct))
        if new := [i for i, ids in enumerate(stored) if ids is None]:
            self._learn([distinct[i] for i in new])
            for i in new:
                stored[i] = self.known[distinct[i]]
        # Ids are at most as many as bytes, so 32 bits number them.
        size = np.fromiter(map(len, stored), dtype=np.int32, count=len(stored)) // 4
        flat, first = np.frombuffer(b"".join(stored), dtype="<u4"), np.cumsum(size, dtype=np.int32) - size
        n = size[codes]
        ends = np.cumsum(n, dtype=np.int32)
        at = np.repeat(first[codes] - (ends - n), n)
        at += np.arange(ends[-1], dtype=np.int32)
        return flat[at], np.append(0, ends).astype(np.int64)[np.searchsorted(cuts, to)]

    def encode_ended(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """encode with end_id after each text's ids."""
        ids, to = self.encode(texts)
        return np.insert(ids, to[1:], end_id), to + np.arange(len(to))

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit bytes, a text each."""
        import pyarrow as pa

        ids, to = self.encode(pa.array(texts, type=pa.string()))
        raw = ids.tobytes()
        return [raw[4 * i : 4 * j] for i, j in zip(to[:-1].tolist(), to[1:].tolist())]


@lru_cache(maxsize=2)
def encoder(path: str, keep: int = KNOWN) -> Encoder:
    """One per worker process, kept from task to task. The tasks are the parallelism; the library's own threads would only compete."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, keep)
