"""Byte-level BPE ids of whole texts by the tokenizers library, each distinct chunk encoded once.

The byte-level pre-tokeniser never joins characters across the start of a run of white space, so a text's
ids are those of its chunks (white space and what follows up to the next white space) one after the other; nor does it join
an ASCII letter or digit and a punctuation mark behind it, so marks are chunks of their own and words recur more often.
Distinct chunks of a batch are encoded joined in long strings and told apart by the lengths of their
tokens, of which each character stands for a byte. The strings of special tokens are found before that: each is one id,
and the texts before and after it are encoded on their own, as the library does by default.
"""

from __future__ import annotations

import os
import re
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa

from keystrata.llm.shared import buffers, ragged, worker_cache

#: Chunks whose ids a worker keeps; beyond that it starts anew.
CACHE = 1_200_000
_BLANK = frozenset([*range(0x09, 0x0E), *range(0x1C, 0x21)])
#: Bits of a byte's kind: white space, ASCII letter or digit, ASCII punctuation, no ASCII, lead byte of two.
WHITE, LETTER, MARK, WIDE, TWO = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = MARK
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = LETTER
_KIND[list(_BLANK)] = WHITE
_KIND[0x80:] = WIDE
_KIND[0xC3:0xE0] |= TWO


class Encoder:
    """``special``: whether the strings of special tokens become their ids; if not, they are ordinary text."""

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        if any(t.lstrip or t.rstrip or t.single_word or set(t.content.encode()) & _BLANK for t in added):
            raise ValueError("added tokens that take in white space are not supported")
        strings = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.marks = re.compile(b"|".join(map(re.escape, strings))) if strings else None
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.lengths[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._forget()

    def _forget(self) -> None:
        """Known chunks have a number; their ids lie one after the other."""
        self.known: dict[bytes, int] = {}
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes]) -> np.ndarray:
        """Each chunk's place among the new ones."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        kind, end = _KIND[np.frombuffer(b"".join(chunks), np.uint8)], np.cumsum(sizes)
        safe = (kind[end - sizes] & WHITE > 0) & ((kind[end - 1] & (LETTER | MARK) > 0) | ((sizes > 1) & (kind[end - 1] & WIDE > 0) & (kind[end - 2] & TWO > 0)))
        joined, alone = list(compress(chunks, safe.tolist())), list(compress(chunks, (~safe).tolist()))
        found = self._ids([b"".join(joined[i : i + 256]).decode("utf-8", "replace") for i in range(0, len(joined), 256)])
        ids = np.fromiter(chain.from_iterable(found), np.uint32)
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined))), "left") + 1
        found = self._ids([c.decode("utf-8", "replace") for c in alone])
        more = np.fromiter(chain.from_iterable(found), np.uint32)
        self.known.update(zip(joined + alone, range(len(self.known), len(self.known) + len(chunks)), strict=True))
        self.flat = np.concatenate((self.flat, ids, more))
        self.sizes = np.concatenate((self.sizes, np.diff(ends, prepend=0), np.array([len(g) for g in found], np.int64)))
        place = np.empty(len(chunks), np.int64)
        place[safe], place[~safe] = np.arange(len(joined)), len(joined) + np.arange(len(alone))
        return place

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each."""
        n = len(at) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        kind = _KIND[raw]
        start = (kind & WHITE).astype(bool)
        # white space behind ASCII or a character of two bytes that is no white space, a mark behind a letter
        start[1:] &= (kind[:-1] & (WHITE | WIDE)) == 0
        start[1:] |= (kind[1:] & MARK & (kind[:-1] & LETTER) << 1).astype(bool)
        start[2:] |= (kind[2:] & WHITE & (kind[1:-1] >> 3) & (kind[:-2] >> 4)).astype(bool)
        start[at[:-1][at[:-1] < len(raw)]] = True
        if self.marks is not None:
            for m in self.marks.finditer(raw):
                # one that runs on into the next text is none
                if at[np.searchsorted(at, m.start(), "right")] >= m.end():
                    start[m.start() : m.end()] = False
                    start[m.start()] = True
                    start[m.end() : m.end() + 1] = True
        begin = np.flatnonzero(start)
        offsets = np.append(begin, len(raw)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        data, ends = buffers(chunks.dictionary)
        whole, ends = data.tobytes(), ends.tolist()
        distinct = [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        numbers = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            if len(self.known) + len(new) > CACHE:
                self._forget()
                new = np.arange(len(distinct))
            numbers[new] = len(self.known) + self._learn([distinct[i] for i in new.tolist()])
        sizes, starts = self.sizes[numbers], (np.cumsum(self.sizes) - self.sizes)[numbers].astype(np.int32)
        index = chunks.indices.to_numpy()
        each = sizes[index]
        ids = self.flat[ragged(starts[index], each, np.int32)]
        total = np.concatenate(([0], np.cumsum(each)))
        return ids, np.diff(total[np.searchsorted(begin, at)])


def encoder(path: str, special: bool = True) -> Encoder:
    """This worker's encoder for the tokenizer file at ``path``."""
    cache = worker_cache()
    if ("bpe", path, special) not in cache:
        cache["bpe", path, special] = Encoder(path, special)
    return cache["bpe", path, special]
