"""Byte-level BPE token ids of whole text columns.

The tokenizer's split never joins a letter run, a digit run or a mark with what follows when the next
byte is ASCII of another class, so a text can be cut there and each distinct unit encoded once per
Python worker. The concatenated ids are those of the whole text (tested against it).
"""

from __future__ import annotations

import os

import numpy as np

from .textvec import span_hashes

#: Units whose ids a worker keeps; beyond this it starts again with the units of the current chunk.
CACHE_UNITS = 1_000_000

_LETTER, _DIGIT, _MARK, _SPACE, _ASCII = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, np.uint8)
_CLASS[:128] |= _ASCII
_CLASS[33:127] |= _MARK
_CLASS[[*range(65, 91), *range(97, 123)]] = _ASCII | _LETTER
_CLASS[48:58] = _ASCII | _DIGIT
_CLASS[[9, 10, 13, 32]] = _ASCII | _SPACE


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(data: np.ndarray) -> np.ndarray:
    """True where a unit may start: the tokenizer's split always has a boundary there."""
    out = np.zeros(len(data), bool)
    if len(data) < 2:
        return out
    kind = _CLASS[data]
    accented = np.flatnonzero(data[:-1] == 0xC3) + 1  # U+00C0 to U+00FF are letters, but for two signs among them
    accented = accented[(data[accented] != 0x97) & (data[accented] != 0xB7)]
    kind[accented] = _LETTER
    a, b = kind[:-1], kind[1:]
    out[1:] = ((a & ~b & (b >> 4) & _LETTER) | ((a & ~b) >> 1 & (b >> 4) & 1) | (a >> 2 & b >> 3 & 1)) != 0
    return out


def token_bytes(tokenizer) -> np.ndarray:
    """UTF-8 length of each token id: a byte-level vocabulary writes one character for each byte."""
    out = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        out[i] = len(token)
    return out


class Encoder:
    """Encodes text columns; one per Python worker and tokenizer file.

    Known units are in an open-addressing table of hashes, searched for a whole chunk at once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.bytes = token_bytes(self.tokenizer)
        self.clear()

    def clear(self, bits: int = 18) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.first = np.zeros(1 << bits, np.int64)
        self.length = np.zeros(1 << bits, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for unknown ones."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, slot, -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = slot[left[hit]]
            left = left[~hit & (there != 0)]
        return out

    def _put(self, keys: np.ndarray, first: np.ndarray, length: np.ndarray) -> None:
        if (self.n + len(keys)) * 3 > 1 << self.bits:
            used = np.flatnonzero(self.keys)
            keys, first, length = (np.concatenate([old[used], new]) for old, new in ((self.keys, keys), (self.first, first), (self.length, length)))
            while len(keys) * 3 > 1 << self.bits:
                self.bits += 1
            pool = self.pool
            self.clear(self.bits)
            self.pool = pool
        left, slot = np.arange(len(keys)), (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.keys[slot[left]] == 0
            at = left[free]
            self.keys[slot[at]] = keys[at]  # of several for one slot the last stays, the others go on
            won = self.keys[slot[left]] == keys[left]
            at = left[won]
            self.first[slot[at]], self.length[slot[at]] = first[at], length[at]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.n += len(keys)

    def _learn(self, keys: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode new units, many to a string where their seams are sure boundaries."""
        data = np.frombuffer(raw, np.uint8)
        solid = (_CLASS & (_LETTER | _DIGIT | _MARK)) > 0
        plain = (ends - starts > 1) & (data[starts] == 32) & solid[data[np.minimum(starts + 1, len(data) - 1)]] & solid[data[ends - 1]]
        order = np.argsort(~plain, kind="stable")
        keys, starts, ends = keys[order], starts[order], ends[order]
        n, ids, lengths = int(plain.sum()), [], []
        for i in range(0, n, 1000):
            j = min(i + 1000, n)
            got = np.array(self.tokenizer.encode_batch_fast([b"".join([raw[s:e] for s, e in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            at = np.searchsorted(np.cumsum(self.bytes[got]), np.cumsum(ends[i:j] - starts[i:j])) + 1
            ids.append(got)
            lengths.append(np.diff(at, prepend=0))
        for i in range(n, len(keys), 5000):
            got = [e.ids for e in self.tokenizer.encode_batch_fast([raw[s:e].decode() for s, e in zip(starts[i : i + 5000].tolist(), ends[i : i + 5000].tolist(), strict=True)], add_special_tokens=False)]
            lengths.append(np.array([len(x) for x in got], np.int64))
            ids.append(np.array([x for y in got for x in y], np.uint32))
        length = np.concatenate(lengths)
        first = len(self.pool) + np.cumsum(length) - length
        self.pool = np.concatenate([self.pool, *ids])
        self._put(keys, first, length.astype(np.int32))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, concatenated, and the number of ids of each."""
        starts = cuts(data)
        starts[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(starts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        keys = span_hashes(data, starts, ends)
        if self.n > CACHE_UNITS:
            self.clear()
        at = self._find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, where = np.unique(keys[new], return_index=True)
            self._learn(fresh, data.tobytes(), starts[new[where]], ends[new[where]])
            at = self._find(keys)
        length = self.length[at]
        total = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        ids = self.pool[np.repeat(self.first[at] - total[:-1], length) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, offsets)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
