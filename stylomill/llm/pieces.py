"""Texts as sequences of pieces that tokenizers never merge across, and a cache of what each distinct piece encodes to.

A piece starts at a space or line feed that follows a character other than white space. Byte-level BPE splits there before
it merges; a BPE without such a split can't merge across if none of its entries holds a space or line feed after another
character, which its user checks. So the ids of a text are those of its pieces, one after the other.

Pieces of a batch are told apart in numpy: their first 16 bytes as two integers and their length are the key, exactly;
longer ones are numbered by a dictionary. Only distinct ones are looked up, and only those not seen before are encoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from stylomill.llm.bpe import ragged
from stylomill.llm.common import mix

#: Bytes that may start a piece.
STARTS = b" \n"
#: Texts are worked on in blocks of about so many bytes.
BLOCK = 1 << 22
#: Distinct pieces that a worker remembers before it forgets them all.
CACHE_PIECES = 1 << 21

_MAY_START = np.array([b in STARTS for b in range(256)])
_PLAIN = np.array([0x21 <= b <= 0x7E for b in range(256)])
# lead bytes of characters none of which is white space; those under C2, E1, E2 and E3 may be
_LEAD2 = np.array([0xC3 <= b <= 0xDF for b in range(256)])
_LEAD3 = np.array([b == 0xE0 or 0xE4 <= b <= 0xEF for b in range(256)])
_LEAD4 = np.array([0xF0 <= b <= 0xF7 for b in range(256)])
_MASK = np.array([(1 << 8 * min(k, 8)) - 1 for k in range(9)], np.uint64)


def cuts(b: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes, from 1, where a piece starts."""
    at = np.flatnonzero(_MAY_START[b[1:]]) + 1
    before = b[at - 1]
    ok = _PLAIN[before]
    wide = np.flatnonzero(before >= 0x80)
    if len(wide):
        p = at[wide]
        ok[wide] = _LEAD2[b[np.maximum(p - 2, 0)]] | (_LEAD3[b[np.maximum(p - 3, 0)]] & (p >= 3)) | (_LEAD4[b[np.maximum(p - 4, 0)]] & (p >= 4))
    return at[ok]


def blocks(text: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """text in blocks of about size, cut where a piece starts; a longer piece stays whole."""
    at, n = 0, len(text)
    while n - at > size:
        to, step = 0, size
        while not to and at + step < n:
            b = np.frombuffer(text[at : at + 2 * step], np.uint8)
            found = cuts(b)
            found = found[found >= size]
            to, step = (int(found[0]) if len(found) else 0), 2 * step
        if not to:
            break
        yield text[at : at + to]
        at += to
    if at < n:
        yield text[at:]


class Seen:
    """Distinct pieces and the ids of each. encode gives the ids of a list of pieces."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = CACHE_PIECES):
        self.encode, self.most = encode, most
        self._forget()

    def _forget(self) -> None:
        self.long: dict[bytes, int] = {}
        self.hash = np.zeros(0, np.uint64)
        self.key = np.zeros((0, 3), np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.flat, self.held = self.ids[0], 0

    def keys(self, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Three integers that tell pieces apart."""
        size = end - start
        padded = np.frombuffer(data + b"\0" * 16, np.uint8)
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        key = np.empty((len(start), 3), np.uint64)
        key[:, 0] = eight[start] & _MASK[np.minimum(size, 8)]
        key[:, 1] = eight[np.minimum(start + 8, len(eight) - 1)] & _MASK[np.clip(size - 8, 0, 8)]
        key[:, 2] = size
        for i in np.flatnonzero(size > 16).tolist():
            key[i, 0], key[i, 1] = self.long.setdefault(data[start[i] : end[i]], len(self.long)), 0
        return key

    def distinct(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hash of each key, the place of the first of each distinct one in order of hash, and for each key the number of its distinct one."""
        h = mix(key[:, 0] ^ mix(key[:, 1] + np.uint64(0x9E3779B97F4A7C15) * key[:, 2]))
        order = np.argsort(h, kind="stable")
        new = np.r_[True, np.diff(h[order]) != 0] if len(h) else np.zeros(0, bool)
        same = key[order[1:]] == key[order[:-1]]
        if len(h) and not same[~new[1:]].all():  # two keys of one hash
            order = np.lexsort((*key.T, h))
            new = np.r_[True, (np.diff(h[order]) != 0) | (key[order[1:]] != key[order[:-1]]).any(axis=1)]
        of = np.empty(len(h), np.int64)
        of[order] = np.cumsum(new) - 1
        return h, order[new], of

    def look_up(self, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in flat, and numbers, of the ids of each piece."""
        if len(self.hash) > self.most:
            self._forget()
        key = self.keys(data, start, end)
        h, first, of = self.distinct(key)
        hash_, key = h[first], key[first]
        at = np.minimum(np.searchsorted(self.hash, hash_), max(len(self.hash) - 1, 0))
        known = (self.hash[at] == hash_) & (self.key[at] == key).all(axis=1) if len(self.hash) else np.zeros(len(first), bool)
        begin, size = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        begin[known], size[known] = self.start[at[known]], self.size[at[known]]
        if not known.all():
            fresh = np.flatnonzero(~known)
            got = self.encode([data[a:b] for a, b in zip(start[first[fresh]].tolist(), end[first[fresh]].tolist())])
            n = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((i for x in got for i in x), np.int32, int(n.sum()))
            begin[fresh], size[fresh] = self.held + np.cumsum(n) - n, n
            self.held += len(flat)
            self.ids.append(flat)
            to = np.searchsorted(self.hash, hash_[fresh])  # of keys of one hash either may be found; the other is encoded again
            self.hash = np.insert(self.hash, to, hash_[fresh])
            self.key = np.insert(self.key, to, key[fresh], axis=0)
            self.start, self.size = np.insert(self.start, to, begin[fresh]), np.insert(self.size, to, n)
        return begin[of], size[of]

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts, one after the other, and how many each has."""
        ids, n = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for data, start, end, owner in spans(texts):
            begin, size = self.look_up(data, start, end)
            if len(self.ids) > 1:
                grown = np.empty(max(self.held, 0), np.int32)
                np.concatenate(self.ids, out=grown)
                self.ids, self.flat = [grown], grown
            ids.append(self.flat[ragged(begin, size)])
            n += np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)
        return np.concatenate(ids), n


def spans(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined in blocks: bytes, start and end of each piece, and the text that it belongs to."""
    held, of, size = [], [], 0

    def made() -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        data = b"".join(held)
        b = np.frombuffer(data, np.uint8)
        edge = np.cumsum([len(x) for x in held])
        start = np.zeros(len(b) + 1, bool)
        start[cuts(b)] = True
        start[np.r_[0, edge[:-1]]] = True
        start = np.flatnonzero(start)
        return data, start, np.r_[start[1:], len(b)], np.array(of, np.int64)[np.searchsorted(edge, start, side="right")]

    for i, t in enumerate(texts):
        for x in blocks(t) if len(t) > BLOCK else [t] if t else []:
            held.append(x)
            of.append(i)
            size += len(x)
            if size >= BLOCK:
                yield made()
                held, of, size = [], [], 0
    if held:
        yield made()
