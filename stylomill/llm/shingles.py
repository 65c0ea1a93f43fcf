"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from stylomill.llm.common import BLOCK, FOLD, mix, span_hashes, word_hashes, word_spans

WORDS = 5
#: Bytes of text that are hashed together.
GROUP = 1 << 21
_STEP = np.uint64(0x9FB21C651E98DF25)
SHORT = np.uint64(0xC3A5C85C97CB3127)


def _chain(parts: list[np.ndarray]) -> np.ndarray:
    h = parts[0]
    for p in parts[1:]:
        h = h * _STEP + p
    return mix(h)


def _joint_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, and how many each has."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK):
            size += len(texts[to]) + 1
            to += 1
        if to == at + 1:
            hashes.append(word_hashes(texts[at]))
            counts[at] = len(hashes[-1])
        else:
            b = np.frombuffer(b"\n".join(texts[at:to]), np.uint8)
            start, end = word_spans(b)
            hashes.append(span_hashes(b, start, end))
            first = np.cumsum([0, *(len(t) + 1 for t in texts[at : to - 1])])
            counts[at:to] = np.diff(np.r_[np.searchsorted(start, first), len(start)])
        at = to
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; of fewer words, the whole sequence is the one shingle."""
    at = 0
    while at < len(texts):  # groups of bounded size
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= GROUP):
            size += len(texts[to])
            to += 1
        yield from _group_sets(texts[at:to], words)
        at = to


def _group_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    h, n = _joint_words([t.translate(FOLD) for t in texts])
    long = _chain([h[i : len(h) - words + 1 + i] for i in range(words)]) if len(h) >= words else h[:0]
    at = 0
    for k in n.tolist():
        if k >= words:
            s = np.sort(long[at : at + k - words + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]]
        elif k:
            yield _chain([np.full(1, SHORT + np.uint64(k)), *h[at : at + k].reshape(-1, 1)])
        else:
            yield h[:0]
        at += k


def signature(s: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()
