"""Shared pieces of the llm operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stylomill.session import broadcast_if_small, stored
from stylomill.workers import trim, trimmed  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
#: ASCII-only case folding on UTF-8 bytes, and the table of white-space bytes.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IS_SPACE = np.array([chr(b) in SPACE for b in range(256)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case and nothing else; lower() has a fast path for ASCII and agrees with this there."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def crc32_of_id(c: Column) -> Column:
    """crc32 of an id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def unused(name: str, columns: Iterable[str]) -> str:
    """A column name that none of columns bears, whatever its case."""
    taken, out = {c.lower() for c in columns}, f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out


def one_of_each(df: DataFrame, key: str) -> DataFrame:
    """One row for each value of key, the same one in each run. Keys are counted apart from the rows, and only rows of keys that repeat are numbered, so most rows aren't shuffled."""
    other, nth = unused("key", df.columns), unused("nth", df.columns)
    counts = df.groupBy(F.col(key).alias(other)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(other)
    twice = broadcast_if_small(stored(counts, "repeated-rows"))
    same = F.col(key).eqNullSafe(F.col(other))
    order = F.xxhash64(*(c for c, t in df.dtypes if "map<" not in t))
    several = df.join(twice, same, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return df.join(twice, same, "left_anti").unionByName(several.where(F.col(nth) == 1).drop(nth))


_ODD = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1
_INV = pow(_ODD, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {}


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    got = _pow.get(kind)
    if got is None or len(got) < n:
        m = 1 << max(12, (n - 1).bit_length())
        got = np.empty(m, np.uint64)
        got[0] = 1
        k = 1
        step = base
        while k < m:  # doubling: powers k..2k-1 are those below k times base**k
            got[k : 2 * k] = got[:k] * np.uint64(step)
            step = step * step & _M
            k *= 2
        _pow[kind] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, elementwise."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A block this long keeps the temporaries of word_hashes() at some MB, however long the text is.
BLOCK = 1 << 19


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that aren't white space."""
    solid = np.zeros(len(b) + 2, np.int8)
    solid[1:-1] = ~IS_SPACE[b]
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: differences of prefix sums of a polynomial, moved back to the origin and mixed with the length."""
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((_MIX8[b] * _powers("up", _ODD, len(b))), out=total[1:])
    h = (total[end] - total[start]) * _powers("down", _INV, len(b) + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_MIX8 = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def blocks(data: bytes, size: int = BLOCK):
    """data in pieces of about this size, cut only before white space; a word longer than a piece stays whole."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + size)
        while to < n and data[to] not in b" \t\n\x0b\x0c\r":
            to += 1
        yield data[at:to]
        at = to


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of all words of a UTF-8 text, in order."""
    out = []
    for piece in blocks(data):
        b = np.frombuffer(piece, np.uint8)
        out.append(span_hashes(b, *word_spans(b)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def text_bytes(column) -> list[bytes]:
    """A column of Arrow strings as UTF-8; null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Rows of a batch whose texts are taken out of Arrow together.
SLICE_ROWS = 1024


def text_slices(batches: Iterator, column: int, size: int = 2 << 20) -> Iterator[tuple]:
    """Slices of Arrow batches that hold about size bytes of text, and their texts."""
    for whole in batches:
        for lo in range(0, whole.num_rows, SLICE_ROWS):
            b = whole.slice(lo, SLICE_ROWS)
            texts, at, held = text_bytes(b.column(column)), 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held >= size:
                    yield b.slice(at, i + 1 - at), texts[at : i + 1]
                    at, held = i + 1, 0
            if at < len(texts):
                yield b.slice(at), texts[at:]
