"""Exact deduplication of texts by counting quotient filters.

Each partition counts the 64-bit fingerprints of its texts in a counting quotient filter. Filters are cut into ranges
of fingerprints; the pieces of one range meet in one task and merge losslessly, as both hold their remainders in sorted
order. Only fingerprints counted more than once send their rows on to a comparison of whole texts.

Defined cases. A null text counts as empty, so null and empty texts are equal. A null id is smaller than any other. Of
rows that repeat both id and text, one stays. An empty table gives an empty result. Input columns that bear the name of
an output column are replaced by it; any other column is kept as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stylomill.llm.common import table, trimmed, unused
from stylomill.session import broadcast_if_small, ship_package, stored

#: Fingerprints that one task's filter holds, so that a task's memory doesn't depend on the input.
RANGE_ROWS = 1 << 20
MAX_RANGES = 1 << 16


class CountingQuotientFilter:
    """Multiset of 64-bit fingerprints, kept as quotient (a slot's home) and remainder (what the slot holds).

    A fingerprint's home is its upper q bits. Runs of one home are sorted by remainder and shifted right past slots in
    use. `occupied` marks homes that have a run, `runend` marks each run's last slot; both together give a remainder
    its quotient back, so nothing is lost and filters of different q can merge.
    """

    def __init__(self, q: int, occupied: np.ndarray, runend: np.ndarray, used: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q, self.occupied, self.runend, self.used, self.remainders, self.counts = q, occupied, runend, used, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        fp = np.asarray(fingerprints, np.uint64)
        counts = np.ones(len(fp), np.int64) if counts is None else np.asarray(counts, np.int64)
        order = np.argsort(fp, kind="stable")
        fp, counts = fp[order], counts[order]
        first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]]) if len(fp) else np.zeros(0, np.int64)
        return cls._of_sorted(fp[first], np.add.reduceat(counts, first) if len(fp) else counts)

    @classmethod
    def _of_sorted(cls, fp: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        q = max(3, int(np.ceil(np.log2(len(fp) / 0.75 + 1))))
        r = np.uint64(64 - q)
        home = (fp >> r).astype(np.int64)
        k = np.arange(len(fp))
        slot = np.maximum.accumulate(home - k) + k if len(fp) else home
        n = max(1 << q, int(slot[-1]) + 1 if len(fp) else 0)
        occupied, runend, used = np.zeros(1 << q, bool), np.zeros(n, bool), np.zeros(n, bool)
        occupied[home] = True
        if len(fp):
            runend[slot[np.r_[home[1:] != home[:-1], True]]] = True
        used[slot] = True
        remainders, held = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        remainders[slot], held[slot] = fp & ((np.uint64(1) << r) - np.uint64(1)), counts
        return cls(q, occupied, runend, used, remainders, held)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in ascending order and their counts."""
        slots = np.flatnonzero(self.used)
        ends = self.runend[slots]
        run = np.cumsum(ends) - ends  # the k-th run belongs to the k-th occupied home
        home = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        return (home << np.uint64(64 - self.q)) | self.remainders[slots], self.counts[slots]

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter of all counts. Two by two, as both lists of fingerprints are sorted: each one's places in the other are found, nothing is sorted anew."""
        parts = [f.items() for f in filters] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        while len(parts) > 1:
            parts = [_merged(*parts[i], *parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return cls._of_sorted(*parts[0])

    def dump(self) -> bytes:
        used = np.flatnonzero(self.used)
        head = np.array([self.q, len(self.runend), len(used)], np.int64).tobytes()
        return head + np.packbits(self.occupied).tobytes() + np.packbits(self.runend).tobytes() + np.packbits(self.used).tobytes() + self.remainders[used].tobytes() + self.counts[used].tobytes()

    @classmethod
    def load(cls, data: bytes) -> CountingQuotientFilter:
        q, n, m = np.frombuffer(data, np.int64, 3)
        at, bits = 24, []
        for size in (1 << int(q), int(n), int(n)):
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
            at += (size + 7) // 8
        used = np.flatnonzero(bits[2])
        remainders, counts = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        remainders[used] = np.frombuffer(data, np.uint64, int(m), at)
        counts[used] = np.frombuffer(data, np.int64, int(m), at + 8 * int(m))
        return cls(int(q), *bits, remainders, counts)


def _merged(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of distinct fingerprints with counts as one."""
    at = np.searchsorted(a, b)
    same = np.zeros(len(b), bool)
    inside = at < len(a)
    same[inside] = a[at[inside]] == b[inside]
    n = n.copy()
    n[at[same]] += m[same]
    at, b, m = at[~same], b[~same], m[~same]
    place = at + np.arange(len(b))
    of_a = np.ones(len(a) + len(b), bool)
    of_a[place] = False
    fp, counts = np.empty(len(of_a), np.uint64), np.empty(len(of_a), np.int64)
    fp[of_a], counts[of_a], fp[place], counts[place] = a, n, b, m
    return fp, counts


def _build(ranges: int, rows: int):
    """Arrow batches of fingerprints to one filter for each range of fingerprints."""

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fp = np.sort(np.concatenate(parts))
        part = ((fp >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)  # ascending, as fp is
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for lo, hi in zip(at, np.r_[at[1:], len(fp)]):
            yield pa.RecordBatch.from_arrays([pa.array([int(part[lo])], pa.int32()), pa.array([CountingQuotientFilter.build(fp[lo:hi]).dump()], pa.binary())], ["part", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            if b.num_rows:
                parts.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                n += b.num_rows
            if n >= rows:
                yield from flush(parts)
                parts, n = [], 0
        if n:
            yield from flush(parts)

    return run


def _merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    fp, counts = CountingQuotientFilter.merge([CountingQuotientFilter.load(x) for x in pdf["filter"]]).items()
    many = counts > 1
    return pd.DataFrame({"fp": fp[many].view(np.int64), "n": counts[many]})


def repeated_fingerprints(df: DataFrame, fp: str, ranges: int | None = None) -> DataFrame:
    """(fp, n): the fingerprints that occur more than once, and how often."""
    ship_package(df.sparkSession)
    if ranges is None:  # of a scan, a count reads only Parquet footers
        ranges = int(min(MAX_RANGES, max(8, -(-df.count() // RANGE_ROWS))))
    filters = df.select(fp).mapInArrow(trimmed(_build(ranges, 4 * RANGE_ROWS)), "part int, filter binary")
    return filters.groupBy("part").applyInPandas(_merge, "fp long, n long")


def mark_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", fingerprint: Column | None = None) -> DataFrame:
    """df with keep_id, group_size, kept and text_sha256; see the module's docstring for the cases.

    fingerprint replaces the 64-bit hash of the text; texts of one fingerprint are still told apart.
    """
    made = ("keep_id", "group_size", "kept", "text_sha256")
    out = df.drop(*made)
    fp, whole_text, sha, keeper, size, again = (unused(n, [*out.columns, *made]) for n in ("fp", "text", "sha", "keeper", "size", "again"))
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = out.withColumns({fp: F.xxhash64(whole) if fingerprint is None else fingerprint, "text_sha256": F.sha2(whole, 256)})
    # stored, so that its size is known: a small one goes to all tasks, and whole texts aren't shuffled to find the suspects
    repeated = broadcast_if_small(stored(repeated_fingerprints(docs, fp).select(F.col("fp").alias(fp)), "repeated"))
    suspects = docs.join(repeated, fp, "left_semi")
    # whole texts are compared: the text is part of the key, and each task sums up its copies before the shuffle
    equal = suspects.groupBy(F.col("text_sha256").alias(sha), whole.alias(whole_text)).agg(F.max(id_col).alias(keeper), F.count(F.lit(1)).alias(size))
    groups = equal.groupBy(sha).agg(F.first(keeper).alias(keeper), F.first(size).alias(size), F.count(F.lit(1)).alias("n")).where(f"{size} > 1")
    groups = groups.withColumn(size, F.when(F.col("n") == 1, F.col(size)).otherwise(F.raise_error(F.lit("two texts of one SHA-256")).cast("long"))).drop("n")
    found = docs.drop(fp).join(broadcast_if_small(stored(groups, "copies")), F.col("text_sha256") == F.col(sha), "left")
    found = found.withColumns({"keep_id": F.when(F.col(size).isNull(), F.col(id_col)).otherwise(F.col(keeper)), "group_size": F.coalesce(size, F.lit(1)).cast("long")})
    stays = F.col(id_col).eqNullSafe(F.col("keep_id"))
    # rows that repeat id and text: few, and only these are numbered, so that one of them stays
    twice = suspects.groupBy(F.col(id_col).alias(again), F.col("text_sha256").alias(sha)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(again, sha)
    twice = broadcast_if_small(stored(twice, "repeated-rows"))
    same = F.col(id_col).eqNullSafe(F.col(again)) & (F.col("text_sha256") == F.col(sha))
    order = F.xxhash64(*(c for c, t in out.dtypes if "map<" not in t))  # the same row stays in each run
    nth = F.row_number().over(Window.partitionBy("text_sha256", id_col).orderBy(order))
    found = found.drop(sha)
    once = found.join(twice, same, "left_anti").withColumn("kept", stays)
    several = found.join(twice, same, "left_semi").withColumn("kept", stays & (nth == 1))
    return once.unionByName(several).select(*out.columns, *made)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: which copy of its text stays."""
    return mark_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
