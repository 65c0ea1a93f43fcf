"""Media columns: content-defined chunks, stored once, and payloads put together again from ordered chunk lists.

A payload is the text's UTF-8, padded with bytes 0 to a positive multiple of 64. A rolling gear hash over the last 32
bytes cuts it where its upper bits are zero, so equal passages of different payloads give equal chunks wherever they
stand. What is stored of a payload is a row: its digest and length, and the ordered list of its chunks, each with SHA-256
digest, length and, unless another place has them, its bytes. A chunk that several payloads share has its bytes with the
one of the smallest digest, one that a payload repeats at its first place. A payload that several ids have is stored once
(rows that repeat the id, too, or have none, store it again). Rows are written as Parquet to the shared folder. Reading
joins references with the chunks they name, puts each payload together in order and verifies its length and SHA-256;
what doesn't match raises an error. media_bytes and media_sha256 are those of the recipe as it is stored, a binary column:
digest and length of each chunk in order, without the chunks' bytes, a payload's own form whatever others share with it.

Only digests are shuffled to find shared chunks; of the chunks' bytes, those that are referred to travel.

Defined cases. A null text is empty; an empty text's payload is 64 bytes 0. Rows that repeat a text, or an id, each get
their row. An empty table gives empty tables. Of the input's columns only those named are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylomill.llm.common import mix, table, text_slices, trimmed
from stylomill.session import broadcast_if_small, shared_path, ship_package, stored

UNIT = 64
MIN_CHUNK, AVG_BITS, MAX_CHUNK = 512, 10, 8192
WINDOW = 32  # bytes that a 32-bit gear hash depends on
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
#: Bytes hashed at a time: bounds memory for payloads of any length.
BLOCK = 1 << 22


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def gear_hashes(b: np.ndarray) -> np.ndarray:
    """The rolling gear hash h = (h << 1) + GEAR[byte] after each byte; the sum over a window is made by doubling."""
    h, k = GEAR[b], 1
    while k < WINDOW:
        s = h.copy()
        s[k:] += h[:-k] << np.uint32(k)
        h, k = s, 2 * k
    return h


def cuts(data: bytes, min_chunk: int = MIN_CHUNK, bits: int = AVG_BITS, max_chunk: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of data."""
    n, found = len(data), []
    for at in range(0, n, BLOCK):
        lo = max(0, at - WINDOW)
        h = gear_hashes(np.frombuffer(data, np.uint8, min(n, at + BLOCK) - lo, lo))[at - lo :]
        found.append(np.flatnonzero(h >> np.uint32(32 - bits) == 0) + at + 1)
    places = np.concatenate(found) if found else np.zeros(0, np.int64)
    ends, start = [], 0
    while start < n:
        k = np.searchsorted(places, start + min_chunk)
        end = min(int(places[k]) if k < len(places) else n, start + max_chunk, n)
        ends.append(end)
        start = end
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def recipe_bytes(parts: list[tuple[bytes, int]]) -> bytes:
    """The stored form of a payload: digest and little-endian length of each chunk, in order."""
    return b"".join(sha + n.to_bytes(4, "little") for sha, n in parts)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, sha, chunks): the text's digest and its chunks' digests, without bytes."""
    for b, texts in text_slices(batches, 1):
        digests = [[hashlib.sha256(c).digest() for c in chunks(pad(t))] for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(digests, pa.list_(pa.binary()))], ["id", "sha", "chunks"])


STORED = "sha binary, n_bytes long, recipe binary, n_foreign int, n_lent int, chunks array<struct<sha:binary,len:int,lent:boolean,own:binary>>"
_CHUNK = pa.struct([("sha", pa.binary()), ("len", pa.int32()), ("lent", pa.bool_()), ("own", pa.binary())])


def _stored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, foreign, lent) to stored rows: a chunk has its bytes unless it is stored elsewhere or earlier in the list."""
    for b, texts in text_slices(batches, 0):
        rows: list[list] = [[], [], [], [], [], []]
        for text, foreign, lent in zip(texts, b.column(1).to_pylist(), b.column(2).to_pylist()):
            foreign, lent, seen, out = set(foreign or ()), set(lent or ()), set(), []
            for c in chunks(pad(text)):
                d = hashlib.sha256(c).digest()
                out.append({"sha": d, "len": len(c), "lent": d in lent and d not in seen, "own": None if d in foreign or d in seen else c})
                seen.add(d)
            recipe = recipe_bytes([(c["sha"], c["len"]) for c in out])
            for col, x in zip(rows, (hashlib.sha256(text).digest(), len(text), recipe, len(foreign), len(lent), out)):
                col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.list_(_CHUNK)))], ["sha", "n_bytes", "recipe", "n_foreign", "n_lent", "chunks"])


def assemble(sha: bytes, n_bytes: int, parts: list[dict], fetched: dict[bytes, bytes]) -> bytes:
    """The payload of a stored row; parts without bytes are taken from fetched or an earlier part. Verified."""
    held, out = dict(fetched), []
    for p in parts:
        if p["own"] is not None:
            held[p["sha"]] = p["own"]
        out.append(held[p["sha"]])
        if len(out[-1]) != p["len"] or hashlib.sha256(out[-1]).digest() != p["sha"]:
            raise ValueError(f"chunk {p['sha'].hex()} is damaged")
    payload = b"".join(out)
    if len(payload) % UNIT or not payload or hashlib.sha256(payload[:n_bytes]).digest() != sha:
        raise ValueError(f"payload {sha.hex()} is damaged")
    return payload


def feature(payload: bytes, n_chunks: int) -> str:
    """Features of the samples read back: chunks, sum of samples, largest sample, distinct samples."""
    b = np.frombuffer(payload, np.uint8)
    return f"chunks={n_chunks};sum={int(b.sum(dtype=np.int64))};max={int(b.max())};distinct={len(np.unique(b))}"


def _sized(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches whose second column is a payload's length, cut to about size bytes of payloads."""
    for b in batches:
        upto = np.cumsum(b.column(1).to_numpy())
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size)))
            yield b.slice(at, to - at)
            at = to


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored rows and what was fetched for them to payloads."""
    for b in _sized(batches):
        rows: list[list] = [[], [], [], [], []]
        for sha, n, recipe, parts, fetched in zip(*(b.column(i).to_pylist() for i in range(5))):
            payload = assemble(sha, n, parts, {x["chunk"]: x["own"] for x in fetched or ()})
            if recipe != recipe_bytes([(p["sha"], p["len"]) for p in parts]):
                raise ValueError(f"recipe of {sha.hex()} is damaged")
            for col, x in zip(rows, (sha, n, payload, recipe, len(parts))):
                col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32()))], ["sha", "n_bytes", "payload", "recipe", "n_chunks"])


def store(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Store df's texts. Returns (refs, media): (id, sha) for each row, and the stored payloads, one for each distinct text."""
    ship_package(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    listed = stored(docs.mapInArrow(trimmed(_listed), f"id {id_type}, sha binary, chunks array<binary>"), "chunk-lists")
    copies = listed.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keeper")).where("n > 1")
    held = listed.select("sha", F.explode(F.array_distinct("chunks")).alias("chunk"))
    shared = held.groupBy("chunk").agg(F.min("sha").alias("owner"), F.max("sha").alias("last")).where("owner < last")
    by_text = held.dropDuplicates().join(shared, "chunk").groupBy("sha").agg(
        F.collect_list(F.when(F.col("sha") != F.col("owner"), F.col("chunk"))).alias("foreign"),
        F.collect_list(F.when(F.col("sha") == F.col("owner"), F.col("chunk"))).alias("lent"),
    )
    special = by_text.join(copies, "sha", "full").select("sha", "foreign", "lent", "keeper", F.col("n").isNotNull().alias("copied"))
    special = broadcast_if_small(stored(special, "shared-chunks"))
    first = ~F.coalesce("copied", F.lit(False)) | F.col("id").eqNullSafe(F.col("keeper"))
    digest = F.unhex(F.sha2("text", 256))
    rows = docs.withColumn("sha", digest).join(special, "sha", "left").where(first).select("text", "foreign", "lent")
    path = shared_path(df.sparkSession, "media")
    rows.mapInArrow(trimmed(_stored_rows), STORED).write.option("compression", "zstd").parquet(path)
    return listed.select("id", "sha"), df.sparkSession.read.schema(STORED).parquet(path)


def _joined(media: DataFrame) -> DataFrame:
    """(sha, n_bytes, recipe, chunks, fetched): stored rows with the chunks that they refer to."""
    lent = media.where("n_lent > 0").select(F.explode("chunks").alias("c")).where("c.lent").select(F.col("c.sha").alias("chunk"), F.col("c.own").alias("own"))
    borrowing = media.where("n_foreign > 0")
    refs = borrowing.select("sha", F.explode("chunks").alias("c")).where("c.own IS NULL").select("sha", F.col("c.sha").alias("chunk"))
    fetched = refs.dropDuplicates().join(lent.dropDuplicates(["chunk"]), "chunk").groupBy("sha").agg(F.collect_list(F.struct("chunk", "own")).alias("fetched"))
    whole = media.where("n_foreign = 0").withColumn("fetched", F.lit(None).cast("array<struct<chunk:binary,own:binary>>"))
    rows = whole.unionByName(borrowing.join(fetched, "sha", "left"))
    return rows.select("sha", "n_bytes", "recipe", "chunks", "fetched")


def load(media: DataFrame) -> DataFrame:
    """(sha, n_bytes, payload, recipe, n_chunks): the stored payloads, put together again and verified, and their recipes as stored."""
    return _joined(media).mapInArrow(trimmed(_rebuilt), "sha binary, n_bytes long, payload binary, recipe binary, n_chunks int")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _sized(batches):
        rows = []
        for sha, n, payload, form, n_chunks in zip(*(b.column(i).to_pylist() for i in range(5))):
            rows.append((sha, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(form), hashlib.sha256(form).hexdigest(), feature(payload, n_chunks)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 8, _FEATURE_TYPES)], _FEATURE_NAMES)


def _read_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored rows to features in one worker: payloads that are put together again don't travel."""
    return _features(_rebuilt(batches))


_FEATURE_NAMES = ["sha", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_FEATURE_TYPES = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the digests and features of its payload as read back from the chunk store."""
    refs, media = store(table(spark, sf_dir, "documents"))
    read = _joined(media).mapInArrow(trimmed(_read_features), "sha binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    # rows that repeat id and text are stored more than once
    return refs.join(read.dropDuplicates(["sha"]), "sha").select(F.col("id").alias("doc_id"), *_FEATURE_NAMES[1:])
