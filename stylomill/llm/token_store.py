"""Token ids in binary files, with document boundaries in Elias-Fano code.

Documents are cut into ranges of their ids and sorted there; each task encodes its documents and packs them into segments
of about `SEGMENT_IDS` token ids, a file each. Spark's own committer puts the files in place, so a lost task's are written
anew and half-written ones are never seen. A segment (all numbers little-endian) is

    EFID, version, bytes of an id, part, segment, documents, documents without an id, token ids, least id, crc32   header
    token ids of 2 or 4 bytes, one document after the other, each with its end id                                  ids
    where documents end, as Elias-Fano code                                                                        ends
    document ids above the least one, as Elias-Fano code                                                           names
    EFID                                                                                                           trailer

Elias-Fano code of n rising numbers up to u keeps the lower log2(u / n) bits of each in a packed array, and the rest as ones
in a bit vector: the i-th one stands at the upper part plus i. Every 64th one's place is kept in 32 bits, so select(i) looks
at a few bytes. That is about 2 + log2(u / n) bits a document where a table of offsets takes 64. Numbers count from the
segment's start; the 64-bit starts of segments are in the manifest, one row a file, written last: without it, there is no store.

Defined cases. A null text is empty: its end id only. Documents without an id come first; rows that repeat an id are
ordered by the hash of their text and may lie in several segments. Texts of any length lie whole in one segment, which then
is longer. An empty table gives a store without segments. Of the input's columns only the id and the text matter; ids must
be whole numbers.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stylomill.llm.bpe import byte_chars
from stylomill.llm.common import table, text_slices, trimmed, unused
from stylomill.llm.pieces import Seen
from stylomill.session import broadcast_if_small, shared_path, ship_package, stored

MAGIC, VERSION = b"EFID", 1
HEADER = struct.Struct("<4sHHIIQQQqI4x")
SEGMENT_IDS, END_ID, SAMPLE, BLOCK_BITS = 4 << 20, 2, 64, 12
#: Fixed value: the public pattern by which byte-level BPE of this kind splits text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# --- Elias-Fano code


def _padded(parts: list[bytes]) -> bytes:
    data = b"".join(parts)
    return data + b"\0" * (-len(data) % 8)


def ef_pack(values: np.ndarray) -> bytes:
    """Code of rising unsigned 64-bit numbers."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    upper = (values >> np.uint64(low_bits)).astype(np.int64)
    ones = upper + np.arange(n)
    bits = np.zeros((top >> low_bits) + n + 1, np.uint8)
    bits[ones] = 1
    low = []
    for at in range(0, n if low_bits else 0, 1 << 16):  # whole bytes, whatever low_bits is
        v = values[at : at + (1 << 16)]
        low.append(np.packbits((v[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes())
    high, samples = np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes()
    lower = b"".join(low)
    return _padded([struct.pack("<QIIQ", n, low_bits, len(samples), len(lower)), struct.pack("<Q", len(high)), samples, lower, high])


class EliasFano:
    """Numbers in Elias-Fano code, within a larger buffer."""

    def __init__(self, data: memoryview, at: int = 0):
        self.n, self.low_bits, samples, low = struct.unpack_from("<QIIQ", data, at)
        (high,) = struct.unpack_from("<Q", data, at + 24)
        at += 32
        self.samples = np.frombuffer(data, "<u4", samples // 4, at)
        self.low = np.frombuffer(data, np.uint8, low, at + samples)
        self.high = np.frombuffer(data, np.uint8, high, at + samples + low)
        self.end = at + -(-(samples + low + high) // 8) * 8

    def all(self) -> np.ndarray:
        upper = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        out = upper.astype(np.uint64) << np.uint64(self.low_bits)
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        for at in range(0, self.n if self.low_bits else 0, 1 << 16):
            k = min(1 << 16, self.n - at)
            bits = np.unpackbits(self.low[at * self.low_bits // 8 :][: -(-k * self.low_bits // 8)], bitorder="little", count=k * self.low_bits)
            out[at : at + k] |= (bits.reshape(k, self.low_bits) * weights).sum(axis=1, dtype=np.uint64)
        return out

    def select(self, i: int) -> int:
        """The i-th number: the nearest sampled one before it, then the ones of a few bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place // 8
        word = int(self.high[byte]) >> place % 8 << place % 8
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        upper = byte * 8 + (word & -word).bit_length() - 1 - i
        at = i * self.low_bits
        near = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8].tobytes(), "little")
        return upper << self.low_bits | near >> at % 8 & (1 << self.low_bits) - 1


# --- segments


def pack_segment(part: int, seq: int, width: int, nulls: int, names: np.ndarray, size: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment without its trailer. names: int64 ids in order, of the documents that have one."""
    least = int(names[0]) if len(names) else 0
    body = _padded([np.ascontiguousarray(ids, f"<u{width}").tobytes()]) + ef_pack(np.cumsum(size).astype(np.uint64)) + ef_pack((names.astype(np.int64) - np.int64(least)).view(np.uint64) if len(names) else names.astype(np.uint64))
    return HEADER.pack(MAGIC, VERSION, width, part, seq, len(size), nulls, len(ids), least, zlib.crc32(body)) + body


class Segment:
    """A segment's parts, read where they lie."""

    def __init__(self, data: bytes, verify: bool = True):
        magic, version, self.width, self.part, self.seq, self.docs, self.nulls, self.n, self.least, crc = HEADER.unpack_from(data, 0)
        if magic != MAGIC or version != VERSION or data[-4:] != MAGIC:
            raise ValueError("not a whole segment")
        if verify and zlib.crc32(memoryview(data)[HEADER.size : -4]) != crc:
            raise ValueError("a segment was changed")
        view = memoryview(data)
        self.ids = np.frombuffer(view, f"<u{self.width}", self.n, HEADER.size)
        self.ends = EliasFano(view, HEADER.size + -(-self.n * self.width // 8) * 8)
        self.names = EliasFano(view, self.ends.end)

    def bounds(self, i: int) -> tuple[int, int]:
        """Where the i-th document's ids start and end."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def doc_ids(self) -> list[int | None]:
        named = self.names.all().view(np.int64) + np.int64(self.least)
        return [None] * self.nulls + named.tolist()


# --- encoding


class Encoder:
    """Ids as the tokenizers library gives them without special tokens added, for a byte-level BPE file.

    Only distinct pieces of text are encoded: pieces of Latin letters, digits and signs by tiktoken with the same entries and
    pattern, which is some times faster; those with other characters or a special token's string by the library itself.
    """

    def __init__(self, spec: str, special: bool = True):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        d = json.loads(spec)
        model, pre = d["model"], d["pre_tokenizer"] or {}
        if d["normalizer"] or model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("not a byte-level BPE vocabulary that splits text by the public pattern")
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        self.library = Tokenizer.from_str(spec)
        self.library.no_padding(), self.library.no_truncation()
        self.library.encode_special_tokens = not special
        self.special = [a["content"].encode() for a in d["added_tokens"]]
        names = {a["content"] for a in d["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in model["vocab"].items() if t not in names}
        made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        plain = made == sorted(made) and len(self.bytes_of) == 256 + len(made)  # an entry's number is its rank, as tiktoken has it
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={v: k for k, v in self.bytes_of.items()}, special_tokens={}) if plain else None
        self.width = 2 if max(self.bytes_of) < 1 << 16 else 4
        self.seen = Seen(self.encode)
        self.batch = self.seen.encode_batch

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            s = p.decode("utf-8", "replace")
            if self.fast and (s.isascii() or max(s) < "ɐ") and not any(x in p for x in self.special):
                out[i] = self.fast.encode_ordinary(s)
            else:
                rest.append((i, s))
        if rest:
            for (i, _), e in zip(rest, self.library.encode_batch([s for _, s in rest], add_special_tokens=False)):
                out[i] = e.ids
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(spec: str, special: bool = True) -> Encoder:
    """The encoder of a file's content, one for each worker process."""
    key = (zlib.crc32(spec.encode()), len(spec), special)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec, special)
    return _encoders[key]


def forget() -> None:
    """Let go what encoder() keeps."""
    _encoders.clear()


def vocabulary(spark: SparkSession, path: str | None = None, name: str = "byte_bpe_50k.json"):
    """A vocabulary file's content for all workers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


# --- the store


def write(df: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", vocabulary_path: str | None = None, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Write df's texts as token ids below path: segments, then the manifest."""
    spark = df.sparkSession
    ship_package(spark)
    spec = vocabulary(spark, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e = encoder(spec.value.decode())
        part, seq, held, parts, sizes, names = TaskContext.get().partitionId(), 0, 0, [], [], []

        def made() -> pa.RecordBatch:
            named = pa.chunked_array(names)
            whole = named.drop_null().to_numpy().astype(np.int64)
            data = pack_segment(part, seq, e.width, named.null_count, whole, np.concatenate(sizes), np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["segment"])

        for b, texts in text_slices(batches, 1, min(2 << 20, 2 * segment_ids)):
            flat, n = e.batch(texts)
            ends = np.cumsum(n)
            flat = np.insert(flat, ends, end_id).astype(f"<u{e.width}")
            n = n + 1
            parts.append(flat)
            sizes.append(n)
            names.append(b.column(0).cast(pa.int64()))
            held += len(flat)
            if held >= segment_ids:
                yield made()
                seq, held, parts, sizes, names = seq + 1, 0, [], [], []
        if parts:
            yield made()

    tie, salt = "tie", "salt"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns({tie: F.xxhash64("text"), salt: F.rand(7)})
    dealt = rows.repartitionByRange(F.col("id").asc_nulls_first(), tie, salt).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)  # repeated rows go to several tasks
    made = dealt.select("id", "text").mapInArrow(trimmed(run), "segment binary")
    # the writer of text puts a string's bytes as they are, and the separator behind each row
    made.select(F.col("segment").cast("string")).write.option("lineSep", MAGIC.decode()).option("maxRecordsPerFile", 1).text(f"{path}/segments")
    heads = stored(_files(spark, path).mapInArrow(trimmed(_heads), "part long, seq long, docs long, ids long, bytes long, name string"), "segments")
    per = heads.groupBy("part").agg(F.sum("ids").alias("n"), F.sum("docs").alias("d"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that wrote
    per = per.select(F.col("part").alias("of"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b{c}") for c in "nd"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, b: (F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(b)).alias(f"first_{c}")
    heads.join(per, F.col("part") == F.col("of")).select("name", "part", "seq", "docs", "ids", "bytes", upto("ids", "bn"), upto("docs", "bd")).write.parquet(f"{path}/manifest")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/segments").select("path", "content")


def _each(batches: Iterator[pa.RecordBatch], column: str = "content") -> Iterator[tuple[pa.RecordBatch, int, Segment]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b, i, Segment(b.column(b.schema.get_field_index(column))[i].as_py())


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the manifest says of each segment, once its checksum holds."""
    for b, i, s in _each(batches):
        row = {"part": s.part, "seq": s.seq, "docs": s.docs, "ids": s.n, "bytes": len(b.column(1)[i].as_buffer()), "name": b.column(0)[i].as_py().rsplit("/", 1)[-1]}
        yield pa.RecordBatch.from_pylist([row])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, part, seq, docs, ids, bytes, first_ids, first_docs): a row for each segment, with the token ids and documents before it."""
    return spark.read.parquet(f"{path}/manifest")


def _placed(found: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    starts = manifest(spark, path).select(F.col("part").alias("p"), F.col("seq").alias("s"), "first_ids", "first_docs")
    return found.join(broadcast_if_small(starts), (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")))


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, place, start, n_tokens, ids_crc32) of each document, read from the segments, and its ids if they are asked for.

    place is the number of documents before it, start that of token ids; the checksum is that of the ids as unsigned
    32-bit little-endian numbers.
    """
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, s in _each(batches):
            ends = s.ends.all().astype(np.int64)
            names = s.doc_ids()
            for lo in range(0, s.docs, 1 << 12):
                e = ends[lo : lo + (1 << 12)]
                a = np.r_[ends[lo - 1] if lo else 0, e[:-1]]
                wide = s.ids[a[0] : e[-1]].astype("<u4")
                crc = [zlib.crc32(wide[x - a[0] : y - a[0]]) for x, y in zip(a.tolist(), e.tolist())]
                k = len(e)
                columns = [pa.array(np.full(k, s.part)), pa.array(np.full(k, s.seq)), pa.array(np.arange(lo, lo + k)), pa.array(names[lo : lo + k], pa.int64()), pa.array(a), pa.array(e - a), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[a, e[-1]].astype(np.int32) - np.int32(a[0])), pa.array(wide.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "nth", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    found = _files(spark, path).mapInArrow(trimmed(run), "part long, seq long, nth long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    return _placed(found, spark, path).select("doc_id", (F.col("first_docs") + F.col("nth")).alias("place"), (F.col("first_ids") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * ids))


def fetch(places: DataFrame, path: str, place: str = "place") -> DataFrame:
    """places with start and ids of the documents at these places; a place that isn't in the store has nulls.

    The manifest tells the segment of a place. Places of a segment go in lots, by hash; for each lot it is opened
    once, and select finds where documents start and end, so the other boundaries aren't decoded.
    """
    spark = places.sparkSession
    ship_package(spark)
    of = manifest(spark, path).select("name", "first_ids", "first_docs", (F.col("first_docs") + F.col("docs")).alias("end_docs"))
    # a segment's row for each block of places that it touches, so that places meet theirs by an equal block
    of = of.withColumn("block", F.explode(F.sequence(F.shiftright("first_docs", BLOCK_BITS), F.shiftright(F.col("end_docs") - 1, BLOCK_BITS))))
    wanted = places.select(F.col(place).cast("long").alias("want")).where("want IS NOT NULL").distinct().withColumn("block", F.shiftright("want", BLOCK_BITS))
    at = wanted.join(of, "block").where("want >= first_docs AND want < end_docs").select("want", "name", "first_ids", (F.col("want") - F.col("first_docs")).alias("nth"))
    lots = at.withColumn("lot", F.pmod(F.xxhash64("want"), F.lit(64))).groupBy("name", "lot", "first_ids").agg(F.collect_list(F.struct("want", "nth")).alias("places"))
    asked = broadcast_if_small(stored(lots, "places"))
    files = _files(spark, path).withColumn("file", F.element_at(F.split("path", "/"), -1))
    rows = files.join(asked, F.col("file") == F.col("name")).select("content", "first_ids", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, s in _each(batches):
            first, asked = b.column(1)[i].as_py(), b.column(2)[i].as_py()
            for r in asked:
                x, y = s.bounds(r["nth"])
                yield pa.RecordBatch.from_pylist([{"want": r["want"], "start": first + x, "ids": s.ids[x:y].tolist()}], pa.schema([("want", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    found = rows.mapInArrow(trimmed(run), "want long, start long, ids array<int>")
    want = unused("want", places.columns)
    found = found.withColumnRenamed("want", want)
    return places.drop("start", "ids").join(found, F.col(place).cast("long") == F.col(want), "left").drop(want)


def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, as read back from the files, where its ids start, how many they are, and their checksum."""
    path = shared_path(spark, "token-store")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
