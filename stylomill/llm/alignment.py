"""Alignment of two tokenizers' tokens: where both end, groups are cut; tokens of a group are linked.

Texts are sequences of pieces that neither tokenizer merges across (see pieces.py), so all piece ends are common cuts, and
a group lies within a piece. The distinct pieces of the corpus are what is tokenized and aligned, relationally: tokens by
posexplode, their ends by windowed sums of lengths, common cuts by an equi-join on piece and end, group numbers by running
counts of the cuts before, groups by a join on piece and number. All of that is partitioned by piece: one shuffle of token
lists, none of tokens. Batches of texts keep their documents as numbers of pieces and a list of their distinct pieces; a join
by the pieces' 128-bit names brings the groups back to the batches, and a document's groups are its pieces' groups in order.
(Among 10^11 distinct pieces, two have one name by a chance below 10^-16.) What goes back to a batch is packed before it is
shuffled: rows of a batch that lie in one partition travel as one.

How many documents hold a pair of ids linked is counted in two steps, by batch and then overall, and comes back to the
batches as a row for each distinct pair.

Defined cases. Texts that are null or empty, or whose tokens of either kind don't give back a space and the text, have no
tokens: zeros and an empty digest; their pairs don't count. Texts of any length are whole in one batch, which is then as long.
Repeated rows each count as a document. An empty table gives an empty result. Of the input's columns only id and text matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stylomill.llm import token_store
from stylomill.llm.bpe import ragged
from stylomill.llm.common import table, text_slices, trim, trimmed
from stylomill.llm.pieces import Seen
from stylomill.session import forget, shared_path, ship_package

#: Bytes of text in a batch.
BATCH_BYTES = 4 << 20
#: Documents and pieces that leave a task together.
ROWS = 1 << 14


class Pair:
    """Both tokenizers on pieces: a byte-level BPE file of the tokenizers library, and a sentencepiece BPE model with byte fallback."""

    def __init__(self, a_spec: bytes, b_model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.a = token_store.encoder(a_spec.decode(), special=False)
        m = proto.ModelProto()
        m.ParseFromString(b_model)
        norm, kinds = m.normalizer_spec, proto.ModelProto.SentencePiece
        whole = [p.piece for p in m.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        crossing = re.compile("[^▁]▁|.\n", re.S)
        if m.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or m.trainer_spec.treat_whitespace_as_suffix or any(map(crossing.search, whole)):
            raise ValueError("not a model that leaves text as it is and merges nothing across white space")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.before = len(self.b.encode("x"))  # pieces are encoded behind a word, as the model puts a space before a text
        self.a_bytes = self.a.bytes_of
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace("▁", " ").encode() for p in m.pieces]

    def encode(self, pieces: list[bytes]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both kinds, and whether both give back the piece."""
        a = [list(x) for x in self.a.encode(pieces)]
        b = [x[self.before :] for x in self.b.encode(["x" + p.decode("utf-8", "replace") for p in pieces], num_threads=1)]
        whole = [b"".join(map(self.a_bytes.__getitem__, x)) == p == b"".join(map(self.b_bytes.__getitem__, y)) for p, x, y in zip(pieces, a, b)]
        return a, b, whole

    def lengths(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        return [(i, len(x)) for i, x in self.a_bytes.items()], [(i, len(x)) for i, x in enumerate(self.b_bytes)]


_pairs: dict[int, Pair] = {}


def _pair(a_spec: bytes, b_model: bytes) -> Pair:
    key = hash((a_spec, b_model))
    if key not in _pairs:
        _pairs.clear()
        _pairs[key] = Pair(a_spec, b_model)
    return _pairs[key]


def _forget() -> None:
    """Workers live on; the vocabularies aren't needed once pieces are encoded."""
    _pairs.clear()
    token_store.forget()


class Numbered:
    """Distinct pieces of a batch, numbered as they come."""

    def __init__(self):
        self.pieces: list[bytes] = []
        self.seen = Seen(self._number)

    def _number(self, pieces: list[bytes]) -> list[list[int]]:
        at = len(self.pieces)
        self.pieces += pieces
        return [[i] for i in range(at, at + len(pieces))]


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, 4 * n, codec="zstd", asbytes=True), "<i4")


BATCHES = "batch long, nth long, n int, occ binary, idx int, piece string"


def batches(df: DataFrame, text: str, id_col: str, batch_bytes: int) -> DataFrame:
    """Rows of two kinds: a document as the numbers of its pieces (nth, id, n, occ), and a distinct piece of a batch (idx, piece)."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ["id", "batch", "nth", "n", "occ", "idx", "piece"]

        def made(ids: list, texts: list[bytes], nth: int) -> Iterator[pa.RecordBatch]:
            batch = part << 32 | nth
            of = Numbered()
            flat, n = of.seen.encode_batch([b" " + t if t else b"" for t in texts])
            ends = np.cumsum(n)
            id_column = pa.chunked_array(ids).combine_chunks()
            for lo in range(0, len(n), ROWS):
                k = range(lo, min(lo + ROWS, len(n)))
                m = len(k)
                occ = [_packed(flat[ends[i] - n[i] : ends[i]]) for i in k]
                yield pa.RecordBatch.from_arrays([id_column.slice(lo, m), pa.array([batch] * m, pa.int64()), pa.array(list(k), pa.int64()), pa.array(n[lo : lo + m], pa.int32()), pa.array(occ, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.string())], names)
            for lo in range(0, len(of.pieces), ROWS):
                some = of.pieces[lo : lo + ROWS]
                m = len(some)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, id_column.type), pa.array([batch] * m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array(np.arange(lo, lo + m), pa.int32()), pa.array(some, pa.binary()).cast(pa.string())], names)

        ids, texts, held, nth = [], [], 0, 0
        for b, some in text_slices(arrow, 1):
            ids.append(b.column(0))
            texts += some
            held += sum(map(len, some))
            if held >= batch_bytes:
                yield from made(ids, texts, nth)
                ids, texts, held, nth = [], [], 0, nth + 1
        if texts:
            yield from made(ids, texts, nth)

    return rows.mapInArrow(trimmed(run), f"id {kind}, {BATCHES}")


def tokenized(pieces: DataFrame, a_spec, b_model) -> DataFrame:
    """(piece, ids) of distinct pieces: ids of both kinds, for those that both give back."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_spec.value, b_model.value)
        for b, some in text_slices(arrow, 0):
            a, c, whole = pair.encode(some)
            ok = np.flatnonzero(whole)
            ids = [(a[i], c[i]) for i in ok.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), pa.array(ids, pa.list_(pa.list_(pa.int32())))], ["piece", "ids"])

    return pieces.mapInArrow(trimmed(run), "piece string, ids array<array<int>>")


def named(piece: Column) -> list[Column]:
    """A piece's name of 128 bits, which is shuffled and sorted in place of the piece."""
    return [F.xxhash64(piece).alias("h1"), F.xxhash64(F.lit("second"), piece).alias("h2")]


def align(pieces: DataFrame, a_lengths: DataFrame, b_lengths: DataFrame) -> DataFrame:
    """(h1, h2, groups) of pieces (p, piece, ids): groups as a1,a2|b1;a3|b2,b3, the ids of each in order.

    The lengths, (id, length), are vocabularies, of a size that doesn't grow with the corpus.
    """
    dealt = pieces.repartition("p")

    def tokens(side: int, lengths: DataFrame) -> DataFrame:
        each = dealt.select("p", F.posexplode(F.col("ids")[side]).alias("pos", "id")).join(F.broadcast(lengths), "id")
        upto = Window.partitionBy("p").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        return each.select("p", "id", F.sum("length").over(upto).alias("end"))

    a, b = tokens(0, a_lengths), tokens(1, b_lengths)

    def numbered(own: DataFrame, other: DataFrame, name: str) -> DataFrame:
        cut = own.join(other.select("p", "end", F.lit(1).alias("cut")), ["p", "end"], "left")
        before = Window.partitionBy("p").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
        g = cut.select("p", "end", "id", F.coalesce(F.sum("cut").over(before), F.lit(0)).cast("int").alias("g"))
        return g.groupBy("p", "g").agg(F.transform(F.sort_array(F.collect_list(F.struct("end", "id"))), lambda t: t["id"]).alias(name))

    both = numbered(a, b, "a").join(numbered(b, a, "b"), ["p", "g"])
    groups = both.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("g", "a", "b"))).alias("groups"))
    written = F.array_join(F.transform("groups", lambda t: F.concat(F.array_join(t["a"], ","), F.lit("|"), F.array_join(t["b"], ","))), ";")
    return dealt.select("p", "piece", "ids").join(groups, "p").select(*named(F.col("piece")), written.alias("groups"))


# --- from pieces to documents


CELL = "batch long, n int, at binary, size int, data binary"


def cells(rows: DataFrame) -> DataFrame:
    """Rows (batch, number, value) as few rows a batch and partition: numbers, and values as long integers or lines of text, compressed."""
    text = rows.dtypes[2][1] == "string"

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        trim()
        for b in arrow:
            if not b.num_rows:
                continue
            batch, number = b.column(0).to_numpy(), b.column(1).to_numpy()
            value = b.column(2).cast(pa.binary()).to_pylist() if text else b.column(2).to_numpy().astype("<i8")
            cuts = np.r_[0, np.flatnonzero(np.diff(batch)) + 1, len(batch)].tolist()
            data = [b"\n".join(value[lo:hi]) if text else value[lo:hi].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:])]
            at = [_packed(np.diff(number[lo:hi], prepend=0)) for lo, hi in zip(cuts[:-1], cuts[1:])]
            size = [len(x) for x in data]
            data = [pa.compress(x, codec="zstd", asbytes=True) for x in data]
            yield pa.RecordBatch.from_arrays([pa.array(batch[cuts[:-1]]), pa.array(np.diff(cuts), pa.int32()), pa.array(at, pa.binary()), pa.array(size, pa.int32()), pa.array(data, pa.binary())], ["batch", "n", "at", "size", "data"])

    return rows.sortWithinPartitions(*rows.columns[:2]).mapInArrow(trimmed(run), CELL)


def opened(packed: pa.Table) -> Iterator[tuple[np.ndarray, bytes]]:
    """Numbers and data of each cell."""
    for n, at, size, data in zip(*(packed.column(c).to_pylist() for c in ("n", "at", "size", "data"))):
        yield np.cumsum(_unpacked(at, n), dtype=np.int64), pa.decompress(data, size, codec="zstd", asbytes=True)


#: Between ids of a group's side, between the sides, and between groups.
COMMA, BAR, SEMICOLON = b",|;"
SPACES = bytes.maketrans(b",|;", b"   ")


class Aligned:
    """A batch's aligned pieces as flat arrays: of their numbers there, and of their groups as written."""

    def __init__(self, idx: np.ndarray, groups: list[bytes]):
        n = int(idx.max()) + 1 if len(idx) else 0
        self.known = np.zeros(n, bool)
        self.known[idx] = True
        self.text: list[bytes] = [b""] * n
        for i, x in zip(idx.tolist(), groups):
            self.text[i] = x
        # one mark follows each id; an id is of the first kind if as many bars as semicolons lie before it
        flat = b"".join(x + b";" for x in groups)
        value = np.fromstring(flat.translate(SPACES), np.int64, sep=" ") if flat else np.zeros(0, np.int64)
        marks = np.frombuffer(flat, np.uint8)
        marks = marks[(marks == COMMA) | (marks == BAR) | (marks == SEMICOLON)]
        bars, group = (np.cumsum(marks == m) - (marks == m) for m in (BAR, SEMICOLON))
        first = bars == group
        per = np.array([x.count(b";") + 1 for x in groups], np.int64)
        piece_of_group = np.repeat(idx, per)
        sizes = [np.bincount(group[side], minlength=len(piece_of_group)) for side in (first, ~first)]
        ids = [value[side] for side in (first, ~first)]
        total = lambda x: np.bincount(piece_of_group, weights=x, minlength=n).astype(np.int64)
        self.n_a, self.n_b, self.n_groups, self.n_links = total(sizes[0]), total(sizes[1]), total(np.ones(len(piece_of_group))), total(sizes[0] * sizes[1])
        # links of a group: each of its distinct ids of one kind with each of the other, as often as both occur
        seen = [np.unique(np.repeat(np.arange(len(x)), x) << 32 | y, return_counts=True) for x, y in zip(sizes, ids)]
        (ka, ca), (kb, cb) = seen
        b_per = np.bincount(kb >> 32, minlength=len(piece_of_group))
        b_start = np.cumsum(b_per) - b_per
        ga = ka >> 32
        right = ragged(b_start[ga], b_per[ga])
        left = np.repeat(np.arange(len(ka)), b_per[ga])
        pair = (ka[left] & 0xFFFFFFFF) << 32 | kb[right] & 0xFFFFFFFF
        self.pairs, at = np.unique(pair, return_inverse=True)
        # a piece's distinct pairs and how often each is linked there
        key = piece_of_group[ga[left]].astype(np.int64) << 32 | at
        key, first = np.unique(key, return_inverse=True)
        self.times = np.bincount(first, weights=ca[left] * cb[right], minlength=len(key)).astype(np.int64)
        self.pair_of = key & 0xFFFFFFFF
        self.pair_n = np.bincount(key >> 32, minlength=n)
        self.pair_at = np.cumsum(self.pair_n) - self.pair_n


COMPOSED = "batch long, nth long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, m int, links binary, times binary, link int, a_id int, b_id int, docs long"


def _aligned(pieces: pa.Table) -> Aligned:
    idx, groups = [np.zeros(0, np.int64)], []
    for at, data in opened(pieces):
        idx.append(at)
        groups += data.split(b"\n")
    return Aligned(np.concatenate(idx), groups)


def _composed(key: tuple, docs: pa.Table, pieces: pa.Table) -> pa.Table:
    """Documents with their totals and distinct pairs, and the batch's distinct pairs with the documents that hold them."""
    _forget()
    of = _aligned(pieces)
    batch = key[0].as_py()
    held = np.zeros(len(of.pairs), np.int64)
    out: dict[str, list] = {k: [] for k in ("nth", "n_a", "n_b", "n_groups", "n_links", "sha", "m", "links", "times")}
    text = of.text
    for nth, n, occ in zip(docs.column("nth").to_pylist(), docs.column("n").to_pylist(), docs.column("occ").to_pylist()):
        at = _unpacked(occ, n) if n else np.zeros(0, np.int32)
        if n and (at.max() >= len(of.known) or not of.known[at].all()):  # a piece that isn't given back
            n, at = 0, at[:0]
        out["nth"].append(nth)
        for name, x in (("n_a", of.n_a), ("n_b", of.n_b), ("n_groups", of.n_groups), ("n_links", of.n_links)):
            out[name].append(int(x[at].sum()) if n else 0)
        out["sha"].append(hashlib.sha256(b";".join(map(text.__getitem__, at.tolist()))).hexdigest() if n else "")
        # distinct pieces first, so that a piece's pairs are looked up once
        once, times = np.unique(at, return_counts=True)
        k = ragged(of.pair_at[once], of.pair_n[once]) if n else np.zeros(0, np.int64)
        pair, place = np.unique(of.pair_of[k], return_inverse=True)
        total = np.bincount(place, weights=of.times[k] * np.repeat(times, of.pair_n[once] if n else 0), minlength=len(pair)) if n else np.zeros(0)
        held[pair] += 1
        out["m"].append(len(pair))
        out["links"].append(_packed(np.diff(pair, prepend=0)) if len(pair) else b"")
        out["times"].append(_packed(total) if len(pair) else b"")
    d, p = len(out["nth"]), len(of.pairs)
    both = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(p, kind)])
    own = lambda x, kind: pa.concat_arrays([pa.nulls(d, kind), pa.array(x, kind)])
    long = pa.int64()
    ids = docs.column("id").combine_chunks()
    found = pa.table({
        "id": pa.concat_arrays([ids, pa.nulls(p, ids.type)]) if d else pa.nulls(p, ids.type), "batch": pa.array([batch] * (d + p), long), "nth": both(out["nth"], long), "n_a": both(out["n_a"], long), "n_b": both(out["n_b"], long), "n_groups": both(out["n_groups"], long),
        "n_links": both(out["n_links"], long), "groups_sha256": both(out["sha"], pa.string()), "m": both(out["m"], pa.int32()), "links": both(out["links"], pa.binary()), "times": both(out["times"], pa.binary()),
        "link": own(np.arange(p), pa.int32()), "a_id": own(of.pairs >> 32, pa.int32()), "b_id": own(of.pairs & 0xFFFFFFFF, pa.int32()), "docs": own(held, long),
    })
    trim()
    return found


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents with sums over their links of what their batch's pairs count overall."""
    _forget()
    found = [(at, np.frombuffer(data, "<i8")) for at, data in opened(pairs)]
    n = max((int(at[-1]) + 1 for at, _ in found), default=0)
    count, best = np.zeros(n, np.int64), np.zeros(n, bool)
    for at, signed in found:
        count[at], best[at] = abs(signed), signed < 0
    n_best, count_sum = [], []
    for m, links, times in zip(docs.column("m").to_pylist(), docs.column("links").to_pylist(), docs.column("times").to_pylist()):
        at = np.cumsum(_unpacked(links, m)) if m else np.zeros(0, np.int64)
        t = _unpacked(times, m).astype(np.int64) if m else at
        n_best.append(int(t[best[at]].sum()))
        count_sum.append(int((t * count[at]).sum()))
    out = docs.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
    trim()
    return out


def pair_counts(composed: DataFrame) -> DataFrame:
    """(a_id, b_id, count, best): how many documents hold each pair linked, and whether none of its A id's counts is higher."""
    counts = composed.where("link IS NOT NULL").groupBy("a_id", "b_id").agg(F.sum("docs").alias("count")).where("count > 0")
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a_id")))  # an id's partners: ids of the other vocabulary


class Alignment:
    """An alignment's tables: pairs with their counts, and documents(). What led there is removed once it has been used."""

    def __init__(self, df: DataFrame, text: str = "text", id_col: str = "doc_id", a_path: str | None = None, b_path: str | None = None, batch_bytes: int = BATCH_BYTES):
        self.spark, self.id_col = df.sparkSession, id_col
        ship_package(self.spark)
        a_spec, b_model = token_store.vocabulary(self.spark, a_path), token_store.vocabulary(self.spark, b_path, "piece_bpe_32k.model")
        # a session of its own: there, rows of a piece stay together through joins on piece and end, and shuffles go with their job
        own = self.own = self.spark.newSession()
        for k, v in {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.shuffle.partitions": self.spark.conf.get("spark.sql.shuffle.partitions")}.items():
            own.conf.set(k, v)

        def kept(found: DataFrame, name: str) -> str:
            path = shared_path(self.spark, name)
            found.write.option("compression", "zstd").parquet(path)
            return path

        rows = kept(batches(df, text, id_col, batch_bytes), "aligned-batches")
        held = lambda: own.read.parquet(rows).where("idx IS NOT NULL").select("batch", "idx", "piece")
        distinct = tokenized(held().select("piece").distinct(), a_spec, b_model)
        tokens = kept(distinct.withColumn("p", F.monotonically_increasing_id()), "aligned-tokens")
        lengths = [own.createDataFrame(x, "id int, length int") for x in Pair(a_spec.value, b_model.value).lengths()]
        pieces = kept(align(own.read.parquet(tokens), *lengths), "aligned-pieces")
        forget(self.spark, tokens)
        groups = held().select("batch", "idx", *named(F.col("piece"))).join(own.read.parquet(pieces), ["h1", "h2"])
        back = kept(cells(groups.select("batch", "idx", "groups")), "aligned-back")
        forget(self.spark, pieces)
        docs = own.read.parquet(rows).where("idx IS NULL").select("id", "batch", "nth", "n", "occ")
        self.kind = df.schema[id_col].dataType.simpleString()
        made = docs.groupBy("batch").cogroup(own.read.parquet(back).groupBy("batch")).applyInArrow(_composed, f"id {self.kind}, {COMPOSED}")
        self.path = shared_path(self.spark, "aligned")
        made.write.option("compression", "zstd").parquet(self.path)
        forget(self.spark, rows, back)
        self.pairs = self.spark.read.parquet(kept(pair_counts(own.read.parquet(self.path)), "pairs"))

    def composed(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def documents(self) -> DataFrame:
        back = self.composed().where("link IS NOT NULL").select("batch", "link", "a_id", "b_id").join(self.pairs, ["a_id", "b_id"])
        signed = F.when(F.col("best"), -F.col("count")).otherwise(F.col("count"))  # negative: none of the A id's counts is higher
        back = cells(back.select("batch", "link", signed.alias("signed")))
        docs = self.composed().where("link IS NULL").select("id", "batch", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "m", "links", "times")
        out = f"id {self.kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
        scored = docs.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(_scored, out)
        return scored.select(F.col("id").alias(self.id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the tokens of both kinds, groups and links, and what the links' pairs count in the corpus."""
    return Alignment(table(spark, sf_dir, "documents")).documents()
