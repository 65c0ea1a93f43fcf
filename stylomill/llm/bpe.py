"""BPE encoding and decoding with a public vocabulary file, as the tokenizers library does.

Words of a batch are looked up in a cache of bounded size; the new ones are merged together: the symbols of all of them
lie in one flat array with a rank for each adjacent pair, found by binary search over the sorted pair keys. A round takes
each word's lowest rank, merges all its pairs of that rank from the left, and looks up only the pairs that changed.
Words without a known pair leave the array.

Follows files of this kind: NFC, white space to spaces, lower case; words by pattern, the rest removed; bytes as
printable characters; a suffix at a word's end; special tokens found in the raw text; no decoder, so tokens are joined
by spaces.

Defined cases. A null text is empty and has no tokens; no tokens decode to the empty string, null ids too. Texts of any
length are encoded whole, in pieces of bounded size cut before white space. An empty table gives an empty result. Input
columns that bear the name of an output column are replaced.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from stylomill.llm.common import blocks, table, text_slices, trimmed
from stylomill.session import ship_package

#: Words that the cache holds before it is emptied.
CACHE_WORDS = 250_000
#: Bytes of text whose ids and texts go on together.
ENCODED_BYTES = 1 << 20
#: Bytes of text that are encoded together.
PIECE = 1 << 22
NONE = np.int64(1) << np.int64(40)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else the next from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


#: Fixed values. Blocks that Unicode 16 added; the library's pattern knows them, this Python's Unicode 15.1 doesn't.
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105FF), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4),
    (0x11380, 0x113FF), (0x116D0, 0x116E3), (0x11BC0, 0x11BFF), (0x13460, 0x143FF), (0x16100, 0x1613F), (0x16D40, 0x16D7F),
    (0x18CFF, 0x18CFF), (0x1CC00, 0x1CEBF), (0x1E5D0, 0x1E5FF),
)
#: Fixed values. Lower cases that Unicode 16 and 17 added: first, last and the distance to the lower case.
LOWER_NEW = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1),
    (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)


class _Newer(dict):
    """For str.translate: letters and digits newer than Unicode 16 count as other characters, as in the library."""

    def __missing__(self, c: int) -> int:
        self[c] = c if unicodedata.category(chr(c)) != "Cn" or any(a <= c <= b for a, b in UNICODE_16) else 0xE000
        return self[c]


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        steps = [n["type"] for n in d["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or d["decoder"] or model["unk_token"] or model["byte_fallback"]:
            raise ValueError("not a vocabulary of the kind that this encoder follows")
        self.word = regex.compile(d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.space = regex.compile(d["normalizer"]["normalizers"][1]["pattern"]["Regex"])
        self.other, self.lower_new = _Newer(), {c: c + to for a, b, to in LOWER_NEW for c in range(a, b + 1)}
        special = {a["content"]: a["id"] for a in d["added_tokens"]}
        self.special = {k.encode(): v for k, v in special.items()}
        self.special_any = regex.compile(b"(" + b"|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + b")")
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"])))
        keys = left << np.int64(32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.made = keys[order], order.astype(np.int64), made
        self.tokens: list[str] = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for k, v in {**vocab, **special}.items():
            self.tokens[v] = k
        self.token_bytes = [t.encode() for t in self.tokens]
        self.numbers = [b"%d" % i for i in range(len(self.tokens))]
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is no merge."""
        key = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many non-empty words, one after the other, and how many each has."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        sym = self.inner[flat]
        sym[ends - 1] = self.final[flat[ends - 1]]
        word = np.arange(len(words))
        rank = np.full(len(sym), NONE)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[ends - 1] = NONE
        done_sym, done_word = [], []
        while len(sym):
            starts = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, starts)
            over = low == NONE
            if over.any():
                gone = np.repeat(over, size)
                done_sym.append(sym[gone])
                done_word.append(np.repeat(word[over], size[over]))
                sym, rank, word, size, low = sym[~gone], rank[~gone], word[~over], size[~over], low[~over]
                if not len(sym):
                    break
                starts = np.cumsum(size) - size
            hit = rank == np.repeat(low, size)
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():  # of pairs that overlap, every other one from the left
                new_run = np.r_[True, np.diff(at) != 1]
                run_start = at[new_run][np.cumsum(new_run) - 1]
                at = at[(at - run_start) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            last = np.zeros(len(sym), bool)
            last[starts + size - 1] = True
            last[at] |= last[at + 1]
            first = np.zeros(len(sym), bool)
            first[starts] = True
            size = np.add.reduceat(keep.astype(np.int64), starts)
            sym, rank, changed, last, first = sym[keep], rank[keep], changed[keep], last[keep], first[keep]
            again = changed.copy()
            again[:-1] |= changed[1:] & ~first[1:]
            k = np.flatnonzero(again & ~last)
            rank[k] = self.ranks(sym[k], sym[k + 1])
            rank[again & last] = NONE
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def _learn(self, pieces: set[bytes]) -> None:
        """Put pieces between white space into the cache."""
        new = list(pieces)
        words, of = [], []
        for i, p in enumerate(new):
            s = p.decode("utf-8", "replace")
            if not s.isascii():
                s = self.space.sub(" ", unicodedata.normalize("NFC", s)).replace("Σ", "σ").lower().translate(self.lower_new)  # a final sigma has no lower case of its own here
                found = [s[m.start() : m.end()] for m in self.word.finditer(s.translate(self.other))]
            else:
                found = self.word.findall(s.lower())
            words += found
            of += [i] * len(found)
        distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids, size = self.merge([w.encode() for w in distinct]) if distinct else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        k = np.fromiter((distinct[w] for w in words), np.int64, len(words))
        lengths = size[k]
        start = np.cumsum(size) - size
        flat = ids[ragged(start[k], lengths)]
        per_piece = np.bincount(np.array(of, np.int64), weights=lengths, minlength=len(new)).astype(np.int64)
        begin = len(self.ids)
        self.start = np.concatenate([self.start, begin + np.cumsum(per_piece) - per_piece])
        self.size = np.concatenate([self.size, per_piece])
        self.ids = np.concatenate([self.ids, flat])
        n = len(self.place)
        self.place.update(zip(new, range(n, n + len(new))))

    def _encode_small(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [t.split() for t in texts]
        fresh = set().union(*pieces) - self.place.keys()
        if len(self.place) + len(fresh) > CACHE_WORDS and self.place:
            self._forget()
            fresh = set().union(*pieces)
        if fresh:
            self._learn(fresh)
        get = self.place.__getitem__
        n = np.array([len(p) for p in pieces], np.int64)
        k = np.fromiter((get(x) for p in pieces for x in p), np.int64, int(n.sum()))
        lengths = self.size[k]
        total = np.r_[0, np.cumsum(lengths)]
        ends = np.cumsum(n)
        return self.ids[ragged(self.start[k], lengths)], total[ends] - total[ends - n]

    def _segments(self, text: bytes) -> list[bytes | int]:
        """A text's pieces of bounded size, and the special tokens between them."""
        parts = self.special_any.split(text) if self.special and any(s in text for s in self.special) else [text]
        out: list[bytes | int] = []
        for p in parts:
            if p in self.special:
                out.append(self.special[p])
            else:
                out += blocks(p, PIECE) if len(p) > PIECE else [p]
        return out

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts, one after the other, and how many each has."""
        ids, owner, todo, todo_of, held = [], [], [], [], 0

        def flush() -> None:
            nonlocal held
            if todo:
                got, n = self._encode_small(todo)
                ids.append(got)
                owner.append(np.repeat(np.array(todo_of, np.int64), n))
            todo.clear(), todo_of.clear()
            held = 0

        for i, t in enumerate(texts):
            for s in self._segments(t):
                if isinstance(s, int):
                    flush()
                    ids.append(np.array([s], np.int64))
                    owner.append(np.array([i], np.int64))
                else:
                    todo.append(s)
                    todo_of.append(i)
                    held += len(s)
                    if held >= PIECE:
                        flush()
        flush()
        if not ids:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        return np.concatenate(ids), np.bincount(np.concatenate(owner), minlength=len(texts))

    def decode(self, ids: list[int]) -> bytes:
        return b" ".join(map(self.token_bytes.__getitem__, ids))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start[i], start[i] + 1, ... (size[i] of them) for each i."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


_codecs: dict[str, Bpe] = {}


def codec(spec: str) -> Bpe:
    """The codec of a file's content, one for each worker process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Bpe(spec)
    return _codecs[key]


def vocabulary(spark: SparkSession, path: str | None = None):
    """A vocabulary file's content for all workers; the public word-level BPE file by default."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _with(df: DataFrame, made: dict[str, str], run_on) -> DataFrame:
    """df with columns made: name and type of each; run_on(batch) yields slices of a batch and their new arrays."""
    ship_package(df.sparkSession)
    base = df.drop(*made)
    names = [f"c{i}" for i in range(len(base.columns))]  # columns of equal names, too, pass through Arrow
    new = [f"m{i}" for i in range(len(made))]
    schema = ", ".join(f"{n} {t}" for n, t in [*zip(names, (f.dataType.simpleString() for f in base.schema.fields)), *zip(new, made.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, arrays in run_on(b):
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*names, *new])

    return base.mapInArrow(trimmed(run), schema).toDF(*base.columns, *made)


def _strings(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.binary()).cast(pa.string())


def encode(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str | None = None, path: str | None = None) -> DataFrame:
    """df with ids: the token ids of the text; and, if it is named, with what they decode to."""
    made = {ids: "array<int>"} | ({decoded: "string"} if decoded else {})
    spec, at = vocabulary(df.sparkSession, path), df.drop(*made).columns.index(text)

    def run_on(b: pa.RecordBatch) -> Iterator[tuple]:
        c = codec(spec.value)
        for part, texts in text_slices([b], at, ENCODED_BYTES):
            flat, n = c.encode_batch(texts)
            ends = np.cumsum(n)
            arrays = [pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat.astype(np.int32)))]
            if decoded:
                arrays.append(_strings([c.decode(flat[e - k : e].tolist()) for e, k in zip(ends, n)]))
            yield part, arrays

    return _with(df, made, run_on)


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """df with decoded: the text of the token ids, special tokens kept."""
    spec, at = vocabulary(df.sparkSession, path), df.drop(decoded).columns.index(ids)

    def run_on(b: pa.RecordBatch) -> Iterator[tuple]:
        c = codec(spec.value)
        for lo in range(0, b.num_rows, 500):
            part = b.slice(lo, 500)
            yield part, [_strings([c.decode(x.values.to_pylist() if x.is_valid else []) for x in part.column(at)])]

    return _with(df, {decoded: "string"}, run_on)


def digests(df: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoded, decoded and summed up in one pass, so neither ids nor texts leave the task."""
    ship_package(df.sparkSession)
    spec = vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for b, texts in text_slices(batches, 1):
            flat, n = c.encode_batch(texts)
            ids_sha, decoded_sha, at = [], [], 0
            for k in n:
                ids = flat[at : at + k].tolist()
                at += k
                ids_sha.append(hashlib.sha256(b" ".join(map(c.numbers.__getitem__, ids))).hexdigest())
                decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["id", "n", "a", "b"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"id {kind}, n long, a string, b string").toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the number of tokens and the digests of its ids and of the text decoded from them."""
    return digests(table(spark, sf_dir, "documents"))
