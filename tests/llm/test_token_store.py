"""Token files with Elias-Fano boundaries against the tokenizers library and plain arrays."""

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stylomill.llm import pieces, token_store
from stylomill.llm.token_store import EliasFano, Segment, ef_pack, pack_segment
from stylomill.session import shared_path

SPEC = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "\n", " \n ", "a", " a", "a  b\n\nc \n", "x  y", "x  y　\nz\x85 w", "tab\t x\r\n y", "it's he'll WE'RE  '' ", "<|endoftext|>", "a <|endoftext|>  b<|endoftext|>",
    "日本語 テキスト。\n次", "Ünïcode é è ", "🙂 🙂🙂 x", "word" * 4000, "longer-than-sixteen-bytes longer-than-sixteen-bytes", "\x00 \x00a\x1c b\x7f c", "é ́ x", "123 4567890 ½ ²",
]


@functools.cache
def tokenizer():
    return Tokenizer.from_file(SPEC)


def library(texts):
    t = tokenizer()
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def texts_of(seed, n=300):
    rng = random.Random(seed)
    parts = [*ODD, *(w for w in "the cat sat on it's mat 12 fünf\n <|endoftext|>   \t  …".split(" "))]
    return ODD + ["".join(rng.choice([rng.choice(parts), " ", "\n", chr(rng.choice([65, 97, 233, 0x4E2D, 0x2009, 0x1F600]))]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("most", [1 << 21, 3])
def test_pieces_give_the_ids_of_whole_texts(monkeypatch, most):
    monkeypatch.setattr(pieces, "BLOCK", 50 if most == 3 else pieces.BLOCK)
    e = token_store.Encoder(open(SPEC).read())
    e.seen.most = most
    texts = texts_of(1)
    for _ in range(2):  # the second time from the cache
        flat, n = e.batch([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == library(texts)


def test_pieces_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(pieces, "mix", lambda h: h & np.uint64(1))
    e = token_store.Encoder(open(SPEC).read())
    texts = texts_of(2, 40)
    for _ in range(2):
        flat, n = e.batch([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == library(texts)


def test_blocks_of_a_long_text():
    text = (b"some words and\nlines " * 5000) + b"x" * 300_000 + b" end"
    got = list(pieces.blocks(text, 1000))
    assert b"".join(got) == text and len(got) > 50
    assert [p for b in got for p in token_store.Encoder(open(SPEC).read()).encode([b])[0]] == library([text.decode()])[0]


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 1, 7, 7, 8], [2**63, 2**64 - 1], [3, 2**40, 2**40 + 1], *([sorted(random.Random(k).randrange(10**k) for _ in range(300))] for k in (1, 3, 9, 18))])
def test_elias_fano_gives_back_every_number(values):
    values = values[0] if values and isinstance(values[0], list) else values
    data = b"????????" + ef_pack(np.array(values, np.uint64))
    ef = EliasFano(memoryview(data), 8)
    assert ef.all().tolist() == values == [ef.select(i) for i in range(len(values))]
    assert ef.end == len(data)
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_is_small():
    rng = np.random.default_rng(0)
    ends = np.cumsum(rng.integers(1, 2000, 100_000)).astype(np.uint64)
    bits = 8 * len(ef_pack(ends)) / len(ends)
    assert bits < 2 + np.log2(1000) + 1.5 < 64 / 4  # samples of places take half a bit a document


def test_a_changed_segment_is_refused():
    data = bytearray(pack_segment(0, 0, 2, 0, np.array([4]), np.array([3]), np.array([7, 8, 2])) + b"EFID")
    s = Segment(bytes(data))
    assert s.doc_ids() == [4] and s.bounds(0) == (0, 3) and s.ids.tolist() == [7, 8, 2]
    data[token_store.HEADER.size] ^= 1
    with pytest.raises(ValueError):
        Segment(bytes(data))
    with pytest.raises(ValueError):
        Segment(bytes(data[:-2]))


def plain(rows):
    out, start = [], 0
    for place, (i, t) in enumerate(rows):
        ids = library([t])[0] + [2]
        out.append((i, place, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_files_hold_all_documents_in_order(spark):
    texts = texts_of(3, 100)
    rows = [(10 * i - 300, t, "extra") for i, t in enumerate(texts)] + [(10**15, None, None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    path = shared_path(spark, "t11")
    token_store.write(df, path, segment_ids=500)
    got = sorted(map(tuple, token_store.read(spark, path, ids=True).collect()), key=lambda r: r[1])
    want = plain([(r[0], r[1]) for r in sorted(rows)])
    assert got == want
    m = token_store.manifest(spark, path).collect()
    assert len(m) > 2 and sum(r["docs"] for r in m) == len(rows) and sum(r["ids"] for r in m) == sum(w[3] for w in want)
    asked = spark.createDataFrame([(0,), (17,), (17,), (len(rows) - 1,), (len(rows),), (None,), (-1,)], "place long")
    found = sorted(((r["place"], r["start"], r["ids"]) for r in token_store.fetch(asked, path).collect()), key=lambda x: (x[0] is None, x[0] or 0))
    assert found == [(-1, None, None), *((k, want[k][2], want[k][5]) for k in (0, 17, 17, len(rows) - 1)), (len(rows), None, None), (None, None, None)]


def test_ids_that_repeat_or_lack(spark):
    rows = [(None, "no id"), (None, None), *[(5, "same text")] * 4000, (5, "another"), (-3, ""), (7, "last")]
    path = shared_path(spark, "t11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_store.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(token_store.read(spark, path).collect(), key=lambda r: r["place"])
    assert [r["doc_id"] for r in got] == [None, None, -3, *[5] * 4001, 7] and [r["place"] for r in got] == list(range(len(rows)))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    assert sum(r["docs"] > 0 for r in token_store.manifest(spark, path).collect()) >= 3  # the repeated rows aren't one task's


def test_empty_table(spark):
    path = shared_path(spark, "t11")
    token_store.write(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_store.read(spark, path, ids=True).count() == 0 and token_store.manifest(spark, path).count() == 0


def test_query_on_the_whole_table(spark):
    got = sorted(token_store.op11_token_store(spark, "/root/testdata/sf0.001").collect(), key=lambda r: r["start"])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(w[0], *w[2:5]) for w in plain([(r["doc_id"], r["text"]) for r in docs])]
