"""Aligned tokens against plain loops over the libraries' tokens of whole texts."""

import functools
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stylomill.llm import alignment
from stylomill.llm.bpe import byte_chars
from tests.llm.test_token_store import texts_of


@functools.cache
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def token_bytes(text):
    a, b = libraries()
    byte_of = {c: i for i, c in enumerate(byte_chars())}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    tok_a = [bytes(byte_of[c] for c in a.id_to_token(i)) if i < 50256 else a.id_to_token(i).encode() for i in ids_a]
    tok_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b))]
    return ids_a, ids_b, tok_a, tok_b


def groups_of(text):
    if not text:
        return []
    ids_a, ids_b, tok_a, tok_b = token_bytes(text)
    if not b"".join(tok_a) == b"".join(tok_b) == (" " + text).encode():
        return []
    ends_a, ends_b = (np.cumsum([len(x) for x in t]).tolist() for t in (tok_a, tok_b))
    cuts, out, i, j = sorted({*ends_a} & {*ends_b}), [], 0, 0
    for c in cuts:
        k, m = i, j
        while i < len(ends_a) and ends_a[i] <= c:
            i += 1
        while j < len(ends_b) and ends_b[j] <= c:
            j += 1
        out.append((ids_a[k:i], ids_b[m:j]))
    return out


def plain(texts):
    docs = [groups_of(t) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in docs]
    count = Counter(p for d in links for p in d)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(n, best.get(a, 0))
    out = []
    for g, link in zip(docs, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(link.values()), sum(n for p, n in link.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in link.items()),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return out


def made(spark, texts, **how):
    rows = [(i, t, -1, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int, batch string").repartition(3)
    found = alignment.Alignment(df, **how)
    got = sorted(found.documents().collect())
    assert [r["doc_id"] for r in got] == list(range(len(texts)))
    return found, [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got]


def test_documents_and_pairs(spark):
    """White space of all kinds, other scripts, special strings, the space sign of the pieces, control characters, copies, nulls."""
    more = ["a▁b", "▁", "<s> </s> <unk> <0x41>", "한국어 텍스트 가", "ﷺ ∑∏ x²", "\r\n x\r y ;\r", "}\r\n  {\r", "tail  ", "   lead", "x" * 700, "日本" * 300, "🤷🏽‍♀️" * 40, "é" * 90, None, None, ""]
    texts = more + texts_of(4, 120) + ["the cat sat on the mat"] * 40
    random.Random(2).shuffle(texts)
    found, got = made(spark, texts, batch_bytes=3000)
    want = plain(texts)
    assert got == want and 5 < sum(w[0] == 0 for w in want) < 60 and any(w[3] > w[0] + 5 for w in want)
    counts = {(r["a_id"], r["b_id"]): r["count"] for r in found.pairs.collect()}
    assert counts == dict(Counter(p for t in texts for p in {(x, y) for a, b in groups_of(t) for x in a for y in b}))


def test_a_group_of_many_tokens():
    """Tokens that never end together but at the end: all links are counted, but only distinct ids are joined."""
    a, b = [5, 6] * 3000, [7] * 5000
    of = alignment.Aligned(np.array([2, 0]), [(",".join(map(str, a)) + "|" + ",".join(map(str, b))).encode(), b"5|7;9|7,8"])
    assert of.n_links.tolist() == [3, 0, 30_000_000] and of.n_groups.tolist() == [2, 0, 1] and len(of.pairs) == 4
    assert of.text[0] == b"5|7;9|7,8" and of.times[of.pair_at[2] :][: of.pair_n[2]].tolist() == [15_000_000] * 2


def test_cells_of_batches(spark):
    """Rows of a batch and a partition travel as one, whatever their values."""
    rows = [(b, i, "é|" * (i % 5)) for b in (7, 1 << 40) for i in range(0, 4000, 3)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "batch long, idx int, value string").repartition(4)
    for some, read in ((df, lambda x: x.decode().split("\n")), (df.select("batch", "idx", (F.col("idx") - 5000).cast("long")), lambda x: np.frombuffer(x, "<i8").tolist())):
        found = alignment.cells(some)
        assert found.count() <= 2 * 4 and alignment.cells(some.where("false")).count() == 0
        got = [(b, i, v) for (b,) in found.select("batch").distinct().collect() for at, data in alignment.opened(found.where(F.col("batch") == b).toArrow()) for i, v in zip(at.tolist(), read(data))]
        assert sorted(got) == sorted(map(tuple, some.collect()))


def test_empty_tables(spark):
    assert made(spark, [])[1] == []
    assert made(spark, [None, ""])[1] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_query_on_the_whole_table(spark):
    got = {r["doc_id"]: r for r in alignment.op13_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    for d, w in zip(docs, plain([d["text"] for d in docs])):
        assert tuple(got[d["doc_id"]][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == w
