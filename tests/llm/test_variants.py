"""One-edit pairs by merged subtries against all pairs; forms and roots against plain loops."""

import random
import zlib

import numpy as np
import pytest

from stylomill.llm import variants
from stylomill.llm.variants import Trie


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def all_pairs(words):
    words = sorted(words)
    return {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}


def made_words(seed, n, alphabet="abé", lo=1, hi=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(lo, hi))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("depth", [0, 2])
def test_merged_subtries_find_each_pair_once(seed, depth):
    rng = random.Random(seed)
    s = rng.randint(max(1, depth), 6)
    words = [w for w in made_words(seed, 400, "ab" if seed % 2 else "abcdeé") if s <= len(w) <= s + 1]
    got = [tuple(sorted((words[i], words[j]))) for a, b in Trie(words, s, depth).pairs() for i, j in zip(a, b)]
    want = {(a, b) for a, b in all_pairs(words) if min(len(a), len(b)) == s and a[:depth] == b[:depth]}
    assert len(got) == len(set(got)) and set(got) == want


def test_words_of_one_hash_get_another_base(monkeypatch):
    first = []

    def weak(h, real=variants.mix):
        first.append(0)
        return h * np.uint64(0) + np.uint64(1) if len(first) == 1 else real(h)

    monkeypatch.setattr(variants, "mix", weak)
    words = made_words(3, 200, "abc", 4, 5)
    got = {tuple(sorted((words[i], words[j]))) for a, b in Trie(words, 4, 0).pairs() for i, j in zip(a, b)}
    assert got == {(a, b) for a, b in all_pairs(words) if min(len(a), len(b)) == 4}


@pytest.mark.parametrize("group", [variants.GROUP, 1000])
def test_large_groups_are_split(spark, group, monkeypatch):
    monkeypatch.setattr(variants, "CHUNK", 200)
    words = [f"abc{w}" for w in made_words(5, 250, "abé", 4, 5)] + made_words(6, 60, lo=7, hi=8) + ["x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 149, "z" * 40]
    vocab = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long").repartition(3)
    got = [tuple(sorted((r["a"], r["b"]))) for r in variants.near_pairs(vocab, group).collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(words)


def plain(docs, least_length=7, least_count=2, ratio=10):
    """As the contract says, word by word."""
    counts, letters = {}, {*map(chr, range(0xC0, 0x100)), *"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for i, text in docs:
        run = ""
        for c in (text or "") + " ":
            if c in letters:
                run += c
                continue
            if run:
                low = "".join(x.lower() if x.isascii() else x for x in run)
                h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
                w = low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low
                if len(w) >= least_length:
                    counts[w] = counts.get(w, 0) + 1
            run = ""
    words = {w: n for w, n in counts.items() if n >= least_count}
    near = {w: [] for w in words}
    for a, b in all_pairs(words):
        near[a].append(b), near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items())


def test_forms_and_roots(spark):
    rng = random.Random(7)
    base = ["spelling", "variant", "grouping", "Naïveté×x", "ÀÉÖabcd", "committee"]
    docs = []
    for i in range(400):
        w = []
        for _ in range(30):
            x = rng.choice(base[:3] if rng.random() < 0.9 else base)
            if rng.random() < 0.08:
                k = rng.randrange(len(x))
                x = rng.choice([x[:k] + x[k + 1 :], x[:k] + rng.choice("aez") + x[k:], x[:k] + rng.choice("aez") + x[k + 1 :]])
            w.append(x.upper() if rng.random() < 0.1 else x)
        docs.append((i, " ".join(w)))
    # a chain of forms: each ten times as frequent as the one before
    docs += [(1000, "chainaaa " * 3000), (1001, "chainaab " * 300), (1002, "chainabb " * 30), (1003, "chainbbb " * 3)]
    docs += [(None, "nothing nothing"), (5, None), (5, ""), (7, "short wörd x1y " * 3), (8, "again again repeated"), (8, "again again repeated")]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(3)
    got = sorted(map(tuple, variants.spelling_variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect()))
    want = plain(docs)
    assert got == want and len({r[5] for r in got if r[0].startswith("chain")}) < 4 and any(r[2] > 2 for r in got)


def test_empty_table(spark):
    got = variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert variants.spelling_variants(spark.createDataFrame([(1, None), (2, "no long one")], "doc_id long, text string")).count() == 0
