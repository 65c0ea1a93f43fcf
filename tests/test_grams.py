"""N-grams counted within tasks against plain loops, with odd rows and repeated ids."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stylomill.operators import grams, tfidf

ROWS = [(1, "a b a_b a"), (1, "b a b"), (2, "é😀 x  x\n"), (3, ""), (4, None), (None, "a b"), (None, "b a b c a_b"), (5, "ab" * 40)]


def of(units, lo, hi, sep):
    return [sep.join(units[i : i + n]) for n in range(lo, hi + 1) for i in range(len(units) - n + 1)]


def slot(term):
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % 1024


@pytest.mark.parametrize("units", [4, 1 << 20])
def test_counts_are_the_plain_loops(spark, monkeypatch, units):
    monkeypatch.setattr(grams.sliced, "__defaults__", (units,))
    df = spark.createDataFrame(ROWS, "id long, text string").repartition(3)
    tk, chars, df_of, cf_of, parts = Counter(), Counter(), Counter(), Counter(), Counter()
    for i, t in ROWS:
        words = (t or "").split()
        tk.update((i, g) for g in of(words, 1, 2, "_"))
        df_of.update(set(of(words, 1, 2, "_"))), cf_of.update(of(words, 1, 2, "_"))
        chars.update(set(of(t or "", 3, 5, "")))
        parts.update((i, "w", slot(g)) for g in words + of(words, 1, 2, "_"))
        parts.update((i, "c", slot(g)) for g in words + of(t or "", 3, 5, ""))
    arrays = df.withColumn("tk", F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    got = [(r["id"], r["term"], r["tf"]) for r in tfidf.term_counts(arrays, F.col("tk"), lo=1, hi=2, sep="_").collect()]
    assert sorted(got, key=str) == sorted(((*k, n) for k, n in tk.items()), key=str)  # "a_b" is a token and a pair
    assert {r["term"]: (r["df"], r["cf"]) for r in tfidf.gram_counts(arrays, F.col("tk"), 1, 2, "_").collect()} == {k: (df_of[k], cf_of[k]) for k in cf_of}
    assert {r["term"]: r["df"] for r in tfidf.gram_df(df, F.col("text"), 3, 5).collect()} == chars
    got = [tuple(r) for r in tfidf.hashed_parts(df, dim=1024).select("id", "part", "slot", "tf").collect()]
    assert sorted(got, key=str) == sorted(((*k, n) for k, n in parts.items()), key=str)


def test_rows_of_their_own_ids_are_not_shuffled(spark):
    df = spark.range(50).select("id", F.array(F.lit("a"), F.lit("b")).alias("tk"))
    plan = tfidf.term_counts(df, F.col("tk"), hi=2)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
