"""The llm operators do the whole job where a smaller one would pass unseen."""

import numpy as np

from stylomill.llm import langid, lm
from tests.llm.test_llm import frame


def test_copies_do_not_starve_a_label(spark):
    rng = np.random.default_rng(1)
    others = [" ".join("".join(rng.choice(list("abcdefg"), 5)) for _ in range(6)) for _ in range(60)]
    rows = [(i, "one text again and again", "xx") for i in range(3000)] + [(i, t, "xx") for i, t in enumerate(others)]
    labels = [f"l{k}" for k in range(8)]
    rows += [(i, f"text {i % 2} of {k}", k) for k in labels for i in range(60)]
    df = frame(spark, rows)
    got, want = langid.fit(df), langid.fit(df.dropDuplicates(["lang", "text"]))
    assert got.langs == [*labels, "xx"]
    assert all(np.array_equal(a, b) for a, b in zip(got.keys, want.keys))  # fewer than sample_docs distinct texts: all are learned
    assert len(langid.Model({"xx": langid.gram_counts([t.encode() for t in others])}).keys[-1]) < len(got.keys[-1])
    assert langid.fit(df, sample_docs=1).langs == got.langs


def test_lm_rows_grow_with_histories(spark):
    """Each history is followed by its own word; there are more histories than a part's events, and each is learned."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)]
    follows = rng.integers(0, 40, 60_000)
    rows = [(k, " ".join(f"h{i} {words[follows[i]]}" for i in range(k * 100, k * 100 + 100))) for k in range(600)]
    counts = lm.token_counts(frame(spark, rows))
    assert counts.count() > 1 << 15
    model = lm.vocabulary(counts)
    got = lm.score(frame(spark, rows[:100]), frame(spark, [(k * 6 + i, t) for k, t in rows for i in range(6)])).collect()
    # of 201 tokens the words that follow have 40 choices; learned, they cost little, however many histories there are
    assert model.tree.shares.shape[1] == lm.BRANCHES and all(r["score"] - r["base_score"] > 100 * 1.2 for r in got)


def test_lm_scores_alike_with_and_without_a_flag(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * k) % 17}" for k in range(20))) for i in range(60)]
    frame(spark, rows).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    cond = ~lm.held_out(df.doc_id)
    a, b = ({r["id"]: round(r["score"], 3) for r in x.collect()} for x in (lm.score(df, df.where(cond)), lm.score(df, df.where(cond), learn=cond)))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 0.05 * abs(a[k]) for k in a)
