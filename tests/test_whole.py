"""The registered queries run the reference's whole jobs."""

import math

import duckdb
import pytest
from pyspark.ml.linalg import Vectors

from stylomill.functions import text as X
from stylomill.operators import models
from stylomill.plans import model_queries, pipelines, queries


class Seen(Exception):
    pass


def test_queries_ask_for_the_references_sizes(spark, monkeypatch):
    cfg = models.Config()
    assert (cfg.ngrams, cfg.max_features, cfg.min_df, cfg.kfolds, cfg.n_iter) == (11, 50_000, 2, 3, 8)
    rows = [(i, i % 2, Vectors.dense([float(i), float(i % 2)])) for i in range(20)]
    df = spark.createDataFrame(rows, ["id", "label", "features"])
    seen = []

    def gbt(**params):
        seen.append(params)
        raise Seen

    monkeypatch.setattr(models.boosting, "Params", gbt)
    monkeypatch.setattr(model_queries, "vectors", lambda *a: (None, df, df))
    for name in ("gbt_scores", "top_importances"):
        with pytest.raises(Seen):
            queries.QUERIES[name](spark, "")
    docs = [spark.createDataFrame([(i, f"Some words here, number {i % 3}.", i % 2) for i in range(12)], "id long, text string, label int")] * 3
    vectors, made = models.fit_vectors, []
    monkeypatch.setattr(models, "fit_vectors", lambda train, cfg: made.append(cfg) or vectors(train, cfg))
    with pytest.raises(Seen):
        pipelines.baseline(*docs)
    assert seen == [{}] * 3
    monkeypatch.undo()
    p = models.boosting.Params()
    assert (p.n_estimators, p.max_depth, p.max_bins, p.learning_rate) == (500, 6, 256, 0.1)
    monkeypatch.setattr(model_queries, "vectors", lambda *a: (None, df, df))
    assert [(c.columns, c.ngrams, c.max_features, c.min_df) for c in made] == [(X.BASIC, 11, 5000, 1)]
    trials = queries.QUERIES["random_search_trials"](spark, "").collect()
    assert len(trials) == 3 * len(models.NB_SPACE["alpha"])  # fewer than n_iter: the whole grid
    monkeypatch.setattr(model_queries, "split", lambda *a: [d.limit(12) for d in docs])
    found = {(r["model"], r["score"]): r["value"] for r in queries.QUERIES["model_comparison"](spark, "").collect()}
    assert len(found) == 12 and {k for k, v in found.items() if math.isnan(v)} == {(m, "cv_f1") for m in ("Boosted", "EmbBag", "CharCNN")}


def test_char_ngrams_of_the_references_lengths(spark, tmp_path):
    texts = ["abcdef", "ab", "", None, "aaaaaa", "é ü\nabcde"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["gram"]: r["df"] for r in queries.QUERIES["char_ngrams35_df"](spark, str(tmp_path)).collect()}
    grams = [{t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)} for t in (t or "" for t in texts)]
    assert got == {g: sum(g in s for s in grams) for g in set().union(*grams)}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(con.sql(queries.ORACLE_SQL["char_ngrams35_df"]).fetchall()) == got


def test_searches_try_every_candidate(spark, tmp_path, monkeypatch):
    """The tuned query asks for both whole grids, and a slow search with low scores drops nothing."""
    asked = []
    monkeypatch.setattr(model_queries, "prepared_split", lambda *a: (None,) * 3)
    monkeypatch.setattr(pipelines, "vectorized", lambda *a: (spark.createDataFrame([(i, i % 2, Vectors.dense([float(i % 3)])) for i in range(12)], ["id", "label", "features"]),) * 3)
    monkeypatch.setattr(models, "random_search", lambda name, fit, space, rows, cfg, **_: asked.append((name, models.candidates(space, cfg.n_iter, cfg.seed))) or ({}, []))
    monkeypatch.setattr(pipelines, "rules_prevalence", lambda *a, **_: (None, None))
    queries.QUERIES["tuned_submission"](spark, "")
    monkeypatch.undo()
    assert [(name, len(found)) for name, found in asked] == [("nb", 5), ("lr", 10)]
    assert {(p["C"], p["class_weight"]) for p in asked[1][1]} == {(c, w) for c in models.LR_SPACE["C"] for w in models.LR_SPACE["class_weight"]}
    df = spark.createDataFrame([(i, i % 2, Vectors.dense([float(i % 3)])) for i in range(12)], ["id", "label", "features"])
    clock = iter(range(0, 10**9, 10_000))  # hours pass between any two looks
    monkeypatch.setattr(models.time, "time", lambda: next(clock))
    _, trials = models.random_search("slow", models.fit_nb, models.NB_SPACE, df, models.Config(n_iter=None, kfolds=2, artifacts=str(tmp_path)))
    assert len(trials) == 10
