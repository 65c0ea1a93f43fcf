"""Queries that train models; SQL can't express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylomill.functions import text as X
from stylomill.operators import charcnn, knn, models
from stylomill.operators.folds import split_labelled
from stylomill.operators.models import Config
from stylomill.plans import pipelines
from stylomill.plans.queries import query, table
from stylomill.session import shared_path, stored


def split(spark, sf_dir, keep=lambda d: stored(d, "dealt")):
    """(train, valid, test). The labelled rows are dealt once, and stored by keep."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return split_labelled(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), keep=keep)


def prepared_split(spark, sf_dir, cfg=Config()):
    """split() with the labelled rows prepared in one pass; test is as it was."""
    return split(spark, sf_dir, lambda d: models.prepared(d, cfg))


def vectors(spark, sf_dir, cfg=Config()):
    train, valid, _ = prepared_split(spark, sf_dir, cfg)
    found = models.fit_vectors(train, cfg)
    return found, *(stored(found.transform(d).select("id", "label", "features"), "vectors") for d in (train, valid))


def _scores(fit, raw=False):
    def run(spark, sf_dir):
        _, train, valid = vectors(spark, sf_dir)
        return models.predict(fit(train), valid, "p", raw).select(F.col("id").alias("doc_id"), "label", "p")

    return run


query("lr_scores")(_scores(models.fit_lr))
query("nb_scores")(_scores(models.fit_nb))
query("gbt_scores")(_scores(models.fit_gbt))
query("svc_scores")(_scores(models.fit_svc, raw=True))


@query("hashed_linear_scores")
def hashed_linear_scores(spark, sf_dir):
    train, valid = (models.hashed_vectors(d, binary=True).select("id", "label", "features") for d in prepared_split(spark, sf_dir)[:2])
    train, valid = stored(train, "hashed"), stored(valid, "hashed")
    return models.predict(models.fit_lr(train), valid, "p").select(F.col("id").alias("doc_id"), "label", "p")


@query("platt_scores")
def platt_scores(spark, sf_dir):
    _, train, valid = vectors(spark, sf_dir)
    rows = models.predict(models.fit_svc(train), valid, "s", raw=True)
    return models.fit_platt(rows, "s").apply(rows, "s", "p").select(F.col("id").alias("doc_id"), "label", "s", "p")


@query("ensemble_scores")
def ensemble_scores(spark, sf_dir):
    _, train, valid = vectors(spark, sf_dir)
    rows = models.predict(models.fit_nb(train), models.predict(models.fit_lr(train), valid, "p2"), "p1")
    return rows.select(F.col("id").alias("doc_id"), "label", models.ensemble("p1", "p2", 0.6).alias("p"))


@query("random_search_trials")
def random_search_trials(spark, sf_dir):
    _, train, _ = vectors(spark, sf_dir)
    cfg = Config(artifacts=shared_path(spark, "trials"))
    _, trials = models.random_search("nb", models.fit_nb, models.NB_SPACE, train.select("id", "label", "features"), cfg)
    return spark.createDataFrame([(t["cand_idx"], t["fold_idx"], t["status"], t["score"]) for t in trials], "cand_idx int, fold_idx int, status string, score double")


@query("top_coefficients")
def top_coefficients(spark, sf_dir):
    found, train, _ = vectors(spark, sf_dir)
    return spark.createDataFrame(models.coefficients(models.fit_lr(train), models.feature_names(found, Config())), "feature string, coefficient double")


@query("top_importances")
def top_importances(spark, sf_dir):
    found, train, _ = vectors(spark, sf_dir)
    return spark.createDataFrame(models.importances(models.fit_gbt(train), models.feature_names(found, Config())), "feature string, gain double")


@query("submission")
def submission(spark, sf_dir):
    return pipelines.rules_prevalence(*prepared_split(spark, sf_dir))[0]


@query("baseline_submission")
def baseline_submission(spark, sf_dir):
    return pipelines.baseline(*prepared_split(spark, sf_dir))[0]


@query("tuned_submission")
def tuned_submission(spark, sf_dir):
    """Both searches over their whole grids, then the heads."""
    return pipelines.tuned(*prepared_split(spark, sf_dir), Config(columns=X.TUNED, n_iter=None, artifacts=shared_path(spark, "trials")))[0]


@query("holdout_trials")
def holdout_trials(spark, sf_dir):
    """The search that scores each candidate on the validation rows."""
    _, train, valid = vectors(spark, sf_dir)
    _, trials = models.tune_holdout("nb", models.fit_nb, models.NB_SPACE, train, valid, Config(artifacts=shared_path(spark, "trials")))
    return spark.createDataFrame([(t["iter_idx"], t["status"], t["f1"]) for t in trials], "iter_idx int, status string, f1 double")


@query("knn_projected")
def knn_projected(spark, sf_dir):
    """The majority of the 11 nearest by the cosine of projections to 512 dimensions; all labelled validation rows ask."""
    _, train, valid = vectors(spark, sf_dir)
    return knn.fit_knn(train).transform(valid).select(F.col("id").alias("doc_id"), "label", F.col("prediction").cast("int").alias("pred"))


@query("charcnn_scores")
def charcnn_scores(spark, sf_dir):
    train, valid, _ = split(spark, sf_dir)
    return models.positive(charcnn.fit(train).transform(valid), "p").select(F.col("id").alias("doc_id"), "label", "p")


@query("best_refit")
def best_refit(spark, sf_dir):
    """The best of two models by validation, fitted anew on train and validation rows, on the documents without a label."""
    train, valid, test = prepared_split(spark, sf_dir)
    test = models.prepared(test, Config())
    found = models.fit_vectors(train, Config())
    train, valid, test = (stored(found.transform(d).select(*(c for c in ("id", "label", "features") if c in d.columns or c == "features")), "vectors") for d in (train, valid, test))
    fitters = {"nb": models.fit_nb, "svc": models.fit_svc}
    name = models.best_model(models.compare(fitters, train, valid, cv=())).first()["model"]
    return models.fit_and_predict(fitters[name], train, valid, test)


@query("model_comparison")
def model_comparison(spark, sf_dir):
    """Six models; macro F1 over 5 folds for the linear ones and the neighbours, and on the validation rows for all."""
    _, train, valid = vectors(spark, sf_dir)
    linear = {"LogReg": models.fit_lr, "LinSVM": models.fit_svc, "Boosted": lambda d: models.fit_gbt(d, n_estimators=200, max_depth=7, learning_rate=0.12, subsample=0.9, colsample_bytree=0.9)}
    found = models.compare(linear, train, valid, cv=("LogReg", "LinSVM"), folds={"LogReg": models.fit_lr_folds, "LinSVM": models.fit_svc_folds})
    near = [stored(knn.project_vectors(d).select("id", "label", "projected"), "projected") for d in (train, valid)]  # once for all folds
    found = found.unionByName(models.compare({"KNN(Proj)": lambda d: knn.fit_knn(d, vector="projected")}, *near))
    texts = [models.prepared(d, Config()) for d in split(spark, sf_dir)[:2]]
    hashed = [stored(models.hashed_vectors(d, binary=True).select("id", "label", "features"), "hashed") for d in texts]
    found = found.unionByName(models.compare({"EmbBag": models.fit_lr}, *hashed, cv=()))
    found = found.unionByName(models.compare({"CharCNN": charcnn.fit}, *split(spark, sf_dir)[:2], cv=()))
    return found.unpivot("model", ["cv_f1", "val_f1"], "score", "value")
