"""Classifiers on text features and n-gram weights, calibration, ensembles and search, with Spark ML."""

from __future__ import annotations

import itertools
import random
import time
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylomill.functions import text as X
from stylomill.operators import boosting, linear, metrics, ngrams, tfidf
from stylomill.operators.folds import shuffled_folds, stratified_folds
from stylomill.session import spread, stored
from stylomill.sources.files import Folder, TrialLog, signature


@dataclass(frozen=True)
class Config:
    """One configuration for all pipelines; all of it is honoured. The defaults are the reference's."""

    columns: tuple[str, ...] = X.FULL
    ngrams: int = 11
    max_features: int = 50_000
    min_df: int = 2
    kfolds: int = 3
    #: Candidates that a search draws; None for the whole grid.
    n_iter: int | None = 8
    seed: int = 42
    weight: float = 0.6
    artifacts: str = "artifacts"


#: The search spaces of the tuned pipeline, and of the one with rules. Solvers have no counterpart, so they aren't searched.
LR_SPACE = {"C": [0.1, 0.3, 1.0, 3.0, 10.0], "class_weight": [None, "balanced"]}
GBT_SPACE = {
    "n_estimators": [500], "max_depth": [3, 4, 5, 6, 7], "learning_rate": [0.03, 0.05, 0.07, 0.1], "subsample": [0.7, 0.8, 0.9],
    "colsample_bytree": [0.6, 0.8, 1.0], "reg_alpha": [0.0, 0.1, 0.5], "reg_lambda": [0.5, 1.0, 1.5],
}
RULES_LR_SPACE = {"C": [0.5, 1.0, 2.0, 4.0], "class_weight": [None, "balanced"]}
RULES_GBT_SPACE = {
    "n_estimators": [500], "max_depth": [4, 6, 8], "learning_rate": [0.05, 0.1], "min_child_weight": [1, 3], "subsample": [0.7, 1.0],
    "colsample_bytree": [0.7, 1.0], "reg_alpha": [0.0, 0.1, 0.5], "reg_lambda": [0.5, 1.0, 1.5],
}
NB_SPACE = {"alpha": [0.01, 0.05, 0.1, 0.5, 1.0]}


def text_features(df: DataFrame, cfg: Config) -> DataFrame:
    """df with the numeric features and tokens, the words that terms are made of; without text."""
    return X.with_features(df, words="tokens").withColumn("tokens", tfidf.model_words(F.col("tokens"))).drop("text")


def prepared(df: DataFrame, cfg: Config) -> DataFrame:
    """text_features() stored, as the vocabulary and the vectors both read it. The rows are stored before that: then their size is known, and how many tasks they are worth."""
    return stored(text_features(spread(stored(df, "rows")), cfg), "features")


def fit_vectors(train: DataFrame, cfg: Config) -> ngrams.TextVectors:
    """The vectors of terms of 1 to cfg.ngrams words, fitted on train only; train has been prepared."""
    vocab = ngrams.mine(train, cfg.ngrams, cfg.max_features, cfg.min_df)
    rows = tfidf.idf(vocab, train).orderBy(F.col("cf").desc(), "term").select("term", "idf").collect()  # max_features rows
    return ngrams.TextVectors([r["term"] for r in rows], [r["idf"] for r in rows], cfg.columns)


def hashed_vectors(df: DataFrame, dim: int = 1 << 19, binary: bool = False, words: tuple[int, int] = (1, 2)) -> DataFrame:
    """df with features, the hashed terms of its tokens."""
    rows = df.withColumn("grams", X.word_ngrams(F.col("tokens"), *words))
    return HashingTF(numFeatures=dim, binary=binary, inputCol="grams", outputCol="features").transform(rows).drop("grams", "tokens")


def balance(mode: str | None, n0: int, n1: int) -> tuple[float, float]:
    """The weights of negatives and positives."""
    if mode is None:
        return 1.0, 1.0
    return (1.0, n0 / max(n1, 1)) if mode == "scaled" else ((n0 + n1) / (2 * max(n0, 1)), (n0 + n1) / (2 * max(n1, 1)))


def class_weights(df: DataFrame, mode: str | None, label: str = "label") -> DataFrame:
    """df with w: 1, n / (2 n_c) if balanced, or n0 / n1 for positives if scaled."""
    if mode is None:
        return df.withColumn("w", F.lit(1.0))
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    w0, w1 = balance(mode, n.get(0, 0), n.get(1, 0))
    return df.withColumn("w", F.when(F.col(label) == 1, w1).otherwise(w0))


#: Bytes of training rows for a task. A step of a solver is a job, so small tables shouldn't be many tasks.
TASK_BYTES = 32 << 20


def size_of(df: DataFrame) -> int:
    """What Spark takes df's size for: that of files, for stored tables."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def packed(df: DataFrame) -> DataFrame:
    """df in no more partitions than its size asks for."""
    wanted = max(1, -(-size_of(df) // TASK_BYTES))
    return df.coalesce(wanted) if wanted < df.sparkSession.sparkContext.defaultParallelism else df


def fit_lr(df: DataFrame, C: float = 1.0, class_weight: str | None = None, max_iter: int = 1000, tol: float = 1e-6):
    """Logistic regression with the inverse regularization C."""
    return linear.fit(class_weights(df, class_weight), C, max_iter, tol)


def fold_counts(rows: DataFrame) -> np.ndarray:
    """Labelled rows by fold, and by whether the label is 1."""
    found = rows.where("label IS NOT NULL").groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()  # two rows a fold
    counts = np.zeros((max([r["fold"] for r in found], default=0) + 1, 2))
    for r in found:
        counts[r["fold"], int(r["label"] == 1)] += r["n"]
    return counts


def fit_lr_folds(rows: DataFrame, wanted: list[tuple[dict, int]], max_iter: int = 1000, tol: float = 1e-6) -> list:
    """fit_lr() with each of (parameters, fold left out) on the rows of the other folds, one job a step for all; fold -1 leaves out none."""
    counts = fold_counts(rows)
    rest = lambda k: (int(x) for x in linear.without_fold(counts, k).sum(axis=0))
    return linear.fit_folds(rows, [(k, p.get("C", 1.0), np.array(balance(p.get("class_weight"), *rest(k)))) for p, k in wanted], counts, max_iter, tol)


def fit_svc_folds(rows: DataFrame, wanted: list[tuple[dict, int]], max_iter: int = 1000, tol: float = 1e-6) -> list:
    """fit_svc() with each of (parameters, fold left out), as in fit_lr_folds()."""
    return linear.fit_hinge_folds(rows, [(k, p.get("reg", 0.01)) for p, k in wanted], fold_counts(rows), max_iter, tol)


def fit_nb(df: DataFrame, alpha: float = 1.0):
    """Multinomial naive Bayes; polarity, the one feature that may be negative, is at least -1 and 0.0 here."""
    return NaiveBayes(modelType="multinomial", smoothing=alpha).fit(df)


def fit_gbt(df: DataFrame, valid: DataFrame | None = None, folder: Folder | None = None, **params):
    """Boosted trees, 500 of depth 6 unless params say otherwise; positives weigh n0 / n1. With a folder, training resumes from its last chunk."""
    return boosting.fit(df, boosting.Params(**params), valid=valid, folder=folder)


def fit_svc(df: DataFrame, reg: float = 0.01, max_iter: int = 1000, tol: float = 1e-6):
    """A linear classifier of squared hinge loss."""
    return linear.fit_hinge(df, reg, max_iter, tol)


def positive(df: DataFrame, out: str, column: str = "probability") -> DataFrame:
    return df.withColumn(out, vector_to_array(column)[1])


MODEL_COLUMNS = ("rawPrediction", "probability", "prediction")


def predict(model, df: DataFrame, out: str, raw: bool = False) -> DataFrame:
    """df with out: the positive class's probability, or its raw score."""
    return positive(model.transform(df), out, "rawPrediction" if raw else "probability").drop(*MODEL_COLUMNS)


@dataclass
class Platt:
    """Sigmoid of a score, fitted on held-out rows."""

    a: float
    b: float

    def apply(self, df: DataFrame, score: str, out: str) -> DataFrame:
        return df.withColumn(out, 1 / (1 + F.exp(-(self.a * F.col(score) + self.b))))


def fit_platt(df: DataFrame, score: str, label: str = "label", smoothed: bool = True, reg: float = 0.0) -> Platt:
    """Smoothed targets stand in as two weighted rows for each row."""
    n = df.agg(F.sum(F.col(label)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = float(n["p"] or 0), float(n["n"] - (n["p"] or 0))
    t = F.when(F.col(label) == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2)) if smoothed else F.col(label).cast("double")
    both = df.select(array_to_vector(F.array(F.col(score).cast("double"))).alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("y"), t.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - t).alias("w")))).alias("r"))
    rows = packed(both.select("features", F.col("r.y").alias("label"), F.col("r.w").alias("w")).where("w > 0"))
    m = LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-9, weightCol="w").fit(rows)
    return Platt(float(m.coefficients[0]), float(m.intercept))


def ensemble(p1: str, p2: str, weight: float):
    return weight * F.col(p1) + (1 - weight) * F.col(p2)


def candidates(space: dict[str, list], n_iter: int | None, seed: int) -> list[dict]:
    """min(n_iter, grid) distinct points of the grid, drawn without replacement; all of them in the grid's order, if n_iter is None."""
    grid = [dict(zip(sorted(space), values)) for values in itertools.product(*(space[k] for k in sorted(space)))]
    if n_iter is None:
        return grid
    return random.Random(seed).sample(grid, min(n_iter, len(grid)))


def identity(df: DataFrame, id_col: str = "id", label: str = "label", features: str = "features") -> dict:
    """What tells a table of training rows from another: rows, features, and a hash of the content, whatever its order."""
    v = F.unwrap_udt(F.col(features))
    row = F.xxhash64(F.col(id_col), F.col(label).cast("double"), v["indices"], v["values"])
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.max(v["size"]).alias("size"), F.max(F.size(v["values"])).alias("dense"), F.bit_xor(row).alias("content"), F.sum(F.pmod(row, F.lit(1 << 30))).alias("sum")).first()
    return seen.asDict()


def _trial(fit, train: DataFrame, valid: DataFrame, params: dict, score: str) -> dict:
    try:
        scored = fit(train, **params).transform(valid).withColumn("pred", F.col("prediction").cast("int"))
        return {"status": "ok", score: metrics.binary_f1(scored).first()[0], "error": None}
    except Exception as e:  # a candidate that can't be fitted is a trial, too
        return {"status": "fail", score: None, "error": str(e)[:500]}


#: Trials that are fitted side by side: each holds some 40 arrays of the features' number on the driver.
TRIALS = 15


def random_search(name: str, fit, space: dict[str, list], df: DataFrame, cfg: Config, id_col: str = "id", retry_failed: bool = False, folds=None) -> tuple[dict, list[dict]]:
    """Best parameters and all trials of a stratified search that resumes from its log of the same rows and settings. Every candidate is tried on every fold, however long it takes. A candidate counts if all its folds scored; of ties the first wins.

    folds(rows, [(parameters, fold)]) gives the models of several trials at once, TRIALS at most; where it can't, fit makes each alone.
    """
    found = candidates(space, cfg.n_iter, cfg.seed)
    log = TrialLog(df.sparkSession, cfg.artifacts, f"{name}-{signature({'space': space, 'n': cfg.n_iter, 'k': cfg.kfolds, 'seed': cfg.seed, 'data': identity(df, id_col)})}")
    trials = log.rows()
    done = {(r["cand_idx"], r["fold_idx"]) for r in trials if not (retry_failed and r["status"] != "ok")}
    rows = stored(stratified_folds(df, cfg.kfolds, id_col=id_col), "folds")
    open_, made = [(i, k) for i in range(len(found)) for k in range(cfg.kfolds) if (i, k) not in done], {}

    def ahead(i: int, k: int) -> None:
        """Fits this trial and those after it."""
        at = open_.index((i, k))
        some = open_[at : at + TRIALS]
        try:
            made.update(zip(some, folds(rows, [(found[a], b) for a, b in some])))
        except Exception:  # one of them can't be fitted; each is tried alone
            made.update(dict.fromkeys(some))

    for i, params in enumerate(found):
        for k in range(cfg.kfolds):
            if (i, k) in done:
                continue
            at = time.time()
            if folds and (i, k) not in made:
                ahead(i, k)
            model = made.pop((i, k), None)
            row = _trial((lambda d, model=model, **_: model) if model else fit, rows.where(F.col("fold") != k), rows.where(F.col("fold") == k), params, "score")
            log.append({"cand_idx": i, "fold_idx": k, "elapsed_sec": time.time() - at, "params": params} | row)
    trials = log.rows()
    scores = {i: {r["fold_idx"]: r["score"] for r in trials if r["cand_idx"] == i and r["status"] == "ok"} for i in range(len(found))}
    whole = [(sum(s.values()) / len(s), -i) for i, s in scores.items() if len(s) >= cfg.kfolds]
    return (found[-max(whole)[1]] if whole else found[0]), trials


def tune_holdout(name: str, fit, space: dict[str, list], train: DataFrame, valid: DataFrame, cfg: Config) -> tuple[dict, list[dict]]:
    """As random_search(), but each candidate is scored once, on valid."""
    found = candidates(space, cfg.n_iter, cfg.seed)
    log = TrialLog(train.sparkSession, cfg.artifacts, f"{name}-holdout-{signature({'space': space, 'n': cfg.n_iter, 'seed': cfg.seed, 'data': [identity(train), identity(valid)]})}")
    done = {r["iter_idx"] for r in log.rows()}
    for i, params in enumerate(found):
        if i not in done:
            log.append({"iter_idx": i, "params": params} | _trial(fit, train, valid, params, "f1"))
    trials = log.rows()
    ok = [(r["f1"], -r["iter_idx"]) for r in trials if r["status"] == "ok"]
    return (found[-max(ok)[1]] if ok else found[0]), trials


def coefficients(model, names: list[str], top: int = 25) -> list[tuple[str, float]]:
    """The largest coefficients by absolute value; of ties the first feature."""
    ranked = sorted(enumerate(model.coefficients.toArray()), key=lambda x: (-abs(x[1]), x[0]))[:top]
    return [(names[i], float(c)) for i, c in ranked]


def importances(model, names: list[str], top: int = 25) -> list[tuple[str, float]]:
    ranked = sorted(enumerate(model.featureImportances), key=lambda x: (-x[1], x[0]))[:top]
    return [(names[i], float(c)) for i, c in ranked]


def feature_names(vectors: ngrams.TextVectors, cfg: Config) -> list[str]:
    return vectors.names()


def cross_validate(fit, df: DataFrame, k: int = 5, id_col: str = "id") -> float:
    """Mean macro F1 over k shuffled folds."""
    rows = stored(shuffled_folds(df, k, id_col), "folds")  # its size is known, so small tables are fitted in one process
    scores = []
    for i in range(k):
        scored = fit(rows.where(F.col("fold") != i)).transform(rows.where(F.col("fold") == i))
        scores.append(metrics.macro_f1(scored.withColumn("pred", F.col("prediction").cast("int"))).first()[0] or 0.0)
    return sum(scores) / k


def compare(fitters: dict, train: DataFrame, valid: DataFrame, k: int = 5, cv: tuple[str, ...] | None = None, folds: dict | None = None) -> DataFrame:
    """(model, cv_f1, val_f1): macro F1 by folds of train, and on valid. Models that cv leaves out have NaN for cv_f1; cv = None is all.

    folds has functions (rows, [(parameters, fold left out)]) of models, as fit_lr_folds(), that fit those of all folds and the last one side by side.
    """

    def f1(model, rows: DataFrame) -> float:
        return metrics.macro_f1(model.transform(rows).withColumn("pred", F.col("prediction").cast("int"))).first()[0] or 0.0

    found = []
    if folds:
        dealt = stored(shuffled_folds(train, k, "id"), "folds")
    for name, fit in fitters.items():
        scored = cv is None or name in cv
        if folds and name in folds and scored:
            *some, last = folds[name](dealt, [({}, i) for i in [*range(k), -1]])
            found.append((name, sum(f1(m, dealt.where(F.col("fold") == i)) for i, m in enumerate(some)) / k, f1(last, valid)))
        else:
            found.append((name, cross_validate(fit, train, k) if scored else float("nan"), f1(fit(train), valid)))
    return train.sparkSession.createDataFrame(found, "model string, cv_f1 double, val_f1 double")


def best_model(comparison: DataFrame, by: str = "val_f1") -> DataFrame:
    """The row of the best model; NaN is never the best."""
    return comparison.where(~F.isnan(by)).orderBy(F.col(by).desc(), "model").limit(1)


def fit_and_predict(fit, train: DataFrame, valid: DataFrame, test: DataFrame) -> DataFrame:
    """test's predictions by a model fitted anew on train and valid."""
    cols = ["id", "label", "features"]
    return fit(train.select(*cols).unionByName(valid.select(*cols))).transform(test).select("id", F.col("prediction").cast("int").alias("label"))
