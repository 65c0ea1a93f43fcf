"""The engine's own operators against plain Python, and invariants."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylomill.functions import text as X
from stylomill.operators import folds, heads, knn, metrics, models, ranking, tfidf
from stylomill.sources import files

EDGE = ["", None, "   ", "abc", "abc.\n", "abc  ", "abc ", "Éléphant, naïve!", "a b c d e a b c d", "a b c d e a b c d e", "zap zap zap quux blip", "zap zap zap quux", "w " * 101, "!!!???", "a\rb\tc", "The THE the", "x_1 ٣ ², 9"]


@pytest.fixture(scope="module")
def feats(spark):
    df = spark.createDataFrame(list(enumerate(EDGE)), "doc_id long, text string")
    return {r["doc_id"]: r.asDict() for r in X.with_features(df).collect()}


def test_features(feats):
    for i, t in enumerate(EDGE):
        t, r = t or "", feats[i]
        tk = t.split()
        assert r["text_length"] == len(t) and r["word_count"] == len(tk)
        assert r["sentence_count"] == max(1, len(re.findall("[.!?]+", t)))
        assert r["punct_count"] == len(re.findall(r"[^\w\s]", t.replace("_", "")))
        assert r["avg_sentence_length"] == min(len(tk) / r["sentence_count"], 100)
        assert math.isclose(r["punct_ratio"], min(r["punct_count"] / max(len(t), 1), 0.3))
        low = [x.lower() for x in tk]
        assert math.isclose(r["ttr"], len(set(low)) / len(low) if low else 0)
        assert math.isclose(r["digit_ratio"], len(re.findall(r"\d", t)) / max(len(t), 1))
        assert math.isclose(r["upper_ratio"], len(re.findall("[A-Z]", t)) / max(len(t), 1))
        assert (r["bangs"], r["questions"]) == (t.count("!"), t.count("?"))
        assert r["ends_with_letter"] == int(bool(re.search("[A-Za-z]$", t.rstrip()) and t.rstrip()))
        grams = [tuple(tk[k : k + 5]) for k in range(len(tk) - 4)]
        assert r["has_5gram_repetition"] == int(len(tk) >= 10 and len(set(grams)) < len(grams))
        u = [w for w in re.findall(r"\w+", t.lower()) if w not in X.COMMON_WORDS]
        assert r["max_uncommon_binary"] == int(len(u) >= 5 and any(u.count(w) >= 3 for w in u))


def test_clean_text_and_ngrams(spark):
    df = spark.createDataFrame([("a\rb\tc\x00\n",), (None,), ("ab😀",)], "text string")
    assert [r[0] for r in df.select(X.clean_text(F.col("text"))).collect()] == ["a\nbc\n", "", "ab😀"]
    assert [r[0] for r in df.select(X.char_ngrams(F.col("text"), 2, 3)).collect()][1:] == [[], ["ab", "b😀", "ab😀"]]
    g = spark.createDataFrame([(["a", "b", "c"],), ([],)], "tk array<string>").select(X.word_ngrams(F.col("tk"), 1, 3, "_"))
    assert [r[0] for r in g.collect()] == [["a", "b", "c", "a_b", "b_c", "a_b_c"], []]


def scored(spark, n=500, seed=1):
    rng = random.Random(seed)
    return [(i, round(rng.random(), 2), round(rng.random(), 3), int(rng.random() < 0.4)) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(scored(spark), "id long, p1 double, p2 double, label int").repartition(5).cache()


def test_ranks_and_running_sums(spark, frame):
    rows = [tuple(r) for r in frame.collect()]
    got = {r["id"]: r["rn"] for r in ranking.by_md5(frame, "rn", "id").collect()}
    order = sorted(got, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert [got[i] for i in order] == list(range(1, len(rows) + 1))
    for k in (3, 7):
        fold = {r["id"]: r["fold"] for r in folds.shuffled_folds(frame, k).collect()}
        parts = np.array_split(order, k)
        assert all(fold[i] == f for f, part in enumerate(parts) for i in part.tolist())
        strat = folds.stratified_folds(frame, k).groupBy("label", "fold").count().collect()
        for y in (0, 1):
            sizes = [r["count"] for r in strat if r["label"] == y]
            assert max(sizes) - min(sizes) <= 1


def test_metrics(spark, frame):
    rows = [tuple(r) for r in frame.collect()]
    auc = metrics.roc_auc(frame, p="p1").first()[0]
    pos, neg = ([r[1] for r in rows if r[3] == y] for y in (1, 0))
    assert math.isclose(auc, sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    assert math.isclose(auc, metrics.roc_auc(frame.withColumn("q", F.col("p1") * F.col("p1")), p="q").first()[0])
    curve = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_curve(frame, p="p1").collect())
    assert curve[0] == (0, 0) and curve[-1] == (1, 1)
    assert math.isclose(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:])), auc)


def f1_of(rows, pred):
    tp = sum(r[3] and p for r, p in zip(rows, pred))
    return 2 * tp / max(1, sum(r[3] for r in rows) + sum(pred))


def test_sweep_is_the_loop(spark, frame):
    rows = [tuple(r) for r in frame.collect()]
    ws, ts = metrics.weights()[::5], metrics.thresholds()
    got = {(r["w"], r["thr"]): r["f1"] for r in metrics.sweep(frame, ws, ts).collect()}
    want = {(w, t): f1_of(rows, [w * r[1] + (1 - w) * r[2] >= t for r in rows]) for w in ws for t in ts}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert len(metrics.thresholds(0.9)) == 80 and len(ts) == 81
    top = metrics.best(metrics.sweep(frame, ws, ts)).first()
    assert (top["w"], top["thr"]) == max(want, key=lambda k: (want[k], -k[0], -k[1]))


def test_prevalence_and_heads(spark, frame):
    rows = [tuple(r) for r in frame.collect()]
    for rate in (0.0, 0.125, 0.5, 1.0):
        flags = {r["id"]: r["flag"] for r in metrics.prevalence_flags(frame, spark.createDataFrame([(rate,)], "r double"), "p1").collect()}
        k = round(rate * len(rows))
        top = [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]]
        assert sum(flags.values()) == k and all(flags[i] for i in top)
    ruled = frame.withColumns({"a": (F.col("p1") > 0.5).cast("int"), "b": (F.col("p2") > 0.9).cast("int")})
    swept = {r["rule"]: r["f1"] for r in metrics.rule_sweep(ruled, ["a", "b"]).collect()}
    assert math.isclose(swept["a|b"], f1_of(rows, [r[1] > 0.5 or r[2] > 0.9 for r in rows])) and len(swept) == 3
    ranked = heads.ranking(ruled, ruled, ["a", "b"]).orderBy("place").collect()
    assert [r["f1"] for r in ranked] == sorted((r["f1"] for r in ranked), reverse=True)
    for r in ranked:
        p = f"{r['w']} * p1 + (1 - {r['w']}) * p2"
        out = heads.decide(ruled.withColumns({"y": F.col("label"), "p": F.expr(p)}).drop("label"), r).collect()
        # what is applied scores as it was judged
        assert math.isclose(f1_of([(0, 0, 0, x["y"]) for x in out], [x["label"] for x in out]), r["f1"]), r


def test_report(spark, frame):
    rows = [tuple(r) for r in frame.collect()]
    got = {r["row"]: r for r in metrics.classification_report(frame.withColumn("pred", metrics.over("p1", 0.5))).collect()}
    pred = [int(r[1] >= 0.5) for r in rows]
    assert math.isclose(got["1"]["f1"], f1_of(rows, pred)) and got["0"]["support"] == sum(not r[3] for r in rows)
    assert math.isclose(got["accuracy"]["f1"], sum(p == r[3] for p, r in zip(pred, rows)) / len(rows))
    empty = frame.where("false").withColumn("pred", F.lit(0))
    assert metrics.confusion(empty).first().asDict() == {"tn": 0, "fp": 0, "fn": 0, "tp": 0}


def test_tfidf_matches_the_ml_path(spark):
    texts = ["red green blue green", "red red yellow fox", "blue fox jumps high", "nothing shared here"]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "id long, text string, label int")
    cfg = models.Config(columns=("word_count",), ngrams=2, max_features=50, min_df=1)
    rows = models.prepared(df, cfg)
    vectors = models.fit_vectors(rows, cfg)
    names = vectors.names()
    ml = {(r["id"], names[int(i)]): v for r in vectors.transform(rows).collect() for i, v in zip(r["features"].indices, r["features"].values) if i}
    tf = tfidf.term_counts(rows, X.word_ngrams(F.col("tokens"), 1, 2))
    rel = {(r["id"], r["term"]): r["weight"] for r in tfidf.weighted(tf, tfidf.idf(tfidf.vocabulary(tfidf.document_frequency(tf), 50), df)).collect()}
    assert ml.keys() == rel.keys() and all(math.isclose(ml[k], rel[k]) for k in ml)
    for i in range(4):
        assert math.isclose(sum(v * v for (k, _), v in rel.items() if k == i), 1)


def test_platt_and_search(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, x := rng.gauss(0, 1), int(rng.random() < 1 / (1 + math.exp(-2 * x)))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, s double, label int")
    p = models.fit_platt(df, "s")
    n1 = sum(r[2] for r in rows)
    hi, lo = (n1 + 1) / (n1 + 2), 1 / (300 - n1 + 2)
    grad = [0.0, 0.0]
    for _, s, y in rows:
        d = 1 / (1 + math.exp(-(p.a * s + p.b))) - (hi if y else lo)
        grad = [grad[0] + d * s, grad[1] + d]
    assert max(map(abs, grad)) < 1e-2 and p.a > 0
    assert len(models.candidates({"a": [1, 2], "b": [1]}, 9, 1)) == 2
    from pyspark.ml.feature import VectorAssembler

    vec = VectorAssembler(inputCols=["s"], outputCol="features").transform(df).select("id", "label", "features")
    cfg = models.Config(n_iter=2, kfolds=2, artifacts=str(tmp_path))

    def fit(d, C):
        if C == 1:
            raise ValueError("no")
        return models.fit_lr(d, C=C, max_iter=5)

    best, trials = models.random_search("x", fit, {"C": [1, 2]}, vec, cfg)
    assert best == {"C": 2} and sorted(t["status"] for t in trials) == ["fail", "fail", "ok", "ok"]
    assert models.random_search("x", fit, {"C": [1, 2]}, vec, cfg)[1] == trials
    # other rows of as many and the same size have trials of their own
    other = vec.withColumn("label", 1 - F.col("label"))
    calls = []

    def counted(d, C):
        calls.append(C)
        return models.fit_lr(d, C=C, max_iter=2)

    models.random_search("x", counted, {"C": [1, 2]}, other, cfg)
    assert len(calls) == 4
    models.random_search("x", counted, {"C": [1, 2]}, other.repartition(3), cfg)
    assert len(calls) == 4
    best, trials = models.tune_holdout("x", counted, {"C": [1, 2]}, vec, other, cfg)
    assert len(trials) == 2 and best in ({"C": 1}, {"C": 2}) and models.tune_holdout("x", counted, {"C": [1, 2]}, vec, other, cfg)[1] == trials
    assert len(calls) == 6


def test_knn(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((40, 8))
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(m)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = knn.nearest(df, df.where("vec_id % 7 = 0"), 5).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 40, 7):
        want = sorted((j for j in range(40) if j != q), key=lambda j: (-(u[q] @ u[j]), j))[:5]
        assert [r["neighbour"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == want
    assert len(knn.random_projection(df, 16).first()["projected"]) == 16


def test_files(spark, tmp_path):
    body = 'id,text,label\n1,"two\nlines, ""quoted""",0\n2,x,1\n'.encode()
    for i in range(3):
        (tmp_path / f"train.csv.part{i}").write_bytes(body[i * 15 : (i + 1) * 15 if i < 2 else None])
    (tmp_path / "train.csv.sha256").write_text(hashlib.sha256(body).hexdigest() + "  train.csv\n")
    assert files.resolve_path("train.csv", tmp_path.name, tmp_path.parent) == tmp_path / "train.csv"
    p = files.reassemble(tmp_path / "train.csv")
    rows = files.validate(files.read_csv(spark, str(p), files.TRAIN), "train").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'two\nlines, "quoted"', 0), (2, "x", 1)]
    (tmp_path / "val.csv.part0").write_bytes(b"x")
    (tmp_path / "val.csv.sha256").write_text("0" * 64)
    with pytest.raises(ValueError):
        files.reassemble(tmp_path / "val.csv")
    assert not (tmp_path / "val.csv").exists() and not (tmp_path / "val.csv.tmp").exists()
    with pytest.raises(FileNotFoundError):
        files.reassemble(tmp_path / "none.csv")
    df = spark.createDataFrame(rows)
    with pytest.raises(ValueError):
        files.validate(df, "test")
    files.write_submission(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        files.write_submission(df.withColumn("label", F.lit(2)), str(tmp_path / "bad"))
    log = files.TrialLog(spark, tmp_path, "log")
    log.append({"cand_idx": 0, "fold_idx": np.int64(1), "status": "ok", "score": np.float64(0.5), "params": {"a": (1, 2)}})
    (tmp_path / "log" / "000001-broken.json").write_text('{"broken": ')
    assert len(log.rows()) == 1
    row = log.frame().where("status = 'ok'").first()
    assert row["score"] == 0.5 and row["params"].replace(" ", "") == '{"a":[1,2]}'
    found = files.read_split(spark, str(tmp_path / "train.csv"), "train").orderBy("id").collect()
    assert [r["text"] for r in found] == ['two\nlines, "quoted"', "x"]
    with pytest.raises(FileNotFoundError):
        files.read_split(spark, str(tmp_path / "none.csv"), "test")
    files.write_results(spark.createDataFrame([("a", 0.5)], "model string, val_f1 double"), str(tmp_path / "results"))
    assert spark.read.option("header", True).csv(str(tmp_path / "results")).first()["model"] == "a"
    assert files.signature({"b": 1, "a": 2}) == files.signature({"a": 2, "b": 1}) and len(files.signature({})) == 10


def test_stream(spark, tmp_path):
    from stylomill.streaming import score

    df = spark.createDataFrame([(1, "a b c."), (2, None)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    rows = score.score_stream(score.read_documents(spark, str(tmp_path / "in"), df.schema))
    score.write_stream(rows, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert {r["doc_id"]: r["word_count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 3, 2: 0}
