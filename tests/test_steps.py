"""Steps that several queries share are done once, and cheaper forms give what the plain ones do."""

import tracemalloc

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from stylomill.functions import text as X
from stylomill.operators import boosting, charcnn, knn, linear, models, tfidf
from stylomill.plans import model_queries, pipelines

SF = "/root/testdata/sf0.001"
ODD = ["", None, "a b c d e f g h i j", "a b c d e a b c d e", "a b c d e f a b c d e", "x " * 9, "x " * 10, "The  the\tTHE ça_va Ÿ9 ΣΑΣ a I 1 22 \U00010400 \U00010400b a-b", "one two\nthree four five six one two three four five"]


def test_labelled_rows_are_dealt_and_prepared_once(spark, monkeypatch):
    made, dealt = [], []
    monkeypatch.setattr(models, "text_features", lambda df, cfg, real=models.text_features: made.append(sorted(df.columns)) or real(df, cfg))
    keep = lambda d: dealt.append(1) or models.prepared(d, models.Config())
    _, train, valid = model_queries.vectors(spark, SF)
    assert len(made) == 1
    a, b, test = model_queries.split(spark, SF, keep)
    assert len(dealt) == 1 and "tokens" in a.columns
    plain = model_queries.split(spark, SF, lambda d: d)
    for got, want in ((train, plain[0]), (valid, plain[1]), (a, plain[0]), (b, plain[1]), (test, plain[2])):
        assert sorted(r[0] for r in got.select("id").collect()) == sorted(r[0] for r in want.select("id").collect())


def test_repeats_and_words_are_the_plain_loops(spark):
    rng = np.random.default_rng(3)
    texts = ODD + [" ".join(rng.choice(list("abcd"), n)) for n in range(4, 60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    rows = X.with_features(df, words="words").withColumns({"got": tfidf.model_words(F.col("words")), "want": tfidf.model_tokens(F.col("text"))}).collect()
    for r in rows:
        t = (texts[r["id"]] or "").split()
        grams = [tuple(t[i : i + 5]) for i in range(len(t) - 4)]
        assert r["has_5gram_repetition"] == int(len(t) >= 10 and len(set(grams)) < len(grams)), t
        assert r["got"] == r["want"], t
    assert "words" not in X.with_features(df).columns


def test_a_steps_job_has_its_rows_only(spark, monkeypatch):
    """Rows are dealt once for many steps: each is in one share of one step, and how many steps are dealt together doesn't matter."""
    rows = spark.createDataFrame([(i * 7919, i % 2, [i % 90] * charcnn.LENGTH) for i in range(100)], "h long, y int, ids array<int>").repartition(3)
    want = {r["h"]: r["s"] for r in rows.select("h", F.pmod(F.xxhash64(F.lit(1), F.lit(0), "h"), F.lit(5)).alias("s")).collect()}
    monkeypatch.setattr(charcnn, "STEPS", 2)
    found = {}
    for at in (0, 2, 4):
        dealt = charcnn._dealt(rows, 1, 0, 5, at, 3)
        for place, part in enumerate(dealt.glom().collect()):
            assert all(k == place for k, _ in part)
            found.update({x[0]: at + place // 3 for _, x in part})
    assert found == want
    df = spark.createDataFrame([(i, "zz qq " * 8 if i % 2 else "aa ee " * 8, i % 2) for i in range(40)], "id long, text string, label int")
    few = charcnn.fit(df, epochs=1, batch=8)
    monkeypatch.setattr(charcnn, "STEPS", 512)
    assert len(few.losses) >= 4 and np.allclose(few.losses, charcnn.fit(df.repartition(5), epochs=1, batch=8).losses, rtol=1e-6)


def test_wide_rows_travel_less_often(spark, monkeypatch):
    """Narrow types stay narrow, wide rows meet in larger blocks, which are compared in parts: neighbours are those of a plain loop."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((90, 128)).astype(np.float32)
    v[40:50] = v[3]
    df = spark.createDataFrame([(i, v[i].tolist(), i % 2) for i in range(90)], "vec_id long, embedding array<float>, label int").repartition(3)
    monkeypatch.setattr(knn, "BLOCK", 16)
    monkeypatch.setattr(knn, "TILE", 7)
    kinds, copied = [], []
    monkeypatch.setattr(knn, "stored", lambda d, name, real=knn.stored: kinds.append(dict(d.dtypes).get("v")) or real(d, name))
    monkeypatch.setattr(F, "sequence", lambda *a, real=F.sequence: copied.append(a) or real(*a))
    got = {(r["query"], r["rank"]): r["neighbour"] for r in knn.nearest(df, df, 5).collect()}
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    sim = np.round(u @ u.T, 12)
    for i in range(90):
        want = sorted((j for j in range(90) if j != i), key=lambda j: (-sim[i, j], j))[:5]
        assert [got[i, k + 1] for k in range(5)] == want
    assert {k for k in kinds if k} == {"array<float>"}
    assert str(copied[0][1]._jc.toString()) == "2"  # 90 queries in 3 chunks of 32; blocks of 16 would be 6


def few_rows(spark):
    rng = np.random.default_rng(4)
    x = np.abs(np.where(rng.random((150, 12)) < 0.4, rng.normal(1, 1, (150, 12)), 0.0))
    return spark.createDataFrame([(i, int(x[i, 0] + x[i, 1] > 1.2), Vectors.dense(x[i])) for i in range(150)], ["id", "label", "features"]).repartition(3)


def test_a_comparisons_folds_share_the_solvers_jobs(spark, monkeypatch):
    """Folds and the last model are fitted side by side, and score as those that are fitted alone (F4)."""
    df = few_rows(spark)
    train, valid = df.where("id < 110"), df.where("id >= 110")
    fitters = {"LogReg": models.fit_lr, "LinSVM": models.fit_svc}
    jobs, original = [], linear.Blocks.sum
    monkeypatch.setattr(linear.Blocks, "sum", lambda *a: jobs.append(1) or original(*a))
    alone = models.compare(fitters, train, valid).collect()
    n = len(jobs)
    side = models.compare(fitters, train, valid, folds={"LogReg": models.fit_lr_folds, "LinSVM": models.fit_svc_folds}).collect()
    assert len(jobs) - n < n / 3
    for a, b in zip(alone, side):
        assert a["model"] == b["model"] and np.allclose([a["cv_f1"], a["val_f1"]], [b["cv_f1"], b["val_f1"]], atol=0.02)
    assert [r["pred"] for r in (knn.fit_knn(d, k=5, vector=v).transform(knn.project_vectors(valid)).selectExpr("id", "prediction AS pred").orderBy("id") for d, v in ((train, None),)) for r in r.collect()] == [
        r["pred"] for r in knn.fit_knn(knn.project_vectors(train), k=5, vector="projected").transform(knn.project_vectors(valid)).selectExpr("id", "prediction AS pred").orderBy("id").collect()
    ]


def test_both_final_models_share_the_solvers_jobs(spark, monkeypatch):
    """The models on train, and on train and valid, are one fit's steps, and are those of fits alone (F5, F7)."""
    df = few_rows(spark)
    rows = df.withColumn("fold", (F.col("id") % 3 == 0).cast("int"))
    for wanted in ({}, {"C": 3.0, "class_weight": "balanced"}):
        for m, some in zip(models.fit_lr_folds(rows, [(wanted, 1), (wanted, -1)], tol=1e-10), (rows.where("fold = 0"), rows)):
            plain = models.fit_lr(some, **wanted, tol=1e-10)
            assert np.allclose(m.coefficients.toArray(), plain.coefficients.toArray(), atol=2e-3) and abs(m.intercept - plain.intercept) < 2e-3
    for m, some in zip(models.fit_svc_folds(rows, [({}, 1), ({}, -1)], tol=1e-10), (rows.where("fold = 0"), rows)):
        assert np.allclose(m.coefficients.toArray(), models.fit_svc(some, tol=1e-10).coefficients.toArray(), atol=2e-3)
    fits, original = [], linear.Blocks.__init__
    monkeypatch.setattr(linear.Blocks, "__init__", lambda *a, **k: fits.append(1) or original(*a, **k))
    docs = spark.createDataFrame([(i, f"Some words here, number {i % 3}, {'good' if i % 2 else 'bad'}.", i % 2) for i in range(24)], "id long, text string, label int")
    assert pipelines.rules_prevalence(docs.where("id < 16"), docs.where("id >= 16"), docs.drop("label"))[0].count() == 24
    assert len(fits) == 1


def test_a_networks_gradients_touch_chosen_windows_only():
    """Channels with one place are summed before they are spread, and no array of all windows' gradients is made (F1)."""
    p = charcnn.initial()
    ids = np.random.default_rng(0).integers(0, 90, (16, charcnn.LENGTH))
    ids[2:4, 100:] = 0  # padding: many maxima at one place
    z, held = charcnn.forward(p, ids)
    tracemalloc.start()
    g, _ = charcnn.backward(p, z.copy(), held, np.arange(16) % 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 61 << 20  # 58 MB; with the windows' gradients 64
    q = charcnn.probabilities(z)
    q[np.arange(16), np.arange(16) % 2] -= 1
    want, (_, _, _, _, y, top, h) = np.zeros_like(p["w2"]), held
    for r in range(16):
        for c in range(charcnn.SECOND):
            want[:, c] += y[r, top[r, c]] * (q[r] @ p["w3"][c]) * (h[r, c] > 0)
    assert np.allclose(g["w2"], want, atol=1e-4)


def test_a_blocks_splits_are_found_in_chunks(monkeypatch):
    """However many features are summed together, splits are the same, and memory is that of a chunk (F2, F3, F6)."""
    rng = np.random.default_rng(2)
    n, width, entries = 4000, 300, 400_000
    f, row = np.divmod(np.unique(rng.integers(0, n * width, entries)), n)
    value = np.round(rng.random(len(f)) - 0.2, 2)
    cuts = boosting.Cuts({i: np.linspace(-0.2, 0.8, 41) for i in range(width)}, width)
    part = boosting.Part(cuts.part(0, width), 0, row, cuts.keys(f, value))
    g, c, place = rng.normal(size=n), rng.random(n), rng.integers(-3, 5, n).astype(np.int16)
    g[row[(f == 7) & (value > 0.3)]] += 9.0
    totals = np.array([[x[place == k].sum() for k in range(5)] for x in (g, c)])
    found = {}
    for chunk in (1, 5000, 1 << 16, 1 << 30):
        monkeypatch.setattr(boosting, "CHUNK", chunk)
        tracemalloc.start()
        found[chunk] = sorted(part.best(g, c, place, totals, 0, boosting.Params()), key=lambda s: s[0])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        if chunk == 5000:
            small = peak
    assert small < peak / 4
    assert [s[0] for s in found[1]] == list(range(5)) and {int(cuts.feature[s[2]]) for s in found[1]} == {7}
    for other in found.values():
        for a, b in zip(found[1], other, strict=True):
            assert (a[0], a[2], a[5]) == (b[0], b[2], b[5]) and np.allclose((a[1], a[3], a[4]), (b[1], b[3], b[4])) and (a[6] == b[6]).all()
