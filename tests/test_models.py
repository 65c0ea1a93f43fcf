"""Boosting, the character network, neighbours in projections, model store, hooks and quantiles against plain code."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from stylomill.functions import hooks
from stylomill.operators import boosting, charcnn, folds, knn, linear, metrics, models
from stylomill.sources import files


def sparse_rows(spark, n=240, width=30, seed=1):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, width)) < 0.2, np.round(rng.normal(1, 1, (n, width)), 2), 0.0)
    y = ((x[:, 3] > 0.8) ^ (x[:, 5] > 0) | (rng.random(n) < 0.05)).astype(int)
    rows = [(i, int(y[i]), Vectors.dense(x[i]) if i % 3 else Vectors.sparse(width, np.flatnonzero(x[i]).tolist(), x[i][x[i] != 0].tolist())) for i in range(n)]
    return spark.createDataFrame(rows, ["id", "label", "features"]).repartition(3), x, y


def plain_boosting(x, y, p, cuts):
    """Exact greedy trees over the given cuts, by loops."""
    w = np.where(y == 1, (len(y) - y.sum()) / y.sum(), 1.0)
    margin = np.zeros(len(y))
    for _ in range(p.n_estimators):
        q = 1 / (1 + np.exp(-margin))
        g, h = w * (q - y), w * q * (1 - q)
        leaf = lambda rows: -p.learning_rate * g[rows].sum() / (h[rows].sum() + p.reg_lambda)

        def grow(rows, depth):
            best = (1e-9, None)
            tg, th = g[rows].sum(), h[rows].sum()
            for f in range(x.shape[1]):
                for c in cuts.get(f, ()):
                    a = rows[x[rows, f] <= c]
                    lg, lh = g[a].sum(), h[a].sum()
                    if lh < p.min_child_weight or th - lh < p.min_child_weight:
                        continue
                    gain = 0.5 * (lg**2 / (lh + p.reg_lambda) + (tg - lg) ** 2 / (th - lh + p.reg_lambda) - tg**2 / (th + p.reg_lambda))
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, c))
            if depth == p.max_depth or best[1] is None:
                margin[rows] += leaf(rows)
                return
            f, c = best[1]
            grow(rows[x[rows, f] <= c], depth + 1), grow(rows[x[rows, f] > c], depth + 1)

        grow(np.arange(len(y)), 0)
    return margin


def test_boosting_is_the_plain_loop(spark):
    df, x, y = sparse_rows(spark)
    p = boosting.Params(n_estimators=6, max_depth=3, learning_rate=0.3, chunk=4, min_child_weight=0.93)
    cuts = {}
    for f in range(x.shape[1]):
        v = np.unique(np.r_[x[:, f], 0.0])
        cuts[f] = (v[1:] + v[:-1]) / 2
    want = plain_boosting(x, y, p, cuts)
    for local in (boosting.LOCAL_BYTES, 0):  # in one process, and as Spark jobs
        model = boosting.fit(df, p, local_bytes=local)
        got = {r["id"]: r["rawPrediction"][1] for r in model.transform(df).collect()}
        assert np.allclose([got[i] for i in range(len(y))], want, atol=1e-6)
    assert math.isclose(model.featureImportances.sum(), 1) and set(np.argsort(-model.featureImportances)[:2]) == {3, 5}


def test_boosting_resumes_stops_and_stands_cases(spark, tmp_path):
    df, x, y = sparse_rows(spark)
    folder = files.Folder(spark, str(tmp_path / "m"))
    p = boosting.Params(n_estimators=8, max_depth=3, chunk=3, subsample=0.8, colsample_bytree=0.7, reg_alpha=0.1, reg_lambda=0.5, min_child_weight=0.5)
    whole = boosting.fit(df, p, folder=folder)
    names = folder.names()
    assert [int(n[-11:-5]) for n in names] == [3, 6, 8]
    for n in names[1:]:
        folder.fs.delete(folder._path(n), False)
    again = boosting.fit(df, p, folder=folder)
    assert again.dumps() == whole.dumps() == boosting.BoostedModel.loads(whole.dumps()).dumps()
    grown = []
    original = boosting.grow
    boosting.grow = lambda *a: grown.append(1) or original(*a)
    try:
        boosting.fit(df, p, folder=folder)
        assert not grown
        boosting.fit(df.withColumn("label", 1 - F.col("label")), p, folder=folder)  # other rows
        assert len(grown) == 8
    finally:
        boosting.grow = original
    valid, _, _ = sparse_rows(spark, seed=2)
    noise = valid.withColumn("label", (F.rand(3) < 0.5).cast("int"))
    stopped = boosting.fit(df, boosting.Params(n_estimators=40, chunk=5, early_stop=5, learning_rate=0.5), valid=noise)
    assert len(stopped.trees) < 40
    nulls = df.withColumn("label", F.when(F.col("id") % 5 > 0, F.col("label"))).withColumn("n", F.lit(1)).withColumn("v", F.lit(2))
    assert boosting.fit(nulls, p).trees
    for some, prior in ((df.where("false"), 0.5), (df.where("label = 1"), None)):
        rows = boosting.fit(some, p).transform(df.limit(2)).collect()
        assert all(r["probability"][1] == 0.5 if prior else r["probability"][1] > 0.9 for r in rows)
    assert models.importances(whole, [f"f{i}" for i in range(30)], 3)[0][0] in ("f3", "f5")


def test_charcnn_gradients_and_learning(spark):
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in charcnn.initial(1).items()}
    ids, y = rng.integers(0, 90, (3, 40)), np.array([0, 1, 1])
    z, held = charcnn.forward(p, ids)
    g, loss = charcnn.backward(p, z, held, y)
    for k in p:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in p[k].shape) if k != "emb" else (ids[0, 5], 3)
            q = {n: v.copy() for n, v in p.items()}
            q[k][at] += 1e-5
            z2, held2 = charcnn.forward(q, ids)
            assert abs((charcnn.backward(q, z2, held2, y)[1] - loss) / 1e-5 - g[k][at]) < 1e-2 * max(1, abs(g[k][at])), k
    rows = [(i, "zzz qqq xxx " * 8 if i % 2 else "aaa eee ooo " * 8, i % 2) for i in range(64)] + [(99, None, 0), (98, "no label", None)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    a, b = charcnn.fit(df, epochs=4, batch=32), charcnn.fit(df.repartition(5), epochs=4, batch=32)
    assert a.losses[-1] < a.losses[0] / 2 and np.allclose(a.losses, b.losses, rtol=1e-3)
    got = a.transform(df).where("id < 64").collect()
    assert sum(r["prediction"] == r["label"] for r in got) >= 60
    assert charcnn.fit(df.where("false")).transform(df).count() == 66


def test_columns_named_like_internal_ones(spark):
    df = spark.createDataFrame([(i, i % 2, "a", "b", "c", Vectors.dense([float(i)])) for i in range(11)], ["id", "label", "__nth_row", "__ALL_ROWS", "__margin", "features"])
    plain = df.select("id", "label")
    for clash, own in ((folds.shuffled_folds(df, 3), folds.shuffled_folds(plain, 3)), (folds.stratified_folds(df.withColumnRenamed("__margin", "__nth_of_label"), 3), folds.stratified_folds(plain, 3))):
        assert {r["id"]: r["fold"] for r in clash.collect()} == {r["id"]: r["fold"] for r in own.collect()} and {"__nth_row", "__ALL_ROWS"} < set(clash.columns)
    scored = boosting.BoostedModel([], 0.0, 1).transform(df)
    assert [r["__margin"] for r in scored.collect()] == ["c"] * 11 and scored.where("prediction = 1").count() == 11


def test_charcnn_saved_and_resumed(spark, tmp_path):
    """A fit that broke off after its first epochs ends with the weights of one that didn't; changed files are refused."""
    rows = [(i, "zzz qqq xxx " * 8 if i % 2 else "aaa eee ooo " * 8, i % 2) for i in range(48)]
    df = spark.createDataFrame(rows, "id long, text string, label int").coalesce(1)
    folder = files.Folder(spark, f"{tmp_path}/epochs")
    whole = charcnn.fit(df, epochs=3, batch=16)
    part = charcnn.fit(df, epochs=2, batch=16, folder=folder)
    assert part.epochs == 2 and len(folder.names()) == 2
    resumed = charcnn.fit(df, epochs=3, batch=16, folder=folder)
    assert len(folder.names()) == 3 and len(resumed.losses) == len(whole.losses) and np.allclose(resumed.losses, whole.losses, rtol=1e-5)
    assert all(np.allclose(resumed.weights[k], whole.weights[k], atol=1e-5) for k in whole.weights)
    assert charcnn.fit(df, epochs=1, batch=16, folder=folder).epochs == 1
    assert len(charcnn.fit(df.where("id < 40"), epochs=1, batch=16, folder=folder).losses) == 3 and len(folder.names()) == 4  # other rows: a start of its own
    store = files.ModelStore(spark, f"{tmp_path}/store")
    store.save(resumed, "charcnn", {"batch": 16})
    loaded = store.load("charcnn", {"batch": 16}, charcnn.CharCnn)
    assert all((loaded.weights[k] == resumed.weights[k]).all() and (loaded.moments[k][1] == resumed.moments[k][1]).all() for k in resumed.weights)
    text = resumed.dumps()
    at = text.index("AA")  # of an array: digests are lower-case
    with pytest.raises(ValueError):
        charcnn.CharCnn.loads(text[:at] + "BB" + text[at + 2 :])


def test_neighbours_in_projections(spark):
    df, x, y = sparse_rows(spark)
    got = {r["id"]: np.array(r["projected"]) for r in knn.project_vectors(df, 64).collect()}
    again = {r["id"]: np.array(r["projected"]) for r in knn.project_vectors(df.repartition(7), 64).collect()}
    m = np.stack([got[i] for i in range(len(y))])
    assert all(np.allclose(got[i], again[i], atol=1e-4) for i in got)
    r = np.linalg.lstsq(x, m, rcond=None)[0]
    assert np.allclose(x @ r, m, atol=1e-3) and abs(r.std() - 1) < 0.1  # linear, of standard normal numbers
    model = knn.fit_knn(df.where("id % 4 > 0"), k=5, dim=64)
    pred = {q["id"]: q["prediction"] for q in model.transform(df.where("id % 4 = 0")).collect()}
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    train = [i for i in range(len(y)) if i % 4]
    for i, v in pred.items():
        s = u[train] @ u[i]
        near = sorted(range(len(train)), key=lambda j: (-round(float(s[j]), 9), train[j]))[:5]
        assert v == float(np.mean([y[train[j]] for j in near]) >= 0.5) or np.isclose(*np.sort(s)[[-6, -5]], atol=1e-6)


def test_neighbours_cases(spark):
    schema = "vec_id long, embedding array<double>, label int, id long, v int, similarity double"
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 9, 9, 0.1), (2, [1.0, 0.0], None, 9, 9, 0.1), (3, None, 1, 9, 9, 0.1), (4, [0.0, 0.0], 0, 9, 9, 0.1), (None, [0.5, 0.5], 0, 9, 9, 0.1)], schema)
    got = knn.nearest(df.where("vec_id IS NOT NULL"), df.where("vec_id < 4"), 2).collect()
    assert {(r["query"], r["rank"], r["neighbour"]) for r in got} == {(1, 1, 2), (1, 2, 4), (2, 1, 1), (2, 2, 4)}
    assert knn.nearest(df.where("false"), df.where("vec_id = 1"), 2).count() == 0 == knn.nearest(df, df.where("false"), 2).count()


@pytest.mark.parametrize("pivots, block", [(256, 4096), (12, 20), (5, 7)])
def test_neighbours_are_exact_whatever_the_groups(spark, pivots, block):
    """Clusters that prune, copies that tie, rows of length 0, a hot group; against all pairs."""
    rng = np.random.default_rng(pivots)
    centres = rng.normal(size=(6, 5)) * 4
    v = np.concatenate([centres[rng.integers(0, 6, 150)] + rng.normal(size=(150, 5)) * 0.2, np.repeat(centres[:1], 60, axis=0), np.zeros((3, 5)), rng.normal(size=(20, 5))])
    df = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").repartition(4)
    report = {}
    got = {}
    for r in knn.nearest(df, df.where("vec_id % 3 = 0"), 5, pivots=pivots, block=block, report=report).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["neighbour"], r["similarity"], r["label"])
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    assert sorted(got) == list(range(0, len(v), 3))
    for i, found in got.items():
        s = u @ u[i]
        s[i] = -np.inf
        want = np.sort(s)[::-1][:5]
        assert np.allclose([found[r][1] for r in range(1, 6)], want, atol=1e-9) and len({found[r][0] for r in range(1, 6)}) == 5
        assert all(abs(s[j] - x) < 1e-9 and l == j % 3 for j, x, l in found.values())
        if i % 3 == 0 and 150 <= i < 210:  # exact copies: ties by id
            assert [found[r][0] for r in range(1, 6)] == [j for j in range(150, 210) if j != i][:5]
    assert 0 <= report["pruned"] <= 1 and (pivots != 12 or report["pruned"] > 0.3)


def test_model_store(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    df, _, _ = sparse_rows(spark)
    store = files.ModelStore(spark, str(tmp_path / "store"))
    assert store.load("lr", {"C": 1}, LogisticRegressionModel) is None
    lr, gbt = models.fit_lr(df, max_iter=5), models.fit_gbt(df, n_estimators=3, max_depth=2)
    store.save(lr, "lr", {"C": 1})
    store.save(gbt, "gbt", {"n": 3})
    assert np.allclose(store.load("lr", {"C": 1}, LogisticRegressionModel).coefficients.toArray(), lr.coefficients.toArray())
    assert store.load("lr", {"C": 2}, LogisticRegressionModel) is None
    assert store.load("lr", {"C": 2}, LogisticRegressionModel, fallback=True).intercept == lr.intercept
    assert store.load("gbt", {"n": 3}, boosting.BoostedModel).dumps() == gbt.dumps()


def test_hooks(spark):
    def make():
        return lambda a, b: a * 2 + b

    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(hooks.scorer(make)("a", "b")).collect()][:2] == [4.0, 10.0]
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = str(public.path("word_bpe_49k.json"))
    t = tokenizers.Tokenizer.from_file(path)
    texts = ["some words of text", "", None, "long " * 50]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", hooks.subword_ids(path, 12, -1)("text").alias("ids")).collect()
    for r in got:
        want = t.encode(texts[r["i"]] or "", add_special_tokens=False).ids[:12]
        assert list(r["ids"]) == want + [-1] * (12 - len(want))


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(v), "a" if i % 3 else None) for i, v in enumerate(np.round(rng.random(400), 2))] + [(900, None, "a"), (901, 0.25, "one")]
    got = {r["g"]: r for r in metrics.quantiles(spark.createDataFrame(rows, "id long, v double, g string"), "v", {"q1": 0.25, "q9": 0.9}, "g").collect()}
    for g in ("a", None, "one"):
        v = [r[1] for r in rows if r[2] == g and r[1] is not None]
        assert np.allclose([got[g]["q1"], got[g]["q9"]], np.quantile(v, [0.25, 0.9]))


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_logistic_regressions_are_sparks(spark, parts):
    from pyspark.ml.classification import LogisticRegression

    df, _, _ = sparse_rows(spark)
    rows = df.unionByName(spark.createDataFrame([(900, None, None)], df.schema)).repartition(parts)
    for how in ({"C": 0.5}, {"C": 2.0, "class_weight": "balanced"}):
        a = models.fit_lr(rows, tol=1e-12, **how)
        weighted = models.class_weights(df, how.get("class_weight"))
        b = LogisticRegression(regParam=1 / (how["C"] * 240), standardization=False, maxIter=1000, tol=1e-12, weightCol="w").fit(weighted)
        assert np.allclose(a.coefficients.toArray(), b.coefficients.toArray(), atol=1e-3) and abs(a.intercept - b.intercept) < 1e-3
        got = a.transform(df).select("probability", "prediction").collect()
        assert len(got) == 240 and all(0 <= r["probability"][1] <= 1 for r in got)


def test_hinge_and_cases(spark):
    df, x, y = sparse_rows(spark)
    m = models.fit_svc(df, reg=0.1, tol=1e-12)
    c, sign = np.r_[m.coefficients.toArray(), m.intercept], 2 * y - 1
    short = np.maximum(0, 1 - sign * (x @ c[:-1] + c[-1]))
    slope = np.r_[(-2 * (sign * short)[:, None] * x).mean(axis=0) + 0.1 * c[:-1], (-2 * sign * short).mean()]
    assert np.abs(slope).max() < 1e-3  # at the optimum
    assert (m.transform(df).where("prediction = label").count()) > 180
    empty = models.fit_lr(df.where("false"))
    assert empty.coefficients.toArray().tolist() == [0.0] and empty.intercept == 0
    one = models.fit_lr(df.where("label = 1"))
    assert np.isfinite(one.intercept) and one.transform(df).where("prediction = 1").count() == 240


def test_mined_terms_are_all_terms_counted(spark):
    """Against counting every term of every length: ties, repeats, nulls, a vocabulary smaller than the terms, filters too small to tell terms apart."""
    from stylomill.operators import ngrams

    rng = np.random.default_rng(5)
    docs = [" ".join(rng.choice(list("abcdef"), rng.integers(0, 30))).split() for _ in range(60)]
    docs += [docs[3]] * 4 + ["x y z w v u t s r q p o n".split()] * 3 + [None, []]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "id long, tokens array<string>").repartition(3)
    counts = {}
    for t in docs:
        grams = [" ".join(t[i : i + n]) for n in range(1, 12) for i in range(len(t) - n + 1)] if t else []
        for g in grams:
            counts.setdefault(g, [0, 0])[1] += 1
        for g in set(grams):
            counts[g][0] += 1
    for size, min_df, slice_tokens, bits in ((10_000, 2, 1 << 20, 1 << 24), (40, 1, 37, 1 << 24), (300, 3, 100, 64)):
        got = [tuple(r) for r in ngrams.mine(df, 11, size, min_df, bits=bits, slice_tokens=slice_tokens).select("term", "df", "cf").collect()]
        want = sorted(((g, *n) for g, n in counts.items() if n[0] >= min_df), key=lambda x: (-x[2], x[0]))[:size]
        assert sorted(got, key=lambda x: (-x[2], x[0])) == want, size
    assert ngrams.mine(df.where("false"), 11, 10).count() == 0
    vectors = ngrams.TextVectors([g for g, *_ in want], [1.0 + i % 3 for i in range(len(want))], ("id",))
    again = ngrams.TextVectors.loads(vectors.dumps())
    for r in again.transform(df).collect():
        t = docs[r["id"]] or []
        tf = {}
        for n in range(1, 12):
            for i in range(len(t) - n + 1):
                g = " ".join(t[i : i + n])
                if g in set(vectors.terms):
                    tf[g] = tf.get(g, 0) + vectors.idf[vectors.terms.index(g)]
        norm = math.sqrt(sum(v * v for v in tf.values()))
        place = {g: i + 1 for i, g in enumerate(vectors.terms)}
        want_v = {place[g]: v / norm for g, v in tf.items()} | ({0: float(r["id"])} if r["id"] else {})
        got_v = dict(zip(r["features"].indices.tolist(), r["features"].values.tolist()))
        assert got_v.keys() == want_v.keys() and all(math.isclose(got_v[k], want_v[k]) for k in got_v)
    nothing = ngrams.TextVectors([], [], ("id",)).transform(df).first()
    assert nothing["features"].size == 2


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_one_array_of_a_sum_comes_to_the_driver(spark, monkeypatch, parts):
    df, x, _ = sparse_rows(spark)
    blocks = linear.Blocks(df.repartition(parts))
    came, collect = [], type(blocks.rdd).collect
    monkeypatch.setattr("pyspark.core.rdd.RDD.collect", lambda rdd: came.append(collect(rdd)) or came[-1])
    got = blocks.sum(lambda b: np.stack(b.moments(30)))
    blocks.free()
    assert np.allclose(got, [x.sum(axis=0), (x**2).sum(axis=0)])
    assert len(came) == 1 and sum(r[1].size for r in came[0]) == 60


def test_boosting_by_features_by_rows_and_without_walks(spark, monkeypatch):
    """Blocks of features, in this process and as jobs, give the trees that blocks of rows give, and no pass walks earlier trees."""
    df, x, y = sparse_rows(spark)
    p = boosting.Params(n_estimators=6, max_depth=3, chunk=4, subsample=0.8, colsample_bytree=0.7, min_child_weight=2.0)
    walked, original = [], boosting.Rows.node
    monkeypatch.setattr(boosting.Rows, "node", lambda *a: walked.append(1) or original(*a))
    near = boosting.fit(df, p)
    assert not walked
    monkeypatch.setattr(boosting, "PART_ENTRIES", 200)
    as_jobs, by_rows = boosting.fit(df, p, local_bytes=0), boosting.fit(df, p, column_rows=0)
    for other in (as_jobs, by_rows):
        for a, b in zip(near.trees, other.trees, strict=True):
            assert a.feature == b.feature and a.left == b.left and np.allclose(a.cut, b.cut) and np.allclose(a.value, b.value)


def test_search_fits_folds_side_by_side(spark, tmp_path, monkeypatch):
    """Trials of one search share the solver's jobs, and score as those that are fitted alone."""
    df, x, y = sparse_rows(spark)
    cfg = models.Config(n_iter=3, kfolds=2, artifacts=str(tmp_path / "alone"))
    jobs, original = [], linear.Blocks.sum
    monkeypatch.setattr(linear.Blocks, "sum", lambda *a: jobs.append(1) or original(*a))
    best, alone = models.random_search("lr", models.fit_lr, models.LR_SPACE, df, cfg)
    n = len(jobs)
    found, side = models.random_search("lr", models.fit_lr, models.LR_SPACE, df, models.Config(n_iter=3, kfolds=2, artifacts=str(tmp_path / "side")), folds=models.fit_lr_folds)
    assert len(jobs) - n < n / 2 and found == best
    assert [(t["cand_idx"], t["fold_idx"], t["status"]) for t in side] == [(t["cand_idx"], t["fold_idx"], t["status"]) for t in alone]
    assert np.allclose([t["score"] for t in side], [t["score"] for t in alone], atol=0.02)
    rows = folds.stratified_folds(df, 2)
    for (params, k), m in zip(wanted := [({"C": 0.3, "class_weight": "balanced"}, 0), ({"C": 3.0}, 1)], models.fit_lr_folds(rows, wanted, tol=1e-10)):
        plain = models.fit_lr(rows.where(F.col("fold") != k), **params, tol=1e-10)
        assert np.allclose(m.coefficients.toArray(), plain.coefficients.toArray(), atol=1e-3) and abs(m.intercept - plain.intercept) < 1e-3
