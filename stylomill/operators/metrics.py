"""Evaluation of scored rows (label, p): one pass and small tables, never rows on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylomill.operators.ranking import ranked, running, unit_part

#: np.arange(.1, .9, .01) and np.arange(.1, .91, .01), whose doubles carry noise; and the weights 0, 0.05, ... 1.


def thresholds(stop: float = 0.91) -> list[float]:
    import numpy as np

    return [float(x) for x in np.arange(0.1, stop, 0.01)]


def weights() -> list[float]:
    import numpy as np

    return [float(x) for x in np.linspace(0.0, 1.0, 21)]


def over(p: str | Column, threshold: float) -> Column:
    return ((F.col(p) if isinstance(p, str) else p) >= threshold).cast("int")


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    n = lambda a, b: F.coalesce(F.sum(F.when((F.col(label) == a) & (F.col(pred) == b), 1)), F.lit(0)).cast("long")
    return df.agg(n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(1, 1).alias("tp"))


def safe(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1).otherwise(b))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return safe(2 * tp, 2 * tp + fp + fn)


def binary_f1(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return confusion(df, label, pred).select(f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def by_class(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(cls, tp, n_pred, support) for each class in labels or predictions: two rows of counts for each, then one sum."""
    a, b = F.col(label).cast("long"), F.col(pred).cast("long")
    hit = (a == b).cast("long")
    rows = df.select(F.explode(F.array(F.struct(a.alias("cls"), hit.alias("tp"), F.lit(0).cast("long").alias("n_pred"), F.lit(1).cast("long").alias("support")), F.struct(b.alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(1).cast("long").alias("n_pred"), F.lit(0).cast("long").alias("support")))).alias("r")).select("r.*")
    return rows.groupBy("cls").agg(*(F.sum(c).alias(c) for c in ("tp", "n_pred", "support")))


def macro_f1(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return by_class(df, label, pred).select(f1(F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("support") - F.col("tp")).alias("f")).agg(F.avg("f").alias("f1_macro"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(row, precision, recall, f1, support): each class, accuracy, and macro and weighted means."""
    c = by_class(df, label, pred).withColumns({"precision": safe(F.col("tp"), F.col("n_pred")), "recall": safe(F.col("tp"), F.col("support"))})
    c = c.withColumn("f1", f1(F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("support") - F.col("tp")))
    cols = ("precision", "recall", "f1")
    rows = c.select(F.col("cls").cast("string").alias("row"), *cols, "support")
    total = F.sum("support").alias("support")
    acc = F.sum("tp") / F.sum("support")
    out = rows.unionByName(c.agg(*(acc.alias(x) for x in cols), total).withColumn("row", F.lit("accuracy")))
    out = out.unionByName(c.agg(*(F.avg(x).alias(x) for x in cols), total).withColumn("row", F.lit("macro avg")))
    return out.unionByName(c.agg(*((F.sum(F.col(x) * F.col("support")) / F.sum("support")).alias(x) for x in cols), total).withColumn("row", F.lit("weighted avg")))


def curve(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """(p, pos, neg, tp, fp): for each distinct score the labels at it, and those at it or above."""
    per = df.groupBy(F.col(p).alias("p")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    return running(per, "p", {"pos": "tp", "neg": "fp"})


def _totals(df: DataFrame, label: str) -> DataFrame:
    return F.broadcast(df.agg(F.sum(F.col(label).cast("long")).alias("n_pos"), F.sum(1 - F.col(label).cast("long")).alias("n_neg")))  # one row


def roc_curve(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """(threshold, fpr, tpr), tied scores as one point, and the origin with a null threshold."""
    points = curve(df, label, p).join(_totals(df, label)).select(F.col("p").alias("threshold"), safe(F.col("fp"), F.col("n_neg")).alias("fpr"), safe(F.col("tp"), F.col("n_pos")).alias("tpr"))
    origin = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def pr_curve(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    return curve(df, label, p).join(_totals(df, label)).select(F.col("p").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), safe(F.col("tp"), F.col("n_pos")).alias("recall"))


def roc_auc(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """(auc): the share of pairs of a positive and a negative that the score orders, ties counting half. 0.5 with one class only."""
    pairs = curve(df, label, p).select((F.col("neg") * (2 * (F.col("tp") - F.col("pos")) + F.col("pos"))).alias("twice"))
    return pairs.agg(F.sum("twice").alias("t")).join(_totals(df, label)).select(F.when(F.col("n_pos") * F.col("n_neg") == 0, 0.5).otherwise(F.col("t") / (2.0 * F.greatest(F.col("n_pos") * F.col("n_neg"), F.lit(1)))).alias("auc"))


def passed(p: Column, at: list[float]) -> Column:
    """How many of the evenly spaced thresholds p reaches: guessed by arithmetic, settled by comparing with the neighbours."""
    step = (at[-1] - at[0]) / (len(at) - 1)
    known = F.array(*(F.lit(x) for x in at))
    guess = F.least(F.greatest(F.floor((p - at[0]) / step) - 1, F.lit(0)), F.lit(len(at) - 3)).cast("int")
    return F.when(p < at[0], 0).otherwise(guess + sum((p >= known[guess + i]).cast("int") for i in range(3)))


def sweep(df: DataFrame, ws: list[float], at: list[float], p1: str = "p1", p2: str = "p2", label: str = "label") -> DataFrame:
    """(w, thr, tp, fp, fn, f1) for all weights and thresholds in one pass: rows count by weight and thresholds passed; the rest is sums of a small table."""
    spark = df.sparkSession
    ws_col = F.explode(F.array(*(F.lit(x) for x in ws))).alias("w")
    per = df.select(ws_col, p1, p2, F.col(label).cast("long").alias("y")).withColumn("k", passed(F.col("w") * F.col(p1) + (1 - F.col("w")) * F.col(p2), at))
    per = per.groupBy("w", "k").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    grid = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "i int, thr double")
    reached = lambda c: F.coalesce(F.sum(F.when(F.col("k") > F.col("i"), F.col(c))), F.lit(0)).cast("long")
    out = per.join(F.broadcast(grid)).groupBy("w", "thr").agg(reached("pos").alias("tp"), reached("neg").alias("fp"), F.sum("pos").alias("n_pos"))  # weights x thresholds x thresholds
    return out.select("w", "thr", "tp", "fp", (F.col("n_pos") - F.col("tp")).alias("fn")).withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def best(df: DataFrame) -> DataFrame:
    """The first best of a sweep: the smallest weight, then threshold."""
    return df.orderBy(F.col("f1").desc(), "w", "thr").limit(1)


def prevalence_flags(df: DataFrame, rate: DataFrame, p: str = "p", id_col: str = "id") -> DataFrame:
    """df with flag: 1 for the round(rate x rows) largest scores, half to even, ties by id. rate: one row, one column."""
    n = df.agg(F.count(F.lit(1)).alias("__n")).join(F.broadcast(rate.toDF("__rate")))
    k = n.select(F.bround(F.col("__rate") * F.col("__n")).cast("long").alias("__k"))
    rows = ranked(df, "__rn", [], [F.col(p).desc(), F.col(id_col)], unit_part(F.col(p)), descending=True)
    return rows.join(F.broadcast(k)).withColumn("flag", (F.col("__rn") <= F.col("__k")).cast("int")).drop("__rn", "__k")


def rule_sweep(df: DataFrame, rules: list[str], label: str = "label") -> DataFrame:
    """(rule, mask, tp, fp, fn, f1) for the OR of each non-empty subset of the rules, in one aggregate."""
    y, parts = F.col(label) == 1, []
    for mask in range(1, 1 << len(rules)):
        chosen = [r for i, r in enumerate(rules) if mask >> i & 1]
        flag = F.greatest(*chosen, F.lit(0)) == 1
        n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        parts.append(F.struct(F.lit("|".join(chosen)).alias("rule"), F.lit(mask).alias("mask"), n(y & flag).alias("tp"), n(~y & flag).alias("fp"), n(y & ~flag).alias("fn")))
    out = df.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return out.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def residuals(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """df with residual: label minus score."""
    return df.withColumn("residual", F.col(label) - F.col(p))


def qq_points(df: DataFrame, value: str, id_col: str = "id") -> DataFrame:
    """df's values (in [-1, 1]) with their normal plotting positions (i - 0.5) / n; the inverse normal is taken where they are drawn."""
    n = F.broadcast(df.agg(F.count(F.lit(1)).alias("__n")))
    rows = ranked(df, "rank", [], [F.col(value), F.col(id_col)], unit_part((F.col(value) + 1) / 2))
    return rows.join(n).withColumn("position", (F.col("rank") - 0.5) / F.col("__n")).drop("__n")


def quantiles(df: DataFrame, value: str, at: dict[str, float], by: str, id_col: str = "id") -> DataFrame:
    """(by, name...): for each group the exact quantiles of a value in [0, 1], between two ranks in proportion. Values are ranked by ranges, so no task holds a group; nulls don't count."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(by).alias("by"), F.col(value).cast("double").alias("v"), F.col(id_col).alias("id"))
    n = F.broadcast(rows.groupBy(F.col("by").alias("g")).agg(F.count(F.lit(1)).alias("n")))  # a row for each group
    placed = ranked(rows, "rank", [F.col("by")], [F.col("v"), F.col("id")], unit_part(F.col("v"))).join(n, F.col("by").eqNullSafe(F.col("g")))
    parts = []
    for name, q in at.items():
        place = F.lit(q) * (F.col("n") - 1)
        low = F.floor(place)
        share = F.when(F.col("rank") - 1 == low, 1 - (place - low)).when(F.col("rank") - 2 == low, place - low).otherwise(0.0)
        parts.append(F.sum(share * F.col("v")).alias(name))
    return placed.groupBy(F.col("by").alias(by)).agg(*parts)
