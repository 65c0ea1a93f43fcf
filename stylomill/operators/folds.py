"""Splits and folds that any engine can reproduce: by the md5 of the id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylomill.functions.text import unused_name
from stylomill.operators.ranking import by_md5


def stratified_folds(df: DataFrame, k: int, label: str = "label", id_col: str = "id") -> DataFrame:
    """df with fold: the rows of each label are dealt in turn, so folds of a label differ by one row at most."""
    nth = unused_name("nth_of_label", df.columns)
    return by_md5(df, nth, id_col, [F.col(label)]).withColumn("fold", F.pmod(F.col(nth) - 1, F.lit(k)).cast("long")).drop(nth)


def shuffled_folds(df: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """df with fold: consecutive parts of the shuffled rows, the first n % k parts longer by one."""
    nth, all_rows = unused_name("nth_row", df.columns), unused_name("all_rows", df.columns)
    ranked = by_md5(df, nth, id_col)
    n = df.agg(F.count(F.lit(1)).alias(all_rows))
    size, extra = F.floor(F.col(all_rows) / k), F.col(all_rows) % k
    at, long_part = F.col(nth) - 1, (size + 1) * extra
    fold = F.when(at < long_part, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - long_part) / F.greatest(size, F.lit(1))))
    return ranked.join(F.broadcast(n)).withColumn("fold", fold.cast("long")).drop(nth, all_rows)


def split_labelled(docs: DataFrame, labels: DataFrame, folds: int = 5, valid_fold: int = 0, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, valid, test): labelled documents by fold, and those without a label. keep makes a stored table of the dealt rows, which train and valid both read; without it each deals them anew."""
    rows = docs.join(labels, "doc_id").withColumnRenamed("doc_id", "id")
    dealt = keep(stratified_folds(rows, folds))
    test = docs.join(labels, "doc_id", "left_anti").withColumnRenamed("doc_id", "id")
    return dealt.where(F.col("fold") != valid_fold), dealt.where(F.col("fold") == valid_fold), test
