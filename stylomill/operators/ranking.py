"""Global ranks and running sums without sending all rows to one task.

An ordered key is cut into ranges. A small table holds each range's total; its running sum is a range's offset. Within a
range, a window does the rest, so tasks hold a range's rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096


def md5_of(c: Column) -> Column:
    return F.md5(c.cast("string").cast("binary"))


def ranked(df: DataFrame, out: str, keys: list[Column], order: list[Column], part: Column, descending: bool = False) -> DataFrame:
    """df with out: the row's number from 1 within keys, by order. part is an integer that never falls along order (never rises, if descending)."""
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.withColumns({**dict(zip(names, keys)), "__part": part})
    per = rows.groupBy(*names, "__part").agg(F.count(F.lit(1)).alias("__n"))
    # ranges of all keys: at most RANGES rows for a key
    before = Window.partitionBy(*names).orderBy(F.col("__part").desc() if descending else F.col("__part")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    at = per.toDF(*(f"__r{n}" for n in names), "__rpart", "__before")
    on = F.col("__part").eqNullSafe(F.col("__rpart"))
    for n in names:
        on &= F.col(n).eqNullSafe(F.col(f"__r{n}"))
    nth = F.row_number().over(Window.partitionBy(*names, "__part").orderBy(*order))
    joined = rows.withColumn("__nth", nth).join(at, on)
    return joined.withColumn(out, (F.col("__before") + F.col("__nth")).cast("long")).drop(*names, "__part", "__before", "__nth", "__rpart", *(f"__r{n}" for n in names))


def by_md5(df: DataFrame, out: str, id_col: str, keys: list[Column] | None = None) -> DataFrame:
    """df with out: the row's number in the pseudo-random order of the id's md5."""
    digest = md5_of(F.col(id_col))
    part = F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")
    return ranked(df, out, keys or [], [digest, F.col(id_col)], part)


def unit_part(c: Column) -> Column:
    """The range of a number in [0, 1]."""
    return F.least(F.greatest(F.floor(c * RANGES), F.lit(0)), F.lit(RANGES - 1)).cast("int")


def running(df: DataFrame, score: str, sums: dict[str, str]) -> DataFrame:
    """df, one row for each score in [0, 1], with sums[x], the running sum of column x from the largest score down."""
    rows = df.withColumn("__part", unit_part(F.col(score)))
    per = rows.groupBy("__part").agg(*(F.sum(x).alias(f"__s_{x}") for x in sums))
    before = Window.orderBy(F.col("__part").desc()).rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    per = per.select(F.col("__part").alias("__p"), *(F.coalesce(F.sum(f"__s_{x}").over(before), F.lit(0)).alias(f"__b_{x}") for x in sums))
    within = Window.partitionBy("__part").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"__w_{x}": F.sum(x).over(within) for x in sums}).join(per, F.col("__part") == F.col("__p"))
    return out.withColumns({name: F.col(f"__w_{x}") + F.col(f"__b_{x}") for x, name in sums.items()}).drop("__part", "__p", *(f"__{k}_{x}" for x in sums for k in "wb"))
