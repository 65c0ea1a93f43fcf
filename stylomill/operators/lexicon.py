"""Sentiment from a word list: a table (word, polarity, subjectivity) joined to the tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylomill.functions import text as X
from stylomill.operators import tfidf


def sentiment(df: DataFrame, lexicon: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """(id, sentiment_polarity, sentiment_subjectivity): means over the tokens that the list knows; 0.0 for documents without any."""
    tf = tfidf.term_counts(df, X.tokens(F.lower(X.whole(F.col(text))), X.WORD), id_col)
    n = F.sum("tf")
    mean = lambda c: F.sum(F.col("tf") * F.col(c)) / n
    known = tf.join(lexicon.withColumnRenamed("word", "term"), "term").groupBy("id").agg(mean("polarity").alias("sentiment_polarity"), mean("subjectivity").alias("sentiment_subjectivity"))
    return df.select(F.col(id_col).alias("id")).distinct().join(known, "id", "left").na.fill(0.0, ["sentiment_polarity", "sentiment_subjectivity"])


def shares(df: DataFrame, lexicon: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """(id, sent_neg, sent_neu, sent_pos, sent_compound): shares of tokens by the sign of their polarity, and the normed sum s / sqrt(s^2 + 15)."""
    tf = tfidf.term_counts(df, X.tokens(F.lower(X.whole(F.col(text))), X.WORD), id_col)
    p = F.coalesce("polarity", F.lit(0.0))
    rows = tf.join(lexicon.withColumnRenamed("word", "term"), "term", "left")
    n, s = F.sum("tf"), F.sum(F.col("tf") * p)
    share = lambda cond: F.sum(F.when(cond, F.col("tf")).otherwise(0)) / n
    out = rows.groupBy("id").agg(share(p < 0).alias("sent_neg"), share(p == 0).alias("sent_neu"), share(p > 0).alias("sent_pos"), (s / F.sqrt(s * s + 15)).alias("sent_compound"))
    return df.select(F.col(id_col).alias("id")).distinct().join(out, "id", "left").na.fill(0.0)
