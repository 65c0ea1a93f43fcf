"""N-gram statistics as relations: one row for a document and term, aggregated early, joined with small vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylomill.functions import text as X
from stylomill.operators import grams as G
from stylomill.session import stored

MODEL_WORD = r"[\p{L}\p{N}_]{2,}"


def model_tokens(text: Column, stop: tuple[str, ...] = X.COMMON_WORDS) -> Column:
    """Lower-case words of two characters or more, without stop words; n-grams are made of what is left."""
    return F.filter(X.tokens(F.lower(X.whole(text)), MODEL_WORD), lambda w: ~w.isin(*stop)) if stop else X.tokens(F.lower(X.whole(text)), MODEL_WORD)


def model_words(words: Column, stop: tuple[str, ...] = X.COMMON_WORDS) -> Column:
    """model_tokens() from a text's words in lower case: those of two characters or more are the same runs."""
    return F.filter(words, lambda w: (F.char_length(w) >= 2) & ~w.isin(*stop) if stop else F.char_length(w) >= 2)


def term_counts(df: DataFrame, tokens: Column, id_col: str = "id", lo: int = 1, hi: int = 1, sep: str = " ") -> DataFrame:
    """(id, term, tf): each document's n-grams of lo to hi tokens, counted within rows. Only ids of several rows are shuffled."""
    return G.by_row(df.select(F.col(id_col).alias("id"), tokens.alias("units")), "id", G.term_counter(lo, hi, sep), "term string")


def document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df, cf) from term_counts()."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def gram_counts(df: DataFrame, tokens: Column, lo: int = 1, hi: int = 1, sep: str = " ") -> DataFrame:
    """(term, df, cf) of the n-grams of an array of tokens a row, in one shuffle of what slices of rows sum up to."""
    return G.counted(df.select(tokens.alias("units")), lo, hi, sep, True).where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def gram_df(df: DataFrame, units: Column, lo: int = 1, hi: int = 1, sep: str = "", term: str = "term") -> DataFrame:
    """(term, df) of the n-grams of a row's units, which are an array's elements or a text's characters, in one shuffle of what slices of rows sum up to."""
    return G.counted(df.select(units.alias("units")), lo, hi, sep, False).groupBy(F.col("term").alias(term)).agg(F.sum("df").alias("df"))


def vocabulary(counts: DataFrame, size: int, min_df: int = 1) -> DataFrame:
    """Of (term, df, cf), the `size` terms with the largest counts in the corpus; of ties the first term."""
    return counts.where(F.col("df") >= min_df).orderBy(F.col("cf").desc(), "term").limit(size)


def idf(vocab: DataFrame, docs: DataFrame) -> DataFrame:
    """vocab with idf = ln((1 + n) / (1 + df)) + 1."""
    n = F.broadcast(docs.agg(F.count(F.lit(1)).alias("__n")))
    return vocab.join(n).withColumn("idf", F.log((1 + F.col("__n")) / (1 + F.col("df"))) + 1).drop("__n")


def weighted(tf: DataFrame, idfs: DataFrame, log_tf: bool = False) -> DataFrame:
    """(id, term, weight): tf (or ln(1 + tf)) times idf, each document's weights of norm 1; terms without idf drop out. idfs is a vocabulary of a size given beforehand, so it is broadcast."""
    raw = tf.join(F.broadcast(idfs.select("term", "idf")), "term").withColumn("w", (F.log1p("tf") if log_tf else F.col("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))  # a document's known terms
    return raw.select("id", "term", (F.col("w") / norm).alias("weight"))


def hashed_counts(df: DataFrame, tokens: Column, lo: int, hi: int, dim: int = 1 << 19, id_col: str = "id") -> DataFrame:
    """(id, slot, tf): n-grams of lo to hi tokens by the first 8 hex digits of their md5, modulo dim, so that every engine and run agrees."""
    return G.by_row(df.select(F.col(id_col).alias("id"), tokens.alias("units")), "id", G.slot_counter([(None, [(1, lo, hi, " ")])], dim), "slot long")


def hashed_parts(df: DataFrame, text: str = "text", id_col: str = "id", dim: int = 1 << 19, words: tuple[int, int] = (1, 2), chars: tuple[int, int] = (3, 5)) -> DataFrame:
    """(id, part, slot, tf): of part w all tokens and their n-grams of words, joined by _, of part c all tokens and the n-grams of characters."""
    rows = df.select(F.col(id_col).alias("id"), X.tokens(F.col(text)).alias("tk"), X.whole(F.col(text)).alias("text"))
    parts = [("w", [(1, 1, 1, "_"), (1, *words, "_")]), ("c", [(1, 1, 1, "_"), (2, *chars, "")])]
    return G.by_row(rows, "id", G.slot_counter(parts, dim), "part string, slot long")


def lexical_richness(df: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """(id, n_tokens, ttr, hapax_ratio, dis_ratio, yule_k) of documents that have tokens."""
    v = term_counts(df, X.tokens(F.col(text)), id_col)
    n, s2 = F.sum("tf"), F.sum(F.col("tf") * F.col("tf"))
    share = lambda k: F.sum((F.col("tf") == k).cast("long")) / F.count(F.lit(1))
    return v.groupBy("id").agg(n.alias("n_tokens"), (F.count(F.lit(1)) / n).alias("ttr"), share(1).alias("hapax_ratio"), share(2).alias("dis_ratio"), (1e4 * (s2 - n) / (n * n + 1e-12)).alias("yule_k"))


#: A term is hot if it makes up this share of all tokens: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1e-4


def zipf(df: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """(id, zipf_mean, zipf_std): mean and deviation over tokens of log10(1e9 x share of the corpus); of documents that have tokens."""
    tf = stored(term_counts(df, X.tokens(F.lower(X.whole(F.col(text)))), id_col), "terms")  # read for counts, for the total and for the rows
    cf = document_frequency(tf).select("term", "cf")
    total = F.broadcast(cf.agg(F.sum("cf").alias("total")))
    z = cf.join(total).select("term", F.log10(1e9 * F.col("cf") / F.col("total")).alias("z"), (F.col("cf") >= F.col("total") * HOT_SHARE).alias("hot"))
    # rows of hot terms, which occur in nearly all documents, meet their few values by broadcast; the others are shuffled
    head = F.broadcast(z.where("hot").select("term", F.col("z").alias("hot_z")))
    rows = tf.join(head, "term", "left")
    rows = rows.where("hot_z IS NOT NULL").select("id", "tf", F.col("hot_z").alias("z")).unionByName(rows.where("hot_z IS NULL").select("id", "term", "tf").join(z.where("NOT hot").select("term", "z"), "term").select("id", "tf", "z"))
    n, s = F.sum("tf"), F.sum(F.col("tf") * F.col("z"))
    s2 = F.sum(F.col("tf") * F.col("z") * F.col("z"))
    return rows.groupBy("id").agg((s / n).alias("zipf_mean"), F.sqrt(F.greatest(s2 / n - (s / n) * (s / n), F.lit(0.0))).alias("zipf_std"))
