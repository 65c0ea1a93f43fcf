"""Queries over the test tables, one for each operator that SQL can express, each beside its DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylomill.functions import text as X
from stylomill.operators import folds, knn, metrics, tfidf
from stylomill.session import spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# the same classes in DuckDB's syntax
_WS = r"\s\x0B\x1C-\x1F\x{85}\pZ"
_TOKEN, _WORD, _MODEL_WORD = f"[^{_WS}]+", r"[\pL\pN_]+", r"[\pL\pN_]{2,}"
_COMMON = ", ".join(f"'{w}'" for w in X.COMMON_WORDS)


def _n(pattern: str, of: str = "t") -> str:
    return f"len(regexp_extract_all({of}, '{pattern}'))"


_FEATS = rf"""
raw AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
toks AS (SELECT doc_id, t, regexp_extract_all(t, '{_TOKEN}') AS tk, regexp_extract_all(lower(t), '{_TOKEN}') AS ltk,
                list_sort(list_filter(regexp_extract_all(lower(t), '{_WORD}'), lambda w: w NOT IN ({_COMMON}))) AS u FROM raw),
counts AS (SELECT *, length(t) AS text_length, len(tk) AS word_count, greatest({_n('[.!?]+')}, 1) AS sentence_count,
                  {_n(rf'[^\pL\pN_{_WS}]')} AS punct_count, {_n('!')} AS bangs, {_n('[?]')} AS questions,
                  {_n(r'\p{Nd}')} AS digits, {_n('[A-Z]')} AS uppers, greatest(length(t), 1) AS safe FROM toks),
feats AS (SELECT doc_id, text_length, word_count, sentence_count, punct_count, bangs, questions,
                 CASE WHEN len(ltk) = 0 THEN 0.0 ELSE len(list_distinct(ltk)) / len(ltk) END AS ttr,
                 least(word_count / sentence_count, 100.0::DOUBLE) AS avg_sentence_length, least(punct_count / safe, 0.3::DOUBLE) AS punct_ratio,
                 0.0::DOUBLE AS sentiment_polarity, 0.0::DOUBLE AS sentiment_subjectivity, digits / safe AS digit_ratio, uppers / safe AS upper_ratio,
                 regexp_matches(t, '[A-Za-z][{_WS}]*\z')::BIGINT AS ends_with_letter,
                 CASE WHEN len(tk) < 10 THEN 0 ELSE (len(list_distinct(list_transform(range(1, len(tk) - 3), lambda i: array_to_string(tk[i:i+4], ' ')))) < len(tk) - 4)::BIGINT END AS has_5gram_repetition,
                 CASE WHEN len(u) < 5 THEN 0 ELSE (len(list_filter(range(1, len(u) - 1), lambda i: u[i] = u[i+2])) > 0)::BIGINT END AS max_uncommon_binary
          FROM counts)"""


def feature_sql(columns: tuple[str, ...]) -> str:
    return f"WITH {_FEATS} SELECT doc_id, {', '.join(columns)} FROM feats"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_features(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


COUNTED = ("text_length", "word_count", "sentence_count", "punct_count")


@query("text_features_basic", feature_sql((*X.BASIC, "punct_count")))
def text_features_basic(spark, sf_dir):
    return features(spark, sf_dir).select("doc_id", *X.BASIC, "punct_count")


@query("text_features_extended", feature_sql(X.TUNED))
def text_features_extended(spark, sf_dir):
    return features(spark, sf_dir).select("doc_id", *X.TUNED)


@query("binary_features", feature_sql(X.RULES))
def binary_features(spark, sf_dir):
    return features(spark, sf_dir).select("doc_id", *X.RULES)


@query("feature_matrix15", feature_sql(X.FULL))
def feature_matrix15(spark, sf_dir):
    return features(spark, sf_dir).select("doc_id", *X.FULL)


@query("clean_text", r"SELECT doc_id, regexp_replace(replace(coalesce(text, ''), chr(13), chr(10)), '[\x00-\x09\x0B-\x1F]', '', 'g') AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


_EDA = rf"""eda AS (SELECT doc_id, length(t) AS n_chars, {_n(_TOKEN)} AS n_words, {_n('[.,;:!?]')} / greatest(length(t), 1) AS pct_punct,
 {_n(r'\p{Nd}')} / greatest(length(t), 1) AS pct_digits, {_n('[A-Z]')} / greatest(length(t), 1) AS pct_upper FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


@query("basic_eda_feats", f"WITH {_EDA} SELECT * FROM eda")
def basic_eda_feats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in X.eda_features(F.col("text")).items()))


@query("melt_features", f"WITH {_EDA} SELECT doc_id, feat, val FROM (SELECT doc_id, n_chars::DOUBLE AS n_chars, n_words::DOUBLE AS n_words, pct_punct, pct_digits, pct_upper FROM eda) UNPIVOT (val FOR feat IN (n_chars, n_words, pct_punct, pct_digits, pct_upper))")
def melt_features(spark, sf_dir):
    wide = basic_eda_feats(spark, sf_dir)
    cols = [c for c in wide.columns if c != "doc_id"]
    return wide.select("doc_id", *(F.col(c).cast("double") for c in cols)).unpivot("doc_id", cols, "feat", "val")


_READ = rf"""
r AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, {_n(f'[^{_WS}]')} AS chars, {_n(_TOKEN)} AS words, greatest({_n('[.!?]+')}, 1) AS sents, {_n('[aeiouy]+', 'lower(t)')} AS syll,
             len(list_filter(regexp_extract_all(lower(t), '{_TOKEN}'), lambda w: len(regexp_extract_all(w, '[aeiouy]+')) >= 3)) AS hard FROM r)"""


@query("ari_readability", f"WITH {_READ} SELECT doc_id, round(CASE WHEN words = 0 THEN 0.0 ELSE 4.71::DOUBLE * chars / words + 0.5::DOUBLE * words / sents - 21.43::DOUBLE END, 9) AS ari FROM c")
def ari_readability(spark, sf_dir):
    return rounded(table(spark, sf_dir, "documents").select("doc_id", X.ari(F.col("text")).alias("ari")), "ari")


@query("readability_scores", f"""WITH {_READ} SELECT doc_id, round(CASE WHEN words = 0 THEN 0.0 ELSE 206.835::DOUBLE - 1.015::DOUBLE * words / sents - 84.6::DOUBLE * syll / words END, 6) AS flesch,
 round(CASE WHEN words = 0 THEN 0.0 ELSE 0.4::DOUBLE * (words / sents + 100.0::DOUBLE * hard / words) END, 6) AS gunning,
 round(CASE WHEN words = 0 THEN 0.0 ELSE 1.043::DOUBLE * sqrt(hard * 30.0::DOUBLE / sents) + 3.1291::DOUBLE END, 6) AS smog FROM c""")
def readability_scores(spark, sf_dir):
    t = F.col("text")
    df = table(spark, sf_dir, "documents").select("doc_id", X.flesch(t).alias("flesch"), X.gunning(t).alias("gunning"), X.smog(t).alias("smog"))
    return rounded(df, "flesch", "gunning", "smog", digits=6)


@query("char_ids", """SELECT doc_id, list_concat(ids, list_transform(range(1024 - len(ids)), lambda i: 0::INTEGER)) AS ids FROM (
 SELECT doc_id, list_transform(list_filter(string_split(substring(coalesce(text, ''), 1, 1024), ''), lambda c: c <> ''), lambda c: instr('abcdefghijklmnopqrstuvwxyz0123456789 .,;!?', c)::INTEGER) AS ids FROM documents)""")
def char_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.char_ids(F.col("text"), "abcdefghijklmnopqrstuvwxyz0123456789 .,;!?").alias("ids"))


# labels, folds and splits

_LABELLED = "lab AS (SELECT d.doc_id, l.quality AS label, d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_FOLDED = _LABELLED + ", folded AS (SELECT doc_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5(doc_id::VARCHAR), doc_id)) - 1) % 5 AS fold FROM lab)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.stratified_folds(labelled(spark, sf_dir), 5, id_col="doc_id")


@query("class_balance", f"WITH {_LABELLED} SELECT count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) / greatest(count(*) FILTER (WHERE label = 1), 1) AS scale_pos_weight FROM lab")
def class_balance(spark, sf_dir):
    n = lambda v: F.coalesce(F.sum((F.col("label") == v).cast("long")), F.lit(0))
    return labelled(spark, sf_dir).agg(n(0).alias("n0"), n(1).alias("n1")).withColumn("scale_pos_weight", F.col("n0") / F.greatest("n1", F.lit(1)))


@query("class_counts", f"WITH {_LABELLED} SELECT label, count(*) AS n FROM lab GROUP BY label")
def class_counts(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_folds", f"WITH {_FOLDED} SELECT doc_id, label, fold FROM folded")
def stratified_folds(spark, sf_dir):
    return folded(spark, sf_dir).select("doc_id", "label", "fold")


@query("shuffled_folds", "SELECT doc_id, ntile(5) OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS fold FROM documents")
def shuffled_folds(spark, sf_dir):
    return folds.shuffled_folds(table(spark, sf_dir, "documents").select("doc_id"), 5, id_col="doc_id").select("doc_id", "fold")


@query("train_val_union", f"WITH {_FOLDED} SELECT doc_id, label, 'train' AS part FROM folded WHERE fold <> 0 UNION ALL SELECT doc_id, label, 'val' AS part FROM folded WHERE fold = 0")
def train_val_union(spark, sf_dir):
    rows = folded(spark, sf_dir).select("doc_id", "label", "fold")
    part = lambda cond, name: rows.where(cond).select("doc_id", "label", F.lit(name).alias("part"))
    return part("fold <> 0", "train").unionByName(part("fold = 0", "val"))


@query("test_anti_join", "SELECT doc_id, length(text) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def test_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", F.char_length("text").cast("long").alias("n"))


@query("prevalence_rate", f"WITH {_LABELLED} SELECT round(avg(label), 9) AS rate FROM lab")
def prevalence_rate(spark, sf_dir):
    return rounded(labelled(spark, sf_dir).agg(F.avg("label").alias("rate")), "rate")


# n-grams

def _terms(lo: int, hi: int, cte: str = "documents", id_col: str = "doc_id") -> str:
    parts = ", ".join(f"CASE WHEN len(tk) >= {n} THEN list_transform(range(1, len(tk) - {n - 2}), lambda i: array_to_string(tk[i:i+{n - 1}], ' ')) ELSE [] END" for n in range(lo, hi + 1))
    return rf"""mt AS (SELECT {id_col}, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{_MODEL_WORD}'), lambda w: w NOT IN ({_COMMON})) AS tk FROM {cte}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(flatten([{parts}])) AS term FROM mt) GROUP BY doc_id, term)"""


def model_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tfidf.model_tokens(F.col("text")).alias("tk"))


def terms(spark: SparkSession, sf_dir: str, lo: int, hi: int) -> DataFrame:
    return tfidf.term_counts(model_terms(spark, sf_dir), F.col("tk"), "doc_id", lo, hi)


def counted(spark: SparkSession, sf_dir: str, lo: int, hi: int) -> DataFrame:
    return tfidf.gram_counts(model_terms(spark, sf_dir), F.col("tk"), lo, hi)


@query("ngram_df", f"WITH {_terms(1, 3)} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term")
def ngram_df(spark, sf_dir):
    return counted(spark, sf_dir, 1, 3)


_VOCAB = "vocab AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT {})"
_IDF = "idf AS (SELECT *, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM vocab)"


@query("vocabulary_topk", f"WITH {_terms(1, 2)}, {_VOCAB.format(5000)} SELECT * FROM vocab")
def vocabulary_topk(spark, sf_dir):
    return tfidf.vocabulary(counted(spark, sf_dir, 1, 2), 5000, 2)


@query("idf_table", f"WITH {_terms(1, 1)}, {_VOCAB.format(2000)}, {_IDF} SELECT term, df, round(idf, 9) AS idf FROM idf")
def idf_table(spark, sf_dir):
    return rounded(tfidf.idf(tfidf.vocabulary(counted(spark, sf_dir, 1, 1), 2000, 2), table(spark, sf_dir, "documents")).select("term", "df", "idf"), "idf")


def _weights_sql(w: str) -> str:
    return f"WITH {_terms(1, 1)}, {_VOCAB.format(2000)}, {_IDF}, raw AS (SELECT doc_id, tf.term, {w} * idf AS w FROM tf JOIN idf ON tf.term = idf.term) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM raw"


def _weighted(spark: SparkSession, sf_dir: str, log_tf: bool) -> DataFrame:
    tf = terms(spark, sf_dir, 1, 1)
    idfs = tfidf.idf(tfidf.vocabulary(counted(spark, sf_dir, 1, 1), 2000, 2), table(spark, sf_dir, "documents"))
    return rounded(tfidf.weighted(tf, idfs, log_tf).withColumnRenamed("id", "doc_id"), "weight")


@query("tfidf_l2", _weights_sql("tf"))
def tfidf_l2(spark, sf_dir):
    return _weighted(spark, sf_dir, False)


@query("tfidf_log1p", _weights_sql("ln(1 + tf)"))
def tfidf_log1p(spark, sf_dir):
    return _weighted(spark, sf_dir, True)


@query("char_ngrams_df", """WITH r AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(flatten([list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: t[i:i+2]), list_transform(range(1, greatest(length(t) - 2, 1)), lambda i: t[i:i+3])])) AS gram FROM r)
SELECT gram, count(*) AS df FROM g GROUP BY gram""")
def char_ngrams_df(spark, sf_dir):
    return tfidf.gram_df(spread(table(spark, sf_dir, "documents").select("text")), F.col("text"), 3, 4, term="gram")


@query("char_ngrams35_df", """WITH r AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(flatten([list_transform(range(1, greatest(length(t) - k + 2, 1)), lambda i: t[i:i+k-1]) for k in [3, 4, 5]])) AS gram FROM r)
SELECT gram, count(*) AS df FROM g GROUP BY gram""")
def char_ngrams35_df(spark, sf_dir):
    """The reference's lengths; char_ngrams_df stops at 4."""
    return tfidf.gram_df(spread(table(spark, sf_dir, "documents").select("text")), F.col("text"), 3, 5, term="gram")


@query("hashed_tf", f"""WITH {_terms(1, 2)} SELECT doc_id, ('0x' || substring(md5(term), 1, 8))::BIGINT % 524288 AS slot, sum(tf)::BIGINT AS tf FROM tf GROUP BY ALL""")
def hashed_tf(spark, sf_dir):
    return tfidf.hashed_counts(model_terms(spark, sf_dir), F.col("tk"), 1, 2, id_col="doc_id").withColumnRenamed("id", "doc_id")


_ALL_GRAMS = rf"""r AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') AS tk FROM documents),
g AS (SELECT doc_id, unnest(flatten([tk, tk, CASE WHEN len(tk) >= 2 THEN list_transform(range(1, len(tk)), lambda i: tk[i] || '_' || tk[i+1]) ELSE [] END])) AS term, 'w' AS part FROM r
      UNION ALL SELECT doc_id, unnest(flatten([tk, list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: t[i:i+2]), list_transform(range(1, greatest(length(t) - 2, 1)), lambda i: t[i:i+3]), list_transform(range(1, greatest(length(t) - 3, 1)), lambda i: t[i:i+4])])), 'c' FROM r)"""


@query("hashed_tf_full", f"""WITH {_ALL_GRAMS} SELECT doc_id, part, ('0x' || substring(md5(term), 1, 8))::BIGINT % 524288 AS slot, count(*) AS tf FROM g GROUP BY ALL""")
def hashed_tf_full(spark, sf_dir):
    """Both hashed matrices: tokens with 1- to 2-grams of words, so that single ones count twice, and tokens with 3- to 5-grams of characters."""
    return tfidf.hashed_parts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), id_col="doc_id").withColumnRenamed("id", "doc_id")


@query("lexicon_shares", f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{{WORD}}')) AS w FROM documents), l(word, p, s) AS (VALUES {{LEX}}),
m AS (SELECT doc_id, coalesce(p, 0.0::DOUBLE) AS p FROM t LEFT JOIN l ON w = word),
a AS (SELECT doc_id, count(*) FILTER (WHERE p < 0) / count(*) AS neg, count(*) FILTER (WHERE p = 0) / count(*) AS neu, count(*) FILTER (WHERE p > 0) / count(*) AS pos, sum(p) AS s FROM m GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(neg, 0.0), 9) AS sent_neg, round(coalesce(neu, 0.0), 9) AS sent_neu, round(coalesce(pos, 0.0), 9) AS sent_pos, round(coalesce(s / sqrt(s * s + 15), 0.0), 9) + 0.0::DOUBLE AS sent_compound FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id""".format(WORD=_WORD, LEX=", ".join(f"('{w}', {p!r}::DOUBLE, {s!r}::DOUBLE)" for w, p, s in X.SMALL_LEXICON)))
def lexicon_shares(spark, sf_dir):
    from stylomill.operators.lexicon import shares

    lexicon = F.broadcast(spark.createDataFrame(X.SMALL_LEXICON, "word string, polarity double, subjectivity double"))
    df = shares(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), lexicon, id_col="doc_id").withColumnRenamed("id", "doc_id")
    return rounded(df, "sent_neg", "sent_neu", "sent_pos", "sent_compound").withColumn("sent_compound", F.col("sent_compound") + 0.0)  # no -0.0


@query("lexical_richness", rf"""WITH v AS (SELECT doc_id, tok, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_TOKEN}')) AS tok FROM documents) GROUP BY ALL)
SELECT doc_id, sum(c)::BIGINT AS n_tokens, round(count(*) / sum(c), 9) AS ttr, round(count(*) FILTER (WHERE c = 1) / count(*), 9) AS hapax_ratio, round(count(*) FILTER (WHERE c = 2) / count(*), 9) AS dis_ratio,
round(1e4 * (sum(c * c) - sum(c)) / (sum(c)::DOUBLE * sum(c) + 1e-12), 6) AS yule_k FROM v GROUP BY doc_id""")
def lexical_richness(spark, sf_dir):
    df = tfidf.lexical_richness(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), id_col="doc_id").withColumnRenamed("id", "doc_id")
    return rounded(rounded(df, "ttr", "hapax_ratio", "dis_ratio"), "yule_k", digits=6)


@query("zipf_corpus", rf"""WITH v AS (SELECT doc_id, tok, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN}')) AS tok FROM documents) GROUP BY ALL),
z AS (SELECT tok, log10(1e9 * sum(c) / (SELECT sum(c) FROM v)) AS z FROM v GROUP BY tok)
SELECT doc_id, round(sum(c * z) / sum(c), 6) AS zipf_mean, round(sqrt(greatest(sum(c * z * z) / sum(c) - (sum(c * z) / sum(c)) * (sum(c * z) / sum(c)), 0)), 6) AS zipf_std FROM v JOIN z ON v.tok = z.tok GROUP BY doc_id""")
def zipf_corpus(spark, sf_dir):
    return rounded(tfidf.zipf(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), id_col="doc_id").withColumnRenamed("id", "doc_id"), "zipf_mean", "zipf_std", digits=6)


@query("common_word_anti", rf"""SELECT doc_id, count(*) AS n_uncommon FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_WORD}')) AS w FROM documents) WHERE w NOT IN ({_COMMON}) GROUP BY doc_id""")
def common_word_anti(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokens(F.lower(X.whole(F.col("text"))), X.WORD)).alias("w"))
    common = spark.createDataFrame([(w,) for w in X.COMMON_WORDS], "w string")  # a fixed list
    return words.join(F.broadcast(common), "w", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_uncommon"))


# scored rows: two fixed scores that need no training

_SCORED = f"{_FEATS}, scored AS (SELECT f.doc_id, l.quality AS label, ttr AS p1, least(punct_ratio / 0.3::DOUBLE, 1.0::DOUBLE) AS p2, ends_with_letter, has_5gram_repetition, max_uncommon_binary, (ttr >= 0.6::DOUBLE)::INTEGER AS pred FROM feats f JOIN labels l ON f.doc_id = l.doc_id)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.with_features(labelled(spark, sf_dir))
    return f.select("doc_id", "label", F.col("ttr").alias("p1"), F.least(F.col("punct_ratio") / 0.3, F.lit(1.0)).alias("p2"), *X.RULES).withColumn("pred", metrics.over("p1", 0.6))


@query("threshold_predicate", f"WITH {_SCORED} SELECT doc_id, pred FROM scored")
def threshold_predicate(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "pred")


@query("any_rule", f"WITH {_FEATS} SELECT doc_id, greatest(ends_with_letter, has_5gram_repetition, max_uncommon_binary) AS flag FROM feats")
def any_rule(spark, sf_dir):
    return features(spark, sf_dir).select("doc_id", F.greatest(*X.RULES).alias("flag"))


@query("confusion", f"WITH {_SCORED} SELECT count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp FROM scored")
def confusion(spark, sf_dir):
    return metrics.confusion(scored(spark, sf_dir))


@query("confusion_long", f"WITH {_SCORED} SELECT label, pred, count(*) AS n FROM scored GROUP BY ALL")
def confusion_long(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


_CLS = """cls AS (SELECT c AS cls, count(*) FILTER (WHERE label = c AND pred = c) AS tp, count(*) FILTER (WHERE pred = c) AS n_pred, count(*) FILTER (WHERE label = c) AS support
 FROM scored, (SELECT unnest([0, 1]) AS c) GROUP BY c HAVING count(*) FILTER (WHERE pred = c OR label = c) > 0),
m AS (SELECT *, coalesce(tp / nullif(n_pred, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall, coalesce(2 * tp / nullif(n_pred + support, 0), 0.0) AS f1 FROM cls)"""


@query("binary_f1", f"WITH {_SCORED} SELECT round(coalesce(2 * count(*) FILTER (WHERE label = 1 AND pred = 1) / nullif(count(*) FILTER (WHERE label = 1) + count(*) FILTER (WHERE pred = 1), 0), 0.0), 9) AS f1 FROM scored")
def binary_f1(spark, sf_dir):
    return rounded(metrics.binary_f1(scored(spark, sf_dir)), "f1")


@query("macro_f1", f"WITH {_SCORED}, {_CLS} SELECT round(avg(f1), 9) AS f1_macro FROM m")
def macro_f1(spark, sf_dir):
    return rounded(metrics.macro_f1(scored(spark, sf_dir)), "f1_macro")


@query("classification_report", f"""WITH {_SCORED}, {_CLS}, r AS (
SELECT cls::VARCHAR AS row, precision, recall, f1, support FROM m UNION ALL
SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support)::BIGINT FROM m UNION ALL
SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM m UNION ALL
SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM m)
SELECT row, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM r""")
def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(scored(spark, sf_dir)), "precision", "recall", "f1")


_CURVE = """per AS (SELECT p1 AS p, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM scored GROUP BY p1),
cum AS (SELECT p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM per WINDOW w AS (ORDER BY p DESC)),
tot AS (SELECT sum(pos) AS n_pos, sum(neg) AS n_neg FROM per)"""


@query("roc_curve", f"WITH {_SCORED}, {_CURVE} SELECT p AS threshold, round(fp / n_neg, 9) AS fpr, round(tp / n_pos, 9) AS tpr FROM cum, tot UNION ALL SELECT NULL, 0.0, 0.0")
def roc_curve(spark, sf_dir):
    return rounded(metrics.roc_curve(scored(spark, sf_dir), p="p1"), "fpr", "tpr")


@query("pr_curve", f"WITH {_SCORED}, {_CURVE} SELECT p AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / n_pos, 9) AS recall FROM cum, tot")
def pr_curve(spark, sf_dir):
    return rounded(metrics.pr_curve(scored(spark, sf_dir), p="p1"), "precision", "recall")


@query("roc_auc", f"WITH {_SCORED}, {_CURVE} SELECT round(sum(neg * (2 * (tp - pos) + pos)) / (2.0::DOUBLE * max(n_pos) * max(n_neg)), 9) AS auc FROM cum, tot")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(scored(spark, sf_dir), p="p1"), "auc")


def _list(xs: list[float]) -> str:
    return "[" + ", ".join(f"{x!r}::DOUBLE" for x in xs) + "]"


def _sweep_sql(ws: list[float], at: list[float]) -> str:
    return f"""g AS (SELECT w, thr FROM (SELECT unnest({_list(ws)}) AS w), (SELECT unnest({_list(at)}) AS thr)),
sw AS (SELECT w, thr, count(*) FILTER (WHERE label = 1 AND w * p1 + (1 - w) * p2 >= thr) AS tp, count(*) FILTER (WHERE label = 0 AND w * p1 + (1 - w) * p2 >= thr) AS fp, count(*) FILTER (WHERE label = 1 AND w * p1 + (1 - w) * p2 < thr) AS fn FROM scored, g GROUP BY w, thr),
sf AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM sw)"""


@query("threshold_sweep_fixed", f"WITH {_SCORED}, {_sweep_sql([0.6], metrics.thresholds(0.9))} SELECT w, thr, tp, fp, fn, round(f1, 9) AS f1 FROM sf")
def threshold_sweep_fixed(spark, sf_dir):
    return rounded(metrics.sweep(scored(spark, sf_dir), [0.6], metrics.thresholds(0.9)), "f1")


@query("threshold_weight_sweep", f"WITH {_SCORED}, {_sweep_sql(metrics.weights(), metrics.thresholds())} SELECT w, thr, tp, fp, fn, round(f1, 9) AS f1 FROM sf")
def threshold_weight_sweep(spark, sf_dir):
    return rounded(metrics.sweep(scored(spark, sf_dir), metrics.weights(), metrics.thresholds()), "f1")


@query("best_weight_threshold", f"WITH {_SCORED}, {_sweep_sql(metrics.weights(), metrics.thresholds())} SELECT w, thr, tp, fp, fn, round(f1, 9) AS f1 FROM sf ORDER BY sf.f1 DESC, w, thr LIMIT 1")
def best_weight_threshold(spark, sf_dir):
    return rounded(metrics.best(metrics.sweep(scored(spark, sf_dir), metrics.weights(), metrics.thresholds())), "f1")


_PREV = "prev AS (SELECT *, (row_number() OVER (ORDER BY p1 DESC, doc_id) <= (SELECT round_even(avg(label) * count(*), 0) FROM scored))::INTEGER AS flag FROM scored)"


@query("prevalence_decode", f"WITH {_SCORED}, {_PREV} SELECT doc_id, flag FROM prev")
def prevalence_decode(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return metrics.prevalence_flags(rows, rows.agg(F.avg("label")), p="p1", id_col="doc_id").select("doc_id", "flag")


def _rule_sql() -> str:
    parts = []
    for mask in range(1, 8):
        chosen = [r for i, r in enumerate(X.RULES) if mask >> i & 1]
        flag = f"greatest({', '.join(chosen)}) = 1"
        parts.append(f"SELECT '{'|'.join(chosen)}' AS rule, {mask} AS mask, count(*) FILTER (WHERE label = 1 AND {flag}) AS tp, count(*) FILTER (WHERE label <> 1 AND {flag}) AS fp, count(*) FILTER (WHERE label = 1 AND NOT {flag}) AS fn FROM scored")
    return f"rules AS ({' UNION ALL '.join(parts)}), rf AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM rules)"


@query("rule_subset_sweep", f"WITH {_SCORED}, {_rule_sql()} SELECT rule, mask, tp, fp, fn, round(f1, 9) AS f1 FROM rf")
def rule_subset_sweep(spark, sf_dir):
    return rounded(metrics.rule_sweep(scored(spark, sf_dir), list(X.RULES)), "f1")


@query("head_ranking", f"""WITH {_SCORED}, {_sweep_sql(metrics.weights(), metrics.thresholds())}, {_rule_sql()},
top AS (SELECT w FROM sf ORDER BY f1 DESC, w, thr LIMIT 1),
mixed AS (SELECT doc_id, label, (SELECT w FROM top) * p1 + (1 - (SELECT w FROM top)) * p2 AS p FROM scored),
prev AS (SELECT *, (row_number() OVER (ORDER BY p DESC, doc_id) <= (SELECT round_even(avg(label) * count(*), 0) FROM scored))::INTEGER AS flag FROM mixed), heads AS (
SELECT 'threshold' AS head, 0 AS priority, max(f1) AS f1 FROM sf UNION ALL
SELECT 'prevalence', 1, coalesce(2 * count(*) FILTER (WHERE label = 1 AND flag = 1) / nullif(sum(label) + sum(flag), 0), 0.0) FROM prev UNION ALL
SELECT 'rule', 2, max(f1) FROM rf)
SELECT head, round(f1, 9) AS f1, row_number() OVER (ORDER BY heads.f1 DESC, priority) AS place, (SELECT w FROM top) AS w FROM heads""")
def head_ranking(spark, sf_dir):
    from stylomill.operators.heads import ranking

    rows = scored(spark, sf_dir)
    return rounded(ranking(rows, rows, list(X.RULES), id_col="doc_id").select("head", "f1", "place", "w"), "f1")


@query("misclassified_rows", f"WITH {_SCORED} SELECT doc_id, label, pred, p1 FROM scored WHERE label <> pred ORDER BY doc_id LIMIT 12")
def misclassified_rows(spark, sf_dir):
    return scored(spark, sf_dir).where("label <> pred").orderBy("doc_id").limit(12).select("doc_id", "label", "pred", "p1")


@query("residuals", f"WITH {_SCORED} SELECT doc_id, p1, label - p1 AS residual FROM scored")
def residuals(spark, sf_dir):
    return metrics.residuals(scored(spark, sf_dir), p="p1").select("doc_id", "p1", "residual")


@query("qq_points", f"WITH {_SCORED} SELECT doc_id, row_number() OVER (ORDER BY label - p1, doc_id) AS rank, round((row_number() OVER (ORDER BY label - p1, doc_id) - 0.5::DOUBLE) / count(*) OVER (), 9) AS position FROM scored")
def qq_points(spark, sf_dir):
    return rounded(metrics.qq_points(metrics.residuals(scored(spark, sf_dir), p="p1"), "residual", "doc_id").select("doc_id", "rank", "position"), "position")


_CV = """cand AS (SELECT unnest([0.5::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE]) AS cand),
fs AS (SELECT cand, fold, coalesce(2 * count(*) FILTER (WHERE label = 1 AND p1 >= cand) / nullif(count(*) FILTER (WHERE label = 1) + count(*) FILTER (WHERE p1 >= cand), 0), 0.0) AS f1
       FROM (SELECT s.*, ((row_number() OVER (PARTITION BY label ORDER BY md5(doc_id::VARCHAR), doc_id)) - 1) % 5 AS fold FROM scored s), cand GROUP BY cand, fold)"""


@query("cv_fold_means", f"WITH {_SCORED}, {_CV} SELECT cand, round(avg(f1), 9) AS mean_f1, count(*) AS folds FROM fs GROUP BY cand HAVING count(*) = 5")
def cv_fold_means(spark, sf_dir):
    rows = folds.stratified_folds(scored(spark, sf_dir), 5, id_col="doc_id").select("label", "p1", "fold", F.explode(F.array(*(F.lit(x) for x in (0.5, 0.6, 0.7)))).alias("cand"))
    hit, y = F.col("p1") >= F.col("cand"), F.col("label") == 1
    n = lambda c: F.sum(c.cast("long"))
    per = rows.groupBy("cand", "fold").agg(metrics.f1(n(y & hit), n(~y & hit), n(y & ~hit)).alias("f1"))
    return rounded(per.groupBy("cand").agg(F.avg("f1").alias("mean_f1"), F.count(F.lit(1)).alias("folds")).where("folds = 5"), "mean_f1")


@query("ensemble_columns", f"WITH {_SCORED} SELECT doc_id, round(0.6::DOUBLE * p1 + 0.4::DOUBLE * p2, 12) AS p FROM scored")
def ensemble_columns(spark, sf_dir):
    s = scored(spark, sf_dir)
    one, two = s.select("doc_id", "p1"), s.select("doc_id", "p2")  # scores made apart meet by id
    return rounded(one.join(two, "doc_id").select("doc_id", (0.6 * F.col("p1") + 0.4 * F.col("p2")).alias("p")), "p", digits=12)


@query("feature_corr", f"WITH {_FEATS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM feats" for i, a in enumerate(("text_length", "word_count", "ttr", "avg_sentence_length", "punct_ratio")) for b in ("text_length", "word_count", "ttr", "avg_sentence_length", "punct_ratio")[i + 1 :]))
def feature_corr(spark, sf_dir):
    cols = ("text_length", "word_count", "ttr", "avg_sentence_length", "punct_ratio")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = features(spark, sf_dir).agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 6).alias("r")) for a, b in pairs)).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")


@query("feature_quartiles", f"WITH {_FEATS} SELECT quality AS label, round(quantile_cont(ttr, 0.25), 9) AS q1, round(quantile_cont(ttr, 0.5), 9) AS q2, round(quantile_cont(ttr, 0.75), 9) AS q3 FROM feats f JOIN labels l ON f.doc_id = l.doc_id GROUP BY quality")
def feature_quartiles(spark, sf_dir):
    rows = X.with_features(spread(labelled(spark, sf_dir))).select("doc_id", "label", "ttr")
    return rounded(metrics.quantiles(rows, "ttr", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, "label", "doc_id"), "q1", "q2", "q3")


@query("label_histogram", f"WITH {_FEATS} SELECT quality AS label, floor(ttr * 10)::BIGINT AS bin, count(*) AS n FROM feats f JOIN labels l ON f.doc_id = l.doc_id GROUP BY ALL")
def label_histogram(spark, sf_dir):
    return X.with_features(labelled(spark, sf_dir)).groupBy("label", F.floor(F.col("ttr") * 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("distinct_classes", f"WITH {_SCORED} SELECT label AS cls FROM scored UNION SELECT pred FROM scored")
def distinct_classes(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select(F.col("label").alias("cls")).union(s.select("pred")).distinct()


@query("ragged_features", rf"""WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[.,;!?]')) AS ch FROM documents) GROUP BY ALL)
SELECT d.doc_id, {', '.join(f"coalesce(max(n) FILTER (WHERE ch = '{c}'), 0.0)::DOUBLE AS {name}" for c, name in ((".", "dot"), (",", "comma"), (";", "semi"), ("!", "bang"), ("?", "quest")))}
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id""")
def ragged_features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = {".": "dot", ",": "comma", ";": "semi", "!": "bang", "?": "quest"}
    long = docs.select("doc_id", F.explode(X.tokens(F.col("text"), "[.,;!?]")).alias("ch"))
    wide = long.groupBy("doc_id").pivot("ch", list(names)).agg(F.count(F.lit(1)).cast("double")).withColumnsRenamed(names)
    return docs.select("doc_id").join(wide, "doc_id", "left").na.fill(0.0)


@query("submission_frame", f"WITH {_FEATS} SELECT f.doc_id AS id, (ttr >= 0.6::DOUBLE)::INTEGER AS label FROM feats f WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id)")
def submission_frame(spark, sf_dir):
    test = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return X.with_features(test).select(F.col("doc_id").alias("id"), metrics.over("ttr", 0.6).alias("label"))


_KNN = """q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), b AS (SELECT vec_id AS neighbour, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT query, neighbour, label, list_dot_product(q.v, b.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(b.v, b.v))) AS s FROM q, b WHERE query <> neighbour),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS rank FROM s)"""


def neighbours(spark: SparkSession, sf_dir: str, k: int = 11) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return knn.nearest(rows, rows.where("vec_id % 50 = 0"), k)  # the queries; all rows are searched


@query("knn_cosine", f"WITH {_KNN} SELECT query, rank, neighbour, round(s, 6) AS similarity FROM k WHERE rank <= 11")
def knn_cosine(spark, sf_dir):
    return rounded(neighbours(spark, sf_dir).select("query", "rank", "neighbour", "similarity"), "similarity", digits=6)


@query("knn_vote", f"WITH {_KNN} SELECT query, (avg((label >= 5)::INTEGER) >= 0.5)::INTEGER AS pred FROM k WHERE rank <= 11 GROUP BY query")
def knn_vote(spark, sf_dir):
    return neighbours(spark, sf_dir).groupBy("query").agg((F.avg((F.col("label") >= 5).cast("int")) >= 0.5).cast("int").alias("pred"))


LEXICON = X.SMALL_LEXICON
_LEX = ", ".join(f"('{w}', {p!r}::DOUBLE, {s!r}::DOUBLE)" for w, p, s in LEXICON)


@query("lexicon_sentiment", f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_WORD}')) AS w FROM documents), l(word, p, s) AS (VALUES {_LEX}),
m AS (SELECT doc_id, avg(p) AS p, avg(s) AS s FROM t JOIN l ON w = word GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(m.p, 0.0), 9) AS sentiment_polarity, round(coalesce(m.s, 0.0), 9) AS sentiment_subjectivity FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id""")
def lexicon_sentiment(spark, sf_dir):
    from stylomill.operators.lexicon import sentiment

    lexicon = F.broadcast(spark.createDataFrame(LEXICON, "word string, polarity double, subjectivity double"))
    df = sentiment(table(spark, sf_dir, "documents").select("doc_id", "text"), lexicon, id_col="doc_id").withColumnRenamed("id", "doc_id")
    return rounded(df, "sentiment_polarity", "sentiment_subjectivity")
