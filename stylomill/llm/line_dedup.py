"""Line deduplication over a corpus, with DataFrame operations only.

Lines are exploded with their positions and normalised: white space `[\\x20\\x09-\\x0D]` off both ends, A-Z lower-cased.
The normalised line's 128-bit hash is the key. Keys of at least `min_chars` code points that at least `min_docs`
distinct documents hold lose all their lines, but for those in the document with the largest id. What stays is put
together again by position. Only hashes and positions are shuffled to find lines; the lines themselves travel once.

Defined cases. A null or empty text is one empty line. A null id counts as one document with the smallest id. Rows that
repeat an id count as one document, and each of them keeps or loses its own lines. A document can lose all its lines:
its text is then empty. An empty table gives an empty result. Input columns that bear the name of an output column are
replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylomill.llm.common import SPACE, ascii_lower, table, unused
from stylomill.session import broadcast_if_small, stored

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def dedup_lines(df: DataFrame, text: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """df with text without the repeated lines, n_lines (before) and n_dropped."""
    columns = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    tag, split, lost_id, lost_tag, lost = (unused(n, df.columns) for n in ("tag", "lines", "id", "lost_tag", "lost"))
    whole = F.coalesce(F.col(text), F.lit(""))
    # (id, tag) names a text, also where rows repeat an id
    tagged = df.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(3), whole).alias("tag"), F.split(whole, "\n").alias("lines"))
    keyed = tagged.select("id", "tag", F.posexplode("lines").alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = keyed.where(F.char_length("key") >= min_chars).select("id", "tag", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), "key").alias("h2"))
    lines = stored(lines, "lines")  # texts are taken apart once
    known = F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))
    frequent = lines.groupBy("h1", "h2").agg(known.alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs).select("h1", "h2", "last")
    # small enough, frequent lines go to all tasks, and no line's rows meet in one
    gone = lines.join(broadcast_if_small(stored(frequent, "frequent-lines")), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("last")))
    gone = gone.groupBy(F.col("id").alias(lost_id), F.col("tag").alias(lost_tag)).agg(F.collect_set("pos").alias(lost))
    docs = df.select(*columns).withColumns({tag: F.xxhash64(F.lit(3), whole), split: F.split(whole, "\n")}).drop(text)
    both = docs.join(gone, F.col(id_col).eqNullSafe(F.col(lost_id)) & (F.col(tag) == F.col(lost_tag)), "left")
    n = F.size(split)
    # array_except is linear in both arrays; positions are distinct, so it only takes out the lost ones
    stays = F.array_except(F.sequence(F.lit(0), n - 1), F.col(lost))
    kept = F.when(F.col(lost).isNull(), F.array_join(split, "\n")).otherwise(F.array_join(F.transform(stays, lambda i: F.col(split)[i]), "\n"))
    dropped = F.when(F.col(lost).isNull(), 0).otherwise(F.size(lost)).cast("long")
    return both.select(*(kept.alias(text) if c == text else F.col(c) for c in columns), n.cast("long").alias("n_lines"), dropped.alias("n_dropped"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document how many lines it has and loses, and the digest of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
             GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.last AS lost
           FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
