"""Grouping of spelling variants: words one edit apart, found by merging subtrees of tries.

Two words one inserted, deleted or replaced code point apart share a half: with s the shorter one's length, either the first
s // 2 code points or the last s - s // 2. So each word goes, for s its own length and one less, to a group by its beginning
and, reversed, to one by its end; a pair meets in the groups of its s, and of the two that of the beginning wins. A group's
words, sorted, are a trie. A pair parts at one node, their lowest common one, and at most one of the two is in the node's
heaviest subtree: so only words of light subtrees are merged into the others, small to large, with the code point at the
node skipped, replaced by that of the heavy path, or put before, and light ones among each other with it as a wild card.
Where that ends at a terminal, these are one edit apart. A word is light at no more than log2(words) nodes, so the work is
words x log(words), whatever the words have in common. Levels of the trie are numpy steps over all words of a chunk of
groups; polynomial hashes find the terminals, whole words confirm them.

Groups of more than `GROUP` code points are never in one task: their root's merge is a Spark join on the words without that
code point, and their subtrees are groups of their own, with a key one longer, until all are small.

Of a word's near words the one with the largest count is its form, if that is at least `ratio` times the word's own; of
equal counts the first in code-point order. The root is where following forms ends; counts rise tenfold with each step, so
it is found by a few joins of the forms with themselves.

Defined cases. Null texts have no words, a null id counts as empty where a run's hash is taken. Repeated rows count each.
Words of any length take part. An empty table gives an empty result; other columns of the input don't matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylomill.llm.common import LOWER, UPPER, ascii_lower, mix, table, trimmed
from stylomill.session import broadcast_if_small, ship_package, stored

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many runs loses a code point.
TYPO_EVERY = 31
#: Code points of the words that a task merges at once, and of the largest group that goes to one task.
CHUNK = GROUP = 2 << 20


def vocabulary(df: DataFrame, text: str = "text", id_col: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo_every: int = TYPO_EVERY) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case; where typo_every divides the crc32 of `<id>:<run>`, without the code point at crc32 modulo length."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"([{LETTERS}]{{{least_length},}})"), F.lit(1))
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % typo_every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    words = rows.withColumn("h", h).select(word.alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# --- a chunk of groups

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)


class Trie:
    """Sorted distinct words of s or s + 1 code points as a trie from depth on; those that share their first depth ones are a group."""

    def __init__(self, words: list[str], s: int, depth: int):
        self.s, n = s, len(words)
        self.code = np.array(words, f"U{s + 2}").view(np.uint32).reshape(n, s + 2)
        self.size = np.array([len(w) for w in words])
        differ = self.code[1:] != self.code[:-1]
        self.shared = np.where(differ.any(axis=1), differ.argmax(axis=1), s + 2)
        self.depth = depth
        for base in _BASES:  # another base, should two words have one hash
            self.power, self.back = _powers(base, s + 3), _powers(pow(base, -1, 1 << 64), 2)
            self.value = np.where(self.code > 0, mix(self.code.astype(np.uint64) * np.uint64(base)), np.uint64(0))
            self.before = np.zeros((n, s + 3), np.uint64)
            np.cumsum(self.value * self.power[: s + 2], axis=1, out=self.before[:, 1:])
            self.whole = self.before[:, -1]
            self.order = np.argsort(self.whole)
            self.sorted = self.whole[self.order]
            if not (self.sorted[1:] == self.sorted[:-1]).any():
                break
        else:
            raise ValueError("two words have one hash under every base")

    def find(self, h: np.ndarray) -> np.ndarray:
        """The word of each hash, or -1."""
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words one edit apart in a group, the shorter of which has s code points, each pair once."""
        n = len(self.size)
        for d in np.unique(self.shared[(self.shared >= self.depth) & (self.shared <= self.s + 1)]).tolist():
            same = self.shared >= d  # a word and the next share a node of this depth
            branch = self.shared == d
            node = np.r_[0, np.cumsum(~same)]
            parts = np.zeros(int(node[-1]) + 1, bool)
            parts[node[1:][branch]] = True
            at = np.flatnonzero(parts[node])
            node, char = node[at], self.code[at, d]
            new_node = np.r_[True, node[1:] != node[:-1]]
            new_child = new_node | np.r_[True, char[1:] != char[:-1]]
            first = np.flatnonzero(new_child)
            weight = np.diff(np.r_[first, len(at)])
            of = np.cumsum(new_node)[first]
            ranked = np.lexsort((np.arange(len(first)), -weight, of))
            heavy = ranked[np.r_[True, of[ranked][1:] != of[ranked][:-1]]]  # the heaviest child of each node
            is_heavy = np.zeros(len(first), bool)
            is_heavy[heavy] = True
            path = char[first[heavy]][np.cumsum(new_node) - 1]
            light = ~is_heavy[np.cumsum(new_child) - 1]
            w, path = at[light], path[light]
            yield from self._merge(w, path, d)

    def _merge(self, w: np.ndarray, path: np.ndarray, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Light words w of nodes of depth d, merged along path, the code points of their nodes' heavy children."""
        here, short = self.code[w, d], self.size[w] == self.s
        path_value = np.where(path > 0, mix(path.astype(np.uint64) * np.uint64(self._base())), np.uint64(0))
        head, power = self.before[w, d], self.power[d]
        rest = self.whole[w] - self.before[w, d + 1]  # what comes after the code point at d
        # replaced by the path's
        can = short & (here > 0) & (path > 0)
        yield self._replaced(w[can], self.find(head[can] + path_value[can] * power + rest[can]))
        # the path's put before
        can = short & (path > 0)
        yield self._inserted(w[can], self.find(head[can] + path_value[can] * power + (self.whole[w] - head)[can] * self.power[1]), d)
        # skipped; where the next one is the same, the pair parts deeper
        can = ~short & (here > 0) & (self.code[w, d + 1] != here)
        u, v = w[can], self.find(head[can] + rest[can] * self.back[1])
        yield tuple(reversed(self._inserted(v, u, d)))
        # light ones among each other, with a wild card at d
        can = np.flatnonzero(short & (here > 0))
        if len(can) > 1:
            wild = head[can] + rest[can]
            order = np.argsort(wild, kind="stable")
            wild, who = wild[order], w[can][order]
            for k in range(1, len(who)):  # as many rounds as code points can stand at a place
                near = np.flatnonzero(wild[k:] == wild[:-k])
                if not len(near):
                    break
                yield self._replaced(who[near], who[near + k])

    def _base(self) -> int:
        return int(self.power[1])

    def _replaced(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = (a >= 0) & (b >= 0)
        a, b = a[found], b[found]
        ok = ((self.code[a] != self.code[b]).sum(axis=1) == 1) & (self.size[a] == self.size[b])
        return a[ok], b[ok]

    def _inserted(self, short: np.ndarray, long: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of which the second without its code point at d is the first."""
        found = (short >= 0) & (long >= 0)
        short, long = short[found], long[found]
        ok = (self.code[short, :d] == self.code[long, :d]).all(axis=1) & (self.code[short, d:-1] == self.code[long, d + 1 :]).all(axis=1) & (self.size[long] == self.size[short] + 1)
        return short[ok], long[ok]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % (1 << 64)))
    out[0] = 1
    return np.multiply.accumulate(out)


PAIRS = "s int, back boolean, a string, a_n long, b string, b_n long"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (s, back, depth, word, n), sorted, as pairs. Chunks end where a group ends."""
    kind, words, counts = None, [], []

    def made(k: int) -> Iterator[pa.RecordBatch]:
        if k < 2:
            return
        s, back, depth = kind
        text, n = pa.array(words[:k], pa.string()), np.array(counts[:k], np.int64)
        for a, b in Trie(words[:k], s, depth).pairs():
            for lo in range(0, len(a), 1 << 16):
                x, y = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), s, np.int32)), pa.array(np.full(len(x), back)), text.take(pa.array(x)), pa.array(n[x]), text.take(pa.array(y)), pa.array(n[y])], ["s", "back", "a", "a_n", "b", "b_n"])

    for batch in batches:
        kinds = np.stack([batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
        edge = np.r_[0, np.flatnonzero((kinds[1:] != kinds[:-1]).any(axis=1)) + 1, len(kinds)] if len(kinds) else np.zeros(1, int)
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            now = (int(kinds[lo, 0]), bool(kinds[lo, 1]), int(kinds[lo, 2]))
            if now != kind:
                yield from made(len(words))
                kind, words, counts = now, [], []
            words += batch.column(3).slice(lo, hi - lo).to_pylist()
            counts += batch.column(4).slice(lo, hi - lo).to_pylist()
            if len(words) * (kind[0] + 2) > CHUNK:
                k = bisect_left(words, words[-1][: kind[2]])  # the last group may go on
                yield from made(k)
                words, counts = words[k:], counts[k:]
    yield from made(len(words))


# --- all groups

_KEY = ("s", "back", "depth")


def _split_root(hot: DataFrame) -> DataFrame:
    """Pairs of groups that part at the groups' root, by joins on what is left without the code point there."""
    at = F.substring("word", F.col("depth") + 1, F.lit(1))
    left = F.concat(F.expr("substring(word, 1, depth)"), F.expr("substring(word, depth + 2)"))
    rows = hot.withColumns({"char": at, "left": left, "long": F.char_length("word") > F.col("s")})
    a = rows.where("NOT long AND char != ''").select(*_KEY, "left", F.col("char").alias("a_char"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = a.select(*_KEY, "left", F.col("a_char").alias("b_char"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))
    replaced = a.join(b, [*_KEY, "left"]).where("a_char < b_char")
    short = rows.where("NOT long").select(*_KEY, F.col("word").alias("left"), F.col("char").alias("a_char"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    long = rows.where("long").select(*_KEY, "left", F.col("char").alias("b_char"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    inserted = short.join(long, [*_KEY, "left"]).where("a_char != b_char")
    return replaced.unionByName(inserted).select("s", "back", "a", "a_n", "b", "b_n")


def near_pairs(vocab: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, a_n, b, b_n): words of vocab (word, n) one edit apart, each pair once."""
    ship_package(vocab.sparkSession)
    length = F.char_length("word")
    both = vocab.where(length > 0).select("word", "n", F.explode(F.filter(F.array(length, length - 1), lambda s: s > 0)).alias("s"))
    half = F.floor(F.col("s") / 2).cast("int")
    ahead = F.struct(F.lit(False).alias("back"), F.col("word"), half.alias("depth"))
    back = F.struct(F.lit(True).alias("back"), F.reverse("word").alias("word"), (F.col("s") - half).alias("depth"))
    rows = both.select("n", "s", F.explode(F.array(ahead, back)).alias("r")).select("s", "r.back", "r.depth", "r.word", "n")
    found, cool = [], []
    key = F.expr("substring(word, 1, depth)")
    while True:
        of = rows.withColumn("key", key)
        per = of.groupBy(*_KEY, "key").agg(F.count(F.lit(1)).alias("rows"), F.min("word").alias("low"), F.max("word").alias("high")).where(F.col("rows") * (F.col("s") + 2) > group)
        # the first and the last word share what all share: nothing parts before that
        same = F.zip_with(F.split("low", ""), F.split("high", ""), lambda x, y: x.eqNullSafe(y))
        hot = stored(per.select(*_KEY, "key", (F.array_position(same, F.lit(False)) - 1).cast("int").alias("shared")), "hot-groups")
        if hot.isEmpty():
            cool.append(rows)
            break
        hot = broadcast_if_small(hot)
        cool.append(of.join(hot, [*_KEY, "key"], "left_anti").select(*rows.columns))
        large = stored(of.join(hot, [*_KEY, "key"]).withColumn("depth", F.greatest("depth", "shared")).select(*rows.columns), "hot-rows")
        found.append(_split_root(large))
        rows = large.where(F.char_length("word") > F.col("depth")).withColumn("depth", F.col("depth") + 1)
    all_rows = cool[0]
    for c in cool[1:]:
        all_rows = all_rows.unionByName(c)
    dealt = all_rows.withColumn("key", key).repartition(*_KEY, "key").select(*_KEY, "word", "n").sortWithinPartitions(*_KEY, "word")
    out = dealt.mapInArrow(trimmed(_merged), PAIRS)
    for f in found:
        out = out.unionByName(f)
    turned = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)).alias(c)
    out = out.select("s", "back", turned("a"), "a_n", turned("b"), "b_n")
    # what beginnings share as well was found there
    begin = lambda c: F.substring(c, F.lit(1), F.floor(F.col("s") / 2).cast("int"))
    return out.where(~F.col("back") | (begin("a") != begin("b"))).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends. Forms must not go in a circle. Each join doubles the steps taken."""
    at = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = at.select(F.col("word").alias("via"), F.col("root").alias("end"))
        nxt = stored(at.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), "forms")
        at = nxt.select("word", "root")
        if nxt.where("moved").isEmpty():
            return at


def spelling_variants(df: DataFrame, ratio: int = RATIO, group: int = GROUP, **how) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of df; how goes to vocabulary()."""
    vocab = stored(vocabulary(df, **how), "vocabulary")
    pairs = near_pairs(vocab, group)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m"))))
    best = F.min(F.struct((-F.col("m")).alias("m"), "other"))
    near = pairs.select(sides.alias("p")).select("p.*").groupBy(F.col("word").alias("near_word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = vocab.join(near, F.col("word") == F.col("near_word"), "left")
    is_form = -F.col("best.m") >= ratio * F.col("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")), "variants")
    ends = roots(rows.where("form IS NOT NULL")).withColumnRenamed("word", "rooted")
    return rows.join(ends, F.col("word") == F.col("rooted"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of the documents with its near words' number, its form and its root."""
    return spelling_variants(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH RECURSIVE crc(i, k, c) AS (
    SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i)
    UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]{{{LEAST_LENGTH},}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
coded AS (
    SELECT run, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
               lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + unicode(x) // 64)::BIGINT, (128 + unicode(x) % 64)::BIGINT] END)) AS bytes FROM runs),
hashed AS (
    SELECT run, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) AS h FROM coded, tab),
words AS (
    SELECT word, count(*) AS n, length(word) AS len FROM (
        SELECT CASE WHEN h % {TYPO_EVERY} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
    WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING count(*) >= {LEAST_COUNT}),
places AS (SELECT word, len, unnest(range(len)) AS p FROM words),
cut AS (SELECT word, len, p, substr(word, 1, p::INT) || substr(word, p::INT + 2) AS d FROM places),
one AS (SELECT DISTINCT cut.word AS a, words.word AS b FROM cut JOIN words ON cut.d = words.word),
near AS (
    SELECT a, b FROM one UNION SELECT b, a FROM one
    UNION SELECT x.word, y.word FROM cut x JOIN cut y ON x.d = y.d AND x.p = y.p AND x.word <> y.word),
best AS (
    SELECT near.a AS word, count(*) AS n_near, arg_min(near.b, struct_pack(m := -words.n, w := near.b)) AS form, max(words.n) AS form_n FROM near JOIN words ON near.b = words.word GROUP BY near.a),
forms AS (
    SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * words.n THEN form END AS form, CASE WHEN form_n >= {RATIO} * words.n THEN form_n END AS form_n
    FROM words LEFT JOIN best ON words.word = best.word),
walk(word, reached) AS (SELECT word, word FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON walk.reached = forms.word WHERE forms.form IS NOT NULL)
SELECT forms.word, forms.n, forms.n_near, forms.form, forms.form_n, walk.reached AS root
FROM forms JOIN walk ON forms.word = walk.word JOIN forms ends ON walk.reached = ends.word WHERE ends.form IS NULL
"""
