"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to `ORDER` bytes, with counts of the bytes that followed. A byte costs
-log2 of its probability in the longest context that knows it, plus the escapes from the longer ones that don't (method
C: n distinct followers get n of total + n). After fitting the counts are frozen, so a text's cost in a language is an
exact code length: that of its words in lower case (A-Z) with one space after each, contexts running through (a text of
more than PIECE bytes is coded in pieces that each start anew). The language of the shortest code wins; the score is its share of the probability.

Only a word's first bytes see what is before it. So the cost of a word is that of its junction, the first ORDER - 1 bytes
after the last ones of the word before, and of its body; both are kept and looked up where they occur again.

Scoring is a search in one sorted table of (context, byte) keys that all languages share; each key holds its resolved
costs, one for each language.

Fitting takes a sample of about `sample_docs` distinct labelled texts a language (chosen by the hash of the text), whole
texts, up to the one that reaches `sample_bytes`; these are parameters, and they bound the model. Prediction covers whole
texts, all rows, and sees text only.

Defined cases. A null text, or one without a letter, is `und` with score 0; so is every text if there is nothing to
learn from. Ties go to the language that sorts first. Repeated rows are predicted alike. An empty table gives an empty
result. Columns named lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stylomill.llm.common import FOLD, blocks, crc32_of_id, table, text_slices, trimmed, unused
from stylomill.session import ship_package

ORDER, SAMPLE_DOCS, SAMPLE_BYTES = 4, 300, 4 << 20
UND = "und"
#: Words that a worker keeps costs of, and the longest of them; bits of the number of junctions that it keeps.
CACHE_WORDS, LONGEST, JUNCTION_BITS = 150_000, 64, 17
#: Words, and bytes of text, that are coded together.
TOGETHER = 10_000
PIECE = 1 << 19
LETTER = regex.compile(r"\p{L}")
LEAD, SPACE = bytes(ORDER - 1) + b" ", 32
FIRST = ORDER - 1  # bytes of a word, its space among them, that see what is before it


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Of all texts one after the other, each folded and with LEAD before it: bytes, where each text's begin, and words."""
    split = [t.translate(FOLD).split() for t in texts]
    folded = [LEAD + b"".join(w + b" " for w in words) for words in split]
    size = np.array([len(f) for f in folded], np.int64)
    return np.frombuffer(b"".join(folded), np.uint8).astype(np.int64), np.cumsum(size) - size, split


def _contexts(flat: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The ORDER bytes before places as an integer, the nearest lowest."""
    context = np.zeros(len(place), np.int64)
    for k in range(1, ORDER + 1):
        context |= flat[place - k] << np.int64(8 * (k - 1))
    return context


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context << 8 | byte) of all bytes of texts, and how often they occur."""
    flat, begin, _ = _stream(texts)
    of_text = np.ones(len(flat), bool)
    for k in range(len(LEAD)):
        of_text[begin + k] = False
    place = np.flatnonzero(of_text)
    return np.unique(_contexts(flat, place) << np.int64(8) | flat[place], return_counts=True)


def _short(context: np.ndarray, k: int) -> np.ndarray:
    """The nearest k bytes of contexts, with the order in the upper bits."""
    return context & np.int64((1 << (8 * k)) - 1) | np.int64(k) << np.int64(48)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of keys, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Model:
    """Frozen context trees of all languages."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        """grams: of each language keys (context << 8 | byte) and counts."""
        self.langs = sorted(grams)
        n_langs = len(self.langs)
        trees = []  # for each language and order: (context << 8 | byte) keys with counts, contexts with totals and distinct followers
        for lang in self.langs:
            context, symbol, weight = grams[lang][0] >> np.int64(8), grams[lang][0] & np.int64(255), grams[lang][1].astype(np.float64)
            orders = []
            for k in range(ORDER + 1):
                keys, inverse = np.unique(_short(context, k) << np.int64(8) | symbol, return_inverse=True)
                n = np.bincount(inverse, weights=weight, minlength=len(keys))
                contexts, of = np.unique(keys >> np.int64(8), return_inverse=True)
                total, distinct = np.bincount(of, weights=n, minlength=len(contexts)), np.bincount(of, minlength=len(contexts))
                orders.append((keys, -np.log2(n / (total + distinct)[of]), contexts, -np.log2(distinct / (total + distinct))))
            trees.append(orders)
        self.keys, self.costs, self.contexts, self.escapes = [], [], [], []
        for k in range(ORDER + 1):
            contexts = np.unique(np.concatenate([t[k][2] for t in trees])) if trees else np.zeros(0, np.int64)
            escapes = np.zeros((len(contexts), n_langs))
            keys = np.unique(np.concatenate([t[k][0] for t in trees])) if trees else np.zeros(0, np.int64)
            # what a byte costs that isn't known here: the escape, if the context is, and the cost one order below
            lower = self._below(keys, k, n_langs)
            costs = np.empty((len(keys), n_langs))
            for j, t in enumerate(trees):
                at = _find(t[k][2], contexts)
                escapes[at >= 0, j] = t[k][3][at[at >= 0]]
            here = escapes[np.searchsorted(contexts, keys >> np.int64(8))] if len(keys) else costs
            for j, t in enumerate(trees):
                at = _find(t[k][0], keys)
                costs[:, j] = np.where(at >= 0, t[k][1][at] if len(t[k][1]) else 0, here[:, j] + lower[:, j])
            self.keys.append(keys), self.costs.append(costs), self.contexts.append(contexts), self.escapes.append(escapes)

    def _below(self, keys: np.ndarray, k: int, n_langs: int) -> np.ndarray:
        if k == 0:
            return np.full((len(keys), n_langs), 8.0)  # any byte
        context, symbol = (keys >> np.int64(8)) & np.int64((1 << 48) - 1), keys & np.int64(255)
        return self.cost(context, symbol, k - 1)

    def cost(self, context: np.ndarray, symbol: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of each symbol in each language."""
        out = np.zeros((len(context), len(self.langs)))
        todo = np.arange(len(context))
        for k in range(order, -1, -1):
            short = _short(context[todo], k)
            at = _find(self.keys[k], short << np.int64(8) | symbol[todo])
            known = at >= 0
            out[todo[known]] += self.costs[k][at[known]]
            todo, short = todo[~known], short[~known]
            at = _find(self.contexts[k], short)
            out[todo[at >= 0]] += self.escapes[k][at[at >= 0]]
        out[todo] += 8.0
        return out

    def bodies(self, words: list[bytes]) -> np.ndarray:
        """Bits of each word, from its FIRST byte on, in each language."""
        out = [np.zeros((0, len(self.langs)))]
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            size = np.array([max(0, len(w) + 1 - FIRST) for w in part], np.int64)
            flat = np.frombuffer(b"".join(b" " + w + b" " for w in part), np.uint8).astype(np.int64)
            ends = np.cumsum([len(w) + 2 for w in part])
            place = np.repeat(ends - size, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            bits = np.zeros((len(part), len(self.langs)))
            some = np.flatnonzero(size)
            if len(some):
                bits[some] = np.add.reduceat(self.cost(_contexts(flat, place), flat[place]), (np.cumsum(size) - size)[some], axis=0)
            out.append(bits)
        return np.concatenate(out)

    def junctions(self, keys: np.ndarray) -> np.ndarray:
        """Bits of the first bytes of words after what is before them; see Scorer.junction_keys()."""
        out = np.zeros((len(keys), len(self.langs)))
        before = keys >> np.int64(8 * FIRST) & np.int64((1 << (8 * FIRST)) - 1)
        context = before << np.int64(8) | SPACE
        for k in range(FIRST):
            symbol = keys >> np.int64(8 * (FIRST - 1 - k)) & np.int64(255)
            has = np.flatnonzero(keys >> np.int64(16 * FIRST) > k)
            out[has] += self.cost(context[has] & np.int64((1 << (8 * ORDER)) - 1), symbol[has])
            context = context << np.int64(8) | symbol
        return out


class Scorer:
    """A worker's model with its cache of words."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.bits = np.zeros((0, len(self.model.langs)))
        self.known = np.full(1 << JUNCTION_BITS, -1, np.int64)
        self.known_bits = np.zeros((1 << JUNCTION_BITS, len(self.model.langs)))

    @staticmethod
    def junction_keys(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """For each word: how many of its first FIRST bytes there are (its space counts), the FIRST bytes before the space before it, and these first bytes."""
        starts = np.flatnonzero((flat[1:] != SPACE) & (flat[:-1] == SPACE)) + 1
        starts = starts[~np.isin(starts, begin)]  # the next text's lead isn't a word
        before, first, n, open_ = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
        for k in range(FIRST):
            before = before << np.int64(8) | flat[starts - 1 - FIRST + k]
            b = np.where(open_, flat[np.minimum(starts + k, len(flat) - 1)], 0)
            first = first << np.int64(8) | b
            n += open_
            open_ &= b != SPACE
        return (n << np.int64(8 * FIRST) | before) << np.int64(8 * FIRST) | first

    def _junctions(self, keys: np.ndarray) -> np.ndarray:
        """Bits by key, from a table that keeps the last one of each place."""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - JUNCTION_BITS)).astype(np.int64)
        bits = self.known_bits[at]
        new = np.flatnonzero(self.known[at] != keys)
        if len(new):
            fresh, of = np.unique(keys[new], return_inverse=True)
            found = self.model.junctions(fresh)
            bits[new] = found[of]
            place, i = np.unique(at[new], return_index=True)
            self.known[place], self.known_bits[place] = keys[new[i]], bits[new[i]]
        return bits

    def _sum(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language; the texts are of bounded size in all."""
        flat, begin, split = _stream(texts)
        fresh = list(set().union(*split) - self.place.keys())
        if len(self.place) + len(fresh) > CACHE_WORDS and self.place:
            self._forget()
            fresh = list(set().union(*split))
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
        self.bits = np.concatenate([self.bits, self.model.bodies(fresh)])
        n = np.array([len(s) for s in split], np.int64)
        k = np.fromiter((self.place[w] for s in split for w in s), np.int64, int(n.sum()))
        out = np.zeros((len(texts), len(self.model.langs)))
        some = np.flatnonzero(n)
        if len(some):
            out[some] = np.add.reduceat(self.bits[k] + self._junctions(self.junction_keys(flat, begin)), (np.cumsum(n) - n)[some], axis=0)
        for w in [w for w in fresh if len(w) > LONGEST]:  # not worth their memory
            del self.place[w]
        if len(self.place) != len(self.bits):
            self._compact()
        return out

    def _compact(self) -> None:
        self.bits = self.bits[list(self.place.values())]
        self.place = dict(zip(self.place, range(len(self.place))))

    def sums(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.model.langs)))
        todo: list[bytes] = []
        of: list[int] = []
        held = 0
        for i, t in enumerate(texts):
            for piece in blocks(t, PIECE) if len(t) > PIECE else [t]:
                todo.append(piece), of.append(i)
                held += len(piece)
                if held >= PIECE:
                    np.add.at(out, of, self._sum(todo))
                    todo, of, held = [], [], 0
        if todo:
            np.add.at(out, of, self._sum(todo))
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float], list[float]]:
        """Languages, scores, and bits a byte of the shortest codes (0 without a language)."""
        n = len(self.model.langs)
        bits = self.sums(texts) if n else np.zeros((len(texts), 1))
        best, least = bits.argmin(axis=1), bits.min(axis=1)
        score = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(axis=1)
        lang, prob, rate = [], [], []
        for t, b, s, x in zip(texts, best, score, least):
            known = n and LETTER.search(t.decode("utf-8", "replace"))
            lang.append(self.model.langs[b] if known else UND)
            prob.append(float(s) if known else 0.0)
            rate.append(float(x) / max(1, len(t)) if known else 0.0)
        return lang, prob, rate


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, key, n), summed up by slice."""
    for b, texts in text_slices(batches, 1):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column(0).to_pylist(), texts):
            by_lang.setdefault(lang, []).append(text)
        for lang, some in by_lang.items():
            keys, n = gram_counts(some)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], ["lang", "key", "n"])


def fit(df: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of the labelled rows of df. What comes to the driver is bounded by sample_docs and sample_bytes for each label."""
    ship_package(df.sparkSession)
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    draw = lambda h: F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)
    texts = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(draw(F.col("h"))).alias("least")).collect()
    if not texts:
        return Model({})
    share = F.lit(1.0)
    for r in texts:  # copies count once; the text that is drawn first is always in, so that no label is without one
        share = F.when(F.col("lang") == r["lang"], F.lit(max(min(1.0, sample_docs / r["n"]), r["least"]))).otherwise(share)
    sample = rows.where(draw(F.col("h")) <= share).dropDuplicates(["lang", "text"])
    before = Window.partitionBy("lang").orderBy(draw(F.col("h")), "text").rowsBetween(Window.unboundedPreceding, -1)  # about sample_docs rows
    sample = sample.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("before") < sample_bytes)
    grams = sample.select("lang", "text").mapInArrow(trimmed(_count), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    keys, n, names = grams["key"].to_numpy(), grams["n"].to_numpy(), np.array(grams["lang"].to_pylist())
    found = {}
    for r in texts:
        mine = np.flatnonzero(names == r["lang"])
        mine = mine[np.argsort(keys[mine], kind="stable")]
        found[r["lang"]] = (keys[mine], n[mine])
    return Model(found)


_scorers: dict[int, Scorer] = {}


def predict(df: DataFrame, model: Model, text: str = "text", bits: str | None = None) -> DataFrame:
    """df with lang_pred and score, and, if it is named, bits: those a byte of the shortest code, 0 for `und`."""
    ship_package(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    made = ["lang_pred", "score", *([bits] if bits else [])]
    base = df.drop(*made)
    at = base.columns.index(text)
    names = [f"c{i}" for i in range(len(base.columns))]
    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, base.schema.fields)), "lang_pred string, score double, bits double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        if id(found) not in _scorers:
            _scorers.clear()
            _scorers[id(found)] = Scorer(found)
        for b, texts in text_slices(batches, at, PIECE):
            lang, score, rate = _scorers[id(found)].predict(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], [*names, "lang_pred", "score", "bits"])

        del found
        _scorers.clear()  # a task's

    out = base.mapInArrow(trimmed(run), schema).toDF(*base.columns, "lang_pred", "score", unused("bits", base.columns))
    return out.toDF(*base.columns, *made) if bits else out.drop(out.columns[-1])


def held_out(id_col: Column) -> Column:
    """The rows that the query doesn't learn from."""
    return F.pmod(crc32_of_id(id_col), F.lit(5)) == 0


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its predicted language, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
