"""Language model scores: a hashed maximum-entropy model with a class-factored softmax.

Tokens are the words of the text in lower case (A-Z), then one end. A token belongs to a slot: the `HOT` most frequent
ones have a slot of their own, the others share `TAIL` slots by their last two bytes. Slots are the leaves of a tree of
classes: each class splits into `BRANCHES` ones of about equal mass, so frequent tokens have short paths. The model's
probability is

    p(token | history) = p(class | history) p(class below | class, history) ... p(token | slot)

All but the last are softmaxes over hashed features of the history: the last token, the last two, and the last but one
alone (a skip). The last is the add-one estimate within the slot, from counts of the whole training corpus, so the model
knows every token that occurs and leaves mass for those that don't. Without weights the softmaxes give the classes'
shares, that is the unigram model.

Weights are spread over parts. Events (a token and its history) are dealt by the last token, and parts are as many as
the training corpus has of `EVENTS`. A part holds a row of weights for each distinct feature and class of its training
events, so rows grow with the corpus and none is shared by chance. Each part makes gradient steps over all its training
events at once and then scores all its events. A very frequent token's events are cut by the token before, those of a
very frequent pair by the row's id. Nothing of that depends on how the input is partitioned. What travels are events and
sums a text, in compressed pieces, never weights.

Counts grow with the corpus, too, and stay distributed: the `HOT` most frequent tokens go to all tasks, the others are
joined.

Defined cases. A null text is empty: one end. Rows that repeat id and text score alike. Without training texts every
token is unknown: base_score is 0, and score is that of slots that are all as likely. An empty table gives an empty
result. Of the input's columns only those named are read.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylomill.llm.common import BLOCK, FOLD, blocks, crc32_of_id, mix, span_hashes, table, text_slices, word_spans
from stylomill.session import ship_package, stored

END = b"\n"  # no word holds white space
BRANCHES, HOT, TAIL = 16, 1 << 17, 1 << 10
#: Upper bits of a hash that tell where to look for it.
INDEX_BITS = 18
#: Training events of a part, and of the pieces that a frequent token's are cut into.
EVENTS, PIECE, MOST_PIECES = 1 << 16, 1 << 14, 1 << 12
#: Parts that one task holds the events of, and the least number of such groups.
TOGETHER, GROUPS = 16, 64
#: Gradient steps after the first, which starts at zero; their rate, and how many events' worth a weight is held back.
STEPS, RATE, SHRINK = 1, 4.0, 3.0
#: Words that a task counts before it hands them on; bytes of text that are dealt out together.
COUNTED, DEALT_BYTES = 400_000, 4 << 20
END_HASH = mix(np.array([0x14057B7EF767814F], np.uint64))[0]
#: Codes of tokens, as 32 bits: the slot of one that has its own; else this bit, the shared slot and bits of the hash.
SHARED, START = np.uint32(1 << 31), np.uint32(1 << 30)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of lower-cased text: hashes, last two bytes, and starts."""
    b = np.frombuffer(data, np.uint8)
    start, end = word_spans(b)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), start
    last = b[end - 1].astype(np.int64) | np.where(end - start > 1, b[np.maximum(end - 2, 0)].astype(np.int64), 0) << 8
    return span_hashes(b, start, end), last, start


def token_arrays(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and last two bytes of the tokens of all texts, ends included, and how many each text has."""
    hashes, lasts, counts, at = [], [], [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < BLOCK):
            size += len(texts[to]) + 1
            to += 1
        group = [t.translate(FOLD) for t in texts[at:to]]
        if len(group) == 1:
            parts = [_hashed(p) for p in blocks(group[0])] or [_hashed(b"")]
            h, last = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            n = np.array([len(h)])
        else:
            h, last, start = _hashed(b"\n".join(group))
            n = np.diff(np.r_[np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in group[:-1])])), len(start)])
        place = np.cumsum(n)
        hashes.append(np.insert(h, place, END_HASH))
        lasts.append(np.insert(last, place, -1))
        counts.append(n + 1)
        at = to
    if not counts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(lasts), np.concatenate(counts)


def token_slices(texts: list[bytes], size: int) -> Iterator[tuple]:
    """Tokens of texts in slices of about size bytes: the place of the first text, the pieces of text, token_arrays() of them, and whether the first one has begun in the slice before."""
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) <= size):
            held += len(texts[to])
            to += 1
        if held <= size:
            yield at, texts[at:to], *token_arrays(texts[at:to]), False
        else:  # one long text
            done = 0
            for piece in blocks(texts[at], size):
                done += len(piece)
                h, last, n = token_arrays([piece])
                more = int(done < len(texts[at]))  # the end is the last piece's
                yield at, [piece], h[: len(h) - more], last[: len(h) - more], n - more, done > len(piece)
        at = to


def shared_slot(last: np.ndarray) -> np.ndarray:
    """Which of the shared slots a token's last two bytes mean."""
    return mix(last.astype(np.uint64) + _A) % np.uint64(TAIL)


class Tree:
    """Classes over slots: each slot's path of (class, branch), and the log shares of each class's branches."""

    def __init__(self, mass: np.ndarray):
        order = np.argsort(-mass, kind="stable")
        upto = np.r_[0.0, np.cumsum(mass[order])]
        steps, shares, todo = [], [], deque([(0, len(mass), 0)])
        while todo:
            a, b, level = todo.popleft()
            cuts = self._cuts(upto, a, b)
            share = np.zeros(BRANCHES)
            share[: len(cuts) - 1] = np.diff(upto[cuts])
            for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                steps.append((level, len(shares), k, lo, hi))
                if hi - lo > 1:
                    todo.append((lo, hi, level + 1))
            shares.append(np.log(np.maximum(share, 1e-30) / share.sum()))
        self.shares = np.array(shares, np.float32)
        self.depth = np.zeros(len(mass), np.int64)
        self.classes = np.zeros((len(mass), steps[-1][0] + 1), np.int32)
        self.branches = np.zeros_like(self.classes)
        for level, c, k, lo, hi in steps:
            of = order[lo:hi]
            self.classes[of, level], self.branches[of, level], self.depth[of] = c, k, level + 1
        #: Paths as parts of keys: the class from bit 25, the branch below bit 5.
        self.steps = self.classes.ravel().astype(np.uint64) << np.uint64(25) | self.branches.ravel().astype(np.uint64)

    @staticmethod
    def _cuts(upto: np.ndarray, a: int, b: int) -> np.ndarray:
        """Bounds of at most BRANCHES parts of slots a to b, none empty, of about equal mass."""
        if b - a <= BRANCHES:
            return np.arange(a, b + 1)
        k = np.arange(1, BRANCHES)
        cuts = np.searchsorted(upto, upto[a] + (upto[b] - upto[a]) * k / BRANCHES)
        cuts = np.maximum.accumulate(np.maximum(cuts, a + k) - k) + k
        return np.r_[a, np.minimum(cuts, b - BRANCHES + k), b]


class Model:
    """The vocabulary of slots, with counts, and the tree over them."""

    def __init__(self, tokens: list[bytes], c: np.ndarray, total: np.ndarray, distinct: np.ndarray):
        """Tokens with slots of their own, and their counts; counts and distinct tokens of each shared slot."""
        c = np.asarray(c, np.int64)
        hashes = np.array([END_HASH if t == END else token_arrays([t])[0][0] for t in tokens], np.uint64)
        order = np.lexsort((hashes, -c))  # slots by frequency
        self.c = c[order]
        by_hash = np.argsort(hashes[order])
        self.own, self.own_slot = hashes[order][by_hash], by_hash.astype(np.int64)
        # where the hashes of each upper part begin
        self.first = np.searchsorted(self.own >> np.uint64(64 - INDEX_BITS), np.arange((1 << INDEX_BITS) + 1)).astype(np.int32)
        self.most = int(np.diff(self.first).max())
        self.log_c = np.log10(self.c + 1)
        self.log_size = np.log10(total + distinct + 1)
        self.tree = Tree(np.r_[self.c + 1.0, total + distinct + 1.0])
        ends = self.c[self.own_slot[np.searchsorted(self.own, END_HASH)]]
        # how often tokens are histories: own slots, starts of texts, and a bound for all others, as none is more frequent than the last own one
        self.often = np.r_[self.c, ends, min(self.c[-1], MOST_PIECES * PIECE)]

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own slots of hashes, and which have one."""
        upper = (h >> np.uint64(64 - INDEX_BITS)).astype(np.int64)
        at = np.minimum(self.first[upper], len(self.own) - 1)
        known = self.own[at] == h
        todo = np.flatnonzero(~known & (self.first[upper + 1] - at > 1))
        for k in range(1, self.most):
            next_ = at[todo] + k
            hit = self.own[np.minimum(next_, len(self.own) - 1)] == h[todo]
            at[todo[hit]], known[todo[hit]] = next_[hit], True
            todo = todo[~hit & (self.first[upper[todo] + 1] > next_ + 1)]
        return self.own_slot[at], known

    def codes(self, h: np.ndarray, last: np.ndarray) -> np.ndarray:
        slot, known = self.found(h)
        other = np.uint64(SHARED) | shared_slot(last) << np.uint64(21) | h >> np.uint64(43)
        return np.where(known, slot.astype(np.uint64), other).astype(np.uint32)

    def slots(self, code: np.ndarray) -> np.ndarray:
        return np.where(code < SHARED, code, len(self.c) + (code >> 21 & (TAIL - 1))).astype(np.int64)

    def at_most(self, code: np.ndarray) -> np.ndarray:
        """How often tokens are histories in training, or a bound on it."""
        return self.often[np.minimum(np.where(code == START, len(self.c), code), len(self.c) + 1)]


def histories(code: np.ndarray, n: np.ndarray, before: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each token's last token and last but one; before: the first text's two tokens before these, if it has begun earlier."""
    one, two = (np.r_[np.zeros(k, np.uint32), code[: len(code) - k]][: len(code)] for k in (1, 2))
    first = np.cumsum(n) - n
    one[first] = START
    two[first] = START
    two[(first + 1)[n > 1]] = START
    if before and len(code):
        one[0], two[0] = before
        two[1:2] = before[0]
    return one, two


def _starts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])


#: Groups that are computed together: their rows stay in the cache.
ROWS = 4096
_kept: dict[str, np.ndarray] = {}


def _space(name: str, n: int) -> np.ndarray:
    """Rows of a worker's array that parts use one after the other, as fresh memory costs more than the sums."""
    if name not in _kept or len(_kept[name]) < n:
        _kept[name] = np.empty((n + n // 4, BRANCHES), np.float32)
    return _kept[name][:n]


def _spans(n: int) -> list[tuple[int, int]]:
    return [(a, min(n, a + ROWS)) for a in range(0, n, ROWS)]


def _add_sums(w: np.ndarray, z: np.ndarray, start: np.ndarray, order: np.ndarray | None, rate: np.ndarray, short: int = 8) -> None:
    """Adds to w's rows the sums of z's rows, taken in order, by segments, times rates. Short segments go row by row for all at once."""
    at = (lambda i: i) if order is None else (lambda i: order[i])
    size = np.diff(np.r_[start, len(z)])
    for a, b in _spans(len(start)):
        first, n = start[a:b], size[a:b]
        sums = np.take(z, at(first), axis=0, mode="clip")
        few = np.flatnonzero((n > 1) & (n <= short))
        for j in range(1, short):
            if not len(few := few[n[few] > j]):
                break
            sums[few] += np.take(z, at(first[few] + j), axis=0, mode="clip")
        for i in np.flatnonzero(n > short):
            span = slice(first[i], first[i] + n[i])
            sums[i] = (z[span] if order is None else np.take(z, order[span], axis=0)).sum(axis=0)
        sums *= rate[a:b, None]
        w[a:b] += sums


def _short_hash(code: np.ndarray) -> np.ndarray:
    """20 bits of a history's token."""
    return code.astype(np.uint64) * _A >> np.uint64(44)


def part_scores(tree: Tree, one: np.ndarray, two: np.ndarray, slot: np.ndarray, learn: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """log10 p(slot | history) of a part's events, after gradient steps over those to learn from.

    Distinct events become items, one for each class on the slot's path. Items of one history and class share their
    softmax, so these groups are what is computed. Groups lie sorted by last token, class, and token before.
    """
    if not len(slot):
        return np.zeros(0)
    event = _short_hash(one) << np.uint64(40) | _short_hash(two) << np.uint64(20) | slot.astype(np.uint64)
    by_event = np.argsort(event)
    event = event[by_event]
    start = _starts(event)
    times = np.diff(np.r_[start, len(event)])
    learned = np.add.reduceat(learn[by_event].astype(np.float32), start)
    event = event[start]
    slot = (event & np.uint64((1 << 20) - 1)).astype(np.int64)
    depth = tree.depth[slot]
    item = np.repeat(np.arange(len(event)), depth)
    step = np.repeat(slot * tree.classes.shape[1] - (np.cumsum(depth) - depth), depth) + np.arange(len(item))
    low = np.uint64((1 << 20) - 1)
    key = (event >> np.uint64(40))[item] << np.uint64(44) | np.take(tree.steps, step) | (event >> np.uint64(20) & low)[item] << np.uint64(5)
    order = np.argsort(key)  # the order of equal keys doesn't matter: what is summed by key are counts
    key = key[order]
    start = _starts(key)  # outcomes: a group and a branch
    repeats = np.diff(np.r_[start, len(key)])
    seen = np.add.reduceat(learned[item[order]], start)
    branch, key = (key[start] & np.uint64(BRANCHES - 1)).astype(np.int64), key[start] >> np.uint64(5)
    first = _starts(key)
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
    place = of * BRANCHES + branch
    key, n, size = key[first], np.add.reduceat(seen, first), len(first)
    cls = (key >> np.uint64(20) & np.uint64((1 << 19) - 1)).astype(np.int64)
    # rows of weights of the last token, and of the one before; the pair's rows are the groups
    start1 = _starts(key >> np.uint64(20))
    row1 = np.repeat(np.arange(len(start1)), np.diff(np.r_[start1, size]))
    # sorted with the group's number, as sorting numbers is faster than sorting their places
    if size >= 1 << 24:
        raise ValueError("a part has more groups than its keys can number")
    key = np.sort(((key & low) << np.uint64(19) | cls.astype(np.uint64)) << np.uint64(24) | np.arange(size, dtype=np.uint64))
    order2 = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
    start2 = _starts(key >> np.uint64(24))
    row2 = np.empty(size, np.int64)
    row2[order2] = np.repeat(np.arange(len(start2)), np.diff(np.r_[start2, size]))
    n1, n2 = np.add.reduceat(n, start1), np.add.reduceat(n[order2], start2)
    rate, rate1, rate2 = (np.float32(RATE) / (x + np.float32(SHRINK)) for x in (n, n1, n2))

    # the first step, from zero: what followed, less the classes' shares
    shares = np.exp(tree.shares)
    w, w1, w2 = _space("w", size), _space("w1", len(start1)), _space("w2", len(start2))
    for to, c, f in ((w, cls, rate * n), (w1, cls[start1], rate1 * n1), (w2, cls[order2[start2]], rate2 * n2)):
        for a, b in _spans(len(to)):
            np.take(shares, c[a:b], axis=0, out=to[a:b], mode="clip")
            to[a:b] *= -f[a:b, None]
    w.reshape(-1)[place] += seen * rate[of]
    for to, row, f in ((w1, row1[of], rate1), (w2, row2[of], rate2)):
        np.add.at(to.reshape(-1), row * BRANCHES + branch, seen * f[row])

    spans, ones, other = _spans(size), np.ones(BRANCHES, np.float32), np.empty((ROWS, BRANCHES), np.float32)
    bounds = np.searchsorted(of, [a for a, _ in spans] + [size])
    inside = place - of // ROWS * (ROWS * BRANCHES)  # place within the group's span

    def logits(a: int, b: int, z: np.ndarray) -> None:
        more = other[: b - a]
        np.take(tree.shares, cls[a:b], axis=0, out=z, mode="clip")
        z += w[a:b]
        for x, row in ((w1, row1), (w2, row2)):
            np.take(x, row[a:b], axis=0, out=more, mode="clip")
            z += more
        np.minimum(z, 60, out=z)

    for _ in range(steps):
        g = _space("g", size)
        for (a, b), lo, hi in zip(spans, bounds[:-1], bounds[1:]):
            z = g[a:b]
            logits(a, b, z)
            np.exp(z, out=z)
            z *= (-n[a:b] / (z @ ones))[:, None]
            z.reshape(-1)[inside[lo:hi]] += seen[lo:hi]
        _add_sums(w1, g, start1, None, rate1)
        _add_sums(w2, g, start2, order2, rate2)
        for a, b in spans:
            g[a:b] *= rate[a:b, None]
            w[a:b] += g[a:b]
    out, z_all = np.empty(len(seen), np.float32), np.empty((ROWS, BRANCHES), np.float32)
    for (a, b), lo, hi in zip(spans, bounds[:-1], bounds[1:]):
        z = z_all[: b - a]
        logits(a, b, z)
        chosen = z.reshape(-1)[inside[lo:hi]]
        np.exp(z, out=z)
        out[lo:hi] = chosen - np.log(z @ ones)[of[lo:hi] - a]
    each = np.bincount(item[order], weights=np.repeat(out, repeats), minlength=len(event)) / math.log(10)
    scores = np.empty(len(by_event))
    scores[by_event] = np.repeat(each, times)
    return scores


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (token, c), summed up within the task as far as memory is bounded."""
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "c"])
        held.clear()
        return out

    for _, texts in text_slices(batches, 0):
        for t in texts:
            held.update(words_of(t))
            held[END] += 1
        if len(held) >= COUNTED:
            yield flush()
    if held:
        yield flush()


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, c) of all texts, stored."""
    found = df.select(F.coalesce(F.col(text), F.lit(""))).mapInArrow(_counted, "token binary, c long")
    return stored(found.groupBy("token").agg(F.sum("c").alias("c")), "token-counts")


def _shared_counts(own):
    """(token, c) to counts and distinct tokens of the shared slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, distinct = np.zeros(TAIL), np.zeros(TAIL)
        for b in batches:
            h, last, n = token_arrays([t if t != END else b"" for t in b.column(0).to_pylist()])
            first = np.cumsum(n) - n  # an end alone, or the word before its end
            at = np.minimum(np.searchsorted(own.value, h[first]), len(own.value) - 1)
            rest = own.value[at] != h[first]
            slot = shared_slot(last[first][rest]).astype(np.int64)
            total += np.bincount(slot, weights=b.column(1).to_numpy()[rest], minlength=TAIL)
            distinct += np.bincount(slot, minlength=TAIL)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAIL)), pa.array(total), pa.array(distinct)], ["slot", "total", "distinct"])

    return run


def most_frequent(counts: DataFrame, n: int) -> DataFrame:
    """At most n of the most frequent tokens: those above a count that a histogram of at most some hundred rows tells, so no task sends more than it has of them."""
    size = lambda c: F.floor(F.log2(c) * 16)
    bins = sorted(((r["b"], r["n"]) for r in counts.groupBy(size(F.col("c")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, held = math.inf, 0
    for b, k in bins:
        held += k
        if held > n:
            break
        least = b
    return counts.where(size(F.col("c")) >= F.lit(float(least)))


def vocabulary(counts: DataFrame, hot: int = HOT) -> Model:
    """The slots of a corpus with these token counts. What comes to the driver is bounded by hot."""
    rows = {bytes(r["token"]): r["c"] for r in most_frequent(counts, hot).collect()}
    if END not in rows:  # always has a slot
        rows[END] = counts.where(F.col("token") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    tokens = sorted(rows)
    h, _, n = token_arrays([t if t != END else b"" for t in tokens])
    own = counts.sparkSession.sparkContext.broadcast(np.sort(h[np.cumsum(n) - n]))
    found = counts.mapInArrow(_shared_counts(own), "slot long, total double, distinct double").groupBy("slot").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).toPandas()
    total, distinct = np.zeros(TAIL), np.zeros(TAIL)
    total[found["slot"]], distinct[found["slot"]] = found["total"], found["distinct"]
    return Model(tokens, np.array([rows[t] for t in tokens]), total, distinct)


TO_SCORE, TO_LEARN = 1, 2
_ROW_BITS, _SUB_BITS = 24, 6


def _packed(a: np.ndarray) -> bytes:
    """32-bit numbers, compressed by their bytes' places."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: type = np.uint32) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view(kind).ravel()


def parts_of(model: Model, one: np.ndarray, two: np.ndarray, row: np.ndarray, parts: int) -> np.ndarray:
    """The part of each event; row is a hash that tells rows apart."""
    c1, c2 = model.at_most(one), model.at_most(two)
    one, two = one.astype(np.uint64), two.astype(np.uint64)
    salt = two + row % np.maximum(np.minimum(c1, c2) // EVENTS, 1).astype(np.uint64) * _C
    salt = mix(salt) % np.maximum(c1 // PIECE, 1).astype(np.uint64)
    return ((mix((one ^ _B) + salt * _A) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _dealt(model, parts: int, together: int):
    """(uid, kind, row, text) to events in pieces by group of parts: last token, the one before, token, and row with part and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, before = model.value, None
        for b, texts in text_slices(batches, 3, DEALT_BYTES):
            uid, kind, rows = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.uint32), mix(b.column(2).to_numpy().view(np.uint64))
            low = int(uid[0])
            if uid[-1] - low >> _ROW_BITS:
                raise ValueError("a batch of too many rows")
            named = (uid - low).astype(np.uint32) | kind << np.uint32(_ROW_BITS + _SUB_BITS)
            for at, _, h, last, n, begun in token_slices(texts, DEALT_BYTES):
                code = m.codes(h, last)
                del h, last
                one, two = histories(code, n, before if begun else None)
                if len(code):
                    before = code[-1], (code[-2] if len(code) > 1 else one[-1])
                of = np.repeat(np.arange(at, at + len(n)), n)
                group, sub = np.divmod(parts_of(m, one, two, rows[of], parts), together)
                order = np.argsort(group.astype(np.uint16) if parts <= together << 16 else group, kind="stable")  # short integers sort by radix
                event = np.stack([one, two, code, named[of] | sub.astype(np.uint32) << np.uint32(_ROW_BITS)])[:, order]
                group = group[order]
                starts = _starts(group) if len(group) else np.zeros(0, np.int64)
                ends = np.r_[starts[1:], len(group)]
                data = [_packed(np.ascontiguousarray(event[:, i:j]).ravel()) for i, j in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(group[starts]), pa.array([low] * len(data), pa.int64()), pa.array((ends - starts)[: len(data)]), pa.array(data, pa.binary())], ["group", "low", "n", "data"])

    return run


def _learned(model):
    """A group's events to each row's sum of log10 p(slot | history), in pieces by where the rows come from."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, sizes = model.value, pdf["n"].tolist()
        event = np.concatenate([_unpacked(x, 4 * n).reshape(4, n) for x, n in zip(pdf["data"], sizes)], axis=1)
        source = np.repeat(np.arange(len(sizes)), sizes)
        sub = event[3] >> np.uint32(_ROW_BITS) & np.uint32((1 << _SUB_BITS) - 1)
        order = np.argsort(sub.astype(np.uint8), kind="stable")
        event, source = event[:, order], source[order]
        one, two, code, row = event
        learn, to_score = (row >> np.uint32(31)) > 0, (row >> np.uint32(30) & np.uint32(1)) > 0
        starts = _starts(sub[order])
        logs = [part_scores(m.tree, one[i:j], two[i:j], m.slots(code[i:j]), learn[i:j]) for i, j in zip(starts, np.r_[starts[1:], len(code)])]
        key = source[to_score] << _ROW_BITS | (row[to_score] & np.uint32((1 << _ROW_BITS) - 1)).astype(np.int64)
        key, of = np.unique(key, return_inverse=True)
        sums = np.bincount(of, weights=np.concatenate(logs)[to_score], minlength=len(key)).astype(np.float32)
        starts = _starts(key >> _ROW_BITS) if len(key) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(key)][: len(starts)]
        rows = (key & ((1 << _ROW_BITS) - 1)).astype(np.uint32)
        low = pdf["low"].to_numpy()[(key[starts] >> _ROW_BITS)]
        return pd.DataFrame({"low": low, "n": ends - starts, "rows": [_packed(rows[i:j]) for i, j in zip(starts, ends)], "sums": [_packed(sums[i:j]) for i, j in zip(starts, ends)]})

    return run


def _gathered(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sums of the rows of one place, from all groups."""
    rows = np.concatenate([_unpacked(x, n) for x, n in zip(pdf["rows"], pdf["n"])])
    sums = np.concatenate([_unpacked(x, n, np.float32) for x, n in zip(pdf["sums"], pdf["n"])]).astype(np.float64)
    ids, of = np.unique(rows, return_inverse=True)
    return pd.DataFrame({"uid": pdf["low"].iloc[0] + ids.astype(np.int64), "m2": np.bincount(of, weights=sums)})


def _scored(model):
    """(uid, id, text) to each row's tokens, and of tokens with own slots how many are known and the sum of their logs; the sum of what the slots' counts are divided by; and the other tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b, texts in text_slices(batches, 2):
            n_tokens, n_known, logs, sizes, n_rest = np.zeros((5, len(texts)))
            rest: list[bytes] = []
            for at, pieces, h, last, n, _ in token_slices(texts, DEALT_BYTES):
                slot, own = m.found(h)
                first = np.cumsum(n) - n
                of = np.repeat(np.arange(len(n)), n)
                log_c = np.where(own, m.log_c[slot], 0)
                size = np.where(own, log_c, m.log_size[shared_slot(last).astype(np.int64)])
                for to, x in ((n_tokens, None), (n_known, own & (m.c[slot] > 0)), (logs, log_c), (sizes, size), (n_rest, ~own)):
                    to[at : at + len(n)] += n if x is None else np.bincount(of, weights=x, minlength=len(n))
                other = np.flatnonzero(~own)
                cut = np.searchsorted(other, np.r_[first, len(h)]).tolist()
                for i, (lo, hi, k) in enumerate(zip(cut[:-1], cut[1:], first.tolist())):
                    if lo < hi:
                        words = words_of(pieces[i])
                        rest += [words[j] for j in (other[lo:hi] - k).tolist()]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_rest)].astype(np.int32)), pa.array(rest, pa.binary()))
            arrays = [pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(logs), pa.array(-sizes), lists]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], ["uid", "id", "n_tokens", "k", "s", "m", "rest"])

    return run


def score(df: DataFrame, train: DataFrame, text: str = "text", id_col: str = "doc_id", learn: Column | None = None, hot: int = HOT) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of df, learned from train; with learn, train is df.where(learn), events are made once for both, and df is a scan, which gives its rows in the same order each time."""
    spark = df.sparkSession
    ship_package(spark)
    counts = token_counts(train, text)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    model = spark.sparkContext.broadcast(vocabulary(counts, hot))
    kind = df.schema[id_col].dataType.simpleString()
    uid, whole = F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(text), F.lit("")).alias("text")
    row = F.xxhash64(F.col(id_col)).alias("row")
    rows = df.select(uid, F.col(id_col).alias("id"), whole)
    if learn is None:
        rows = stored(rows, "texts")  # as two passes go by uid
        every = rows.select("uid", F.lit(TO_SCORE).alias("kind"), F.xxhash64("id").alias("row"), "text").unionByName(train.select(uid, F.lit(TO_LEARN).alias("kind"), row, whole))
    else:
        every = df.select(uid, F.when(learn, TO_SCORE + TO_LEARN).otherwise(TO_SCORE).alias("kind"), row, whole)
    # parts by the events of both, so that a small train doesn't give a part all rows to score
    tokens = df.agg(F.sum(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + F.lit(1).cast("long"))).first()[0] or 0
    parts = max(1, math.ceil(max(n, tokens) / EVENTS))
    together = min(TOGETHER, max(1, parts // GROUPS))
    events = every.mapInArrow(_dealt(model, parts, together), "group long, low long, n long, data binary")
    sums = events.groupBy("group").applyInPandas(_learned(model), "low long, n long, rows binary, sums binary")
    sums = sums.groupBy("low").applyInPandas(_gathered, "uid long, m2 double")
    found = stored(rows.mapInArrow(_scored(model), f"uid long, id {kind}, n_tokens long, k long, s double, m double, rest array<binary>"), "scored")
    rest = found.select("uid", F.explode("rest").alias("token")).join(counts, "token")
    rest = rest.groupBy("uid").agg(F.count(F.lit(1)).alias("k2"), F.sum(F.log10(F.col("c") + 1)).alias("s2"))
    both = found.drop("rest").join(rest, "uid", "left").join(sums, "uid", "left")
    known = F.col("k") + F.coalesce("k2", F.lit(0))
    logs = F.col("s") + F.coalesce("s2", F.lit(0.0))
    return both.select("id", "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"), (logs + F.col("m") + F.coalesce("m2", F.lit(0.0))).alias("score"))


def held_out(id_col: Column) -> Column:
    """The rows that the query doesn't learn from."""
    return F.pmod(crc32_of_id(id_col), F.lit(7)) == 2


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its log10 probability under the add-one unigram base and under the model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = ~held_out(F.col("doc_id"))
    found = score(docs, docs.where(learn), learn=learn)
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
