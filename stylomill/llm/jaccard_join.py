"""N-gram Jaccard join: texts whose sets of word shingles are similar, and the components that such links form.

Sets link when their Jaccard similarity is at least `percent`. Two linked sets share at least `least(n)` of n shingles,
so, all sets sorted by one order, the first n - least(n) + l of both share at least l: a prefix of multiplicity l. A pair
needs as many matches as the smaller of its two multiplicities asks for.

1. Sets are sorted by hash and cut to a prefix of multiplicity n / 10. Prefixes go to tasks by a hash of the shingles; a
   task reports how many shingles of a set another set has, too. Sets with too few are linked with nothing. A shingle
   that is frequent within a batch is counted there and sent once, so its rows grow with batches, not with documents.
2. For what remains, exact frequencies are counted. Sets with too few shared shingles drop out again.
3. Adaptive prefixes: shared shingles are sorted by frequency, unshared ones come first. Each set takes the multiplicity
   of the smallest estimated cost: rows of its prefix's lists, and candidates to verify, fewer as more matches are asked.
4. Of two linked sets the prefixes share at least as many shingles as matches() tells from their sizes, often more than
   the multiplicity. So the first that they share has that many prefix shingles after it in both. In a long list, rows
   without a possible partner by this rule drop out: a passage that is common to texts of little else in common makes no
   candidates.
5. Of each list's sets the one with the fewest unshared shingles is the hub. The others are candidates with it. They are
   verified if the prefixes share as many shingles as matches() asks for. This joins a group of near copies without its
   pairs.
6. What the hubs have left apart is searched exactly: in each hub's cluster, sets outside the largest component are
   compared with all sets of the cluster in blocks of bounded size: first matches in the prefixes, then whole sets.
   No link between different components is lost; links within one aren't listed.

Sets bear 64-bit names in step 1. Where sets of different 128-bit names share one, all of them are kept and get names of
their own, so no sets are ever taken for each other.

Defined cases. A text with fewer words than a shingle has is one shingle; one without words, or null, has none and is
alone. A null id is larger than any other for component_id. Rows that repeat an id each get their row. Equal sets are one
node. An empty table gives an empty result. Of the input's columns only text and id are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stylomill.llm.common import mix, table, text_bytes, trimmed
from stylomill.llm.components import components
from stylomill.llm.shingles import WORDS, shingle_sets, signature
from stylomill.session import broadcast_if_small, cut, ship_package, stored

PERCENT = 80
#: Bytes of text that are cut into shingles together, and shingles that one task of step 1 receives.
BATCH_BYTES, TASK_SHINGLES = 4 << 20, 1 << 19
#: Largest adaptive multiplicity; what verifying a candidate costs, in rows of a list.
MOST_MATCHES, VERIFY_COST = 8, 8
#: Sets in a block of step 6; rows of a list from which step 4 looks for rows without a partner; sets of a hub that one task verifies.
BLOCK_SETS, LONG_LIST, HUB_SETS = 256, 64, 2048
#: Sizes within this factor are one class of sizes.
SIZE_STEP = 1.05
MANY = np.iinfo(np.int64).min  # stands for several sets of one batch


def least(n, percent: int = PERCENT):
    """Shingles that a set of n must share with any set it links with."""
    return -(-percent * n // 100)


def first_matches(n):
    """Multiplicity of step 1's prefixes."""
    return np.maximum(1, n // 10)


def matches(n, m, rest_n, rest_m, percent: int = PERCENT):
    """Shingles that the prefixes of linked sets of n and m share at least, where rest_n and rest_m shared shingles come after the prefixes."""
    return np.maximum(1, -(-percent * (n + m) // (100 + percent)) - np.maximum(rest_n, rest_m))


def ref_of(name: bytes, bits: int = 64) -> np.int64:
    """A set's name in step 1."""
    return np.int64(int.from_bytes(name[:8], "little", signed=True) >> (64 - bits))


def _prefixes(percent: int, words: int, ranges: int, bits: int = 64):
    """(id, hash, text) to rows of three kinds: 0 a document, 1 prefix shingles of a part, 2 counts made within the batch."""

    def rows(ids: list, hashes: list, texts: list[bytes], id_type: pa.DataType) -> pa.RecordBatch:
        names, sizes, seen, parts = [], [], {}, []
        for s in shingle_sets(texts, words):
            name = signature(s)
            names.append(name)
            sizes.append(len(s))
            if len(s) and name not in seen:
                seen[name] = ref_of(name, bits)
                parts.append(s[: len(s) - least(len(s), percent) + int(first_matches(len(s)))])
        k = len(ids)
        out = {"kind": [0] * k, "part": [0] * k, "n": sizes, "name": names, "a": [None] * k, "b": [None] * k}

        def add(kind: int, part: int, a: np.ndarray, b: np.ndarray) -> None:
            for c, x in zip(out.values(), (kind, part, 0, None, a.tobytes(), b.tobytes())):
                c.append(x)

        if parts:
            refs = np.fromiter(seen.values(), np.int64, len(seen))
            shingle, ref = np.concatenate(parts), np.repeat(refs, [len(p) for p in parts])
            order = np.argsort(shingle, kind="stable")
            shingle, ref = shingle[order], ref[order]
            start = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
            size = np.diff(np.r_[start, len(shingle)])
            several = np.repeat(size > 1, size)
            of, n = np.unique(ref[several], return_counts=True)
            if len(of):
                add(2, 0, of, n.astype(np.int64))
            shingle, ref = shingle[start], np.where(size > 1, MANY, ref[start])
            part = (mix(shingle) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)  # prefixes hold the lowest hashes, so these are mixed
            order = np.argsort(part, kind="stable")
            part, shingle, ref = part[order], shingle[order], ref[order]
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for lo, hi in zip(at, np.r_[at[1:], len(part)]):
                add(1, int(part[lo]), shingle[lo:hi], ref[lo:hi])
        more = [None] * (len(out["kind"]) - k)
        types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        arrays = [pa.array(ids + more, id_type), pa.array(hashes + more, pa.int64()), *(pa.array(c, t) for c, t in zip(out.values(), types))]
        return pa.RecordBatch.from_arrays(arrays, ["id", "hash", *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, texts, held, id_type = [], [], [], 0, None
        for b in batches:
            id_type = b.column(0).type
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2))):
                ids.append(i), hashes.append(h), texts.append(t)
                held += len(t)
                if held >= BATCH_BYTES:
                    yield rows(ids, hashes, texts, id_type)
                    ids, hashes, texts, held = [], [], [], 0
        if ids:
            yield rows(ids, hashes, texts, id_type)

    return run


def _seen_elsewhere(groups: int):
    """Of one part of the shingles: how many of a set's other sets have, too (those of the same batch are counted there). Sets in packed groups."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shingle = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["a"]])
        ref = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["b"]])
        order = np.lexsort((ref, shingle))
        shingle, ref = shingle[order], ref[order]
        new = np.r_[True, shingle[1:] != shingle[:-1]]
        keep = new | np.r_[True, ref[1:] != ref[:-1]] | (ref == MANY)  # a set with copies in several batches counts once
        shingle, ref = shingle[keep], ref[keep]
        start = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
        size = np.diff(np.r_[start, len(shingle)])
        shared = ref[np.repeat(size > 1, size)]
        of, n = np.unique(shared[shared != MANY].view(np.uint64), return_counts=True)
        group = (((of >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)
        at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(of) else np.zeros(0, np.int64)
        ends = np.r_[at[1:], len(of)]
        return pd.DataFrame({"group": group[at], "a": [of[i:j].tobytes() for i, j in zip(at, ends)], "b": [n[i:j].astype(np.int64).tobytes() for i, j in zip(at, ends)]})

    return run


def _totals(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over all ranges of one group's sets."""
    ref, inverse = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in pdf["a"]]), return_inverse=True)
    c = np.bincount(inverse, weights=np.concatenate([np.frombuffer(x, np.int64) for x in pdf["b"]]))
    return pd.DataFrame({"ref": ref, "c": c.astype(np.int64)})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)), pa.array(np.frombuffer(n, np.int64))], ["ref", "c"])


def _sets(words: int):
    """(ref, name, text) to (ref, n, shingles), where the text has the set that is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            refs, sets = [], []
            for ref, name, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingle_sets(text_bytes(b.column(2)), words)):
                if signature(s) == name:
                    refs.append(ref), sets.append(s.view(np.int64))
            n = [len(s) for s in sets]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat))], ["ref", "n", "shingles"])

    return run


def multiplicity(c: np.ndarray, open_: int, most: int) -> int:
    """Matches to ask for: c are the frequencies of a set's shared shingles, ascending; open_ + l of them make a prefix."""
    work = np.cumsum(c - 1)
    asked = np.arange(1, most + 1)
    rows = work[np.minimum(open_ + asked, len(c)) - 1]
    return int(asked[np.argmin(rows * (1 + VERIFY_COST / asked))])


def _adaptive(percent: int):
    """(ref, n, shared) to the adaptive prefix: its shingles, how many of the set are unshared, and the multiplicity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, l, prefixes = [], [], [np.zeros(0, np.int64)]
            for n, shared in zip(b.column(1).to_pylist(), b.column(2)):
                c, h = (shared.values.field(i).to_numpy() for i in (0, 1))
                open_ = len(c) - least(n, percent)  # prefix of all shingles less the unshared ones, for l = 0
                take = multiplicity(c, open_, min(MOST_MATCHES, least(n, percent)))
                u.append(n - len(c)), l.append(take), prefixes.append(h[: open_ + take])
            ends = np.cumsum([len(p) for p in prefixes])
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(u, pa.int64()), pa.array(l, pa.int64()), prefix], ["ref", "n", "u", "l", "prefix"])

    return run


def alive(postings: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Postings (h, ref, n, u, l, tail) of lists of at least two rows, of long lists only those rows that may have a partner there. sizes: (h, k)."""
    several = postings.join(sizes.where("k > 1"), "h")
    short, long = several.where(F.col("k") <= LONG_LIST).drop("k"), several.where(F.col("k") > LONG_LIST).drop("k")
    step = math.log(SIZE_STEP)
    size_class = F.floor(F.log("n") / step).cast("int")
    per = long.groupBy("h", size_class.alias("s")).agg(F.max("tail").alias("t"))  # the rows of a task are summed up before they are sent
    per = per.groupBy("h").agg(F.collect_list(F.struct("s", "t")).alias("classes"))  # some hundred classes at most
    lo, hi = lambda x: F.floor(F.exp(x["s"] * step) - 1e-6), lambda x: F.ceil(F.exp((x["s"] + 1) * step) + 1e-6)
    ceil = lambda a, b: F.floor((a + (b - 1)) / b)
    needed = lambda n: ceil(percent * n, 100)
    rest = needed(F.col("n")) - F.col("l")

    def partner(x: Column) -> Column:
        least_matches = F.greatest(F.lit(1), ceil(percent * (F.col("n") + lo(x)), 100 + percent) - F.greatest(rest, needed(hi(x)) - 1))
        near = (100 * F.least(F.col("n"), hi(x)) >= percent * F.greatest(F.col("n"), lo(x)))
        return near & (F.col("tail") >= least_matches) & (x["t"] >= least_matches)

    return short.unionByName(long.join(per, "h").where(F.exists("classes", partner)).drop("classes"))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _matching(percent: int):
    """(ref, hub, n, l, hub_n, hub_l, prefix, hub_prefix) to the pairs whose prefixes share enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, l, m, k = (b.column(i).to_numpy() for i in range(2, 6))
            wanted = matches(n, m, least(n, percent) - l, least(m, percent) - k, percent)
            keep = [i for i in range(b.num_rows) if overlap(b.column(6)[i].values.to_numpy(), b.column(7)[i].values.to_numpy()) >= wanted[i]]
            yield b.select([0, 1, 2, 4]).take(pa.array(keep, pa.int64()))

    return run


def _verified(percent: int):
    """(x, y, nx, ny, hx, hy) to the links among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, nx, ny = (b.column(i).to_pylist() for i in range(4))
            keep = []
            for i in range(b.num_rows):
                o = overlap(b.column(4)[i].values.to_numpy(), b.column(5)[i].values.to_numpy())
                if 100 * o >= percent * (nx[i] + ny[i] - o):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in keep], pa.int64()) for v in (x, y)], ["x", "y"])

    return run


def _block(percent: int):
    """One block of a cluster: its outside sets against its members; the links between different components."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        outside, members = pdf[pdf["outside"]], pdf[~pdf["outside"]]
        if not len(outside) or not len(members):
            return pd.DataFrame({"x": [], "y": []}, dtype="int64")
        ref, comp, n, u, l = (members[c].to_numpy(np.int64) for c in ("ref", "comp", "n", "u", "l"))
        whole = [np.asarray(x) for x in members["hs"]]
        prefix = [x[: len(x) - least(k, percent) + j] for x, k, j in zip(whole, n.tolist(), l.tolist())]
        flat, size = np.concatenate(prefix), np.array([len(p) for p in prefix])
        start = np.cumsum(size) - size
        found = []
        for r in outside.itertuples():
            hs, ok = np.asarray(r.hs), comp != r.comp
            ok &= 100 * np.minimum(n, r.n) >= percent * np.maximum(n, r.n)
            ok &= (100 + percent) * np.minimum(n - u, r.n - r.u) >= percent * (n + r.n)
            if not ok.any():
                continue
            own = np.sort(hs[: len(hs) - least(r.n, percent) + r.l])
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            ok &= np.add.reduceat(hit.astype(np.int64), start) >= matches(n, r.n, least(n, percent) - l, least(r.n, percent) - r.l, percent)
            for i in np.flatnonzero(ok):
                o = overlap(hs, whole[i])
                if 100 * o >= percent * (n[i] + r.n - o):
                    found.append((r.ref, ref[i]))
        return pd.DataFrame(found, columns=["x", "y"], dtype="int64")

    return run


def jaccard_components(df: DataFrame, text: str = "text", id_col: str = "doc_id", percent: int = PERCENT, words: int = WORDS, bits: int = 64) -> DataFrame:
    """(id, n_shingles, component_id) for each row of df; see the module's docstring. bits: those of the names of step 1."""
    spark = df.sparkSession
    ship_package(spark)
    source = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(8, size // 20 // TASK_SHINGLES)  # about six bytes a word, a third of all in prefixes
    groups = max(8, ranges // 8)
    rows = stored(source.mapInArrow(trimmed(_prefixes(percent, words, ranges, bits)), f"id {kind}, hash long, kind int, part int, n long, name binary, a binary, b binary"), "shingles")

    # 1: sets that share enough of their prefixes
    docs = rows.where("kind = 0").select("id", "hash", "n", "name")
    near = rows.where("kind = 2").select("a", "b").mapInArrow(_unpacked, "ref long, c long").groupBy("ref").agg(F.max("c").alias("c"))
    far = rows.where("kind = 1").select("part", "a", "b").groupBy("part").applyInPandas(_seen_elsewhere(groups), "group long, a binary, b binary")
    far = far.groupBy("group").applyInPandas(_totals, "ref long, c long")
    shares = near.unionByName(far).groupBy("ref").agg(F.sum("c").alias("c"))
    sets = docs.where("n > 0").groupBy("name").agg(F.max("n").alias("n"), F.min(F.struct("id", "hash")).alias("row")).withColumn("ref", _ref("name", bits))
    needed = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 10))
    named = F.count(F.lit(1)).over(Window.partitionBy("ref"))  # one but for collisions
    kept = sets.join(shares, "ref", "left").withColumn("names", named).where((F.col("names") > 1) | (F.col("c") >= needed))
    kept = kept.select(F.when(F.col("names") > 1, F.xxhash64("name")).otherwise(F.col("ref")).alias("ref"), "name", F.col("row.id").alias("id"), F.col("row.hash").alias("hash"))
    kept = stored(kept, "kept")

    # 2: their whole sets, and exact frequencies among them
    wanted = broadcast_if_small(kept.select("ref", "name", F.col("id").alias("wanted"), F.col("hash").alias("wanted_hash")))
    texts = source.join(wanted, F.col("id").eqNullSafe(F.col("wanted")) & F.col("hash").eqNullSafe(F.col("wanted_hash"))).select("ref", "name", "text")
    held = stored(texts.mapInArrow(trimmed(_sets(words)), "ref long, n long, shingles array<long>"), "sets")
    each = held.select("ref", "n", F.explode("shingles").alias("h"))
    frequent = each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    lists = each.join(frequent, "h").groupBy("ref").agg(F.max("n").alias("n"), F.sort_array(F.collect_set(F.struct("c", "h"))).alias("shared"))
    lists = stored(lists.where(F.size("shared") * 100 >= F.col("n") * percent), "lists")

    # 3 and 4: adaptive prefixes, their lists without rows that can't have a partner
    prefixes = stored(lists.mapInArrow(_adaptive(percent), "ref long, n long, u long, l long, prefix array<long>"), "prefixes")
    postings = prefixes.select("ref", "n", "u", "l", F.size("prefix").alias("size"), F.posexplode("prefix").alias("at", "h")).select("h", "ref", "n", "u", "l", (F.col("size") - F.col("at")).alias("tail"))
    postings = cut(alive(postings, postings.groupBy("h").agg(F.count(F.lit(1)).alias("k")), percent))

    # 5: hubs
    hub = F.min(F.struct((F.col("u") / F.col("n")).alias("r"), "ref", "n", "u", "l"))
    hubs = postings.groupBy("h").agg(F.count(F.lit(1)).alias("k"), hub.alias("hub")).where("k > 1").select("h", "hub")
    members = postings.join(hubs, "h").select("ref", "n", "u", "l", F.col("hub.ref").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.u").alias("hub_u"), F.col("hub.l").alias("hub_l"))
    members = cut(members.distinct())
    possible = (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")) & ((100 + percent) * F.least(F.col("n") - F.col("u"), F.col("hub_n") - F.col("hub_u")) >= percent * (F.col("n") + F.col("hub_n")))
    candidates = members.where((F.col("ref") != F.col("hub")) & possible)
    # a hub's sets go to several tasks where they are many, each with the hub's own
    shares = candidates.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_SETS).cast("int").alias("shares"))
    dealt = candidates.join(shares, "hub").withColumn("share", F.pmod(F.xxhash64(F.lit(3), "ref"), "shares").cast("int"))

    def with_hubs(of: DataFrame, column: str, name: str) -> DataFrame:
        return shares.join(of.select(F.col("ref").alias("hub"), F.col(column).alias(name)), "hub").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

    pairs = dealt.join(prefixes.select("ref", "prefix"), "ref").join(with_hubs(prefixes, "prefix", "hub_prefix"), ["hub", "share"])
    pairs = pairs.select("ref", "hub", "n", "l", "hub_n", "hub_l", "prefix", "hub_prefix").mapInArrow(trimmed(_matching(percent)), "ref long, hub long, n long, hub_n long")
    pairs = cut(pairs)
    hashes = lists.select("ref", F.transform("shared", lambda s: s["h"]).alias("hs"))
    whole = pairs.join(hashes.withColumnRenamed("hs", "hx"), "ref").join(shares, "hub").withColumn("share", F.pmod(F.xxhash64(F.lit(3), "ref"), "shares").cast("int"))
    whole = whole.join(with_hubs(hashes, "hs", "hy"), ["hub", "share"]).select("ref", "hub", "n", "hub_n", "hx", "hy")
    star = cut(whole.mapInArrow(trimmed(_verified(percent)), "x long, y long"))
    labels = components(star)

    # 6: what is still apart, in blocks
    apart = members.join(labels, members["ref"] == labels["node"], "left").select("ref", "n", "u", "l", "hub", F.coalesce("label", "ref").alias("comp"))
    by_comp = apart.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("k"))
    clusters = by_comp.groupBy("hub").agg(F.sum("k").alias("k"), F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    blocks = lambda k: F.ceil(k / BLOCK_SETS).cast("int")
    clusters = clusters.select("hub", F.col("top.comp").alias("top"), blocks(F.col("k")).alias("mbs"), blocks(F.col("k") - F.col("top.k")).alias("obs"))
    joined = apart.join(clusters, "hub").join(hashes, "ref").withColumn("block", F.xxhash64(F.lit(5), "ref"))
    columns = ["hub", "ref", "n", "u", "l", "comp", "hs"]
    inside = joined.select(*columns, F.lit(False).alias("outside"), F.pmod("block", "mbs").cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("obs") - 1)).alias("ob"))
    outside = joined.where("comp <> top").select(*columns, F.lit(True).alias("outside"), F.explode(F.sequence(F.lit(0), F.col("mbs") - 1)).alias("mb"), F.pmod("block", "obs").cast("int").alias("ob"))
    more = inside.unionByName(outside).groupBy("hub", "mb", "ob").applyInPandas(_block(percent), "x long, y long")
    labels = components(cut(star.unionByName(more)))

    # every document's component: its set's label, or its set
    found = labels.join(kept, labels["node"] == kept["ref"]).select("name", F.col("label").cast("string").alias("label"))
    keyed = docs.join(found, "name", "left").withColumn("key", F.coalesce("label", F.hex("name")))
    smallest = keyed.where("n > 0").groupBy("key").agg(F.min("id").alias("smallest"))
    out = keyed.join(smallest, "key", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("smallest")).alias("component_id"))


def _ref(name: str, bits: int = 64) -> Column:
    """ref_of() as a column: the first 8 bytes of the 128-bit name, little-endian and signed."""
    digits = F.hex(F.substring(name, 1, 8))
    swapped = F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2)))
    return F.shiftright(F.conv(swapped, 16, -10).cast("long"), 64 - bits)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the size of its set and the smallest id that links reach."""
    found = jaccard_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(r.y) AS component_id
FROM documents d JOIN reach r ON r.x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
