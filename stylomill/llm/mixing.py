"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations only.

A source's target is a share of all words by its weight, stopped at `most` times its own words; what is over goes to the
others by weight until none is above. Each document of a source is due the same fractional number of copies, target
over words. The whole part is fixed; the fractions are rounded by pivotal steps: two documents meet, and mass (words
times probability) moves from one to the other until one of the probabilities is 0 or 1. Which of the two gets it is
drawn so that no document's expected copies change; their words stay constant at each step. A step mostly decides the
shorter document, so documents meet those of their own length first: of a source's documents of 2^k to 2^(k+1) words, groups
of about `FAN` fold to one undecided document each, and these meet in the next level's groups, up to one. One group of each
length is kept out and folds at last with what the others have left, from long to short. That is done in phases, `PHASES`,
from documents of 4,096 words or more down to single words. The last undecided one of a phase takes a pivotal step with all
shorter documents of its source as one unit: they have one probability still, which moves a little, and it is decided. If they
lack the words for that, it goes on to the next phase. So what is rounded to the nearest in the end is a document of a few
words, or the last of a source without short ones. No task holds more than a group, or `FAN` documents of each length.

All draws are hashes of ids and a seed: reruns agree, also after a task is lost.

Defined cases. A null text has size 0. Null is a source of its own, the last one. Documents of size 0 are rounded on
their own; they take no words. Rows that repeat source, id and size are one unit and all get as many copies. An empty
table gives an empty result. Of the input's columns only those named matter; others are kept by apply_mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stylomill.llm.common import table, unused
from stylomill.session import cut

WEIGHTS, MOST, FAN, SEED = (5, 2, 1), 3, 64, 17
#: The least length, as a power of 2, of each phase's documents.
PHASES = (12, 8, 4, 0)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _draw(*of: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / float(1 << 53)


def source_targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n_units, target) of units (source, size, m). One row for each source."""
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(most))
    by_cap = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    capped = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    # words for one weight if all before are stopped; it rises up to the first that isn't and falls from there
    per = per.withColumn("level", (total - capped) / left)
    target = F.least(F.col("cap").cast("double"), F.max("level").over(Window.partitionBy()) * F.col("w"))
    return per.select("source", "source_size", "n_units", target.alias("target"))


def _pivot(level: int, seed: int):
    """One pivotal step between the undecided document of acc and the next one."""

    def step(acc: Column, b: Column) -> Column:
        a = acc["cur"]
        ma, mb = (a["size"] * a["m"]).cast("double"), (b["size"] * b["m"]).cast("double")
        up_a, up_b, down_a, down_b = (1 - a["x"]) * ma, (1 - b["x"]) * mb, a["x"] * ma, b["x"] * mb
        to_a, to_b = F.least(up_a, down_b), F.least(down_a, up_b)
        a_gets = _draw(F.lit(seed), F.lit(level), a["u"], b["u"]) * (to_a + to_b) < to_b
        a_ends = F.when(a_gets, up_a <= down_b).otherwise(down_a <= up_b)
        x_a = F.when(a_gets, F.when(a_ends, 1.0).otherwise(a["x"] + to_a / ma)).otherwise(F.when(a_ends, 0.0).otherwise(a["x"] - to_b / ma))
        x_b = F.when(a_gets, F.when(a_ends, b["x"] - to_a / mb).otherwise(0.0)).otherwise(F.when(a_ends, b["x"] + to_b / mb).otherwise(1.0))
        new_a, new_b = a.withField("x", x_a), b.withField("x", x_b)
        return F.struct(F.when(a_ends, new_b).otherwise(new_a).alias("cur"), F.concat(acc["done"], F.array(F.when(a_ends, new_a).otherwise(new_b))).alias("done"))

    return step


def mix_sources(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(source, id, size, m, source_size, target, copies): how often each unit of m equal rows is taken."""
    rows = df.select(F.col(source).alias("source"), F.col(id_col).alias("id"), n_words(F.col(text)).alias("size"))
    units = cut(rows.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("m")))
    targets = cut(source_targets(units, weights, most))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    due = units.join(targets.withColumnRenamed("source", "source2"), F.col("source").eqNullSafe(F.col("source2")), "left").drop("source2")
    due = due.withColumn("rate", rate).withColumns({"base": F.floor("rate"), "x": F.col("rate") - F.floor("rate"), "u": F.xxhash64(F.lit(seed), "source", "id", "size")})
    whole = (F.col("x") == 0) | (F.col("size") == 0)
    alone = (F.col("x") > 0) & (_draw(F.lit(seed), F.lit(-1), F.col("u")) < F.col("x"))
    decided = [due.where(whole).select("source", "id", "size", "m", (F.col("base") + alone.cast("long")).alias("copies"))]
    mass = F.col("size") * F.col("m")
    length = F.floor(F.log2(mass.cast("double"))).cast("int")
    phase = F.coalesce(*(F.when(length >= least, i) for i, least in enumerate(PHASES)))
    open_ = due.where(~whole).select("source", phase.alias("phase"), length.alias("length"), mass.alias("mass"), F.struct("u", "id", "size", "m", "base", "x").alias("unit"))
    per = cut(open_.groupBy(F.col("source").alias("source2"), F.col("phase").alias("phase2"), F.col("length").alias("length2")).agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("words")))  # at most 64 rows a source
    most_of = {r["phase2"]: r["n"] for r in per.groupBy("phase2").agg(F.max("n").alias("n")).collect()}
    shares = cut(due.where(~whole).groupBy("source").agg(F.max("x").alias("x")))  # all of a source's documents have one
    open_ = open_.join(per, F.col("source").eqNullSafe(F.col("source2")) & (F.col("length") == F.col("length2"))).select("source", "phase", "length", F.ceil(F.col("n") / FAN).alias("groups"), "unit")

    def bucket(level: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("unit.u")), F.col("groups"))

    def folded(rows: DataFrame, keys: list, level: int) -> DataFrame:
        """Groups of rows, folded from long to short: r.cur is undecided, r.done are decided."""
        units = F.transform(F.sort_array(F.collect_list(F.struct(-F.col("unit.size") * F.col("unit.m"), "unit"))), lambda x: x["unit"])
        groups = rows.groupBy(*keys).agg(units.alias("units"))
        first, rest = F.col("units")[0], F.slice("units", F.lit(2), F.greatest(F.size("units") - 1, F.lit(0)))
        zero = F.struct(first.alias("cur"), F.slice("units", 1, 0).alias("done"))
        return cut(groups.select(*(k for k in groups.columns if k not in ("units", "bucket")), F.aggregate(rest, zero, _pivot(level, seed)).alias("r")))

    def settled(rows: DataFrame) -> DataFrame:
        return rows.select("source", "d.id", "d.size", "d.m", (F.col("d.base") + F.round("d.x").cast("long")).alias("copies"))

    def by_source(rows: DataFrame, other: DataFrame, how: str = "left") -> DataFrame:
        return rows.join(other.withColumnRenamed("source", "source2"), F.col("source").eqNullSafe(F.col("source2")), how).drop("source2")

    left = None  # of each source, what the phase before has left undecided
    for i in sorted(most_of):
        now = by_source(open_.where(F.col("phase") == i), shares.withColumnRenamed("x", "share")).withColumn("unit", F.col("unit").withField("x", F.col("share"))).drop("share")
        last, more, largest, level = now.where(bucket(0) == 0).select("source", "unit"), now.where(bucket(0) != 0), most_of[i], 0
        while largest > FAN:  # at last one is left of each source and length
            found = folded(more, ["source", "length", "groups", bucket(level).alias("bucket")], level + 100 * i)
            decided.append(settled(found.select("source", F.explode("r.done").alias("d"))))
            more = found.select("source", "length", F.ceil(F.col("groups") / FAN).alias("groups"), F.col("r.cur").alias("unit"))
            largest = -(-largest // FAN)
            level += 1
        last = last.unionByName(more.select("source", "unit")) if level else last
        found = folded(last if left is None else last.unionByName(left), ["source"], -2 - i)
        decided.append(settled(found.select("source", F.explode("r.done").alias("d"))))
        # the last one and all shorter documents of its source
        pool = per.where(F.col("phase2") > i).groupBy(F.col("source2").alias("source")).agg(F.sum("words").cast("double").alias("pool"))
        met = by_source(by_source(shares, found.select("source", F.col("r.cur").alias("cur"))), pool).na.fill(0.0, ["pool"])
        words, x, p = (F.col("cur.size") * F.col("cur.m")).cast("double"), F.col("cur.x"), F.col("x")
        gets, gives = F.least((1 - x) * words, p * F.col("pool")), F.least(x * words, (1 - p) * F.col("pool"))
        up = _draw(F.lit(seed), F.lit(-20 - i), F.col("cur.u")) * (gets + gives) < gives
        open_end = F.col("cur").isNotNull() & (F.col("pool") > 0) & (x > 0) & (x < 1)
        met = met.withColumns({"gets": gets, "gives": gives, "up": up})
        moved = F.when(F.col("up"), F.when(F.col("gets") >= (1 - x) * words, 1.0).otherwise(x + F.col("gets") / words)).otherwise(F.when(F.col("gives") >= x * words, 0.0).otherwise(x - F.col("gives") / words))
        share = F.when(F.col("up"), p - F.col("gets") / F.col("pool")).otherwise(p + F.col("gives") / F.col("pool"))
        met = cut(met.select("source", F.when(open_end, F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).otherwise(p).alias("x"), F.when(open_end, F.col("cur").withField("x", moved)).otherwise(F.col("cur")).alias("unit")))
        shares = met.select("source", "x")
        ended = met.where("unit IS NOT NULL")
        whole_now = (F.col("unit.x") == 0) | (F.col("unit.x") == 1)
        decided.append(settled(ended.where(whole_now).select("source", F.col("unit").alias("d"))))
        left = ended.where(~whole_now).select("source", "unit")
        # sources without documents of the later phases end here
        after = per.where(F.col("phase2") > i).select(F.col("source2").alias("source")).distinct()
        decided.append(settled(left.join(after, left["source"].eqNullSafe(after["source"]), "left_anti").select("source", F.col("unit").alias("d"))))
        left = left.join(after, left["source"].eqNullSafe(after["source"]), "left_semi")
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    per = targets.select(F.col("source").alias("source2"), "source_size", "target")
    return out.join(per, F.col("source").eqNullSafe(F.col("source2")), "left").drop("source2")


def apply_mix(df: DataFrame, decisions: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """df's rows, each as often as decided."""
    s, i, n, c, size, k = (unused(x, df.columns) for x in ("source", "id", "n", "copies", "size", "k"))
    d = decisions.where("copies > 0").select(F.col("source").alias(s), F.col("id").alias(i), F.col("size").alias(n), F.col("copies").alias(c))
    docs = df.withColumn(size, n_words(F.col(text)))
    both = docs.join(d, F.col(source).eqNullSafe(F.col(s)) & F.col(id_col).eqNullSafe(F.col(i)) & (F.col(size) == F.col(n)))
    return both.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(c).cast("int")))).select(*df.columns)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its size, its source's size and target, and the words that the mix takes of it."""
    d = mix_sources(table(spark, sf_dir, "documents"))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return d.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
