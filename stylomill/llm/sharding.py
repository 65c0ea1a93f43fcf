"""Sharding by size-tiered compaction.

A store is a folder of immutable Parquet shards and of numbered manifests. An append writes its rows as one run of small
shards. Runs belong to tiers by their size; as soon as a tier has `fan` runs, these merge into one run of shards of about
the target size, which belongs to a higher tier. So a row is rewritten once a tier, and tiers grow with the logarithm of
the store. Appends, merges and removals end with a manifest of the next version, written aside and renamed into place;
the rename fails if the version exists, so of two writers one commits. The other finds that out and commits on top of
what is there: an append with the run that it has written, a merge if its runs are still there.

vacuum() removes runs that no kept version names and that are older than `min_age` seconds. What it is about to remove
stands in a manifest of its own first, so a writer whose run is among them learns of it from the versions that it must
build on, and writes the run anew. The last `keep` versions stay readable.

The rename must fail where the name exists, as HDFS and local disks see to; an object store needs a connector with such a
rename, or manifests on another file system.

A row's shard is the hash of the row modulo the run's number of shards, so shards are even also where a source or a key
is hot; each shard is written by one task. Sizes are bytes of text, known from the rows themselves.

Defined cases. Null and empty texts have size 0 and are stored as they are. Repeated rows are all kept. An append of no
rows commits a version without a new run. All columns are kept, whatever their names.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stylomill.llm.common import table, unused
from stylomill.session import broadcast_if_small, shared_path, stored

SMALL_BYTES, TARGET_BYTES, FAN = 8 << 20, 64 << 20, 4


@dataclass
class Shard:
    path: str
    rows: int
    bytes: int


@dataclass
class Run:
    name: str
    level: int
    shards: list[Shard] = field(default_factory=list)

    @property
    def bytes(self) -> int:
        return sum(s.bytes for s in self.shards)


class Conflict(Exception):
    """Another writer has committed the version."""


#: How often a writer starts anew, versions that stay readable, and the age from which runs without a version may go.
TRIES, KEEP, MIN_AGE = 20, 8, 24 * 3600.0


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, text: str = "text", small: int = SMALL_BYTES, target: int = TARGET_BYTES, fan: int = FAN):
        self.spark, self.root, self.schema, self.text, self.small, self.target, self.fan = spark, root.rstrip("/"), schema, text, small, target, fan
        self.shard = unused("shard", schema.fieldNames())
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self.conf)
        self.fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    # manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")

    def version(self) -> int:
        """The last version, 0 before the first."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict:
        stream = self.fs.open(self._path(self._name(version)))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def runs(self, version: int | None = None) -> list[Run]:
        version = self.version() if version is None else version
        if not version:
            return []
        return [Run(r["name"], r["level"], [Shard(**s) for s in r["shards"]]) for r in self._manifest(version)["runs"]]

    def _name(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def commit(self, runs: list[Run], version: int, gone: list[str] = ()) -> None:
        """Make runs the store's version, or raise Conflict. gone: runs that are about to be removed."""
        aside = f"{self.root}/manifests/.{version:012d}-{uuid.uuid4().hex}"
        out = self.fs.create(self._path(aside), False)
        out.write(bytearray(json.dumps({"version": version, "runs": [asdict(r) for r in runs], "gone": list(gone)}).encode()))
        out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark._sc._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.conf)
        try:
            context.rename(self._path(aside), self._path(self._name(version)), options)
        except Exception as e:
            self.fs.delete(self._path(aside), False)
            if "AlreadyExists" in str(e):
                raise Conflict(f"version {version} exists") from e
            raise

    # runs

    def _write(self, df: DataFrame, level: int, shard_bytes: int, size: int) -> Run:
        """df's rows as one run of shards of about shard_bytes."""
        n = max(1, math.ceil(size / shard_bytes))
        name = f"run-{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        # the row's place is part of the hash, so that rows that are equal go to all shards, too
        shard = F.pmod(F.xxhash64(*(c for c, t in df.dtypes if "map<" not in t), F.monotonically_increasing_id()), F.lit(n)).cast("int")
        df.withColumn(self.shard, shard).repartitionById(n, self.shard).write.option("compression", "zstd").partitionBy(self.shard).parquet(path)
        return Run(name, level, self._found(path))

    def _found(self, path: str) -> list[Shard]:
        """The shards of a written run with their counts. As many rows as shards, whatever these hold."""
        if not self.fs.globStatus(self._path(f"{path}/{self.shard}=*")):
            return []
        held = self.spark.read.schema(self.schema).parquet(path)
        per = held.select(F.input_file_name().alias("path"), F.coalesce(F.octet_length(self.text), F.lit(0)).alias("n")).groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").cast("long").alias("bytes"))
        return sorted((Shard(r["path"], r["rows"], r["bytes"]) for r in per.collect()), key=lambda s: s.path)

    def _lost(self, run: Run, since: int) -> bool:
        """Whether run has been removed, or may be, by versions after since."""
        held = self.versions()
        if any(run.name in self._manifest(v).get("gone", ()) for v in held if v > since) or held and held[0] > since + 1:
            return True
        return not all(self.fs.exists(self._path(s.path)) for s in run.shards)

    def tier(self, run: Run) -> int:
        """Runs of one tier differ in size by less than the factor fan."""
        return max(0, math.floor(math.log(max(run.bytes, 1) / self.small, self.fan)))

    def append(self, df: DataFrame, size: int | None = None) -> int:
        """Store df's rows as a run of small shards; returns the new version. size: their bytes of text, where these are known."""
        rows = df.select(*self.schema.fieldNames())
        if size is None:
            size = rows.agg(F.sum(F.octet_length(self.text))).first()[0] or 0
        since = self.version()
        run = self._write(rows, 0, self.small, size)
        for _ in range(TRIES):
            base = self.version()
            if self._lost(run, since):
                since = base
                run = self._write(rows, 0, self.small, size)
            try:
                self.commit([*self.runs(base), *([run] if run.shards else [])], base + 1)
                return base + 1
            except Conflict:
                continue
        raise Conflict(f"no version in {TRIES} tries")

    def compact(self) -> int:
        """Merge the runs of each full tier until none is full; returns the version. Runs that another writer has merged are left to it."""
        for _ in range(TRIES):
            base = self.version()
            tiers: dict[int, list[Run]] = {}
            for r in self.runs(base):
                tiers.setdefault(self.tier(r), []).append(r)
            full = next((t for t in sorted(tiers) if len(tiers[t]) >= self.fan), None)
            if full is None:
                return base
            self._merge(tiers[full], base)
        raise Conflict(f"no version in {TRIES} tries")

    def _merge(self, old: list[Run], since: int) -> None:
        gone = {r.name for r in old}
        merged = self._write(self._read(old), max(r.level for r in old) + 1, self.target, sum(r.bytes for r in old))
        for _ in range(TRIES):
            base = self.version()
            runs = self.runs(base)
            if gone - {r.name for r in runs} or self._lost(merged, since):
                return  # left to vacuum()
            try:
                return self.commit([*(r for r in runs if r.name not in gone), merged], base + 1)
            except Conflict:
                continue

    def _read(self, runs: list[Run]) -> DataFrame:
        paths = [s.path for r in runs for s in r.shards]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        return self._read(self.runs(version))

    def manifest(self, version: int | None = None) -> DataFrame:
        """One row for each shard of a version."""
        version = self.version() if version is None else version
        rows = [(version, r.name, r.level, self.tier(r), i, s.path, s.rows, s.bytes) for r in self.runs(version) for i, s in enumerate(r.shards)]
        return self.spark.createDataFrame(rows, "version int, run string, level int, tier int, shard int, path string, shard_rows long, shard_bytes long")

    def vacuum(self, min_age: float = MIN_AGE, keep: int = KEEP) -> int:
        """Remove the runs that none of the last `keep` versions names and that are older than min_age seconds, and older manifests; returns how many runs went."""
        for _ in range(TRIES):
            base = self.version()
            kept = [v for v in self.versions() if v > base - keep]
            named = {r.name for v in kept for r in self.runs(v)}
            old = time.time() - min_age
            found = [s for s in self.fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("run-")]
            gone = [s.getPath().getName() for s in found if s.getPath().getName() not in named and s.getModificationTime() / 1000 <= old]
            if gone:
                try:
                    self.commit(self.runs(base), base + 1, gone)
                except Conflict:
                    continue
            for name in gone:
                self.fs.delete(self._path(f"{self.root}/{name}"), True)
            for v in self.versions():
                if v not in kept and v < base:
                    self.fs.delete(self._path(self._name(v)), False)
            return len(gone)
        raise Conflict(f"no version in {TRIES} tries")


ARRIVALS = 8


def op9_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as read back from the shard that holds it after all arrivals were appended and compacted."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, shared_path(spark, "shards"), docs.schema)
    arrival = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(ARRIVALS))
    sizes = {r["k"]: r["n"] for r in docs.groupBy(arrival.alias("k")).agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    for k in range(ARRIVALS):  # together they are the whole table
        store.append(docs.where(arrival == k), sizes.get(k) or 0)
        store.compact()
    store.vacuum(min_age=0, keep=1)
    rows = store.read().select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.input_file_name().alias("path"))
    shards = store.manifest().select("path", "version", "level", "tier", "shard", "shard_rows", "shard_bytes")
    return rows.join(broadcast_if_small(stored(shards, "shard-list")), "path").drop("path")  # a row for each shard; inner, so that a path spelt in two ways would be seen as rows that lack
