"""Size-tiered compaction of immutable Parquet shards under a versioned manifest.

Layout of a store:  data/<batch>/part-*.parquet  and  _manifest/v<20 digits>.jsonl, a line per live shard.
append() writes an arrival as it comes, one small shard a task, without a shuffle. compact() takes, tier by
tier, the runs of similarly sized shards and rewrites each run into files of the target size: the scan packs
whole files into read partitions of that size, so a merge is a narrow copy. Every change becomes visible by
one rename of a finished manifest to the next version's name, which fails if that version exists; a task or
driver lost before that leaves only files that no manifest names, and vacuum() removes them.
DataFrame operations and metadata calls only: no Python runs on the executors.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, shard string, bytes long, rows long, tier int"


@dataclass(frozen=True)
class Shard:
    shard: str
    bytes: int
    rows: int
    tier: int


class CommitConflict(RuntimeError):
    """Another writer committed first and its change doesn't go with this one."""


class ShardStore:
    """A table kept as immutable shards; columns are whatever the first arrival has.

    Nulls, empty and long texts and repeated rows are stored as they are, and columns of any name: where one is called
    as read() would call its own, read() puts another _ before its own. An arrival without rows commits no
    shard; a store without rows reads as an empty table of the first arrival's schema.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4, smallest_bytes: int = 1 << 20):
        self.spark, self.root, self.target, self.fanout, self.smallest = spark, root.rstrip("/"), target_bytes, fanout, smallest_bytes
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)
        self.fs.mkdirs(self._path("_manifest"))
        self.merging = spark.newSession()
        for key, value in (("maxPartitionBytes", target_bytes), ("openCostInBytes", 0), ("minPartitionNum", 1)):
            self.merging.conf.set(f"spark.sql.files.{key}", str(value))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def tier(self, size: int) -> int:
        """0 below fanout times the smallest size, one more for each further factor of fanout."""
        return max(0, int(math.log(max(size, self.smallest) / self.smallest, self.fanout) + 1e-9))

    # -- manifest ---------------------------------------------------------------------------------
    def version(self) -> int:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("_manifest"))]
        return max([int(n[1:21]) for n in names if n.startswith("v") and n.endswith(".jsonl")], default=0)

    def manifest_path(self, version: int) -> str:
        return f"{self.root}/_manifest/v{version:020d}.jsonl"

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if version == 0:
            return []
        stream = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(self.manifest_path(version)))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**{k: v for k, v in json.loads(line).items() if k != "version"}) for line in text.splitlines() if line]

    def _commit(self, version: int, shards: list[Shard]) -> bool:
        tmp = self._path(f"_manifest/.tmp-{uuid.uuid4().hex}")
        out = self.fs.create(tmp, False)
        try:
            out.write(bytearray("".join(json.dumps({"version": version} | asdict(s)) + "\n" for s in shards).encode()))
        finally:
            out.close()
        target = self.jvm.org.apache.hadoop.fs.Path(self.manifest_path(version))
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(tmp, target, none)
            return True
        except Exception:
            if not self.fs.exists(target):
                raise
            self.fs.delete(tmp, False)
            return False

    def _replace(self, gone: set[str], new: list[Shard]) -> int:
        """Commit live - gone + new on top of whatever version is current by then."""
        while True:
            version = self.version()
            live = self.shards(version)
            if not gone <= {s.shard for s in live}:
                raise CommitConflict(f"version {version} no longer holds the shards that were merged")
            if self._commit(version + 1, [s for s in live if s.shard not in gone] + new):
                return version + 1

    # -- data -------------------------------------------------------------------------------------
    def _write(self, df: DataFrame) -> list[Shard]:
        batch = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{batch}")
        sizes = {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self._path(batch)) if s.getPath().getName().endswith(".parquet")}
        counted = df.sparkSession.read.schema(df.schema).parquet(f"{self.root}/{batch}").groupBy(F.col("_metadata.file_name").alias("name")).count()
        rows = {r["name"]: r["count"] for r in counted.collect()}  # a row a file: metadata
        return [Shard(f"{batch}/{n}", b, rows[n], self.tier(b)) for n, b in sorted(sizes.items()) if rows.get(n)]

    def append(self, arrival: DataFrame) -> int:
        """Add an arrival; returns the version that holds it."""
        schema = self._path("_manifest/schema.json")
        if not self.fs.exists(schema):
            out = self.fs.create(schema, False)
            out.write(bytearray(arrival.schema.json().encode()))
            out.close()
        return self._replace(set(), self._write(arrival))

    def compact(self) -> int:
        """Merge until no tier below the target holds a run of fanout shards; returns the current version."""
        while True:
            tiers: dict[int, list[Shard]] = {}
            for s in self.shards():
                if s.bytes < self.target // 2:
                    tiers.setdefault(s.tier, []).append(s)
            runs = [run for _, run in sorted(tiers.items()) if len(run) >= self.fanout]
            if not runs:
                return self.version()
            run = runs[0]
            merged = self._write(self.merging.read.schema(self.schema()).parquet(*[f"{self.root}/{s.shard}" for s in run]))
            self._replace({s.shard for s in run}, merged)

    def schema(self):
        from pyspark.sql.types import StructType

        stream = self.fs.open(self._path("_manifest/schema.json"))
        try:
            return StructType.fromJson(json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete data files that none of the last keep_versions manifests names; not while writers run."""
        last = self.version()
        named = {s.shard for v in range(max(1, last - keep_versions + 1), last + 1) for s in self.shards(v)}
        gone = 0
        if not self.fs.exists(self._path("data")):
            return 0
        for batch in self.fs.listStatus(self._path("data")):
            for f in self.fs.listStatus(batch.getPath()):
                if f.getPath().getName().endswith(".parquet") and f"data/{batch.getPath().getName()}/{f.getPath().getName()}" not in named:
                    self.fs.delete(f.getPath(), False)
                    gone += 1
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the shard each lies in: _shard, _shard_bytes, _shard_rows, _version."""
        taken = {c.lower() for c in self.schema().names}
        own = ["_shard", "_shard_bytes", "_shard_rows", "_version"]
        while taken & set(own):
            own = [f"_{c}" for c in own]
        version = self.version() if version is None else version
        shards = self.shards(version)
        reader = self.spark.read.schema(self.schema())
        paths = [f"{self.root}/{s.shard}" for s in shards]
        if not paths:
            empty = f"{self.root}/data/_none"
            self.fs.mkdirs(self.jvm.org.apache.hadoop.fs.Path(empty))
            paths = [empty]
        rows = reader.parquet(*paths)
        rows = rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), "(data/[^/]+/[^/]+)$", 1).alias(own[0]))
        if not shards:
            return rows.selectExpr("*", *[f"0L as {c}" for c in own[1:3]], f"{version}L as {own[3]}")
        listed = self.spark.read.schema(MANIFEST).json(self.manifest_path(version)).selectExpr(*[f"{a} as {b}" for a, b in zip(("shard", "bytes", "rows", "version"), own)])
        return rows.join(listed, own[0])
