"""Shards by size-tiered compaction: arrivals are appended as small immutable files, files of like size are merged into larger ones up to a target,
and each change is one new version of a manifest, put in place by an atomic rename that fails if another writer was first.

A manifest says what changed since the version before, and every EVERY-th one says everything: a change of few files writes little, however many
shards there are, and a reader opens EVERY manifests at most.

A reader takes the files that one version names, so it never sees half a change; files that no version names (of a writer that was lost) are ignored
and later vacuumed. Merging reads whole files and writes them again task by task; nothing is shuffled and no row is looked at.

Rows are kept as they are: nulls, empty and long texts, repeated rows, further columns of any name. An empty append makes a version without new files.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import scratch

TARGET_BYTES = 128 << 20
FANOUT = 4
#: Files up to this size are of the lowest tier; each next one is FANOUT times as large.
BASE_BYTES = 1 << 20
#: Files that one merging job reads at most.
MOST_FILES = 10_000
#: Versions from one whole manifest to the next.
EVERY = 16


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    batch: str


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str | None
    shards: tuple[Shard, ...]
    batches: tuple[str, ...]


class Conflict(RuntimeError):
    """Another writer has committed the version first; read again and retry."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, base_bytes: int = BASE_BYTES):
        if fanout < 2 or target_bytes < 1 or base_bytes < 1:
            raise ValueError("fanout must be 2 at least, sizes 1 at least")
        self.spark, self.root, self.target, self.fanout, self.base = spark, root.rstrip("/"), target_bytes, fanout, base_bytes
        #: The version last read or committed here; versions never change, so the next one may be written as what differs from it.
        self._last: Manifest | None = None

    def versions(self) -> list[int]:
        fs, at = scratch.hadoop(self.spark, f"{self.root}/manifest")
        return sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(at) if s.getPath().getName().startswith("v")) if fs.exists(at) else []

    def manifest(self, version: int | None = None) -> Manifest:
        """A version's manifest, the latest unless given; version 0 has nothing."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return Manifest(0, None, (), ())
        chain = self._chain(version)
        shards = {x["path"]: Shard(**x) for x in chain[0]["shards"]}
        batches = list(chain[0]["batches"])
        for step in chain[1:]:
            for path in step["removed"]:
                del shards[path]
            shards |= {x["path"]: Shard(**x) for x in step["added"]}
            batches += step["new_batches"]
        found = Manifest(version, chain[-1]["schema"], tuple(shards.values()), tuple(batches))
        if version == known[-1]:
            self._last = found
        return found

    def _load(self, version: int) -> dict:
        fs, at = scratch.hadoop(self.spark, f"{self.root}/manifest/v{version:012d}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _chain(self, version: int) -> list[dict]:
        """The manifests from the last whole one up to a version."""
        chain = [self._load(version)]
        while "shards" not in chain[-1]:
            chain.append(self._load(chain[-1]["version"] - 1))
        return chain[::-1]

    def _said(self, new: Manifest) -> dict:
        """What a version's manifest holds: all, or what differs from the version before if that is known here."""
        old, head = self._last, {"version": new.version, "schema": new.schema}
        if old is None or old.version != new.version - 1 or new.version % EVERY == 1:
            return head | {"shards": [asdict(s) for s in new.shards], "batches": new.batches}
        before, after = ({s.path for s in m.shards} for m in (old, new))
        return head | {"added": [asdict(s) for s in new.shards if s.path not in before], "removed": [s.path for s in old.shards if s.path not in after], "new_batches": new.batches[len(old.batches) :]}

    def _commit(self, new: Manifest) -> Manifest:
        jvm = self.spark._jvm
        final = f"{self.root}/manifest/v{new.version:012d}.json"
        fs, temp = scratch.hadoop(self.spark, f"{self.root}/manifest/.{uuid.uuid4().hex}")
        fs.mkdirs(temp.getParent())
        out = fs.create(temp, False)
        try:
            out.write(bytearray(json.dumps(self._said(new)).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        rename[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            context.rename(fs.makeQualified(temp), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(final)), rename)
        except Exception as e:
            fs.delete(temp, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(final) from e
            raise
        self._last = new
        return new

    def _write(self, df: DataFrame, batch: str) -> tuple[Shard, ...]:
        """df's tasks as files of a folder of their own."""
        to = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(to)
        fs, at = scratch.hadoop(self.spark, to)
        sizes = {s.getPath().getName(): (s.getPath().toString(), s.getLen()) for s in fs.listStatus(at) if s.getPath().getName().startswith("part-")}
        counted = self.spark.read.schema(df.schema).parquet(to).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
        rows = {r["f"]: r["n"] for r in counted}
        return tuple(Shard(path, size, rows[name], batch) for name, (path, size) in sorted(sizes.items()) if rows.get(name))

    def append(self, df: DataFrame, batch: str | None = None) -> Manifest:
        """df as new shards, as they come out of its tasks. A batch that is already there changes nothing, so a caller may try again."""
        now = self.manifest()
        batch = batch or uuid.uuid4().hex
        if batch in now.batches:
            return now
        schema = df.schema.json()
        if now.schema is not None and StructType.fromJson(json.loads(now.schema)).simpleString() != df.schema.simpleString():
            raise ValueError(f"the store has {StructType.fromJson(json.loads(now.schema)).simpleString()}, not {df.schema.simpleString()}")
        made = self._write(df, batch)
        while True:  # the files stand; only the manifest is tried again after another writer's
            try:
                return self._commit(Manifest(now.version + 1, now.schema or schema, now.shards + made, (*now.batches, batch)))
            except Conflict:
                now = self.manifest()
                if batch in now.batches:
                    return now
                if now.schema is not None and StructType.fromJson(json.loads(now.schema)).simpleString() != df.schema.simpleString():
                    raise

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.base, self.fanout)) + 1) if size > self.base else 0

    def compact(self) -> Manifest:
        """Merges tiers of FANOUT files or more, lowest first, until none is left; each merge is a version."""
        now = self.manifest()
        while True:
            tiers: dict[int, list[Shard]] = {}
            for s in now.shards:
                if s.bytes < self.target // 2:  # larger ones are done
                    tiers.setdefault(self.tier(s.bytes), []).append(s)
            full = sorted(t for t, shards in tiers.items() if len(shards) >= self.fanout)
            if not full:
                return now
            merged = sorted(tiers[full[0]], key=lambda s: (s.bytes, s.path))[:MOST_FILES]
            total = sum(s.bytes for s in merged)
            # into files of the target's size, or of the next tier's where there isn't enough
            count = max(1, round(total / self.target)) if total >= self.target else 1
            rows = self.spark.read.schema(StructType.fromJson(json.loads(now.schema))).parquet(*[s.path for s in merged]).coalesce(count)
            made = self._write(rows, "merged")
            if sum(s.rows for s in made) != sum(s.rows for s in merged):
                raise RuntimeError("a merge has other rows than its files")
            gone = {s.path for s in merged}
            while True:
                try:
                    now = self._commit(Manifest(now.version + 1, now.schema, tuple(s for s in now.shards if s.path not in gone) + made, now.batches))
                    break
                except Conflict:
                    now = self.manifest()
                    if not gone <= {s.path for s in now.shards}:
                        break  # another writer has merged some of them; vacuum() takes the files made here

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version's shards."""
        m = self.manifest(version)
        if m.schema is None:
            raise ValueError("nothing was appended yet")
        schema = StructType.fromJson(json.loads(m.schema))
        return self.spark.read.schema(schema).parquet(*[s.path for s in m.shards]) if m.shards else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes files that none of the last `keep` versions names, and older manifests. Not while another writer is at work, whose files have no version yet."""
        known = self.versions()
        live = {s.path for v in known[-keep:] for s in self.manifest(v).shards}
        fs, data = scratch.hadoop(self.spark, f"{self.root}/data")
        gone = 0
        for folder in fs.listStatus(data) if fs.exists(data) else []:
            files = [s.getPath() for s in fs.listStatus(folder.getPath())]
            if any(f.toString() in live for f in files):
                stale = [f for f in files if f.getName().startswith("part-") and f.toString() not in live]
                gone += sum(fs.delete(f, False) for f in stale)
            else:
                gone += sum(f.getName().startswith("part-") for f in files)
                fs.delete(folder.getPath(), True)
        # the oldest version that is kept may rest on manifests before it
        first = self._chain(known[-keep:][0])[0]["version"] if known else 0
        for v in (v for v in known if v < first):
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/v{v:012d}.json"), False)
        return gone


def op6(spark, sf_dir: str) -> DataFrame:
    """All documents, arriving in four batches, compacted; read back: (doc_id, shard_id, version, n_chars, text_crc32), shard_id by the files' order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, scratch.path(spark, "shards"))
    for k in range(4):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k), f"arrival-{k}")
    m = store.compact()
    store.vacuum(keep=1)
    names = F.element_at(F.split(F.input_file_name(), "/"), -1)
    back = store.read(m.version).select("doc_id", names.alias("file"), F.length("text").cast("long").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    files = spark.createDataFrame([(s.path.rsplit("/", 1)[1], i) for i, s in enumerate(m.shards)], "file string, shard_id long")
    return back.join(files, "file").select("doc_id", "shard_id", F.lit(m.version).cast("long").alias("version"), "n_chars", "text_crc32")
