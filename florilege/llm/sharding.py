"""Size-tiered compaction of immutable shards under a versioned manifest."""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to write."""


@dataclass(frozen=True)
class Tiers:
    """Runs whose sizes lie within a factor `fanout` of each other form a tier; `fanout` runs of a tier merge into one; files from target / 2 on are done."""

    target_bytes: int = 128 << 20
    fanout: int = 4
    parallel_jobs: int = 4

    def tier(self, size: int) -> int:
        t, bound = 0, self.target_bytes / 2
        while size < bound:
            t, bound = t - 1, bound / self.fanout
        return t


class ShardStore:
    """A folder with data/ (immutable parquet shards) and manifests/ (one JSON document for each version).

    Everything goes through Spark's own file systems. A version is committed by renaming a finished manifest to its final name,
    which fails if that name is taken where a rename is atomic, as on HDFS and local disks: readers see the old
    or the new version, never a mixture, and a job lost before the rename leaves only files that no manifest names. Object stores copy
    instead: there one writer at a time may commit.
    """

    def __init__(self, spark: SparkSession, root: str, tiers: Tiers = Tiers(), attempts: int = 1_000):
        self.spark, self.root, self.tiers, self.attempts = spark, root.rstrip("/"), tiers, attempts
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)
        for d in ("data", "manifests"):
            self._fs.mkdirs(self._path(f"{self.root}/{d}"))

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _list(self, p: str) -> list[tuple[str, int]]:
        return [(s.getPath().toString(), s.getLen()) for s in self._fs.listStatus(self._path(p))]

    def version(self) -> int:
        return max([0, *(int(p.rsplit("/", 1)[-1][1:-5]) for p, _ in self._list(f"{self.root}/manifests") if p.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, base: dict, shards: list[dict], schema: str) -> dict:
        new = {"version": base["version"] + 1, "parent": base["version"], "schema": schema, "shards": sorted(shards, key=lambda s: s["path"])}
        final, tmp = (self._path(f"{self.root}/manifests/{n}") for n in (f"v{new['version']:09d}.json", f".{uuid.uuid4().hex}.tmp"))
        out = self._fs.create(tmp, False)
        try:
            out.write(bytearray(json.dumps(new).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(tmp, final, options)
        except Exception as e:
            self._fs.delete(tmp, False)
            if self._fs.exists(final):
                raise Conflict(f"version {new['version']} exists") from e
            raise
        return new

    def _written(self, df: DataFrame) -> list[dict]:
        """Write df as new shards, one for each of its partitions that has rows."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return [{"path": p[p.index("/data/") + 1 :], "bytes": n} for p, n in self._list(folder) if p.endswith(".parquet")]

    def append(self, df: DataFrame) -> dict:
        """Arrivals become small shards, one for each partition in which they arrive, and a new version."""
        return self._change(set(), self._written(df), df.schema.json())

    def _change(self, gone: set[str], new: list[dict], schema: str) -> dict:
        """Commit the removal of `gone` and the addition of `new`, again on the newest version where another writer was faster, `attempts` times. Conflict if that one has dropped a shard of `gone` (its rows are in another shard by then), or all attempts fail."""
        for _ in range(self.attempts):
            base = self.manifest()
            if not gone <= {s["path"] for s in base["shards"]}:
                raise Conflict(f"version {base['version']} no longer has the shards to be replaced")
            try:
                return self.commit(base, [s for s in base["shards"] if s["path"] not in gone] + new, schema)
            except Conflict:
                continue
        raise Conflict(f"other writers were faster {self.attempts} times")

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Runs to merge: within each tier, `fanout` files at a time in order of size, never over the target; a rest waits."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            tiers.setdefault(self.tiers.tier(s["bytes"]), []).append(s)
        runs = []
        for t, files in sorted(tiers.items()):
            run: list[dict] = []
            for s in sorted(files, key=lambda s: (s["bytes"], s["path"])) if t < 0 else []:
                if run and sum(x["bytes"] for x in run) + s["bytes"] > self.tiers.target_bytes:
                    runs.append(run)
                    run = []
                run.append(s)
                if len(run) == self.tiers.fanout:
                    runs.append(run)
                    run = []
        return [r for r in runs if len(r) > 1]

    def _merge(self, run: list[dict], schema) -> list[dict]:
        files = [f"{self.root}/{s['path']}" for s in run]
        return self._written(self.spark.read.schema(schema).parquet(*files).coalesce(1))

    def compact(self, keep_versions: int = 2) -> dict:
        """Merge tier by tier until no tier holds `fanout` runs; each round is one commit. Files go once none of the last `keep_versions` versions names them: a reader of the version before the last round isn't disturbed."""
        while runs := self.plan((base := self.manifest())["shards"]):
            schema = self._schema(base)
            with ThreadPoolExecutor(self.tiers.parallel_jobs) as pool:
                merged = [s for out in pool.map(lambda r: self._merge(r, schema), runs) for s in out]
            gone = {s["path"] for r in runs for s in r}
            self._change(gone, merged, base["schema"])
            self.vacuum(keep_versions)
        return self.manifest()

    def vacuum(self, keep_versions: int = 2, grace: float = 86_400) -> None:
        """Delete the shards that only versions older than the last `keep_versions` name, and folders of data that no version names once they are `grace` seconds old: what jobs lost before their commit have left."""
        last = self.version()
        first = max(1, last - keep_versions + 1)
        live = {s["path"] for v in range(first, last + 1) for s in self.manifest(v)["shards"]}
        old = {s["path"] for v in range(max(1, first - 1), first) for s in self.manifest(v)["shards"]}
        for path in old - live:
            self._fs.delete(self._path(f"{self.root}/{path}"), False)
        folders = {p.split("/")[1] for p in live | old}
        for status in self._fs.listStatus(self._path(f"{self.root}/data")):
            if status.getPath().getName() not in folders and status.getModificationTime() / 1000 < time.time() - grace:
                self._fs.delete(status.getPath(), True)

    def _schema(self, manifest: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(manifest["schema"]))

    def shard_col(self, version: int | None = None) -> str:
        """_shard, with as many more underscores in front as it takes to be no column of the rows (in any case of letters)."""
        name, taken = "_shard", {c.lower() for c in self._schema(self.manifest(version)).names}
        while name in taken:
            name = "_" + name
        return name

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one), with the path of the shard that holds them: the column self.shard_col(), _shard unless the rows have one of that name."""
        m = self.manifest(version)
        if not m["schema"]:
            raise ValueError("nothing has been appended")
        schema = self._schema(m)
        if not m["shards"]:
            return self.spark.createDataFrame([], schema).withColumn(self.shard_col(version), F.lit(None).cast("string"))
        df = self.spark.read.schema(schema).parquet(*(f"{self.root}/{s['path']}" for s in m["shards"]))
        return df.withColumn(self.shard_col(version), F.regexp_extract(F.input_file_name(), r"(data/[^/]+/[^/]+)$", 1))


def shard(docs: DataFrame, root: str, tiers: Tiers = Tiers(), arrivals: int = 1) -> ShardStore:
    """Append docs to the store at root, as one arrival or several (rows are dealt by their hash), and compact it; the store.

    Every row is kept as it is: nulls, empty or very long texts and repeated rows make no difference, and columns may have any
    names (see read). A row larger than the target makes a shard larger than the target. An empty table commits a version without rows.
    """
    store = ShardStore(docs.sparkSession, root, tiers)
    for i in range(arrivals):
        store.append(docs.filter(F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)), F.lit(arrivals)) == i) if arrivals > 1 else docs)
    store.compact()
    return store
