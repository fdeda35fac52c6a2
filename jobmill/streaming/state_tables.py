"""Current state that new runs are merged into: tables in hash buckets of their keys, one manifest that is swapped once a load.

Landed objects lie below ``landed``/objects by batch and run, run headers and
summaries once more below ``landed``/index. A load picks the earliest pending
runs, reads their objects only, types them once, and rewrites the buckets that
their rows fall into, in new folders. Then one new manifest names the
folders of every bucket; until it is there, readers see the state before. A load that
dies leaves folders that no manifest names. One writer at a time.
"""

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobmill.plans import backfill as B
from jobmill.sources.raw import discover_runs, eligible_runs, pending_runs

BUCKETS = 64
#: Ids that may stand in a path as they are.
SAFE_ID = r"^[0-9A-Za-z][0-9A-Za-z_-]*$"


@dataclass
class Report:
    """What a load found and did; version is None if there was nothing to change."""

    discovered: int = 0
    eligible: int = 0
    pending: int = 0
    selected: list[str] = field(default_factory=list)
    loaded: list[str] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)
    read: list[str] = field(default_factory=list)
    rewritten: dict[str, list[int]] = field(default_factory=dict)
    version: int | None = None


class StateTables:
    """Tables below ``root``, each a schema and a folder per bucket, as the newest manifest names them."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def manifest(self) -> dict:
        """The newest manifest: version, buckets, tables: name to schema and folders by bucket."""
        at = self._path("_manifests")
        found = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        versions = sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json"))
        if not versions:
            return {"version": 0, "buckets": self.buckets, "tables": {}}
        stream = self._fs.open(self._path(f"_manifests/{versions[-1]:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The table, or only some of its buckets; None before its first row."""
        table = (manifest or self.manifest())["tables"].get(name)
        if table is None:
            return None
        schema = StructType.fromJson(table["schema"])
        paths = [f"{self.root}/{p}" for b, p in table["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rewrite(self, manifest: dict, name: str, key: list[str], rows: DataFrame, merged: Callable[[DataFrame | None, DataFrame], DataFrame], touch: DataFrame | None = None) -> list[int]:
        """Merges rows into the buckets that they, or the keys of ``touch``, fall into, in new folders, and notes these in the manifest given; the buckets."""
        bucket = F.pmod(F.xxhash64(*key), F.lit(manifest["buckets"])).cast("int")
        touched = sorted(r["b"] for r in (rows if touch is None else touch).select(bucket.alias("b")).distinct().collect())
        if not touched:
            return []
        out = merged(self.read(name, manifest, touched), rows)
        folder = f"{name}/v{manifest['version']:012d}-{uuid.uuid4().hex[:8]}"
        out.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        table = manifest["tables"].setdefault(name, {"folders": {}})
        table["schema"] = out.schema.jsonValue()
        for b in touched:  # a bucket whose rows are all gone has no folder
            table["folders"].pop(str(b), None)
            if self._fs.exists(self._path(f"{folder}/_bucket={b}")):
                table["folders"][str(b)] = f"{folder}/_bucket={b}"
        return touched

    def commit(self, manifest: dict) -> None:
        """Makes the manifest the newest: written aside, then moved; another writer's manifest of that version stops this one."""
        final, aside = self._path(f"_manifests/{manifest['version']:012d}.json"), self._path(f"_manifests/{uuid.uuid4().hex}.tmp")
        self._fs.mkdirs(self._path("_manifests"))
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise RuntimeError(f"version {manifest['version']} was written by another load")

    def vacuum(self) -> int:
        """Removes folders that the newest manifest doesn't name, those of readers of older versions too; how many."""
        m = self.manifest()
        named = {p.split("/_bucket=")[0] for t in m["tables"].values() for p in t["folders"].values()}
        gone = 0
        for name in m["tables"]:
            for f in self._fs.listStatus(self._path(name)):
                if f"{name}/{f.getPath().getName()}" not in named:
                    gone += self._fs.delete(f.getPath(), True)
        return gone


def land(landed: str) -> Callable[[DataFrame, int], None]:
    """A load for ``materialise.materialise``: lands classified objects by batch and run; a batch that is repeated replaces itself."""

    def load(objects: DataFrame, batch: int) -> None:
        known = objects.filter(F.col("kind").isNotNull() & F.col("run_id").rlike(SAFE_ID)).persist()
        known.withColumn("_run", F.col("run_id")).repartition("_run").write.mode("overwrite").partitionBy("_run").parquet(f"{landed}/objects/batch={batch}")
        known.filter("kind = 'run'").write.mode("overwrite").parquet(f"{landed}/index/batch={batch}")
        # which batches hold objects of a run: candidates may arrive before or after their header
        known.select("run_id").distinct().write.mode("overwrite").parquet(f"{landed}/runs/batch={batch}")
        known.unpersist()

    return load


def load_pending(tables: StateTables, landed: str, bucket: str, prefix: str, limit: int = 10, source: str = "board") -> Report:
    """Merges the earliest pending runs, at most ``limit``, into the state: observing runs of version 3 with a summary that are not loaded as finished.

    A run with a broken object is rolled back alone: it is in the quarantine, adds nothing else, and stays pending. Loading again what
    is loaded changes nothing.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    spark, report = tables.spark, Report()
    manifest = tables.manifest()
    index = spark.read.parquet(f"{landed}/index").dropDuplicates(["key", "sha256"])
    body = F.col("body").cast("string")
    discovered = discover_runs(index)
    headers = index.filter("name = 'run'").select("run_id", *[F.get_json_object(body, f"$.{c}").alias(c) for c in ("event_type", "schema_version", "runtime_mode")]).withColumn("schema_version", F.col("schema_version").try_cast("int"))
    eligible = eligible_runs(discovered, headers)
    done = tables.read("runs", manifest)
    done = spark.createDataFrame([], "run_id string, status string") if done is None else done.select("run_id", "status")
    pending = eligible.join(done.filter("status = 'finished'"), "run_id", "left_anti")
    report.discovered, report.eligible, report.pending = discovered.count(), eligible.count(), pending.count()
    report.selected = [r["run_id"] for r in pending_runs(pending, done, limit).collect()]
    if not report.selected:
        return report
    where = spark.read.parquet(f"{landed}/runs").filter(F.col("run_id").isin(report.selected)).select("batch", "run_id").distinct().orderBy("batch", "run_id").collect()
    report.read = [f"{landed}/objects/batch={r['batch']}/_run={r['run_id']}" for r in where]
    objects = spark.read.option("basePath", f"{landed}/objects").parquet(*report.read).drop("_run", "batch").withColumn("run_id", F.col("run_id").cast("string"))

    manifest["version"] += 1
    staged = f"{tables.root}/_staged/v{manifest['version']:012d}-{uuid.uuid4().hex[:8]}"
    parts, quarantine = B.store_parts(*B.parse(objects, bucket, prefix, versions=(3,)), staged)
    log = B.run_log(objects, parts, quarantine)
    verdicts = {r["run_id"]: r["verdict"] for r in log.select("run_id", "verdict").collect()}
    report.loaded = [r for r in report.selected if verdicts.get(r) == "loaded"]
    report.failed = [r for r in report.selected if r not in report.loaded]

    chosen = spark.createDataFrame([(r,) for r in report.selected], "run_id string")

    def into(name: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
        return lambda old, new: B.merged(name, new if old is None else B.as_feed(name, old).unionByName(new, allowMissingColumns=True))

    def replaced(old: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if old is None else old.join(chosen, "run_id", "left_anti").unionByName(new)

    todo = [(n, B.KEYS[n], feed, into(n)) for n, feed in B.feeds(parts, quarantine, f"s3://{bucket}/{prefix}", source, f"{manifest['version']:012d}-").items()]
    todo += [(n, ["run_id"], rows, replaced, chosen) for n, rows in (("run_log", log), ("quarantine", quarantine))]
    with ThreadPoolExecutor(B.AT_ONCE) as pool:
        done = list(pool.map(lambda x: tables.rewrite(manifest, *x), todo))
    report.rewritten = {x[0]: d for x, d in zip(todo, done, strict=True)}
    tables.commit(manifest)
    tables._fs.delete(tables._jvm.org.apache.hadoop.fs.Path(staged), True)
    report.version = manifest["version"]
    return report


def merging_sink(tables: StateTables, landed: str, bucket: str, prefix: str, limit: int = 10, seen: list[Report] | None = None) -> Callable[[DataFrame, int], None]:
    """A load for ``materialise.materialise`` that lands a micro-batch and merges every run that it completes; reports go to ``seen``.

    A micro-batch that Spark repeats lands again in the same folder, and its runs are loaded already.
    """
    to_landed = land(landed)

    def load(objects: DataFrame, batch: int) -> None:
        to_landed(objects, batch)
        tried: set[str] = set()
        while True:
            report = load_pending(tables, landed, bucket, prefix, limit)
            if seen is not None:
                seen.append(report)
            # runs that failed stay pending: stop where a load brings nothing new
            if not report.loaded or report.pending <= len(report.selected) or tried >= set(report.selected):
                return
            tried |= set(report.selected)

    return load
