"""The tree of raw JSON objects: reading, checking, writing, and the load of whole runs."""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Forms of keys.
RUN_KEY = r"^batches/date=([0-9]{4}-[0-9]{2}-[0-9]{2})/run_id=([^/]+)/"
CANDIDATE_KEY = RUN_KEY + r"candidates/vacancy_id=([^/]+)/(search_item|vacancy|decision|outcome|observation|evaluation_candidates)\.json$"
APPLICATION_KEY = r"^applications/date=([0-9]{4}-[0-9]{2}-[0-9]{2})/run_id=([^/]+)/vacancy_id=([^/]+)/(vacancy_before|application_request|application_result|vacancy_after)\.json$"
OBJECTS = "key string, body binary, size_bytes long, sha256 string, last_modified timestamp"


def read_objects(spark: SparkSession, root: str) -> DataFrame:
    """All JSON objects below root with keys relative to it: OBJECTS. Bodies are read where they are used."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    return _objects(f, root)


def stream_objects(spark: SparkSession, root: str, files_per_trigger: int) -> DataFrame:
    """The same as a stream of new files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    f = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_trigger).load(root)
    return _objects(f, root)


def _objects(f: DataFrame, root: str) -> DataFrame:
    base = root.split("://")[-1].removeprefix("file:").rstrip("/")
    key = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), rf"^.*?{_quoted(base)}/", "")
    return f.select(key.alias("key"), F.col("content").alias("body"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("last_modified"))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else f"\\{c}" for c in text)


def relative_key(uri: Column, bucket: str, prefix: str) -> Column:
    """struct(key, error): keys, full keys and s3:// URIs as keys below the prefix; other buckets, prefixes, queries and fragments are errors."""
    is_uri = uri.startswith("s3://")
    path = F.when(is_uri, F.regexp_extract(uri, r"^s3://[^/]*/?(.*)$", 1)).otherwise(F.regexp_replace(uri, "^/+", ""))
    key = F.when(path.startswith(f"{prefix}/"), F.regexp_replace(path, f"^{_quoted(prefix)}/", "")).otherwise(F.when(~is_uri, path))
    error = (
        F.when(uri.isNull() | (F.trim(uri) == ""), "empty").when(is_uri & (F.regexp_extract(uri, r"^s3://([^/]*)", 1) != bucket), "foreign_bucket")
        .when(uri.rlike(r"[?#]"), "query_or_fragment").when(key.isNull(), "foreign_prefix").when(key.rlike(r"(^|/)\.\.(/|$)"), "parent_reference")
    )
    return F.struct(F.when(error.isNull(), key).alias("key"), error.alias("error"))


def classify(objects: DataFrame) -> DataFrame:
    """objects with kind, date, run_id, vacancy_id, name; kind is null for keys of no known form."""
    k = F.col("key")
    kind = F.when(k.rlike(CANDIDATE_KEY), "candidate").when(k.rlike(APPLICATION_KEY), "application").when(k.rlike(RUN_KEY + r"(run|summary|discovery|resume_reconciliation)\.json$"), "run").when(k.rlike(RUN_KEY + r"discovery/queries/query=[^/]+/page=\d+\.json$"), "page")
    return objects.withColumns({
        "kind": kind, "date": F.regexp_extract(k, r"/date=([^/]+)/", 1).try_cast("date"), "run_id": F.regexp_extract(k, r"/run_id=([^/]+)/", 1),
        "vacancy_id": F.nullif(F.regexp_extract(k, r"/vacancy_id=([^/]+)/", 1), F.lit("")), "name": F.regexp_extract(k, r"([^/]+)\.json$", 1),
    })


def verify(objects: DataFrame, manifest: DataFrame) -> DataFrame:
    """objects with observed_at and error, against manifest(key, sha256, collected_at): checksum (any case), a JSON object, a time.

    A collected_at given as text must carry a zone; a time of Spark's is an instant already. Without one, the object's own time counts.
    """
    given = F.col("collected_at")
    if isinstance(manifest.schema["collected_at"].dataType, StringType):
        zoned = given.rlike(r"(Z|z|[+-][0-9]{2}:?[0-9]{2})$")
        m = manifest.select("key", F.lower("sha256").alias("_sha"), F.when(zoned, F.try_to_timestamp(given)).alias("collected_at"), (given.isNotNull() & (~zoned | F.try_to_timestamp(given).isNull())).alias("_unzoned"))
    else:
        m = manifest.select("key", F.lower("sha256").alias("_sha"), given, F.lit(False).alias("_unzoned"))
    j = objects.join(m, "key", "left").withColumn("observed_at", F.when(~F.coalesce("_unzoned", F.lit(False)), F.coalesce("collected_at", "last_modified")))
    error = F.when(F.col("_sha").isNotNull() & (F.col("_sha") != F.col("sha256")), "checksum").when(F.json_object_keys(F.col("body").cast("string")).isNull(), "not_a_json_object").when(F.col("_unzoned"), "time_without_zone").when(F.col("observed_at").isNull(), "no_time")
    return j.withColumn("error", error).drop("_sha", "_unzoned")


def write_objects(objects: DataFrame, path: str) -> None:
    """objects(date, run_id, key, body, collected_at) as a table with digest and size, by date and run."""
    objects.withColumns({"sha256": F.sha2("body", 256), "size_bytes": F.octet_length("body")}).write.mode("append").partitionBy("date", "run_id").parquet(path)


def append_new(existing: DataFrame, incoming: DataFrame, key: str = "vacancy_id") -> DataFrame:
    """Rows of incoming(key, body) whose (key, digest) is not stored, each once."""
    new = incoming.withColumn("sha256", F.sha2("body", 256)).dropDuplicates([key, "sha256"])
    return new.join(existing.select(key, "sha256"), [key, "sha256"], "left_anti")


def canonical_digest(df: DataFrame, column: str, out: str = "digest") -> DataFrame:
    """SHA-256 of JSON text with sorted keys and no spaces; null if it is no JSON. 1.0 and 1 stay different."""
    import hashlib

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                value = json.loads(t)
            except (TypeError, ValueError):
                return None
            return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

        return texts.map(one)

    return df.withColumn(out, of(F.col(column)))


def exact_visible_text(df: DataFrame, column: str, out: str = "visible") -> DataFrame:
    """Visible text by an HTML parser, fragments one a line: the exact form of ``text.visible_text``."""
    from html.parser import HTMLParser

    class Fragments(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.parts: list[str] = []

        def handle_data(self, data: str) -> None:
            if data.strip():
                self.parts.append(data.strip())

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for t in b:
                p = Fragments()
                p.feed(t or "")
                p.close()  # an unfinished entity at the end keeps the text before it
                out.append("\n".join(p.parts))
            yield pd.Series(out, dtype=object)

    return df.withColumn(out, F.pandas_udf(texts, "string")(F.col(column)))


def discover_runs(classified: DataFrame) -> DataFrame:
    """One row per run: date, names of its objects, has_summary; ``clash`` when its id stands below several dates."""
    r = classified.filter("kind = 'run'")
    return r.groupBy("run_id").agg(F.min("date").alias("date"), F.array_sort(F.collect_set("name")).alias("names"), F.max(F.col("name") == "summary").alias("has_summary"), (F.count_distinct("date") > 1).alias("clash"))


def candidate_keys(classified: DataFrame) -> DataFrame:
    """One row per run and vacancy with the keys of its six possible objects."""
    names = ["search_item", "vacancy", "decision", "outcome", "observation", "evaluation_candidates"]
    return classified.filter("kind = 'candidate'").groupBy("date", "run_id", "vacancy_id").pivot("name", names).agg(F.first("key"))


def first_candidates(keys: DataFrame, n: int | None = None) -> DataFrame:
    """Candidates of each run in order of their identifier, all or the first n of every run: adds ``place`` from 1. A run's candidates are bounded by its page limits."""
    placed = keys.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("vacancy_id")))
    return placed if n is None else placed.filter(F.col("place") <= n)


def select_runs(runs: DataFrame, run_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Earliest runs by (date, id), or exactly one."""
    if run_id is not None and limit is not None:
        raise ValueError("give a run or a limit, not both")
    if run_id is not None:
        return runs.filter(F.col("run_id") == run_id)
    ordered = runs.orderBy("date", "run_id")
    return ordered if limit is None else ordered.limit(limit)


def read_index(df: DataFrame, preferred: list[str], required: tuple[str, ...] = ("id", "name"), limit: int | None = None) -> DataFrame:
    """Preferred columns that exist, newest identifier first; a missing required column is an error."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    out = df.select(*[c for c in preferred if c in df.columns]).orderBy(F.desc("id"))
    return out if limit is None else out.limit(limit)


def index_ids(index: DataFrame) -> DataFrame:
    """Distinct identifiers of an index that aren't null, newest first, with how many rows each has; the sum of ``n`` is the index's count of such rows."""
    return index.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("id"))


def sync_postings(index: DataFrame, postings: DataFrame, ids: DataFrame | None = None, newest: int | None = None) -> DataFrame:
    """Raw postings of the index: of the given identifiers, or the newest n."""
    chosen = index.select("id")
    if ids is not None:
        chosen = chosen.join(ids.select("id").distinct(), "id", "left_semi")
    if newest is not None:
        chosen = chosen.orderBy(F.desc("id")).limit(newest)
    return postings.join(chosen.distinct(), "id", "left_semi")


def eligible_runs(runs: DataFrame, headers: DataFrame) -> DataFrame:
    """Runs with a summary and an observe header of version 3: headers(run_id, event_type, schema_version, runtime_mode); event types with or without the board's prefix."""
    h = headers.filter("(event_type = 'run_started' or event_type like '%.batch.started') and schema_version = 3 and runtime_mode = 'observe'").select("run_id")
    return runs.filter("has_summary and not clash").join(h, "run_id", "left_semi")


def pending_runs(eligible: DataFrame, loaded: DataFrame, limit: int = 10) -> DataFrame:
    """Earliest eligible runs that are not loaded as finished: loaded(run_id, status)."""
    done = loaded.filter("status = 'finished'").select("run_id")
    return eligible.join(done, "run_id", "left_anti").orderBy("date", "run_id").limit(limit)
