"""Findings history: fingerprints across runs, upsert, comparison and retention.

A history is a table keyed by fingerprint and dealt into ``BUCKETS`` by its hash. A version is a manifest that names a
folder for each bucket; an upsert reads and writes the buckets only that its findings fall into, and names the former
folders for all others. ``_versions`` names the complete versions, ``prune`` deletes what no kept version names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import escapes, finding_fingerprint, line_hash, normal_path

HISTORY = "fingerprint string, file_path string, line_start int, line_end int, title string, severity string, category string, confidence double, line_content_hash string, first_seen timestamp, last_seen timestamp, run_count int, finding_json string"
BUCKETS = 64
_FIRST = ["file_path", "line_start", "line_end", "title", "severity", "category", "confidence"]


def with_fingerprint(findings: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Adds ``fingerprint`` and, from lines(path, line_no, text), ``line_content_hash`` by its folded path (null for escaping or absent ones)."""
    out = findings.withColumn("fingerprint", finding_fingerprint("file_path", "line_start", "title"))
    if lines is None:
        return out if "line_content_hash" in out.columns else out.withColumn("line_content_hash", F.lit(None).cast("string"))
    hashed = lines.select(F.col("path").alias("_path"), F.col("line_no").alias("line_start"), line_hash("text").alias("line_content_hash")).dropDuplicates(["_path", "line_start"])
    named = out.drop("line_content_hash").withColumn("_path", F.when(~escapes("file_path"), normal_path("file_path")))
    return named.join(hashed, ["_path", "line_start"], "left").drop("_path")


def record_run(history: DataFrame, findings: DataFrame, now: Column) -> DataFrame:
    """The history after a run. New fingerprints enter; known ones move last_seen, add to run_count, take a new line
    hash if there is one, and keep their first values. A repeat within the run counts again."""
    order = F.struct(*[F.col(c) for c in ("severity", "category", "confidence", "line_end")])
    batch = findings.groupBy("fingerprint").agg(*[F.min_by(c, order).alias(c) for c in _FIRST], F.max("line_content_hash").alias("line_content_hash"), F.count("*").cast("int").alias("times"), F.max(F.to_json(F.struct(*_FIRST))).alias("finding_json"))
    h, b = history.alias("h"), batch.alias("b")
    both = h.join(b, F.col("h.fingerprint") == F.col("b.fingerprint"), "full_outer")
    seen = F.col("b.fingerprint").isNotNull()
    pick = lambda c: F.when(F.col("h.fingerprint").isNotNull(), F.col(f"h.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return both.select(F.coalesce("h.fingerprint", "b.fingerprint").alias("fingerprint"), *[pick(c) for c in _FIRST], F.coalesce("b.line_content_hash", "h.line_content_hash").alias("line_content_hash"), F.coalesce("h.first_seen", now).alias("first_seen"), F.when(seen, now).otherwise(F.col("h.last_seen")).alias("last_seen"), (F.coalesce("h.run_count", F.lit(0)) + F.coalesce("b.times", F.lit(0))).cast("int").alias("run_count"), F.coalesce("b.finding_json", "h.finding_json").alias("finding_json"))


def compare(findings: DataFrame, history: DataFrame) -> DataFrame:
    """Adds ``status``: new, maybe_fixed (both line hashes known and different) or still_present, and when first seen."""
    prior = history.select("fingerprint", F.col("line_content_hash").alias("prior_hash"), F.col("first_seen").alias("prior_first_seen"), F.col("run_count").alias("prior_runs"))
    status = F.when(F.col("prior_runs").isNull(), "new").when(F.col("line_content_hash") != F.col("prior_hash"), "maybe_fixed").otherwise("still_present")
    return findings.join(prior, "fingerprint", "left").withColumn("status", status)


def compare_summary(compared: DataFrame, history: DataFrame) -> DataFrame:
    counts = compared.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("new", "still_present", "maybe_fixed")])
    return counts.crossJoin(F.broadcast(history.agg(F.count("*").alias("history_size"))))


def not_seen(history: DataFrame, findings: DataFrame) -> DataFrame:
    """History rows that this run does not have."""
    return history.join(findings.select("fingerprint").distinct(), "fingerprint", "left_anti")


def retain_newest(rows: DataFrame, n: int = 5000, by: str | None = None, order: str = "last_seen", tie: str = "fingerprint") -> DataFrame:
    """The newest n rows of each ``by``, or of all (a top-n, not a window over one partition)."""
    if by is None:
        return rows.orderBy(F.desc(order), tie).limit(n)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), tie))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def dropped_by_retention(rows: DataFrame, n: int = 5000, by: str | None = None, order: str = "last_seen", tie: str = "fingerprint") -> DataFrame:
    return rows.join(retain_newest(rows, n, by, order, tie).select(tie, *([by] if by else [])), [tie, *([by] if by else [])], "left_anti")


def list_history(history: DataFrame, n: int = 50) -> DataFrame:
    return history.orderBy(F.desc("last_seen"), "fingerprint").limit(n)


def lookup(history: DataFrame, fingerprint: str) -> DataFrame:
    return history.filter(F.col("fingerprint") == fingerprint)


def latest_version(spark: SparkSession, root: str) -> int:
    """The latest complete version under a root; 0 before the first write."""
    try:
        return spark.read.text(f"{root}/_versions").agg(F.max(F.col("value").cast("long"))).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def _manifest(spark: SparkSession, root: str, version: int) -> dict[int, str]:
    """The folder of each bucket of a version, ``BUCKETS`` at most."""
    if not version:
        return {}
    return dict(spark.read.schema("bucket int, folder string").json(f"{root}/_manifest/v={version}").collect())


def at_version(spark: SparkSession, root: str, version: int, buckets: set[int] | None = None) -> DataFrame:
    """A version, or those of its buckets only; version 0 is empty."""
    folders = [f"{root}/{f}" for b, f in _manifest(spark, root, version).items() if buckets is None or b in buckets]
    return spark.read.schema(HISTORY).parquet(*folders) if folders else spark.createDataFrame([], HISTORY)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The latest complete version under a root, or an empty history."""
    return at_version(spark, root, latest_version(spark, root))


def clear(spark: SparkSession, root: str) -> None:
    """Go on from an empty history, as a version of its own."""
    publish(spark.createDataFrame([], HISTORY), root, latest_version(spark, root) + 1)


def publish(history: DataFrame, root: str, version: int, kept: dict[int, str] | None = None) -> None:
    """Write a version from whole buckets and the folders of ``kept`` ones, then name it; the same version again replaces it."""
    spark, folder = history.sparkSession, f"data/v={version}"
    history.withColumn("bucket", _bucket()).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{root}/{folder}")
    held = spark.read.schema(f"{HISTORY}, bucket int").parquet(f"{root}/{folder}").select("bucket").distinct().collect()
    named = (kept or {}) | {b: f"{folder}/bucket={b}" for (b,) in held}
    spark.createDataFrame(list(named.items()), "bucket int, folder string").coalesce(1).write.mode("overwrite").json(f"{root}/_manifest/v={version}")
    spark.range(1).select(F.lit(str(version)).alias("value")).coalesce(1).write.mode("append").text(f"{root}/_versions")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("fingerprint"), F.lit(BUCKETS)).cast("int")


def upsert(findings: DataFrame, root: str, now: Column, version: int | None = None) -> int:
    """A run's findings, with fingerprints, into the buckets that they fall into; the new version's number.

    ``version`` is the one to go on from (the latest if null): a retried run that names it is written again.
    """
    spark = findings.sparkSession
    version = latest_version(spark, root) if version is None else version
    touched = {b for (b,) in findings.select(_bucket().alias("b")).distinct().collect()}
    kept = {b: f for b, f in _manifest(spark, root, version).items() if b not in touched}
    publish(record_run(at_version(spark, root, version, touched), findings, now), root, version + 1, kept)
    return version + 1


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete manifests before the last ``keep`` versions, and folders that no later one names."""
    last = latest_version(spark, root)
    named = {f for v in range(max(1, last - keep + 1), last + 1) for f in _manifest(spark, root, v).values()}
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for held in files.globStatus(path(f"{root}/data/v=*/bucket=*")):
        name = held.getPath()
        if f"data/{name.getParent().getName()}/{name.getName()}" not in named and int(name.getParent().getName()[2:]) <= last:
            files.delete(name, True)
    for held in files.globStatus(path(f"{root}/_manifest/v=*")):
        if int(held.getPath().getName()[2:]) <= last - keep:
            files.delete(held.getPath(), True)
