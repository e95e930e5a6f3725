"""Status of nodes kept up to date from a stream of test records or of result files.

Each batch is matched, the last record of a node wins, and the result is merged into the state. A record's
rank is (time, file, place in it), the time that of the file's last change unless another is named, so an older file that comes late changes
nothing newer. The state is a table of ``BUCKETS`` parts; a batch writes those that it touches, under its
number, and then a manifest that says which batch wrote each part last. A batch that is run again writes the same parts
once more, or does nothing if a manifest has its number. Of manifests the last ``KEEP`` stay, with the parts that they name; all else is removed,
so what is stored follows the nodes, not the batches. Result files are parsed from the bytes that the stream has read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from triage.operators.tagging import match_results
from triage.sources.results import located_records, parsed_files
from triage.sources.shared import written

BUCKETS, KEEP = 64, 3
#: ``said``: the rank of the record that the message is of, which may be older than that of the status.
STATE = "project string, node_id string, status string, error_message string, modified timestamp, file string, ord long, said struct<modified:timestamp,file:string,ord:long>"


def _bucket() -> Column:
    return F.pmod(F.xxhash64("project", "node_id"), F.lit(BUCKETS)).cast("int")


def _manifest(spark: SparkSession, target: str) -> tuple[int, dict[int, int]]:
    """The number of the last whole batch (-1: none) and which batch wrote each bucket; BUCKETS rows."""
    try:
        manifests = spark.read.schema("bucket int, wrote long, version long").parquet(f"{target}/manifests")
        last = manifests.agg(F.max("version")).first()[0]
        rows = [] if last is None else manifests.where(F.col("version") == last).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1, {}
    return (rows[0]["version"] if rows else -1), {r["bucket"]: r["wrote"] for r in rows if r["bucket"] >= 0}


def _tidy(spark: SparkSession, target: str) -> None:
    """Removes manifests before the last KEEP, and parts that none of these names."""
    manifests = spark.read.schema("bucket int, wrote long, version long").parquet(f"{target}/manifests")
    versions = sorted(r[0] for r in manifests.select("version").distinct().collect())  # KEEP + 1 at most, but for batches that failed here
    old, kept = versions[:-KEEP], versions[-KEEP:]
    if not old:
        return
    named = {(r["wrote"], r["bucket"]) for r in manifests.where(F.col("version").isin(kept)).collect()}
    gone = [f"state/version={r['wrote']}/bucket={r['bucket']}" for r in manifests.where(F.col("version").isin(old)).collect() if r["bucket"] >= 0 and (r["wrote"], r["bucket"]) not in named]
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in (*gone, *[f"manifests/version={v}" for v in old]):
        where = jvm.org.apache.hadoop.fs.Path(f"{target}/{path}")
        where.getFileSystem(conf).delete(where, True)


def current(spark: SparkSession, target: str, buckets: list[int] | None = None) -> DataFrame:
    """The state after the last whole batch; ``buckets``: of these only."""
    paths = [f"{target}/state/version={v}/bucket={b}" for b, v in _manifest(spark, target)[1].items() if buckets is None or b in buckets]
    return spark.read.schema(STATE).parquet(*paths) if paths else spark.createDataFrame([], STATE)


def merge(state: DataFrame, hit: DataFrame) -> DataFrame:
    """The state with matched records (``STATE``'s columns) merged in."""
    rank = F.struct("modified", "file", "ord")
    return state.unionByName(hit).groupBy("project", "node_id").agg(
        F.max_by("status", rank).alias("status"), F.max_by("error_message", "said").alias("error_message"), F.max(rank).alias("_r"), F.max("said").alias("said")
    ).select("project", "node_id", "status", "error_message", "_r.modified", "_r.file", "_r.ord", "said")


def apply_batch(batch: DataFrame, number: int, nodes: DataFrame, lang: str, target: str) -> None:
    """Merges a batch of records (project, run_id, name, status, message, modified, ord, and file where there is one) into the state."""
    spark = batch.sparkSession
    last, wrote = _manifest(spark, target)
    if number <= last:
        return
    named = batch if "file" in batch.columns else batch.withColumn("file", F.lit(""))
    hit = match_results(named, nodes, lang).where("node_id is not null").select("project", "node_id", "status", F.when(F.col("message") != "", F.col("message")).alias("error_message"), "modified", "file", "ord")
    hit = hit.withColumn("said", F.when(F.col("error_message").isNotNull(), F.struct("modified", "file", "ord")))
    hit = written(hit, "hit")  # the batch is read and parsed once
    touched = [r[0] for r in hit.select(_bucket().alias("bucket")).distinct().collect()]
    if touched:
        merged = merge(current(spark, target, touched), hit).withColumn("bucket", _bucket())
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/state/version={number}")
    rows = [(-1, number), *({**wrote, **dict.fromkeys(touched, number)}).items()]  # a batch that touched nothing has a manifest, too
    spark.createDataFrame(rows, "bucket int, wrote long").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifests/version={number}")
    _tidy(spark, target)


def stream_status(records: DataFrame, nodes: DataFrame, lang: str, target: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream of parsed records; takes what is there and ends."""
    return records.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, number, nodes, lang, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_result_files(spark: SparkSession, path: str, nodes: DataFrame, lang: str, target: str, checkpoint: str, files_per_batch: int = 1000, project: str | None = None, run_id: str | None = None, time: Column | None = None) -> StreamingQuery:
    """Starts a stream of the result files under ``path`` in any dialect; takes what is there and ends. ``project``, ``run_id``: as in ``load_results``.
    ``time``: what a record's age is told by, of the columns of ``load_results``; None: the change of its file."""
    seen = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{xml,trx,json}").option("maxFilesPerTrigger", files_per_batch).load(path)
    records = located_records(parsed_files(seen), path, project, run_id).select("project", "run_id", "file", "ord", "name", "status", "message", (F.col("modified") if time is None else time).alias("modified"))
    return stream_status(records, nodes, lang, target, checkpoint)
