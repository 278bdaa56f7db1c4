"""Incremental versions: score unseen documents, keep the latest record, snapshot coverage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstat.operators.versions import latest_records


def table_stream(spark: SparkSession, folder: str, table: str, files_per_batch: int = 100) -> DataFrame:
    """Stream over one table below ``folder``, a single file or a folder of part files, its schema read once."""
    path = f"{folder}/{table}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    fs, jpath = _located(spark, path)
    # a stream watches folders: a single file is picked out of the one it lies in
    return stream.parquet(path) if fs.getFileStatus(jpath).isDirectory() else stream.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def _located(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _located(spark, path)
    return fs.exists(jpath)


def score_unseen(stream: DataFrame, key: str, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Score only documents whose key is not in the sink yet, and append them.

    A batch is written below its own id and overwritten if it is replayed, so a lost executor or
    a restarted query neither loses nor doubles a document.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        if _exists(spark, sink):
            seen = spark.read.parquet(sink).where(F.col("batch_id") != batch_id).select(key)
            fresh = fresh.join(seen, key, "left_anti")
        score(fresh).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


BUCKET = "upsert_bucket"


def _manifest(spark: SparkSession, sink: str, generation: int) -> dict[int, str]:
    """Folder of every bucket at a generation, at most one row per bucket; a generation that was never committed raises."""
    path = f"{sink}/manifest/generation={generation}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        raise ValueError(f"generation {generation} of {sink} is missing; the next one can't be built on a gap")
    return {r[BUCKET]: r["folder"] for r in spark.read.schema(f"{BUCKET} int, folder string").parquet(path).collect()}


def upsert_batch(batch: DataFrame, batch_id: int, keys: Sequence[str], ts: str, tie: str, sink: str, buckets: int = 64) -> None:
    """One generation of a table of latest records: the buckets that ``batch`` touches are merged and written anew.

    Keys are dealt to ``buckets`` by hash. Data files of a generation are never changed later; its
    manifest, written last, names the folder of every bucket, so untouched buckets stay where they
    are. A replayed batch starts from the generation before it and overwrites only its own files. An
    empty batch repeats the manifest. ``buckets`` is fixed for the life of a table: a bucket number
    beyond it raises. The column ``upsert_bucket`` is reserved.
    """
    spark, cols = batch.sparkSession, batch.columns
    if BUCKET in cols:
        raise ValueError(f"column {BUCKET} is reserved")
    folders = _manifest(spark, sink, batch_id - 1) if batch_id else {}
    held = [f for b, f in folders.items() if b < 0]  # bucket -1 keeps the number of buckets
    if held and held[0] != str(buckets):
        raise ValueError(f"{sink} has {held[0]} buckets, not {buckets}")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(BUCKET)
    rows = batch.select("*", bucket)
    touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
    if touched:
        old = [folders[b] for b in touched if b in folders]
        if old:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*old).select("*", bucket))
        data = f"{sink}/data/generation={batch_id}"
        latest_records(rows, [*keys, BUCKET], ts, tie).select(*cols, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(data)
        folders |= {b: f"{data}/{BUCKET}={b}" for b in touched}
    folders[-1] = str(buckets)
    spark.createDataFrame(sorted(folders.items()), f"{BUCKET} int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{sink}/manifest/generation={batch_id}")


def latest_table(spark: SparkSession, sink: str, schema, generation: int | None = None) -> DataFrame:
    """The table at a generation, by default the last one that was committed."""
    if generation is None:
        generation = spark.read.parquet(f"{sink}/manifest").agg(F.max("generation")).first()[0]
    folders = [f for b, f in _manifest(spark, sink, generation).items() if b >= 0]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_latest(stream: DataFrame, keys: Sequence[str], ts: str, tie: str, sink: str, checkpoint: str, buckets: int = 64) -> DataFrame:
    """Keep the latest record per key of an append log (later timestamp, then later line, wins); see ``upsert_batch``."""
    def step(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(batch, batch_id, keys, ts, tie, sink, buckets)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return latest_table(stream.sparkSession, sink, stream.schema)


def coverage_windows(stream: DataFrame, ts: str, by: str, width: str, delay: str) -> DataFrame:
    """Counts per tumbling window and ``by``, late rows dropped after ``delay``."""
    return (
        stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), by)
        .agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_scored"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "n_scored")
    )


def write_closed_windows(windows: DataFrame, sink: str, checkpoint: str) -> None:
    """Append every window once its watermark has passed."""
    windows.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
