"""Incremental processing of arriving records with Structured Streaming.

New record files are picked up by the file source (each file once, tracked
in the checkpoint).  Records already seen are dropped by a stateful
``dropDuplicates`` on the record key (state in the checkpoint, RocksDB store,
so each micro-batch costs a state lookup per record rather than a read of
everything written so far).  Each micro-batch is transformed and written to
its own ``batch_id`` partition with dynamic overwrite, so a replayed batch
rewrites exactly its own rows.  ``trigger(availableNow=True)`` processes
everything present and stops, which makes the same job usable as a
resumable batch run.

Without ``ttl`` the state holds every key for ever.  With it a key leaves the
state once it has not been needed for ``ttl`` (twice that at most, by arrival
time), so the state is bounded by what arrives in that time; a key that comes
back later is held against the keys written so far, a narrow table of 16 bytes
a record beside the sink.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import path_has_data, persisted

Transform = Callable[[DataFrame], DataFrame]


def batch_writer(sink: str, transform: Transform):
    def write(batch: DataFrame, batch_id: int) -> None:
        (transform(batch).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id").parquet(sink))
    return write


def keys_path(sink: str) -> str:
    return f"{sink.rstrip('/')}-keys"


def record_key(keys: Sequence[str]):
    """16 bytes that tell the records' keys apart; NULL is a value of its own."""
    return F.unhex(F.md5(F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]), {"ignoreNullFields": "false"})))


def once_writer(sink: str, transform: Transform, keys: Sequence[str]):
    """Like :func:`batch_writer` for records whose key no other batch has written.

    A replayed batch does not see its own keys, so it writes the same rows
    again.  The written keys are first cut down to those of the batch (a semi
    join, which Spark prunes by a Bloom filter of the batch's keys where the
    table is large), so only those meet the records.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_batch = batch_writer(sink, transform)
        # read once: every use of a micro-batch runs its stateful plan again
        keyed = persisted(batch.withColumn("_key", record_key(keys)), "arrived")
        if path_has_data(spark, keys_path(sink)):
            written = spark.read.schema("_key binary, batch_id bigint").parquet(keys_path(sink))
            seen = written.filter(F.col("batch_id") != batch_id).select("_key")
            keyed = keyed.join(seen.join(keyed.select("_key"), "_key", "left_semi"), "_key", "left_anti")
        write_batch(keyed.drop("_key"), batch_id)
        (keyed.select("_key", F.lit(batch_id).cast("bigint").alias("batch_id"))
              .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy("batch_id").parquet(keys_path(sink)))
    return write


def run_incremental(spark: SparkSession, source: str, schema: T.StructType, keys: Sequence[str],
                    transform: Transform, sink: str, checkpoint: str,
                    max_files_per_trigger: int | None = None, fmt: str = "parquet",
                    ttl: str | None = None, progress: list | None = None) -> DataFrame:
    """Process every new file under ``source`` once; return the sink table.

    ``ttl`` (an interval such as ``1 hour``) bounds the key state; a stream
    keeps the choice it began with.  ``progress`` takes the micro-batches'
    reports, with the rows that the state holds.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    arriving = reader.load(source)
    if ttl is None:
        stream, writer = arriving.dropDuplicates(list(keys)), batch_writer(sink, transform)
    else:
        timed = arriving.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", ttl)
        stream = timed.dropDuplicatesWithinWatermark(list(keys)).drop("_arrived")
        writer = once_writer(sink, transform, keys)
    q = (stream.writeStream.foreachBatch(writer)
               .option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    if progress is not None:
        progress.extend(q.recentProgress)
    return spark.read.parquet(sink)
