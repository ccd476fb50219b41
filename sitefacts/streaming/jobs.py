"""Long-running forms of the incremental jobs, on Structured Streaming.

A batch starts from the state that was committed before it and commits its own under its number, so a
batch that is replayed after a failure replaces what it did before and is never counted twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sitefacts.functions import text as T
from sitefacts.sources.parts import PART, PartStore
from sitefacts.sources.tables import append_unique, pending_after_resume

BATCH = "batch_id"
PARTS = 64


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stored_rows(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """All rows that the batches have stored."""
    return PartStore(spark, target).read(schema)


def _batch_writer(target: str):
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/{BATCH}={batch}")

    return write


def _start(stream: DataFrame, step, checkpoint: str, mode: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _touched(rows: DataFrame, part: Column) -> list[int]:
    return [r[0] for r in rows.select(part).distinct().collect()]  # numbers of parts


def stream_append_unique(stream: DataFrame, target: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, once: bool = True, n_parts: int = PARTS) -> StreamingQuery:
    """Appends the rows whose key is new, across batches and restarts; exact, without a time bound.

    Stored rows lie in parts by a hash of their key, and a batch reads the keys of the parts it touches.
    Small folders are merged by level, so what a batch lists grows with the logarithm of the batches.
    """
    schema = stream.schema

    def step(rows: DataFrame, batch: int) -> None:
        store = PartStore(rows.sparkSession, target, n_parts)
        state = store.current(before=batch)
        part = F.pmod(F.xxhash64(*[T.strip(F.col(k).cast("string")) for k in keys]), F.lit(state.n_parts)).cast("int").alias(PART)
        known = store.read(schema, state, _touched(rows, part))
        store.append(append_unique(known, rows, keys, order).withColumn(PART, part), state, batch)

    return _start(stream, step, checkpoint, "append", once)


def unique_within(stream: DataFrame, keys: Sequence[str], time: str, bound: str) -> DataFrame:
    """Drops repeats that come within a time bound: the form with limited state. Repeats further apart stay, by its purpose."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, bound).dropDuplicatesWithinWatermark(list(keys))


def status_counts(log: DataFrame, time: str, stage: str, status: str, window: str = "1 day") -> DataFrame:
    """Rows of a status log per time window, stage and status."""
    counted = log.groupBy(F.window(F.col(time).cast("timestamp"), window).alias("_w"), F.col(stage).alias("stage"), F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return counted.select(F.col("_w.start").alias("window_start"), "stage", "status", "n")


COUNTS = "window_start timestamp, stage string, status string, n long"
COUNT_PARTS = 8


def stream_status(log: DataFrame, target: str, time: str, stage: str, status: str, checkpoint: str, window: str = "1 day", once: bool = True) -> StreamingQuery:
    """Stores each batch's own counts. Rows may come at any time, however late; no state is kept.

    The counts of old batches are folded into sums, level by level; the manifest of a batch names exactly
    the folders that hold it and all batches before it, so a replayed batch counts once.
    """
    group = ["window_start", "stage", "status"]

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy(PART, *group).agg(F.sum("n").alias("n"))

    def step(rows: DataFrame, batch: int) -> None:
        store = PartStore(rows.sparkSession, target, COUNT_PARTS)
        state = store.current(before=batch)
        counted = status_counts(rows, time, stage, status, window)
        store.append(counted.withColumn(PART, F.pmod(F.xxhash64(*group), F.lit(state.n_parts)).cast("int")), state, batch, fold)

    return _start(log, step, checkpoint, "append", once)


def current_status(spark: SparkSession, target: str) -> DataFrame:
    """The count of every window, stage and status: the sum of what the batches have stored."""
    rows = PartStore(spark, target).read(COUNTS)
    return rows.groupBy("window_start", "stage", "status").agg(F.sum("n").alias("n"))


RESULT_KEY = "done"


def _result_part(key: Column, n_parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_parts)).cast("int").alias(PART)


def store_results(results: DataFrame, key: str, target: str, n_parts: int = PARTS) -> None:
    """Adds the keys of finished results to the store that ``stream_pending`` reads, as ``pending_after_resume`` compares them."""
    store = PartStore(results.sparkSession, target, n_parts)
    state = store.current()
    keys = results.select(F.lower(T.strip(F.col(key).cast("string"))).alias(RESULT_KEY)).where(F.col(RESULT_KEY).isNotNull()).distinct()
    distinct = lambda rows: rows.distinct()
    store.append(keys.withColumn(PART, _result_part(F.col(RESULT_KEY), state.n_parts)), state, state.version + 1, distinct)


def stream_pending(inputs: DataFrame, results: str, key: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Passes on only inputs that have no stored result yet.

    ``results`` is the store that ``store_results`` fills, at any time and by any process. A batch loads
    its newest state and reads the keys of the parts that its own inputs fall in.
    """
    write = _batch_writer(target)

    def step(rows: DataFrame, batch: int) -> None:
        store = PartStore(rows.sparkSession, results)
        state = store.current()
        own = _result_part(F.lower(T.strip(F.col(key).cast("string"))), state.n_parts)
        done = store.read(f"{RESULT_KEY} string", state, _touched(rows, own))
        write(pending_after_resume(rows, done, key, RESULT_KEY), batch)

    return _start(inputs, step, checkpoint, "append", once)
