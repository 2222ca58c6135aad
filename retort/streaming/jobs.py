"""Incremental, restartable jobs over arriving files: what streams is the arrival of work."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from retort.operators.fingerprints import ph4_histogram_fp
from retort.operators.reactions import reaction_matrix


def arriving(spark: SparkSession, path: str, schema: StructType, files_a_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else reader).parquet(path)


def append_each(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run ``work`` on each micro-batch and write the result under the batch's number, so that a batch that is run again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The state store of jobs whose state grows with the catalogue: on disk, with only changes written to the checkpoint of each batch.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def with_rocksdb(stream: DataFrame, batches_without_data: bool) -> DataFrame:
    """``stream``, after the session was told to keep the state of queries in RocksDB, and whether batches without data may run to let go of state.

    A query takes these settings when it starts.
    """
    for key, value in {**ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(batches_without_data).lower()}.items():
        stream.sparkSession.conf.set(key, value)
    return stream


def gathered(stream: DataFrame, key: str, expected: str, wait_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """Rows of ``stream`` once all of their key have arrived, with ``complete``; ``expected`` is the column with the number of a key's rows.

    Rows of a key are held over batches until there are as many as the column ``expected`` of any of them says; ``complete`` is true then. A key that is
    not complete ``wait_ms`` after its last rows is given out as it is, with ``complete`` false, and forgotten.

    State is kept in RocksDB, a list for each open key, and travels to the tasks with the keys' rows, many keys at a time. A key's rows should fit a task,
    as those of one molecule do; a key that goes on after it was given out starts anew. Null keys are one key.
    """
    names, kind = stream.schema.names, to_arrow_schema(stream.schema)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row as bytes, in which numbers beside nulls stay whole, with its key and what it expects."""
        for batch in batches:
            rows = [pickle.dumps(r) for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(names.index(key)), batch.column(names.index(expected)).cast(pa.int64()), pa.array(rows, pa.binary())], ["key", "wanted", "row"])

    def gather(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wanted, rows = state.get if state.exists else (None, [])
        complete = False
        if not state.hasTimedOut:
            rows = list(rows)
            for frame in frames:
                rows += frame["row"].tolist()
                wanted = max((int(n) for n in (wanted, frame["wanted"].max()) if not pd.isna(n)), default=None)
            complete = wanted is not None and len(rows) >= wanted
            if not complete:
                state.update((wanted, rows))
                state.setTimeoutDuration(wait_ms)
                return
        if state.exists:
            state.remove()
        yield pd.DataFrame({"row": rows, "complete": complete})

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [pickle.loads(r) for r in batch.column("row").to_pylist()]
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("complete")], [*names, "complete"])

    # timers go off in batches that have data: a job that runs to the end of its input would else go on for as long as any timer is set
    keyed = with_rocksdb(stream, False).mapInArrow(packed, StructType([StructField("key", stream.schema[key].dataType), StructField("wanted", LongType()), StructField("row", BinaryType())])).groupBy("key")
    held = keyed.applyInPandasWithState(gather, "row binary, complete boolean", "wanted long, rows array<binary>", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return held.mapInArrow(unpacked, StructType([*stream.schema.fields, StructField("complete", BooleanType())]))


def gathered_fingerprint_stream(points: DataFrame, path: str, checkpoint: str, wait_ms: int = 7 * 24 * 3600 * 1000) -> StreamingQuery:
    """Pharmacophore fingerprints of molecules whose points arrive in parts, over any number of batches; ``n_points`` says how many a molecule has.

    Molecules that stay incomplete get no fingerprint.
    """
    whole = gathered(points, "mol_id", "n_points", wait_ms).filter("complete").drop("complete", "n_points")
    return append_each(whole, ph4_histogram_fp, path, checkpoint)


def fingerprint_stream(points: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Pharmacophore fingerprints of molecules as their points arrive; a molecule's points arrive together (``gathered_fingerprint_stream`` needs not)."""
    return append_each(points, ph4_histogram_fp, path, checkpoint)


def matrix_stream(matches: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Partial flags of arriving template matches; ``merged_matrix`` ORs them."""
    return append_each(matches, reaction_matrix, path, checkpoint)


def merged_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The reaction matrix over all batches so far."""
    return spark.read.parquet(path).groupBy("reactant_id", "rxn_id").agg(F.bit_or("flag").alias("flag"))


def distinct_stream(stream: DataFrame, key: str, path: str, checkpoint: str, time: str | None = None, within: str = "7 days") -> StreamingQuery:
    """First arrivals of each key. The state holds digests, in RocksDB, and grows with the number of keys.

    With a ``time`` column the state is bounded: a key is remembered for ``within`` after the watermark of its first arrival, and what comes later than
    that is not compared with it.
    """
    keyed = with_rocksdb(stream, True).withColumn("_digest", F.coalesce(F.md5(F.col(key)), F.lit("null")))
    once = keyed.withWatermark(time, within).dropDuplicatesWithinWatermark(["_digest"]) if time else keyed.dropDuplicates(["_digest"])
    return once.drop("_digest").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_results(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Results appended as targets complete."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
