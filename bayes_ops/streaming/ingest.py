"""Streaming ingest of event files into an experiment table (ops T1, T4).

Files arriving in a folder are read as text columns, validated against the
kind schema (the same Column checks as batch ingest, W3) and written by the
Parquet file sink partitioned by ``status`` (ok / rejected).  The file sink
plus the checkpoint give exactly-once output across restarts and executor
loss; readers take ``status = 'ok'`` (a partition filter).

With an event key, a batch delivered twice lands once: every micro-batch is
compared with the accepted rows of earlier ones and written to a folder of
its own (a replayed batch overwrites that folder).  No row is too late: the
table itself is the memory, so there is neither streaming state nor a
watermark that drops rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from bayes_ops.operators.cache import read_or_empty
from bayes_ops.sources.ingest import validate
from bayes_ops.sources.schemas import kind_schema, table_schema


def text_schema(kind: str, extra: tuple[str, ...] = (), optional: bool = False) -> T.StructType:
    """All columns as text; ``optional`` adds the kind's optional columns (exposure)."""
    fields = table_schema(kind).fields if optional else kind_schema(kind).fields
    names = [f.name for f in fields] + list(extra)
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def event_stream(spark: SparkSession, source_dir: str, kind: str, fmt: str = "json",
                 key: str | None = None, max_files_per_trigger: int | None = None,
                 optional: bool = False) -> DataFrame:
    """Streaming frame of raw (text) event columns from ``source_dir``; ``optional``
    says that the files carry the kind's optional columns."""
    extra = (key,) if key else ()
    r = spark.readStream.schema(text_schema(kind, extra, optional))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        return r.option("header", True).csv(source_dir)
    return r.json(source_dir)


def validated(raw: DataFrame, kind: str, key: str | None = None) -> DataFrame:
    """Typed rows with ``status`` and ``reject_reason`` (batch or stream)."""
    v = validate(raw, kind, keep=(key,) if key else ())
    return v.withColumn("status", F.when(F.col("reject_reason").isNull(), F.lit("ok")).otherwise(F.lit("rejected")))


def new_rows(rows: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """``rows`` without accepted rows whose key came before (T4).

    Of rows with one key in a batch one is kept.  Earlier rows are looked up by
    the key alone, so a row however late, or delivered again with another event
    time, meets its duplicates.  Rows without a key, and rejected rows, are all
    kept.
    """
    keyed = rows.where((F.col("status") == "ok") & F.col(key).isNotNull()).dropDuplicates([key])
    known = accepted.where((F.col("status") == "ok") & F.col(key).isNotNull())
    keyed = keyed.join(known.select(key), key, "left_anti").select(*rows.columns)
    return keyed.unionByName(rows.where((F.col("status") != "ok") | F.col(key).isNull()))


def _keyed_writer(sink_dir: str, key: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        schema = T.StructType(batch.schema.fields + [T.StructField("batch", T.LongType())])
        accepted = read_or_empty(batch.sparkSession, sink_dir, schema).where(F.col("batch") < batch_id)
        out = new_rows(batch, accepted, key)
        out.write.mode("overwrite").partitionBy("status").parquet(f"{sink_dir}/batch={batch_id}")
    return write


def start_ingest(raw: DataFrame, kind: str, sink_dir: str, checkpoint: str, key: str | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Start the ingest query (T1); ``available_now`` processes what is there and stops."""
    w = validated(raw, kind, key).writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    if key is None:
        w = w.format("parquet").partitionBy("status")
    else:
        w = w.foreachBatch(_keyed_writer(sink_dir, key))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start() if key is not None else w.start(sink_dir)


def read_ingested(spark: SparkSession, sink_dir: str, kind: str) -> DataFrame:
    """Accepted rows of a streaming-ingested table, in the kind schema (with exposure where it was ingested)."""
    t = spark.read.parquet(sink_dir)
    return t.where(F.col("status") == "ok").select(*[f.name for f in table_schema(kind, t.columns).fields])
