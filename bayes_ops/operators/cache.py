"""Order-free data fingerprint and the posterior result cache (ops K1-K4).

The fingerprint of a table is (row count, xor and decimal sum of a 64-bit
row hash): all three are algebraic aggregates computed map-side, independent
of row order and partitioning, and the sum keeps duplicated rows visible
(xor alone would cancel them).  The cache key hashes that fingerprint with
the model name and its parameters.

The cache itself is an append-only Parquet table of records (experiment,
model, cache_key, created_at, result rows as JSON, op): clearing appends a
tombstone instead of rewriting files, so it works on any storage Spark
writes to and never loses data on a failed job; a failed fit writes nothing.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE_SCHEMA = T.StructType([
    T.StructField("experiment", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("cache_key", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("result_json", T.StringType(), False),
    T.StructField("op", T.StringType(), False),  # "result" or "clear"
])


def _as_text(df: DataFrame, name: str) -> Column:
    """``name:length:value;`` of a column (``name:-;`` for NULL); timestamps as microseconds."""
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    text = (F.unix_micros(value) if isinstance(kind, T.TimestampType) else value).cast("string")
    seen = F.concat(F.length(text).cast("string"), F.lit(":"), text)
    return F.concat(F.lit(f"{name}:"), F.coalesce(seen, F.lit("-")), F.lit(";"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: n_rows, hash_xor, hash_sum, fingerprint (op K1).

    A row's hash is 60 bits of the md5 of its columns as text.  Each column
    enters with its name, and NULL apart from any value, so equal values in
    other columns, or a NULL in another place, give another fingerprint."""
    row = F.md5(F.concat(F.lit(""), *[_as_text(df, c) for c in sorted(df.columns)]))
    h = F.conv(F.substring(row, 1, 15), 16, 10).cast("long")
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.bit_xor(h).alias("hash_xor"),
                 F.sum(h.cast("decimal(38,0)")).alias("hash_sum"))
    return agg.withColumn("fingerprint", F.sha2(F.concat_ws(
        "|", F.col("n_rows").cast("string"), F.coalesce(F.col("hash_xor"), F.lit(0)).cast("string"),
        F.coalesce(F.col("hash_sum"), F.lit(0)).cast("string")), 256))


def cache_key(df: DataFrame, model: str, params: dict | None = None) -> str:
    fp = fingerprint(df).first()["fingerprint"]
    blob = json.dumps({"fp": fp, "model": model, "params": params or {}}, sort_keys=True, default=str)
    import hashlib
    return hashlib.sha256(blob.encode()).hexdigest()


def _read_cache(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, CACHE_SCHEMA)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Parquet table at ``path``, or an empty frame when nothing is there yet (any other fault is raised)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _visible(spark: SparkSession, path: str) -> DataFrame:
    """Results newer than the experiment's latest tombstone."""
    cur = _read_cache(spark, path)
    cleared = (cur.where(F.col("op") == "clear").groupBy("experiment")
               .agg(F.max("created_at").alias("cleared_at")))
    res = cur.where(F.col("op") == "result").join(cleared, "experiment", "left")
    return res.where(F.col("cleared_at").isNull() | (F.col("created_at") > F.col("cleared_at"))).drop("cleared_at")


def _now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def get_or_compute(spark: SparkSession, cache_path: str, experiment: str, model: str,
                   df: DataFrame, fit: Callable[[DataFrame], DataFrame],
                   params: dict | None = None) -> tuple[DataFrame, bool]:
    """Cached posterior summary for (data, model, params), else fit and store (K2).

    Returns (result, hit).  The result is written as Parquet beside the cache
    table and the record holds its folder and schema, so a hit has the miss's
    names, order, types and rows and nothing passes through the driver; the
    fit runs only on a miss and a failing fit leaves no record.
    """
    key = cache_key(df, model, params)
    hit = (_visible(spark, cache_path)
           .where((F.col("experiment") == experiment) & (F.col("model") == model)
                  & (F.col("cache_key") == key)).limit(1).collect())
    if hit:
        return _stored(spark, hit[0]["result_json"]), True
    folder = f"{cache_path.rstrip('/')}_results/{key}-{uuid.uuid4().hex}"
    result = fit(df)
    result.write.parquet(folder)
    told = json.dumps({"folder": folder, "schema": result.schema.json()})
    rec = spark.createDataFrame([(experiment, model, key, _now(), told, "result")], CACHE_SCHEMA)
    rec.write.mode("append").parquet(cache_path)
    return _stored(spark, told), False


def _stored(spark: SparkSession, told: str) -> DataFrame:
    at = json.loads(told)
    return spark.read.schema(T.StructType.fromJson(json.loads(at["schema"]))).parquet(at["folder"])


def list_cached(spark: SparkSession, cache_path: str, experiment: str) -> DataFrame:
    """Cached results of exactly this experiment (K3; exact name, quirk Q3)."""
    return (_visible(spark, cache_path).where(F.col("experiment") == experiment)
            .select("experiment", "model", "cache_key", "created_at"))


def clear_cached(spark: SparkSession, cache_path: str, experiment: str) -> int:
    """Hide the experiment's cached results; returns how many (K4)."""
    n = list_cached(spark, cache_path, experiment).count()
    if n:
        spark.createDataFrame([(experiment, "*", "*", _now(), "[]", "clear")], CACHE_SCHEMA) \
            .write.mode("append").parquet(cache_path)
    return n
