"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bayes_ops.session import checkpoint_dir

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint (every executor and any
    restarted one can read it), but columnar, so later reads are pruned.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.spilled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``spill`` once their last reader is done."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.spilled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class Shared:
    """A broadcast object whose class may be unknown to the workers."""

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        return pickle.loads(self._sent.value)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def plain_spaces(text: Column) -> Column:
    """The text (null: empty) with tab, \\v, \\f and \\r as spaces; line ends stay."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\v\f\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column (null: no words).

    Split at single blanks, which needs no regular expression."""
    return F.array_remove(F.split(F.replace(plain_spaces(text), F.lit("\n"), F.lit(" ")), " "), "")


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8 bytes."""
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def crc_mod(doc_id: Column, k: int) -> Column:
    """crc32(doc_id as text) mod k; null for a null id."""
    return F.crc32(doc_id.cast("string")) % k
