"""Filter interaction audit by incremental retraction streaming.

Five filters judge whole texts (null: empty; words ``[^\\x20\\x09-\\x0D]+``):
A under 200 words; B 100 * distinct words < 50 * words; C 100 * [A-Z] > 2 * code points;
D any of ``#$%&*|``; E a smaller doc_id has an identical text.  A document's
failures are a mask of five bits; every figure of the audit, for all 120 orders of the filters, follows from
the number of documents by (part, mask, label), the counters.

1. A stream reads all files in available-now micro-batches.  A task gives each text its bits A to D
   and two 64-bit hashes, labels are joined by doc_id, and a second pass in the task keeps
   of each text the rows with the least id: the others fail E whatever else comes and go on as counts, so a
   text that a third of the corpus repeats is one row per task.
2. Keyed state holds, for every text, its least id so far and the rows that have it.
   A micro-batch that brings a smaller id retracts those rows' earlier mask from their parts' counters and
   counts them again with E; equal ids fail nothing.  Texts share a state entry by hash, about
   ``TEXTS`` of them, so one call serves many texts.
3. Each micro-batch writes its changes of the counters to a folder of its own (a replayed one overwrites it);
   their sum is exact whatever the order in which files come.

State and counters lie under ``spark.checkpoint.dir``.  On a large cluster the
RocksDB state store (``spark.sql.streaming.stateStore.providerClass``) keeps the state, a row of some 40
bytes per text, off the heap.

Defined results: null sources are part ''; a null doc_id is smaller than none and none is smaller
than it, so such a row passes E and fails nobody; rows with one id and one text do not fail each other;
a document with several label rows is good (toxic) if any says so; other columns are not read; a
table without rows has no parts.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayes_ops.llm.common import spill
from bayes_ops.llm.wordhash import chunks, words
from bayes_ops.session import scratch_path
from bayes_ops.sources.tables import is_folder

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
BATCHES = 4              # micro-batches that the registered query takes for its files
TEXTS = 256              # texts of a state entry, about
WINDOW = 1 << 18         # rows that a task holds at once
_KEEP = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("mask", pa.int32()), ("least", pa.int64()), ("part", pa.string()),
                   ("good", pa.bool_()), ("toxic", pa.bool_()), ("n", pa.int64())])
_COUNTER = ["part", "mask", "good", "toxic"]

_SPECIAL = np.zeros(256, bool)
_SPECIAL[list(b"#$%&*|")] = True


def masks(texts: pa.Array) -> np.ndarray:
    """Bits of the filters A to D of every text."""
    out = []
    for i, j, data, offsets in chunks(texts):
        word, own = words(data, offsets, lower=False)
        n = np.bincount(own, minlength=j - i)
        order = np.lexsort((word, own))
        word, own = word[order], own[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (own[1:] != own[:-1])
        distinct = np.bincount(own[new], minlength=j - i)

        def total(which: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(which)])[offsets])

        capitals, points = total((data >= 65) & (data <= 90)), total((data & 0xC0) != 0x80)
        fails = (n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * points, total(_SPECIAL[data]) > 0)
        out.append(sum(f.astype(np.int32) << k for k, f in enumerate(fails)))
    return np.concatenate([*out, np.zeros(0, np.int32)]).astype(np.int32)


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, k1, k2, mask (A to D) of every row."""
    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(masks(b.column(4)))],
                                             names=["doc_id", "part", "k1", "k2", "mask"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"),
                       F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), text.alias("text"))
    return rows.mapInArrow(make, "doc_id bigint, part string, k1 bigint, k2 bigint, mask int")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with good and toxic; rows without an id meet no label and are spread over the tasks."""
    each = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    each = spill(each, "labels").withColumn("salt", F.lit(0).cast("long"))
    keyed = rows.withColumn("id", F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn(
        "salt", F.when(F.col("doc_id").isNull(), F.pmod("k1", F.lit(1 << 20).cast("long")) + 1).otherwise(F.lit(0).cast("long")))
    no = F.lit(False)
    return keyed.join(each, ["id", "salt"], "left").select(
        "k1", "k2", "mask", "doc_id", "part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def _least_first(rows: DataFrame, buckets: int, window: int) -> DataFrame:
    """bucket, k1, k2, mask, least, part, good, toxic, n: of each text of a window the rows with its least id;
    all others as counts (``least`` null), failing E unless they have no id."""
    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        p = pa.Table.from_batches(parts).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        least = p.groupby(["k1", "k2"], sort=False)["doc_id"].transform("min")
        first = (p["doc_id"] == least).fillna(False).astype(bool)
        ahead = p[first].groupby(["k1", "k2", "doc_id", *_COUNTER], sort=False).size().reset_index(name="n")
        rest = p[~first].copy()
        rest["mask"] = rest["mask"].where(rest["doc_id"].isna(), rest["mask"] | DUPLICATE)
        rest = rest.groupby(_COUNTER, sort=False).size().reset_index(name="n")
        rest[["k1", "k2"]] = int(p["k1"].iat[0]), int(p["k2"].iat[0])     # any text: they only pass through
        rest["doc_id"] = pd.array([pd.NA] * len(rest), dtype="Int64")
        out = pd.concat([x for x in (ahead, rest) if len(x)]).rename(columns={"doc_id": "least"})
        out["bucket"] = (out["k1"].astype("int64") % buckets)
        return pa.RecordBatch.from_pandas(out[["bucket", *_KEEP.names]], schema=pa.schema([("bucket", pa.int64()), *_KEEP]),
                                          preserve_index=False)

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in it:
            if batch.num_rows:
                held, n = [*held, batch], n + batch.num_rows
            if n >= window:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return rows.mapInArrow(make, "bucket bigint, k1 bigint, k2 bigint, mask int, least bigint, part string, "
                                 "good boolean, toxic boolean, n bigint")


def _retract(key, frames, state):
    """Update the texts of a state entry; yields changes of the counters."""
    new = pd.concat(list(frames), ignore_index=True)[_KEEP.names]
    passing = new["least"].isna()
    changes = [new[passing][[*_COUNTER, "n"]]]
    new = new[~passing].astype({"least": "int64"})
    new["old"] = False
    if state.exists:
        old = pa.ipc.read_record_batch(pa.py_buffer(state.get[0]), _KEEP).to_pandas()
        old["old"] = True
        new = pd.concat([old, new], ignore_index=True)
    if len(new):
        first = new["least"] == new.groupby(["k1", "k2"], sort=False)["least"].transform("min")
        gone = new[~first & new["old"]][[*_COUNTER, "n"]]
        changes.append(gone.assign(n=-gone["n"]))
        late = new[~first][[*_COUNTER, "n"]]
        changes += [late.assign(mask=late["mask"] | DUPLICATE), new[first & ~new["old"]][[*_COUNTER, "n"]]]
        keep = new[first].groupby([c for c in _KEEP.names if c != "n"], sort=False)["n"].sum().reset_index()
        state.update((pa.RecordBatch.from_pandas(keep[_KEEP.names], schema=_KEEP, preserve_index=False).serialize().to_pybytes(),))
    out = pd.concat(changes, ignore_index=True).groupby(_COUNTER, sort=False)["n"].sum().reset_index()
    yield out[out["n"] != 0]


def _stream(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    """The table's files as a stream (a folder of files, or one file)."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    if is_folder(spark, path):
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def counters(spark: SparkSession, path: str, labels: DataFrame, files_per_batch: int | None = None,
             texts: int = TEXTS, window: int = WINDOW) -> DataFrame:
    """part, mask, good, toxic, n: documents of the table at ``path`` by failed filters and label."""
    table = spark.read.parquet(path)
    if files_per_batch is None:
        files_per_batch = -(-len(table.inputFiles()) // BATCHES)
    buckets = max(1, table.count() // texts)
    base = scratch_path(spark, f"llm/audit-{uuid.uuid4().hex}")

    def write(changes: DataFrame, batch: int) -> None:
        changes.groupBy(*_COUNTER).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{base}/counters/batch={batch}")

    rows = _least_first(_labelled(_judged(_stream(spark, path, max(1, files_per_batch))), labels), buckets, window)
    shape = "part string, mask int, good boolean, toxic boolean, n bigint"
    changes = rows.groupBy("bucket").applyInPandasWithState(_retract, shape, "entries binary", "update", "NoTimeout")
    run = (changes.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state")
           .trigger(availableNow=True).foreachBatch(write).start())
    run.awaitTermination()
    spark.createDataFrame([], shape).write.mode("overwrite").parquet(f"{base}/counters/batch=-1")   # a table without rows
    got = spark.read.schema(shape).parquet(f"{base}/counters")
    return got.groupBy(*_COUNTER).agg(F.sum("n").alias("n")).filter("n <> 0")


def steps() -> list[dict]:
    """All orders of the filters and their steps: earlier filters' bits ``b``, the step's bit ``f``."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        for k, f in enumerate(order):
            out.append({"o": "".join(FILTERS[x] for x in order), "s": k + 1, "b": sum(1 << x for x in order[:k]), "f": 1 << f})
    return out


def report(counted: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, from the counters."""
    full = 1 << len(FILTERS)

    def by_mask(which):
        return F.array(*[F.coalesce(F.sum(F.when((F.col("mask") == m) & which, F.col("n"))), F.lit(0)) for m in range(full)])

    parts = counted.groupBy("part").agg(by_mask(F.lit(True)).alias("every"), by_mask(F.col("good")).alias("good"),
                                        by_mask(F.col("toxic")).alias("toxic"))
    at = F.from_json(F.lit(json.dumps(steps())), "array<struct<o:string,s:int,b:int,f:int>>")
    rows = parts.withColumn("at", F.explode(at)).select("*", "at.*")
    b, f = F.col("b"), F.col("f")

    def total(column: str, holds, times=lambda m: F.lit(1)):
        return F.aggregate(F.sequence(F.lit(0), F.lit(full - 1)), F.lit(0).cast("long"), lambda a, m: a + F.when(
            holds(m), F.get(F.col(column), m) * times(m)).otherwise(F.lit(0)))

    fails, passed = lambda m: m.bitwiseAND(f) != 0, lambda m: m.bitwiseAND(b) == 0
    here = lambda m: fails(m) & passed(m)
    # of the 120 orders, a filter comes first among a document's k failed ones in 120 / k
    orders = F.array(*[F.lit(120 // max(1, k)).cast("long") for k in range(len(FILTERS) + 1)])
    return rows.select(
        "part", F.col("o").alias("filter_order"), F.col("s").alias("step"),
        total("every", lambda m: m.bitwiseAND(b.bitwiseOR(f)) == 0).alias("kept"), total("every", here).alias("removed"),
        total("every", lambda m: fails(m) & ~passed(m)).alias("redundant"),
        total("every", lambda m: m == f).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        total("every", fails, lambda m: F.get(orders, F.bit_count(m))).alias("shapley"))


def audit(spark: SparkSession, path: str, labels: DataFrame, **kw) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return report(counters(spark, path, labels, **kw))
