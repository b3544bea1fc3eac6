"""Sharding by vector bin packing of bytes, tokens and rows.

Documents are dealt into shards in groups (equal texts).  A group stays
together unless no shard has room for it.  The items that are packed are hash
buckets of groups -- ``ITEMS`` per shard, a fixed number whatever the data --
and, taken out of their buckets, the heavy groups that by bytes, tokens or
rows are more than 1/ITEMS of a shard.  Items are placed largest first, each
where the dot product of its size vector with the shard's residual capacity is
highest, among the shards whose byte capacity still has room for it.  Heavy
groups are tried alone first; those that find no room (larger than a shard, or one of too
many large ones) are cut into pieces of 1/ITEMS of a shard, each an item.

The law that holds is ``bytes``: the shards' sizes are near equal.  Slots
number a shard's rows from 0 without gaps: rows are numbered within a bucket or a
piece (an uncut heavy group has pieces too, all in its shard), and these follow each other in a shard,
so no task numbers more than about 1/ITEMS of a shard.  Pieces are dealt by the row, so
rows that repeat an id or have none are spread like any others.

Defined results: a null text has 0 bytes, 0 tokens, crc32 0, and groups with
the empty text; rows that repeat doc_id and text hold slots of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from bayes_ops.llm.common import spill, words

SHARDS = 24
ITEMS = 256              # hash buckets per shard


def place(sizes: np.ndarray, shards: int, slack: float = 0.002) -> np.ndarray:
    """Shard of each item (rows of ``sizes`` are bytes, tokens, rows)."""
    total = sizes.sum(0)
    unit = sizes / np.where(total > 0, total / shards, 1.0)        # in shares of a shard
    residual = np.ones((shards, sizes.shape[1]))
    out = np.zeros(len(sizes), np.int64)
    for i in sorted(range(len(sizes)), key=lambda k: (-unit[k].max(), k)):
        gain = residual @ unit[i]
        fits = residual[:, 0] + slack >= unit[i, 0]
        at = int(np.argmax(np.where(fits, gain, -np.inf))) if fits.any() else int(np.argmax(residual[:, 0]))
        out[i] = at
        residual[at] -= unit[i]
    return out


def uncut(sizes: np.ndarray, total: np.ndarray, shards: int, slack: float = 0.002) -> np.ndarray:
    """Which heavy groups (rows of ``sizes``) find a shard with room for the whole of them, largest first."""
    unit = sizes / np.where(total > 0, total / shards, 1.0)
    residual = np.ones((shards, sizes.shape[1]))
    whole = np.zeros(len(sizes), bool)
    for i in sorted(range(len(sizes)), key=lambda k: (-unit[k].max(), k)):
        fits = residual[:, 0] + slack >= unit[i, 0]
        if fits.any():
            whole[i] = True
            residual[int(np.argmax(np.where(fits, residual @ unit[i], -np.inf)))] -= unit[i]
    return whole


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    h = F.xxhash64(text)
    return docs.select(
        "doc_id", h.alias("grp"), F.crc32(text).cast("long").alias("text_crc32"),
        F.octet_length(text).cast("long").alias("bytes"), F.size(words(F.col("text"))).cast("long").alias("tokens"))


def assign(docs: DataFrame, shards: int = SHARDS, items: int = ITEMS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    size = F.col("bytes") + 8
    buckets = shards * items
    rows = spill(_measured(docs).withColumns({"bucket": F.pmod("grp", F.lit(buckets)), "row": F.monotonically_increasing_id()}), "rows")
    sums = [F.sum(size).alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    by_bucket = rows.groupBy("bucket").agg(*sums).collect()                  # at most shards * items rows
    total = {k: sum(r[k] for r in by_bucket) for k in ("bytes", "tokens", "rows")}
    limit = {k: max(1.0, v / buckets) for k, v in total.items()}
    # a heavy group makes its bucket heavy; groups are summed in those buckets alone
    heavy_at = [r["bucket"] for r in by_bucket if any(r[k] > 2 * limit[k] for k in limit)]
    heavy = []
    if heavy_at:
        over = F.lit(False)
        for k in limit:
            over = over | (F.col(k) > 2 * limit[k])
        marks = spark.createDataFrame([(b,) for b in heavy_at], "bucket long")
        heavy = (rows.join(F.broadcast(marks), "bucket").groupBy("grp", "bucket").agg(*sums)
                 .filter(over & (F.col("rows") > 1)).collect())              # under 3/2 * shards * items groups
    pieces = {r["grp"]: int(np.ceil(max(r[k] / limit[k] for k in limit))) for r in heavy}
    cut = spark.createDataFrame([(g, n) for g, n in pieces.items()], "grp long, pieces int")
    dealt = (rows.join(F.broadcast(cut), "grp", "left")
             .withColumn("piece", F.when(F.col("pieces").isNull(), F.lit(-1).cast("long"))
                         .otherwise(F.pmod(F.xxhash64("row"), F.col("pieces"))))
             .withColumn("item", F.when(F.col("piece") < 0, F.col("bucket")).otherwise(F.col("grp"))))
    if heavy:
        found = dealt.groupBy("item", "piece").agg(*sums).collect()           # bounded like the tables above
    else:
        found = [{"item": r["bucket"], "piece": -1, **{k: r[k] for k in limit}} for r in by_bucket]
    found = sorted(found, key=lambda r: (r["item"], r["piece"]))
    vector = lambda r: [float(r[k]) for k in ("bytes", "tokens", "rows")]
    fits = uncut(np.array([vector(r) for r in heavy]).reshape(len(heavy), 3), np.array([float(total[k] or 0) for k in limit]), shards)
    whole = {r["grp"] for r, w in zip(heavy, fits) if w}
    parcels: list[list] = []                                    # pieces that go to one shard
    for r in found:
        if r["piece"] > 0 and r["item"] in whole and parcels and parcels[-1][0]["item"] == r["item"] and parcels[-1][0]["piece"] >= 0:
            parcels[-1].append(r)
        else:
            parcels.append([r])
    at = place(np.array([np.sum([vector(r) for r in p], 0) for p in parcels], float).reshape(len(parcels), 3), shards)
    filled = [0] * shards
    plan = []
    for p, s in zip(parcels, at.tolist()):
        for r in p:
            plan.append((r["item"], r["piece"], s, filled[s]))
            filled[s] += r["rows"]
    placed = spark.createDataFrame(plan, "item long, piece long, shard int, first long")
    within = W.partitionBy("item", "piece").orderBy("grp", "doc_id", "row")
    return (dealt.join(F.broadcast(placed), ["item", "piece"])
            .select("doc_id", size.alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("first") + F.row_number().over(within) - 1).alias("slot"),
                    F.lit(None).cast(T.IntegerType()).alias("grown_shard")))


