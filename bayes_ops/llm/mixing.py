"""Mixing sources to target weights by hash-threshold histograms.

Sources (by code point, null last) have weights 5, 2, 1, repeating, and share
a budget (all sizes; a size is a number of words) by weight.  A target stops at ``MAX_REPEAT`` times its source's
size; the excess is shared again by weight until none is above.  A source is
taken whole as often as its target holds it, and the rest of the target is
the documents whose hash lies below a threshold.  The threshold is found
without sorting: sizes are summed by (source, leading 12 bits of the hash),
the bucket in which the budget ends is refined by the next 12 bits, alone,
and so on.  Budgets are nested: a larger one takes a superset.

A document's key is 36 bits of md5(doc_id), so reruns and SQL agree, then 12 bits of its text's
hash and 24 bits of its row's.  The last 36 bits matter only for documents that share
the first, such as rows that repeat an id or have none: these are split at the threshold like any
others, however many they are.  The document at the threshold is taken if that
brings the source nearer to its target.

Defined results: a null text has size 0 and nothing is taken of it; sources of
size 0 have target 0; a null doc_id hashes as the empty string; of equal rows without an id some
may be taken and some not (which, is of no consequence: the result is the same multiset).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bayes_ops.llm.common import fresh, spill, words

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BITS = 12                # of the key, per level
LEVELS = 3               # of each half of the key: that of the id, that of text and row
HALF = BITS * LEVELS


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size -> target.  One row per source; the windows run over sources, not documents."""
    cycle = F.array(*[F.lit(w) for w in weights])
    nth = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source")))
    s = sources.withColumn("weight", F.get(cycle, (nth - 1) % len(weights)))
    s = s.withColumn("cap", F.col("source_size") * max_repeat)
    # sources in the order in which their caps bind; the first that does not bind gives the share per weight
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    s = s.withColumn("share", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                     / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("place", F.row_number().over(order))
    free = F.when(F.col("cap") >= F.col("share") * F.col("weight"), F.col("place"))
    s = s.withColumn("share", F.min_by("share", free).over(everything))
    return s.select("source", "source_size",
                    F.least(F.col("cap").cast("double"), F.col("share") * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """source -> copies (whole passes), below, below_tie: documents whose key (h, tie) lies below are taken once more.

    rows: source, size, h, tie (36 bits each); budget: source, source_size, target."""
    b = budget.filter("source_size > 0").select(
        "source", F.floor(F.col("target") / F.col("source_size")).cast("long").alias("copies"),
        (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).alias("left"),
        F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("below_tie"))
    done = b
    for step in range(1, 2 * LEVELS + 1):
        key, found = ("h", "below") if step <= LEVELS else ("tie", "below_tie")
        level = (step - 1) % LEVELS + 1
        near = rows.alias("r").join(done.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        if step > LEVELS:  # the boundary bucket alone
            near = near.filter(F.col("r.h") == F.col("t.below"))
        if level > 1:
            near = near.filter(F.shiftright(f"r.{key}", HALF - BITS * (level - 1)) == F.col(f"t.{found}"))
        prefix = F.shiftright(f"r.{key}", HALF - BITS * level)
        hist = near.groupBy(F.col("t.source").alias("source"), prefix.alias("bucket")).agg(F.sum("r.size").alias("n"))
        run = W.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("n").over(run))
        h = hist.alias("h").join(done.alias("t"), F.col("h.source").eqNullSafe(F.col("t.source")))
        fits = F.col("h.upto") <= F.col("t.left")
        cut = h.groupBy(F.col("t.source").alias("source")).agg(
            F.max(F.when(fits, F.col("h.upto"))).alias("used"),
            F.min(F.when(~fits, F.col("h.bucket"))).alias("edge"),
            F.min_by("h.n", F.when(~fits, F.col("h.bucket"))).alias("edge_n"))
        edge = F.coalesce("c.edge", (F.col(f"t.{found}") + 1) * (1 << BITS) if level > 1 else F.lit(1 << BITS)).cast("long")
        if step == 2 * LEVELS:
            # the last bucket is a document or so: taken if that comes nearer to the target
            edge = edge + F.when(F.col("c.edge_n") < 2 * (F.col("t.left") - F.coalesce("c.used", F.lit(0))), 1).otherwise(0)
        other = "below_tie" if found == "below" else "below"
        done = spill(done.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select(
            "t.source", "t.copies", (F.col("t.left") - F.coalesce("c.used", F.lit(0))).alias("left"),
            edge.alias(found), f"t.{other}"), "budget")
    return done.select("source", "copies", "below", "below_tie")


def _key(row: str) -> tuple[Column, Column]:
    """The key (h, tie) of a document whose number is column ``row``."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, HALF // 4), 16, 10).cast("long")
    tie = F.shiftleft(F.pmod(F.xxhash64("text"), F.lit(1 << BITS)), HALF - BITS).bitwiseOR(
        F.pmod(F.xxhash64(row), F.lit(1 << (HALF - BITS))))
    return h, tie


def sized(docs: DataFrame, row: str) -> DataFrame:
    """doc_id, source, size and the key (h, tie) of every document."""
    h, tie = _key(row)
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), h.alias("h"), tie.alias("tie"))


def _plan(rows: DataFrame) -> DataFrame:
    """s (source), source_size, target, copies, below, below_tie: one row per source."""
    budget = spill(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    t = thresholds(rows, budget)
    plan = budget.alias("b").join(t.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")), "left").select(
        F.col("b.source").alias("s"), "b.source_size", "b.target", "t.copies", "t.below", "t.below_tie")
    return spill(plan, "plan")


def _copies(h: Column, tie: Column, at: str = "") -> Column:
    """How often the mix takes a document; ``at``: prefix of the plan's columns."""
    below, copies = F.col(f"{at}below"), F.col(f"{at}copies")
    more = ((h < below) | ((h == below) & (tie < F.col(f"{at}below_tie")))).cast("long")
    return F.least(F.lit(MAX_REPEAT), F.coalesce(copies + more, F.lit(0).cast("long")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    numbered = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row"))
    rows = spill(sized(numbered, "row"), "sizes")
    plan = _plan(rows)
    return rows.join(plan, rows["source"].eqNullSafe(plan["s"])).select(
        "doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"),
        (F.col("size") * _copies(F.col("h"), F.col("tie"))).alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: those of no copies go, repeats are rows.

    Only the plan, a row per source, is joined to the texts; they are not shuffled."""
    row, at, copies = fresh(docs, "_row"), fresh(docs, "_plan"), fresh(docs, "_copies")
    # numbered once: the numbers must be the same where the texts are read again
    numbered = spill(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = spill(sized(numbered, row), "sizes")
    plan = _plan(rows)
    plan = plan.select(F.struct(*plan.columns).alias(at))
    return (numbered.join(plan, numbered["source"].eqNullSafe(plan[f"{at}.s"]))
            .withColumn(copies, F.explode(F.array_repeat(F.lit(1), _copies(*_key(row), f"{at}.").cast("int")))).select(*docs.columns))
