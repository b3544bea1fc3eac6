"""Line dedup by an exact set-similarity join.

A line is the set of its words; lines whose Jaccard similarity is
``SIMILARITY`` (4/5) or more match, and a line that matches an earlier one (by
doc_id, then row, then line number) is removed, as is a line with an equal word set.

1. Rarity: words are counted in a hashed histogram of 2^19 cells over all
   lines (a fixed size).  A word is one long: the logarithm of its cell's count
   (3 steps an octave), then 56 bits of its hash.  That is one order for all
   lines, rare words first, and what words are compared by.
2. Equal sets are merged map-side, so a line repeated over a third of the
   corpus is one set, known by its first place.
3. Prefix filter: a set of n words is listed under its n - ceil(4n/5) + 1
   rarest words; matching sets share one of them.
4. Pairs that meet under a word must pass the length filter (5 min >= 4 max),
   the positional filter (words left after the meeting point can still give
   9 * overlap >= 4 * (n + m)), and a bitmap filter: bit k of a set's bitmap is the
   parity of its words of hash k, so bitmaps differ in at most as many bits as the
   sets do in words, and do not fill up.
5. The words of the sets in what passes are read again from the texts, only
   those of lines whose hash is asked for, and bitmaps of 256 bits made of them,
   which pairs are held against before any words are joined to them.
6. A line is removed if any earlier one matches.  So of a set's earlier ones the
   one of the nearest bitmap is verified first, and then all others of the sets
   which that has not settled.  Verified is the Jaccard of the full word sets, in
   integers.

A set is known by 96 bits of hash.

Defined results: blank lines are neither counted nor removed; null and empty
texts have no lines; null doc_ids come first, each row of them a document of
its own, in order of the rows; rows that repeat a doc_id with unlike texts are
documents of their own, in order of their texts' hashes; rows that repeat both
doc_id and text are one document (one result row, equal lines of theirs do not
remove each other).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayes_ops.llm.common import discard, fresh, let, plain_spaces, spill

CELLS = 1 << 19
MARKS = 1 << 25          # most bits of the filter of lines read again
WIDE = (1 << 16) - 1     # sizes are kept up to here; a line this wide passes the filters unseen
HASH = 56                # bits of a word's hash below its rarity


def row_id() -> Column:
    """Tells rows of one doc_id apart: a number where there is no id, else the text's hash."""
    return F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("text"))


def split_lines(docs: DataFrame, keys: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """``keys``, line_no and text (``line``) of every line with a word; with ``every`` also of a first
    line without one, so no row is missing."""
    # the outer form: the plain one adds a filter on the array's size, for which arrays are made twice
    lines = docs.select(*keys, F.posexplode_outer(F.split(plain_spaces(F.col("text")), "\n")).alias("line_no", "line"))
    held = F.trim("line") != ""
    return lines.filter(held | (F.col("line_no") == 0) if every else held)


def word_set(line: Column, hist: Column | str, cells: int) -> Column:
    """The sorted distinct words of a line, as longs in the order of rarity."""
    hashes = F.array_remove(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))
    # never null, and so compiled to arrays of longs
    rare = lambda x: F.coalesce(F.get(hist, x.bitwiseAND(F.lit(cells - 1)).cast("int")), F.lit(0).cast("long"))
    return F.sort_array(F.array_distinct(F.transform(
        hashes, lambda x: rare(x).bitwiseOR(x.bitwiseAND(F.lit((1 << HASH) - 1))))))


def _set_id(t: Column) -> list[Column]:
    return [F.xxhash64(t).alias("set_a"), F.hash(t, F.lit(7)).alias("set_b")]


def _as_value(cells: DataFrame, n: int, name: str, shape=lambda v: v) -> Column:
    """``shape(v)`` of (cell, v), 0 for a cell not there, as one array of n, a scalar value of a plan."""
    none = cells.sparkSession.range(0, n, numPartitions=4).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("v"))
    every = cells.unionByName(none).groupBy("cell").agg(F.sum("v").alias("v"))
    packed = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "v"))), lambda x: shape(x["v"])).alias("h"))
    return spill(packed, name).scalar()


def rarity(docs: DataFrame, cells: int = CELLS) -> Column:
    """The logarithm of the word count over all texts, by cell of the word's hash, above ``HASH`` bits."""
    text = F.replace(plain_spaces(F.col("text")), F.lit("\n"), F.lit(" "))
    ws = docs.select(F.explode_outer(F.split(text, " ")).alias("w")).filter("w <> ''")
    counts = ws.groupBy(F.xxhash64("w").bitwiseAND(F.lit(cells - 1)).alias("cell")).agg(F.count("*").alias("v"))
    # up to 127: 4e12 words in a cell
    steps = lambda v: F.least(F.floor(3 * F.log2(F.greatest(v, F.lit(1)))), F.lit(127)).cast("long")
    return _as_value(counts, cells, "cells", lambda v: F.shiftleft(steps(v), HASH))


def wide_parities(t: Column) -> Column:
    """256 parities of a set's words, as 4 longs."""
    def odd(q: int) -> Column:
        mine = F.filter(t, lambda x: F.shiftrightunsigned(x, HASH - 2).bitwiseAND(F.lit(3)) == q)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function(
            "shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(x, HASH - 8).bitwiseAND(F.lit(63)).cast("int"))))
    return F.struct(*(odd(q).alias(f"s{q}") for q in range(4)))


def line_sets(docs: DataFrame, hist: Column, cells: int = CELLS) -> DataFrame:
    """doc_id, row, line_no, line_hash, set_a, set_b (the set's id), n (its size), sig (64 parities), and the
    prefix: the rarest words' hashes, 31 bits each, rarest first.  Every row of ``docs`` (doc_id, row,
    text) has its first line here, of size 0 where that is blank."""
    # the histogram is one value of the plan (a scalar subquery), never a column of rows
    lines = split_lines(docs, ("doc_id", "row"), every=True).withColumn("hist", hist)

    def parts(t: Column) -> Column:
        # the array is bound once; as a column it would be made again for every use.  A shift takes 6 bits
        odd = F.aggregate(t, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(x, HASH - 6).cast("int"))))
        size = F.size(t)
        prefix = F.slice(t, F.lit(1), size - F.floor((size * 4 + 4) / 5).cast("int") + 1)
        return F.struct(*_set_id(t), size.alias("n"), odd.alias("sig"),
                        F.transform(prefix, lambda k: k.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("prefix"))

    at = ["doc_id", "row", "line_no"]
    return lines.select(*at, F.xxhash64("line").alias("line_hash"),
                        let(word_set(F.col("line"), "hist", cells), parts).alias("s")).select(*at, "line_hash", "s.*")


def distinct_sets(sets: DataFrame) -> DataFrame:
    """Every distinct set with its first place, and the hash of the line there."""
    kept = F.min(F.struct("doc_id", "row", "line_no", "line_hash", "n", "sig", "prefix")).alias("f")
    return sets.groupBy("set_a", "set_b").agg(kept).select(
        "set_a", "set_b", F.struct("f.doc_id", "f.row", "f.line_no").alias("first"), "f.line_hash", "f.n", "f.sig", "f.prefix")


def index(firsts: DataFrame) -> DataFrame:
    """key (prefix word, size, position), set_a, sig: one row per distinct set and prefix word."""
    rows = firsts.select("set_a", "sig", "n", F.posexplode_outer("prefix").alias("pos", "p"))
    packed = F.shiftleft(F.col("p").cast("long"), 32)
    for c, left in (("n", 16), ("pos", 0)):
        packed = packed.bitwiseOR(F.shiftleft(F.least(F.col(c), F.lit(WIDE)).cast("long"), left))
    return rows.select(packed.alias("key"), "set_a", "sig")


def candidates(idx: DataFrame) -> DataFrame:
    """Distinct pairs of set ids (a, b) that pass the filters, the smaller first."""
    x, y = idx.alias("x"), idx.alias("y")
    n, m = (f"(shiftright({t}.key, 16) & {WIDE})" for t in "xy")
    i, j = (f"({t}.key & {WIDE})" for t in "xy")
    ok = F.expr(f"""shiftright(x.key, 32) = shiftright(y.key, 32) and x.set_a < y.set_a
        and (greatest({n}, {m}) = {WIDE} or (
            5 * least({n}, {m}) >= 4 * greatest({n}, {m})
            and 9 * (1 + least({n} - {i} - 1, {m} - {j} - 1)) >= 4 * ({n} + {m})
            and 9 * bit_count(x.sig ^ y.sig) <= {n} + {m}))""")
    return x.join(y, ok).select(F.col("x.set_a").alias("a"), F.col("y.set_a").alias("b")).distinct()


def _marked(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test that every hash of ``hashes`` (column line_hash) passes, and few others."""
    bits = 1 << 16
    while bits < min(MARKS, 16 * hashes.count()):
        bits *= 2
    cell = lambda h: h.bitwiseAND(F.lit(bits - 1))
    bit = lambda h: h.bitwiseAND(F.lit(63)).cast("int")
    words = hashes.groupBy(F.shiftright(cell(F.col("line_hash")), 6).alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("line_hash")))).alias("v"))
    marks = _as_value(words, bits >> 6, "marks")
    return lambda h: F.call_function("shiftright", F.get(marks, F.shiftright(cell(h), 6).cast("int")), bit(h)).bitwiseAND(F.lit(1)) == 1


def close(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """late, late_b, early, early_b (the ids of a pair's later and earlier set) and far (unlike bits of their
    wide bitmaps) of the pairs that may match."""
    def side(c: str) -> DataFrame:
        return full.select(F.col("set_a").alias(c), F.struct("first", "set_a", "set_b", "n", "sig").alias("of_" + c))
    x, y = F.col("of_a"), F.col("of_b")
    far = reduce(add, (F.bit_count(x["sig"][f"s{q}"].bitwiseXOR(y["sig"][f"s{q}"])) for q in range(4)))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(far * 9 <= x["n"] + y["n"])
    swap = x["first"] > y["first"]
    late, early = F.when(swap, x).otherwise(y), F.when(swap, y).otherwise(x)
    return both.select(late["set_a"].alias("late"), late["set_b"].alias("late_b"),
                       early["set_a"].alias("early"), early["set_b"].alias("early_b"), far.alias("far"))


def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """set_a, set_b: the later sets of the pairs whose words match."""
    def side(c: str) -> DataFrame:
        return full.select(F.col("set_a").alias(c), F.col("set_b").alias(c + "_b"), F.col("toks").alias("of_" + c))
    both = pairs.join(side("late"), ["late", "late_b"]).join(side("early"), ["early", "early_b"])
    return both.filter(F.size(F.array_intersect("of_late", "of_early")) * 9 >= (F.size("of_late") + F.size("of_early")) * 4).select(
        F.col("late").alias("set_a"), F.col("late_b").alias("set_b")).distinct()


def matches(docs: DataFrame, firsts: DataFrame, hist: Column, cells: int = CELLS) -> DataFrame:
    """set_a, set_b: every set that matches an earlier one."""
    pairs = spill(candidates(index(firsts)), "pairs")
    ids = pairs.select(F.col("a").alias("set_a")).unionByName(pairs.select(F.col("b").alias("set_a"))).distinct()
    asked = spill(firsts.select("set_a", "set_b", "first", "line_hash").join(ids, "set_a", "left_semi"), "asked")
    some = split_lines(docs.select("text")).select("line", F.xxhash64("line").alias("line_hash"))
    # other lines skip the splitting into words and the shuffle
    some = some.filter(_marked(asked)(F.col("line_hash"))).withColumn("hist", hist)
    some = some.select("line_hash", word_set(F.col("line"), "hist", cells).alias("toks"))
    some = some.select("toks", "line_hash", *_set_id(F.col("toks")))
    full = spill(some.join(asked, ["set_a", "set_b", "line_hash"])
                 .groupBy("set_a", "set_b").agg(F.first("first").alias("first"), F.first("toks").alias("toks"))
                 .select("set_a", "set_b", "first", "toks", F.size("toks").alias("n"), wide_parities(F.col("toks")).alias("sig")), "full")
    near_pairs = spill(close(pairs, full), "close")
    best = near_pairs.groupBy("late", "late_b").agg(F.min(F.struct("far", "early", "early_b")).alias("m"))
    near = spill(verified(best.select("late", "late_b", "m.early", "m.early_b"), full), "near")
    open_ = near_pairs.join(near.select(F.col("set_a").alias("late"), F.col("set_b").alias("late_b")), ["late", "late_b"], "left_anti")
    more = spill(verified(open_.drop("far"), full), "more")
    discard(pairs, asked, full, near_pairs)
    return near.unionByName(more)


def _judge(docs: DataFrame, cells: int) -> DataFrame:
    """doc_id, row, n_lines, n_removed, removed_lines of every doc_id and row of ``docs``."""
    hist = rarity(docs, cells)
    every = spill(line_sets(docs, hist, cells), "lines")
    sets = every.filter("n > 0")
    firsts = spill(distinct_sets(sets), "firsts")
    near = matches(docs, firsts, hist, cells).withColumn("near", F.lit(True))
    place = F.struct("doc_id", "row", "line_no")
    judged = sets.select("doc_id", "row", "line_no", "set_a", "set_b").join(
        firsts.select("set_a", "set_b", "first"), ["set_a", "set_b"]).join(near, ["set_a", "set_b"], "left")
    judged = judged.select("doc_id", "row", F.lit(1).alias("n"), F.when(
        F.coalesce("near", place > F.col("first")), F.col("line_no")).alias("gone"))
    blank = every.filter("n = 0").select("doc_id", "row", F.lit(0).alias("n"), F.lit(None).cast("int").alias("gone"))
    return judged.unionByName(blank).groupBy("doc_id", "row").agg(
        F.sum("n").alias("n_lines"), F.count("gone").alias("n_removed"),
        F.sort_array(F.collect_set("gone")).alias("removed_lines"))


def dedup(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (sorted line numbers) of every document."""
    return _judge(docs.select("doc_id", "text", row_id().alias("row")), cells).drop("row")


def clean(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """The documents without their removed lines (the other lines as they were), all columns kept."""
    # numbered once: the numbers must be the same where the texts are read again
    at, key, of, gone = (fresh(docs, c) for c in ("_row", "_id", "_at", "_gone"))
    rows = spill(docs.withColumn(at, row_id()), "numbered")
    judged = _judge(rows.select("doc_id", "text", F.col(at).alias("row")), cells).select(
        F.col("doc_id").alias(key), F.col("row").alias(of), F.col("removed_lines").alias(gone))
    j = rows.join(judged, rows["doc_id"].eqNullSafe(judged[key]) & (rows[at] == judged[of]), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return j.withColumn("text", F.when(F.size(gone) > 0, kept).otherwise(F.col("text"))).select(*docs.columns)
