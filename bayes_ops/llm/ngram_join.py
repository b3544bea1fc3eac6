"""N-gram Jaccard join: blocked product of the document by n-gram incidence matrix.

A document is the set of its distinct word shingles (a sparse 0/1 row), an
n-gram is a column.  Two rows link when their Jaccard similarity is
``SIMILARITY`` (4/5) or more, that is 9 * overlap >= 4 * (n + m).  The product of
the matrix with its transpose is taken in blocks, and pairs whose overlap can
no longer reach that bound, which follows from the two sizes alone, are dropped:

1. Leading block.  Columns are ordered by hash; a row's first 3/10 (and one
   more) columns are multiplied.  Columns with more than ``HOT`` rows there are
   not counted.  The part of a row that is not counted bounds what it can share
   besides: a pair with count c goes on only if 9 * (c + uncounted) >= 4 * (n + m).
   A row with more than a fifth of its columns counted ("rich") shares a counted
   column with every row it links with, so no link is lost.
2. Rows with fewer ("poor": mostly boilerplate, or near copies of one
   text) are multiplied over all their columns.  Columns with more than
   ``HOT`` poor rows are not counted between two poor rows.
3. Two poor rows that share no counted column can link only through hot
   columns, by 9 * min(hot columns) >= 4 * (n + m).  The rows that can are grouped by
   common hot columns and multiplied in dense blocks of about ``BLOCK`` rows,
   each with the group's least row besides; blocks of one group meet only
   where they hold rows of different classes.
4. Pairs that stay are verified: overlap of the whole rows, in integers.

Equal sets are one row, told by 64 bits of hash (as n-grams are): two of n unlike sets
meet in one by chance with probability n^2 / 2^65.  Hot columns are thinned in the task that reads the
texts: beyond ``HOT`` + 1 rows of a column in one window of texts it is known to
be hot and sends no more.  Every row of the matrix has at most 2 ``HOT`` partners per
counted column, so the work grows in proportion to the texts; between the
classes of one dense group it grows with the product of their sizes.

Defined results: null, empty and blank texts have size 0, their own doc_id as
component_id, and no links; a component_id is the least id that is not null
(null where all are); rows that repeat an id are told apart by their texts;
shorter texts than a shingle are one n-gram; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bayes_ops.llm.common import Shared, discard, spill
from bayes_ops.llm.simhash import components
from bayes_ops.llm.wordhash import chunks, mix, shingles

SHINGLE = 5
HOT = 32                 # rows of a column from which it is not counted
WINDOW = 1 << 21         # n-grams that a task holds at once
BLOCK = 512              # rows of a dense block, about
BLOCK_ENTRIES = 1 << 19  # n-grams of a dense block, about
FILTER_BITS = 24         # a bitmap of 2^24 bits tells which rows or columns are asked for


# --- rows of the matrix, made in the tasks that read the texts ---------------

def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """(first, last, set id, sorted distinct n-grams) of runs of texts; an empty set has id 0."""
    for i, j, data, offsets in chunks(texts):
        found, at = shingles(data, offsets, size)
        rows = []
        for a, b in zip(at[:-1], at[1:]):
            x = np.sort(found[a:b])
            rows.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if b > a else x)
        n = np.array([len(r) for r in rows], np.int64)
        ids = np.zeros(j - i, np.uint64)
        if n.sum():
            sums = np.add.reduceat(mix(np.concatenate(rows)), (np.cumsum(n) - n)[n > 0])
            ids[n > 0] = mix(sums + n[n > 0].astype(np.uint64))
        yield i, j, ids, rows


def _list(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), values.view(np.int64))


def _ranks(x: np.ndarray) -> np.ndarray:
    """How many earlier entries equal each entry."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    start = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1]) if len(s) else np.zeros(0, np.int64)
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(s)) - np.repeat(start, np.diff(np.concatenate([start, [len(s)]])))
    return out


def leading_rows(docs: DataFrame, size: int, hot: int, window: int) -> DataFrame:
    """doc_id, n, sid, look (leading n-grams; of equal rows of one window, the first has them) and
    held (those withheld, as the window has more than ``hot`` + 1 rows with them)."""
    def flush(ids: list, n: np.ndarray, sid: np.ndarray, look: list) -> pa.RecordBatch:
        q = np.array([len(x) for x in look], np.int64)
        first = np.zeros(len(sid), bool)
        first[np.unique(sid, return_index=True)[1]] = True
        x = np.concatenate([*look, np.zeros(0, np.uint64)])
        own = np.repeat(np.arange(len(q)), q)
        x, own = x[first[own]], own[first[own]]
        sent = _ranks(x) <= hot
        lists = [_list(x[m], np.bincount(own[m], minlength=len(q))) for m in (sent, ~sent)]
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), pa.array(n), pa.array(sid.view(np.int64)), *lists],
            names=["doc_id", "n", "sid", "look", "held"])

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ns, sids, look, held = [], [], [], [], 0
        for batch in it:
            for i, j, sid, rows in _sets(batch.column(1), size):
                n = np.array([len(r) for r in rows], np.int64)
                q = np.minimum(n, n * 3 // 10 + 1)   # the leading block
                ids.append(batch.column(0).slice(i, j - i))
                ns.append(n)
                sids.append(sid)
                look += [r[:k].copy() for r, k in zip(rows, q)]
                held += int(q.sum())
                if held >= window:
                    yield flush(ids, np.concatenate(ns), np.concatenate(sids), look)
                    ids, ns, sids, look, held = [], [], [], [], 0
        if ids:
            yield flush(ids, np.concatenate(ns), np.concatenate(sids), look)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        make, f"doc_id {kind}, n bigint, sid bigint, look array<bigint>, held array<bigint>")


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """2^FILTER_BITS bits, those of the values of ``column`` set: a size that does not grow with the data."""
    bit = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int"))
    got = hashes.select(F.shiftright(bit, 5).alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    bits[got["w"].to_numpy()] = got["b"].to_numpy()
    return bits


def _set_in(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = (x.view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return ((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool)


def whole_rows(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """sid, toks (all n-grams) of the rows with a sid of ``ids``.

    A bitmap keeps most others out of the shuffle; the join is exact."""
    asked = Shared(docs.sparkSession, bitmap(ids, "sid"))

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = asked.get()
        for batch in it:
            for _, _, sid, rows in _sets(batch.column(0), size):
                first = np.zeros(len(sid), bool)
                first[np.unique(sid, return_index=True)[1]] = True
                take = np.flatnonzero(_set_in(bits, sid) & first & (sid != 0))
                if len(take):
                    picked = [rows[k] for k in take]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sid[take].view(np.int64)),
                         _list(np.concatenate(picked), np.array([len(r) for r in picked]))], names=["sid", "toks"])

    made = docs.select("text").mapInArrow(make, "sid bigint, toks array<bigint>")
    return made.join(ids.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.first("toks").alias("toks"))


def leading_in(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Distinct (h, sid) of leading n-grams that are an ``h`` of ``columns``."""
    asked = Shared(rows.sparkSession, bitmap(columns, "h"))

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = asked.get()
        for batch in it:
            look = batch.column(1)
            x = look.flatten().to_numpy()
            own = np.repeat(batch.column(0).to_numpy(), look.value_lengths().to_numpy())
            take = _set_in(bits, x)
            yield pa.RecordBatch.from_arrays([pa.array(x[take]), pa.array(own[take])], names=["h", "sid"])

    met = rows.select("sid", "look").mapInArrow(make, "h bigint, sid bigint")
    return met.repartition("h").distinct().join(columns.select("h"), "h", "left_semi")


# --- the product, block by block ----------------------------------------------

def product(rich: DataFrame, near: DataFrame, poor: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows, a < b, whose count over the counted columns can still reach the bound.

    Entries h, sid, n, u (uncounted part): ``rich`` among the leading columns, ``near`` those on columns of poor
    rows, ``poor`` over all columns (with ``hot``: not counted between poor rows).  Of two rich rows the one whose
    leading block ends first shares no more than the count and its own uncounted part, hence the greater one;
    a rich and a poor row no more than the rich one's; two poor rows no more than the lesser number of
    hot columns."""
    def meet(x: DataFrame, y: DataFrame, rest: str, one_sided: bool) -> DataFrame:
        order = "and x.sid < y.sid" if one_sided else ""
        on = F.expr(f"x.h = y.h and 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) {order}")
        return x.alias("x").join(y.alias("y"), on).select(
            F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"),
            F.expr(f"4 * (x.n + y.n) - 9 * {rest}").alias("need"))

    cold = poor.filter("not hot")
    met = meet(rich, rich, "greatest(x.u, y.u)", True).unionByName(meet(near, poor, "x.u", False)) \
        .unionByName(meet(cold, cold, "least(x.u, y.u)", True))
    counts = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("need").alias("need"))
    return counts.filter("9 * c >= need").select("a", "b")


def verified(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The pairs that link."""
    ids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))
    rows = spill(whole_rows(docs, ids, size), "asked")
    a = rows.select(F.col("sid").alias("a"), F.col("toks").alias("ta"))
    b = rows.select(F.col("sid").alias("b"), F.col("toks").alias("tb"))
    overlap = F.size(F.array_intersect("ta", "tb"))
    both = pairs.join(b, "b").join(a, "a").filter(overlap * 9 >= (F.size("ta") + F.size("tb")) * 4)
    out = spill(both.select("a", "b"), "verified")
    discard(rows)
    return out


def _cell_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning links of a dense block; between rows of one ``label`` none is looked for."""
    pdf = pdf.drop_duplicates("sid")
    sid, n = pdf["sid"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    toks = [np.asarray(t, np.int64) for t in pdf["toks"]]
    row = np.repeat(np.arange(len(toks)), [len(t) for t in toks])
    names, col = np.unique(np.concatenate(toks), return_inverse=True)
    shared = np.bincount(col, minlength=len(names)) > 1
    keep = shared[col]
    row, col = row[keep], (np.cumsum(shared) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    overlap = np.zeros((len(sid), len(sid)), np.float32)   # exact: counts stay below 2^24
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(col, [lo, lo + width])
        part = np.zeros((len(sid), width), np.float32)
        part[row[a:b], col[a:b] - lo] = 1
        overlap += part @ part.T
    link = 9 * overlap.astype(np.int64) >= 4 * (n[:, None] + n[None, :])
    if "label" in pdf:
        label = pdf["label"].to_numpy(np.int64)
        link &= label[:, None] != label[None, :]
    left, found = np.ones(len(sid), bool), []
    for i in range(len(sid)):
        stack = [i] if left[i] else []
        left[i] = False
        while stack:
            k = stack.pop()
            new = np.flatnonzero(link[k] & left)
            left[new] = False
            found += [(sid[k], sid[m]) for m in new]
            stack += list(new)
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def _cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    cols = [c for c in ("sid", "n", "toks", "label") if c in rows.columns]
    return rows.select(*keys, *cols).groupBy(*keys).applyInPandas(
        lambda pdf: _cell_links(pdf[cols]), "a bigint, b bigint")


def _blocks(count, entries, rows: int, most: int):
    return F.greatest(F.ceil(count / rows), F.ceil(entries / most), F.lit(1)).cast("long")


def dense_links(hot: DataFrame, known: DataFrame, rows: int = BLOCK, most: int = BLOCK_ENTRIES) -> DataFrame:
    """Links through hot columns alone between poor rows, spanning their classes with the links ``known``.

    ``hot``: sid, n, h, cp (poor rows of the column), a row per hot column of a poor row."""
    sets = hot.groupBy("sid").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("cp", "h"))).alias("s"))
    sets = spill(sets.filter(F.size("s") * 5 >= F.col("n") * 4), "dense")
    # of two linked rows one of the first columns, by number of rows, is in both
    first = sets.select("sid", F.explode(F.expr("slice(s, 1, int(size(s) - (4 * n + 4) div 5 + 1))")).alias("p"))
    first = first.select("sid", F.col("p.h").alias("h"))
    least = first.groupBy("h").agg(F.min("sid").alias("least"), F.count("*").alias("c")).filter("c > 1")
    near = components(first.join(least, "h").select(F.col("sid").alias("a"), F.col("least").alias("b")).distinct())
    near = spill(near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()), "groups")
    grouped = sets.join(near.withColumnRenamed("node", "sid"), "sid")
    grouped = grouped.select("root", "sid", "n", F.transform("s", lambda x: x["h"]).alias("toks"))
    sizes = grouped.groupBy("root").agg(
        _blocks(F.count("*"), F.sum(F.size("toks")), rows, most).alias("blocks"))
    placed = grouped.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    placed = spill(placed, "placed")
    pivots = placed.filter("sid = root and blocks > 1").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pivots = pivots.filter("at <> block").withColumn("block", F.col("at")).select(*placed.columns)
    own = spill(_cells(placed.unionByName(pivots), ["root", "block"]), "block_links")
    every = known.unionByName(own)
    large = placed.filter("blocks > 1")
    if large.isEmpty():
        return own
    # blocks of a large group meet where their rows are of different classes by now
    classes = components(every).select(F.col("node").alias("sid"), F.col("root").alias("label"))
    named = large.join(classes, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    of_label = named.groupBy("root", "label").agg(F.count("*").alias("c"), F.sum(F.size("toks")).alias("w"))
    pure = (F.col("c") >= rows) | (F.col("w") >= most)
    of_label = of_label.withColumn("pool", F.when(pure, F.col("label")))
    pools = of_label.groupBy("root", "pool").agg(_blocks(F.sum("c"), F.sum("w"), rows, most).alias("parts"))
    blocks = pools.select("root", "pool", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    blocks = blocks.withColumn("key", F.xxhash64(F.coalesce("pool", F.lit(0)), F.col("pool").isNull(), "part"))
    meet = blocks.alias("x").join(blocks.alias("y"), F.expr(
        "x.root = y.root and x.key <= y.key and (x.pool is null or y.pool is null or x.pool <> y.pool)"))
    meet = meet.select(F.col("x.root").alias("root"), F.col("x.key").alias("i"), F.col("y.key").alias("j"))
    sides = meet.select("root", F.col("i").alias("key"), "i", "j").unionByName(
        meet.filter("i <> j").select("root", F.col("j").alias("key"), "i", "j"))
    keyed = named.join(of_label.select("root", "label", "pool"), ["root", "label"])
    keyed = keyed.join(pools, keyed["root"].eqNullSafe(pools["root"]) & keyed["pool"].eqNullSafe(pools["pool"])) \
        .drop(pools["root"]).drop(pools["pool"])
    keyed = keyed.withColumn("key", F.xxhash64(F.coalesce("pool", F.lit(0)), F.col("pool").isNull(),
                                               F.pmod(F.xxhash64("sid"), F.col("parts"))))
    across = _cells(keyed.join(sides, ["root", "key"]), ["root", "i", "j"])
    return own.unionByName(spill(across, "block_links"))


def links(docs: DataFrame, rows: DataFrame, size: int, hot: int) -> DataFrame:
    """Links (a, b) between the sets of ``rows`` (made by ``leading_rows``), spanning all classes."""
    sizes = spill(rows.filter("n > 0").groupBy("sid").agg(F.max("n").alias("n")), "sizes")
    by_column = Window.partitionBy("h")
    met = rows.select("sid", F.explode("look").alias("h")).repartition("h").distinct()
    met = spill(met.withColumn("c", F.count("*").over(by_column)).filter("c > 1"), "met")
    busy = spill(met.filter(F.col("c") > hot).select("h").distinct(), "busy")
    withheld = rows.select("sid", F.explode("held").alias("h"))
    lost = met.filter(F.col("c") > hot).select("sid", "h").unionByName(withheld).distinct().groupBy("sid").agg(F.count("*").alias("lost"))
    info = sizes.join(lost, "sid", "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    counted = F.expr("least(n, 3 * n div 10 + 1) - lost")
    info = spill(info.select("sid", "n", (F.col("n") - counted).alias("u"), (counted * 5 <= F.col("n")).alias("poor")), "info")

    poor = info.filter("poor")
    full = spill(whole_rows(docs, poor, size), "poor")
    full = full.join(poor.select("sid", "n"), "sid").select("sid", "n", F.explode("toks").alias("h"))
    columns = full.groupBy("h").agg(F.count("*").alias("cp")).join(busy.withColumn("busy", F.lit(True)), "h", "left")
    columns = columns.select("h", "cp", F.coalesce("busy", F.lit(False)).alias("busy"),
                             (F.col("busy").isNotNull() | (F.col("cp") > hot)).alias("hot"))
    full = spill(full.join(columns, "h"), "poor_columns")
    uncounted = full.groupBy("sid").agg(F.count(F.when(F.col("hot"), 1)).alias("u"))

    shape = ["h", "sid", "n", "u"]
    of_rich = info.filter("not poor")
    rich = spill(met.filter(F.col("c") <= hot).join(of_rich, "sid").select(*shape), "rich")
    rest = spill(full.filter("not busy").join(uncounted, "sid").select(*shape, "hot"), "poor_entries")
    near = leading_in(rows, rest.select("h").distinct()).join(of_rich, "sid").select(*shape)
    pairs = spill(product(rich, near, rest), "pairs")
    known = verified(docs, pairs, size)
    every = known.unionByName(dense_links(full.filter("hot").select("sid", "n", "h", "cp"), known))
    return every


def join(docs: DataFrame, size: int = SHINGLE, hot: int = HOT, window: int = WINDOW) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (doc_id, text)."""
    rows = spill(leading_rows(docs, size, hot, window), "rows")
    found = spill(components(links(docs, rows, size, hot)), "classes")
    firsts = rows.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first"))
    classes = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    linked = firsts.join(classes.withColumnRenamed("node", "sid"), "sid")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    of_linked = linked.join(least, "root").select("sid", "least")
    of_set = spill(firsts.join(of_linked, "sid", "left").select("sid", F.coalesce("least", "first").alias("component_id")), "of_set")
    full = rows.filter("n > 0").select("doc_id", "n", "sid").join(of_set, "sid")
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
