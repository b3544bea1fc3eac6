"""SimHash near-duplicates with vantage-point trees over Hamming space.

A fingerprint has a bit set where over half of the XXH64 hashes (seed 42) of
the text's 4-word shingles have it.  Two fingerprints link at ``max_bits`` (4)
or fewer differing bits; a class is what is reachable over links.

Distances of unrelated 64-bit fingerprints to any vantage point crowd around
32 with a deviation of 4, so a tree over all 64 bits prunes little at radius
4.  The fingerprint is therefore cut into 3 blocks of bits: of two linked
fingerprints some block differs in at most 4 // 3 = 1 bit (pigeonhole), and
the Hamming distance on a block is a metric too.  Each block has its own tree:

* top: vantage points and radii from a sample (``sample_rows``, or 16 a shard if that is more, which is
  one in 2500 fingerprints) cut the fingerprints into shards by distance to the
  vantage points;
* a fingerprint is a member of its home shard, and visits every earlier shard
  that the triangle bounds (|d - radius| <= 1) cannot rule out -- so each
  linked pair meets in exactly one shard per block;
* a shard that holds far more than it should, since many fingerprints share a
  block's value (near copies of one template), is cut again in the same way by trees
  over the other bits, in 3 parts of which some differs in at most 1 bit;
* inside a shard a local tree prunes in the same way down to small leaves,
  where full 64-bit distances are compared.

Shards emit a spanning forest of the links, never all pairs; classes come from
distributed star contractions.  Copies (equal fingerprints) are merged before
the search, so a hot group of copies is one fingerprint.

Defined results: null and empty texts have fingerprint zero, linked like any
other; rows that repeat a doc_id keep one output row each; a null doc_id never
names a class unless the whole class has none (component_id null then).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayes_ops.llm.common import byte_texts, fresh, popcount, spill

SHINGLE = 4
MAX_BITS = 4
SAMPLE_ROWS = 16_384     # fingerprints that shape the top trees; all are indexed
SHARD_ROWS = 40_000      # members a shard aims at
LARGE = 4                # times that: a shard that is cut again
LEAF = 96                # members of a leaf that is compared directly


# --- fingerprints ---------------------------------------------------------

def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text."""
    ws = text.lower().split() if text else []
    if not ws:
        return 0
    if len(ws) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(ws), 42)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(ws) - shingle + 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle - 1:].tolist())),
                    np.uint64, n)
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, 65_536):
        part = h[lo:lo + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit long."""
    @F.arrow_udf("long")
    def fp(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            x = np.array([fingerprint(t, shingle) for t in byte_texts(a)], np.uint64)
            yield pa.array(x.view(np.int64), pa.int64())
    return fp.asNondeterministic()(text)


# --- vantage-point trees ----------------------------------------------------

def block_masks(max_bits: int) -> tuple[list[int], int]:
    """Bit masks of the blocks, and the radius that suffices on one of them."""
    n = max(1, min(3, max_bits + 1))
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])], max_bits // n


def parts_of(mask: int, max_bits: int) -> tuple[list[int], int]:
    """The bits outside ``mask`` in parts, and the radius that suffices on one of them."""
    bits = [b for b in range(64) if not mask >> b & 1]
    n = max(1, min(3, max_bits + 1, len(bits)))
    cuts = [round(len(bits) * i / n) for i in range(n + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])], max_bits // n


def _split(fps: np.ndarray, mask: np.uint64) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage point, a radius that leaves points on both sides, and the distances."""
    for at in (0, len(fps) // 2, len(fps) - 1):
        d = popcount((fps ^ fps[at]) & mask)
        lo, hi = int(d.min()), int(d.max())
        if lo < hi:
            return fps[at], min(int(np.median(d)), hi - 1), d
    return None


def top_tree(sample: np.ndarray, mask: int, shards: int) -> list[tuple]:
    """Nodes (vantage point, radius, inside, outside); a leaf is (shard,).
    Shards are numbered in order, the inside of a node before its outside."""
    nodes: list[tuple] = []
    leaves = 0

    def grow(fps: np.ndarray, want: int) -> int:
        nonlocal leaves
        me = len(nodes)
        nodes.append(())
        cut = _split(fps, np.uint64(mask)) if want > 1 and len(fps) >= 16 else None
        if cut is None:
            nodes[me] = (leaves,)
            leaves += 1
            return me
        vp, radius, d = cut
        inside = fps[d <= radius]
        share = min(want - 1, max(1, round(want * len(inside) / len(fps))))
        left = grow(inside, share)
        right = grow(fps[d > radius], want - share)
        nodes[me] = (int(vp), radius, left, right)
        return me

    grow(sample, shards)
    return nodes


def route(nodes: list[tuple], mask: int, r: int, fps: np.ndarray,
          visitors: np.ndarray | None = None) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(shard, home, positions of fps) for home shards and the earlier ones within r; positions marked in
    ``visitors`` have no home and come to every shard within r."""
    m = np.uint64(mask)
    every = np.arange(len(fps))
    guest = np.zeros(len(fps), bool) if visitors is None else visitors
    stack = [(0, every[~guest], every[guest])]
    while stack:
        at, home, visit = stack.pop()
        node = nodes[at]
        if len(node) == 1:
            if len(home):
                yield node[0], True, home
            if len(visit):
                yield node[0], False, visit
            continue
        vp, radius, left, right = node
        dh = popcount((fps[home] ^ np.uint64(vp)) & m).astype(np.int64)
        dv = popcount((fps[visit] ^ np.uint64(vp)) & m).astype(np.int64)
        out = dh > radius
        stack.append((left, home[~out], np.concatenate((visit[dv <= radius + r], home[out & (dh <= radius + r)]))))
        stack.append((right, home[out], visit[dv > radius - r]))


def star_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable position for each of n positions over links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        nxt = label.copy()
        np.minimum.at(nxt, label[a], low)
        np.minimum.at(nxt, label[b], low)
        nxt = nxt[nxt]
        nxt = nxt[nxt]
        if np.array_equal(nxt, label):
            return label
        label = nxt


def shard_links(members: np.ndarray, visitors: np.ndarray, mask: int, r: int, max_bits: int,
                leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among members and between members and visitors."""
    fps = np.concatenate((members, visitors))
    nm, full = len(members), np.uint64(0xFFFFFFFFFFFFFFFF)
    label = np.arange(len(fps))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def flush() -> None:
        nonlocal label, held
        if found:
            a = np.concatenate([x for x, _ in found] + [np.arange(len(fps))])
            b = np.concatenate([x for _, x in found] + [label])
            label = star_forest(len(fps), a, b)
            found.clear()
            held = 0

    def compare(home: np.ndarray, visit: np.ndarray) -> None:
        """Direct comparison; members that are linked leave the waiting set."""
        nonlocal held
        if len(home) <= 4 * leaf:
            everyone = np.concatenate((home, visit))
            step = max(1, 4_000_000 // max(1, len(everyone)))
            for lo in range(0, len(home), step):
                x, y = np.nonzero(popcount(fps[home[lo:lo + step], None] ^ fps[None, everyone]) <= max_bits)
                keep = home[lo + x] != everyone[y]
                found.append((home[lo + x][keep], everyone[y][keep]))
                held += int(keep.sum())
                if held > 2_000_000:
                    flush()
            return
        waiting = home
        while len(waiting):
            queue, waiting = [waiting[0]], waiting[1:]
            while queue:
                c = queue.pop()
                near = popcount(fps[waiting] ^ fps[c]) <= max_bits
                hit, waiting = waiting[near], waiting[~near]
                seen = visit[popcount(fps[visit] ^ fps[c]) <= max_bits]
                for other in (hit, seen):
                    if len(other):
                        found.append((np.full(len(other), c), other))
                        held += len(other)
                if held > 2_000_000:
                    flush()
                queue.extend(hit.tolist())

    stack = [(np.arange(nm), np.arange(nm, len(fps)), np.uint64(mask), r)]
    while stack:
        home, visit, m, near = stack.pop()
        if not len(home) or len(home) + len(visit) < 2:
            continue
        if len(home) <= leaf:
            compare(home, visit)
            continue
        cut = _split(fps[home], m)
        if cut is None:
            # all equal on this block: go on with a tree over all bits, or compare
            if m != full:
                stack.append((home, visit, full, max_bits))
            else:
                compare(home, visit)
            continue
        vp, radius, d = cut
        dv = popcount((fps[visit] ^ vp) & m).astype(np.int64)
        d = d.astype(np.int64)
        out = d > radius
        inner = np.concatenate((visit[dv <= radius + near], home[out & (d <= radius + near)]))
        if m == full and len(home) - int(out.sum()) + len(inner) >= 0.95 * (len(home) + len(visit)):
            compare(home, visit)        # a dense ball: the bounds rule out next to nothing
            continue
        stack.append((home[~out], inner, m, near))
        stack.append((home[out], visit[dv > radius - near], m, near))
    flush()
    moved = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[moved], fps[label[moved]]


# --- the distributed join ---------------------------------------------------

def _sampled(rows: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` of the distinct fingerprints of column ``fp``, evenly: those of the smallest rehash."""
    n = rows.count()
    rehash = F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 30))
    share = min(1.0, 1.5 * most / max(1, n))
    got = rows.filter(rehash < int(share * (1 << 30)) + 1).select("fp", rehash.alias("k")).orderBy("k", "fp").limit(most).toArrow()
    return np.unique(got["fp"].to_numpy()).view(np.uint64)


def _linked(dealt: DataFrame, keys: list[str], masks: dict[int, int], r: int, max_bits: int) -> DataFrame:
    """Spanning links of the cells of ``dealt`` (keys, tree, home, fp); ``masks``: by tree."""
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        u = pdf["fp"].to_numpy().view(np.uint64)
        home = pdf["home"].to_numpy(bool)
        a, b = shard_links(np.sort(u[home]), np.sort(u[~home]), masks[int(pdf["tree"].iat[0])], r, max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
    return dealt.groupBy(*keys).applyInPandas(join, "a long, b long")


def links(fps: DataFrame, max_bits: int = MAX_BITS, sample_rows: int = SAMPLE_ROWS,
          shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links (a, b) over the distinct fingerprints of column ``fp``."""
    spark = fps.sparkSession
    want = max(1, -(-fps.count() // shard_rows))
    base = _sampled(fps, max(sample_rows, 16 * want))
    masks, r = block_masks(max_bits)
    trees = spark.sparkContext.broadcast([top_tree(base, m, want) for m in masks])

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            u = np.ascontiguousarray(x).view(np.uint64)
            for t, (nodes, mask) in enumerate(zip(trees.value, masks)):
                for shard, home, at in route(nodes, mask, r, u):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), t, np.int32)), pa.array(np.full(len(at), shard, np.int64)),
                         pa.array(np.full(len(at), home)), pa.array(x[at])], names=["tree", "shard", "home", "fp"])

    dealt = spill(fps.select("fp").mapInArrow(deal, "tree int, shard long, home boolean, fp long"), "dealt")
    sizes = dealt.groupBy("tree", "shard").agg(F.count_if("home").alias("n"))      # members; visitors are at most some 20 times as many
    large = spill(sizes.filter(F.col("n") > LARGE * shard_rows), "large")
    fit = dealt.join(large, ["tree", "shard"], "left_anti")
    out = _linked(fit, ["tree", "shard"], dict(enumerate(masks)), r, max_bits)
    if large.isEmpty():
        return out
    return out.unionByName(_cut_again(dealt.join(large, ["tree", "shard"]).drop("n"), masks, max_bits, sample_rows, shard_rows))


def _cut_again(rows: DataFrame, masks: list[int], max_bits: int, sample_rows: int, shard_rows: int) -> DataFrame:
    """Links inside shards that are too large, by trees over the bits outside their block."""
    spark = rows.sparkSession
    rows = spill(rows, "large_shards")
    plan, by_part = [], {}
    for t, mask in enumerate(masks):
        own = rows.filter(F.col("tree") == t)
        want = max(1, -(-own.count() // shard_rows))
        base = _sampled(own, max(sample_rows, 16 * want))
        parts, r = parts_of(mask, max_bits)
        for j, part in enumerate(parts):
            by_part[3 * t + j] = part
            plan.append((t, 3 * t + j, part, r, top_tree(base, part, want)))
    trees = spark.sparkContext.broadcast(plan)
    r = plan[0][3]

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            tree, shard, home, x = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            for t, name, part, near, nodes in trees.value:
                own = np.flatnonzero(tree == t)
                u = np.ascontiguousarray(x[own]).view(np.uint64)
                for leaf, at_home, at in route(nodes, part, near, u, ~home[own].astype(bool)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), name, np.int32)), pa.array(shard[own[at]]), pa.array(np.full(len(at), leaf, np.int64)),
                         pa.array(np.full(len(at), at_home)), pa.array(x[own[at]])], names=["tree", "shard", "leaf", "home", "fp"])

    again = rows.select("tree", "shard", "home", "fp").mapInArrow(deal, "tree int, shard long, leaf long, home boolean, fp long")
    return _linked(again, ["tree", "shard", "leaf"], by_part, r, max_bits)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): smallest reachable node, by alternating star contractions."""
    def nearest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = spill(e, "links")
    now = state(e)
    for _ in range(max_rounds):
        if not now[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(nearest(both), "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                             F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        e = spill(small, "links")
        before, now = now, state(e)
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def _classes(firsts: DataFrame, max_bits: int, **kw) -> DataFrame:
    """fp, root (the least fingerprint of its class) of every fingerprint with a link."""
    roots = spill(components(links(firsts, max_bits, **kw)), "roots")
    return roots.select(F.col("node").alias("fp"), "root").unionByName(
        roots.select(F.col("root").alias("fp"), "root").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, **kw) -> DataFrame:
    """doc_id, fp (signed long), component_id of every row."""
    prints = spill(docs.select("doc_id", fingerprint_column(F.col("text"), shingle).alias("fp")), "prints")
    firsts = spill(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    linked = firsts.join(_classes(firsts, max_bits, **kw), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    of_linked = linked.join(least, "root").select("fp", "least")
    classes = spill(firsts.join(of_linked, "fp", "left")
                    .select("fp", F.coalesce("least", "first").alias("component_id")), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs, **kw).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, **kw) -> DataFrame:
    """One row of each class stays; all columns kept.

    It is the row with the smallest doc_id (null ids last), then fingerprint, hash of the text, and row
    number, so rows that repeat an id or have none are told apart."""
    # numbered once: the numbers must be the same where the texts are read again
    at = fresh(docs, "_row")
    rows = spill(docs.withColumn(at, F.monotonically_increasing_id()), "numbered")
    prints = spill(rows.select("doc_id", F.col(at).alias("row"), F.xxhash64("text").alias("body"),
                               fingerprint_column(F.col("text"), shingle).alias("fp")), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "body", "row")
    firsts = spill(prints.groupBy("fp").agg(F.min(order).alias("first")), "firsts")
    of_class = firsts.join(_classes(firsts, max_bits, **kw), "fp", "left").groupBy(F.coalesce("root", "fp"))
    keepers = spill(of_class.agg(F.min("first").alias("first")).select(F.col("first.row").alias(at)), "keepers")
    # merged by row at every size: keepers are about as many as documents, so they are never a broadcast
    return rows.join(keepers.hint("merge"), at, "left_semi").select(*docs.columns)
