"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items: every 10 consecutive words,
or all words of a shorter item.  Patterns of one length form one class with
a block shift table (how far the search may jump past a block of words), a
suffix-block hash table that selects the patterns ending in a block, and a
direct comparison of all words.  The documents are never shuffled: the search
is one pass over the text, in step with the scan.

The benchmark is read in pieces of at most ``max_words`` pattern words; each
piece is broadcast by itself and searched in a pass of its own whose hits are
merged with those of the passes before, so a benchmark of any size works in
bounded memory.

Defined results: a null or empty text has no words and no hits; an item
without words never occurs; a null item_id marks words as hit but is not
listed; items that repeat an id count once; an empty benchmark hits nothing.
Extra columns of the documents are carried untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayes_ops.llm.common import Shared, byte_texts, fresh, spill

WINDOW = 10
MAX_WORDS = 2_000_000

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))


def search_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_TABLE).split() if text else []


def windows(item: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; an item of fewer words, but not none, is one run."""
    if not item:
        return []
    return [tuple(item[i:i + size]) for i in range(max(1, len(item) - size + 1))]


class WuManber:
    """Search tables of the patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length = length
        self.block = 2 if length >= 3 else 1
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for p, ids in patterns.items():
            for end in range(self.block, length + 1):
                key = p[end - 2:end] if self.block == 2 else p[end - 1]
                far = length - end
                if far < self.shift.get(key, self.default):
                    self.shift[key] = far
            last = p[-2:] if self.block == 2 else p[-1]
            self.bucket.setdefault(last, []).append((list(p), ids))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, item ids) of every occurrence."""
        m, n, default = self.length, len(text), self.default
        shift, bucket = self.shift.get, self.bucket
        pair = self.block == 2
        at = m - 1
        while at < n:
            key = (text[at - 1], text[at]) if pair else text[at]
            far = shift(key, default)
            if far:
                at += far
                continue
            start = at - m + 1
            for p, ids in bucket.get(key, ()):
                if text[start:at + 1] == p:
                    yield start, ids
            at += 1


def build(patterns: list[tuple[tuple[bytes, ...], str | None]]) -> list[WuManber]:
    """One search table per pattern length."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for p, item in patterns:
        ids = by_length.setdefault(len(p), {}).setdefault(p, set())
        if item is not None:
            ids.add(item)
    return [WuManber(n, ps) for n, ps in sorted(by_length.items())]


def _pieces(benchmark: DataFrame, size: int, max_words: int) -> Iterator[list]:
    """The benchmark's distinct (pattern, item) in pieces of at most max_words pattern words."""
    piece, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        for p in windows(search_words(row["t"].encode() if row["t"] is not None else None), size):
            if held + len(p) > max_words and piece:
                yield piece
                piece, held = [], 0
            piece.append((p, row["i"]))
            held += len(p)
    if piece:
        yield piece


_HITS = "struct<n_words:bigint, spans:array<struct<start:int,end:int>>, items:array<string>>"
_HITS_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ("items", pa.list_(pa.string())),
])


def _merge(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"start": a, "end": b})
    return out


def find_hits(tables: list[WuManber], text: bytes | None, before: dict | None) -> dict:
    ws = search_words(text)
    spans = [(s["start"], s["end"]) for s in before["spans"]] if before else []
    items = set(before["items"]) if before else set()
    for t in tables:
        for start, ids in t.find(ws):
            spans.append((start, start + t.length))
            items |= ids
    return {"n_words": len(ws), "spans": _merge(spans), "items": sorted(items, key=lambda x: x.encode())}


def _pass(tables_b, text: Column, before: Column | None) -> Column:
    @F.arrow_udf(_HITS)
    def first(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = tables_b.get()
        for a in it:
            yield pa.array([find_hits(tables, t, None) for t in byte_texts(a)], type=_HITS_ARROW)

    @F.arrow_udf(_HITS)
    def later(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tables = tables_b.get()
        for a, b in it:
            yield pa.array([find_hits(tables, t, x) for t, x in zip(byte_texts(a), b.to_pylist())], type=_HITS_ARROW)

    return first.asNondeterministic()(text) if before is None else later.asNondeterministic()(text, before)


def contamination(docs: DataFrame, benchmark: DataFrame, out: str = "_hits", text: str = "text",
                  size: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, merged word spans
    [start, end) inside any occurrence of a window, and the sorted item ids."""
    spark = docs.sparkSession
    df = None
    for piece in _pieces(benchmark, size, max_words):
        tables_b = Shared(spark, build(piece))
        if df is None:
            df = docs.withColumn(out, _pass(tables_b, F.col(text), None))
        else:
            df = spill(df, "decontaminate")
            df = df.withColumn(out, _pass(tables_b, F.col(text), F.col(out)))
    if df is None:
        df = docs.withColumn(out, _pass(Shared(spark, []), F.col(text), None))
    return df


def report(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    h = contamination(docs.select("doc_id", "text"), benchmark, **kw)
    n_hit = F.aggregate("_hits.spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return h.select(
        "doc_id", F.col("_hits.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("_hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hits.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents without any occurrence of a benchmark window, all columns kept."""
    at = fresh(docs, "_hits")
    h = contamination(docs, benchmark, out=at, **kw)
    return h.filter(F.size(f"{at}.spans") == 0).drop(at)


def items_digest(items: list[str]) -> str:
    """items_sha256 of a sorted id list (for brute-force checks)."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
