"""N-gram Jaccard join against all pairs."""

import random
import re
from collections import Counter

from bayes_ops.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def grams(text):
    ws = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(ws[i:i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])


def brute(rows):
    """Counter of (doc_id, n, component) by comparing all pairs of distinct sets."""
    first = {}
    for i, t in rows:
        first.setdefault(grams(t), []).append(i)
    sets = [s for s in first if s]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            n, m = len(sets[a]), len(sets[b])
            if 5 * min(n, m) >= 4 * max(n, m) and 9 * len(sets[a] & sets[b]) >= 4 * (n + m):
                root[find(a)] = find(b)
    least = {}
    for k, s in enumerate(sets):
        ids = [i for i in first[s] if i is not None]
        least.setdefault(find(k), []).extend(ids)
    comp = {s: min(least[find(k)], default=None) for k, s in enumerate(sets)}
    return Counter((i, len(grams(t)), comp[grams(t)] if grams(t) else i) for i, t in rows)


def check(df, **kw):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in ngram_join.join(df, **kw).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows)
    return got


def test_join_matches_all_pairs(docs):
    check(docs)


def test_join_with_few_rows_to_a_hot_column(docs):
    """Nearly every shared column is hot: poor rows, hot columns and dense blocks do the work."""
    check(docs, hot=1, window=2000)


def test_join_odd_and_empty(odd_docs, no_docs):
    check(odd_docs)
    check(odd_docs, hot=2, window=50)
    assert ngram_join.join(no_docs).collect() == []


def near_copies(n, seed):
    """Copies of a few templates with some words exchanged, and texts that share a long passage."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(3)]
    rows = []
    for i in range(n):
        ws = list(base[i % 3])
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
        if i % 5 == 0:
            ws = ws[:90] + [f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(60))]
        rows.append((i + 1, " ".join(ws)))
    return rows


def test_join_of_near_copies(spark):
    df = spark.createDataFrame(near_copies(400, 1), "doc_id long, text string").repartition(5)
    check(df, hot=4, window=3000)


def test_dense_blocks_meet_across(spark, monkeypatch):
    """A dense group of many small blocks: classes that only meet between blocks are found."""
    monkeypatch.setattr(ngram_join.dense_links, "__defaults__", (16, 4000))
    df = spark.createDataFrame(near_copies(240, 2), "doc_id long, text string").repartition(3)
    got = check(df, hot=4)
    assert len({c for _, _, c in got}) > 3


def test_two_sets_that_differ_in_one_side_only(spark):
    """A text and its extension, around the bound: 40 of 50 shingles is a link, 39 of 50 none."""
    ws = [f"a{i}" for i in range(60)]
    rows = [(1, " ".join(ws[:54])), (2, " ".join(ws[:44])), (3, " ".join(["b"] + ws[:43])), (4, "  ".join(ws[:54]).upper())]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(i, c) for i, _, c in got} >= {(1, 1), (2, 1), (4, 1)}


def test_wide_words_and_pieces(spark, monkeypatch):
    """Words longer than the pieces in which bytes are hashed."""
    long = "z" * 3_000_000
    rows = [(1, f"{long} b c d e f"), (2, f"{long}  b c d e f"), (3, f"{long}y b c d e f"), (4, None), (5, " ")]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert (2, 2, 1) in got and (3, 2, 1) not in got
