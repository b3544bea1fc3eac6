"""Operators on texts against brute force: quality, scoring, language, decontamination, lines."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from bayes_ops.llm import decontaminate, langid, lattice, lines, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- quality ------------------------------------------------------------------

def base(text):
    ws = WORD.findall(text or "")
    runs = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    hit = {j for i in range(len(ws) - 4) if runs[tuple(ws[i:i + 5])] > 1 for j in range(i, i + 5)}
    ls = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(hit))


def check_quality(df):
    got = quality.judge(df)
    want = Counter((r["doc_id"], *base(r["text"])) for r in df.collect())
    rows = got.collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
                   for r in rows) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["failed"] == "")


def test_quality_matches_brute_force(docs):
    check_quality(docs)


def test_quality_odd_and_empty(odd_docs, no_docs):
    check_quality(odd_docs)
    check_quality(no_docs)


def test_quality_sketches_merge(docs):
    d = quality.with_rules(quality.metrics(docs)).cache()
    whole = quality.quartiles(quality.sketches(d), ["lang"]).collect()
    for r in whole:
        vs = sorted(x[r["metric"]] for x in d.filter("not base_failed").filter(d["lang"] == r["lang"]).collect())
        for q, name in ((1, "q25"), (3, "q75")):
            true = vs[math.ceil(len(vs) * q / 4) - 1]
            assert r[name] <= true <= r[name] * 65 / 64 + 1


# --- language-model scoring -----------------------------------------------------

def enumerate_lattice(lat, word):
    """Sum over all segmentations by plain recursion over pieces and bytes."""
    s = lattice.MARK + word

    def rest(i):
        if i == len(s):
            return 1.0
        total = math.exp(lat.spelled(s[i])) * rest(i + 1)
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in lat.logp:
                total += math.exp(lat.logp[s[i:j]]) * rest(j)
        return total
    return math.log(rest(0))


@pytest.fixture(scope="module")
def lat():
    pieces = lattice.read_vocabulary(lattice.VOCABULARY)
    return lattice.Lattice(pieces, *lattice.first_weights(pieces))


def test_first_weights_are_a_distribution(lat):
    assert math.isclose(sum(map(math.exp, [*lat.logp.values(), *lat.byte, lat.end])), 1, rel_tol=1e-9)


@pytest.mark.parametrize("word", ["the", "tionthe", "éaux", "😀x", "a", "▁"])
def test_forward_sums_all_segmentations(lat, word):
    assert math.isclose(lat.word(word), enumerate_lattice(lat, word), rel_tol=1e-9)


def test_best_path_spells_the_word(lat):
    pieces = lattice.read_vocabulary(lattice.VOCABULARY)
    for w in ("tionthe", "éaux😀", "x" * 300):
        out = b"".join(bytes([int(pieces[i][3:5], 16)]) if i >= lat.first_byte else pieces[i].encode() for i in lat.best(w))
        assert out.decode() == lattice.MARK + w


def test_very_long_word_stays_finite(lat):
    assert -1e6 < lat.word("qz" * 20_000) < -1e4


def check_scores(df, head):
    rows = df.collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    toks = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    counts, ends = Counter(), 0
    for r in rows:
        if not held(r["doc_id"]):
            counts.update(toks(r["text"]))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    b = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    want = Counter()
    for r in rows:
        t = toks(r["text"])
        want[(r["doc_id"], held(r["doc_id"]), len(t) + 1, sum(counts[w] > 0 for w in t) + (ends > 0), n,
              round(sum(b(counts[w]) for w in t) + b(ends), 3))] += 1
    got = lattice.score(df, head=head).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3))
                   for r in got) == want
    assert all(r["score"] < 0 for r in got)
    return got


def test_scores_match_brute_force(docs):
    got = check_scores(docs, lattice.HEAD)
    few = check_scores(docs, 200)          # nearly all words through the join
    a, b = ({r["doc_id"]: r["score"] for r in x} for x in (got, few))
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)
    # the fitted model is better on held-out text than the vocabulary's own ranks
    pieces = lattice.read_vocabulary(lattice.VOCABULARY)
    raw = lattice.Lattice(pieces, *lattice.first_weights(pieces))
    held = {r["doc_id"]: r["score"] for r in got if r["held_out"]}
    for r in docs.filter(docs["doc_id"].isin(sorted(held)[:40])).collect():
        plain = sum(raw.word(w.decode()) for w in lattice.tokens(r["text"].encode())) / math.log(10)
        assert held[r["doc_id"]] > plain


def test_scores_odd_and_empty(odd_docs, no_docs):
    check_scores(odd_docs, lattice.HEAD)
    assert lattice.score(no_docs).count() == 0


# --- language -------------------------------------------------------------------

def test_language_held_out_accuracy(docs):
    got = by_id(langid.report(docs))
    rows = docs.collect()
    assert len(got) == len(rows)
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if got[r["doc_id"]]["held_out"]]
    assert len(right) > 200 and sum(right) / len(right) > 0.97
    for r in rows:
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= g["score"] <= 1


def test_language_close_pairs_are_decided_within_the_family():
    import numpy as np
    texts = {"fr": "le chat et la souris dans une maison", "es": "el gato y la rata en una casa",
             "en": "the cat and the mouse in a house", "de": "die katze und der hund in einem haus"}
    x = np.array([langid.features(t.encode()) for t in texts.values()])
    m = langid.Model(x, list(texts))
    assert m.families == ["germanic", "romance"]
    assert sorted(p[1:] for p in m.pairs) == [("de", "en"), ("es", "fr")]
    for lang, t in texts.items():
        assert m.predict(t.encode())[0] == lang


def test_language_odd_and_empty(odd_docs, no_docs):
    got = langid.report(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r["doc_id"] in (1, 2, 3, 8):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.report(no_docs).count() == 0
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns
    assert not {1, 2, 3, 8} & {r["doc_id"] for r in kept.collect()}


# --- decontamination --------------------------------------------------------------

TEST_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def check_hits(docs, bench, **kw):
    items = {}
    for r in bench.collect():
        ws = TEST_WORD.findall(lower(r["text"]))
        for i in range(max(1, len(ws) - 9) if ws else 0):
            items.setdefault(tuple(ws[i:i + 10]), set()).add(None if r["item_id"] is None else str(r["item_id"]))
    lengths = sorted({len(p) for p in items})
    want = Counter()
    for r in docs.collect():
        ws = TEST_WORD.findall(lower(r["text"]))
        hit, ids = set(), set()
        for n in lengths:
            for i in range(len(ws) - n + 1):
                found = items.get(tuple(ws[i:i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    ids |= found - {None}
        ids = sorted(ids)
        want[(r["doc_id"], len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))] += 1
    got = decontaminate.report(docs, bench, **kw)
    assert Counter(tuple(r) for r in got.collect()) == want
    return want


def test_decontamination_matches_brute_force(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = check_hits(docs, bench)
    assert any(w[-1] for w in want)


def test_decontamination_pieces_odd_and_empty(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(
        [("a", "same words in a LINE"), ("b", "copy of the very same text number one x"), ("c", "Été où"), ("c", "one"),
         (None, "no id"), ("d", None), ("e", " -- "), ("a", "same words in a line"),
         ("f", "word1 and word2 and word3 and word4 and word5 and word6 and word7 and")], "item_id string, text string")
    check_hits(odd_docs, bench)
    check_hits(odd_docs, bench, max_words=12)      # many pieces, a pass each
    check_hits(odd_docs, bench.limit(0))
    check_hits(no_docs, bench)
    kept = decontaminate.clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 2, 3, 7, 8}


# --- lines --------------------------------------------------------------------------

def check_lines(df, **kw):
    sets = []
    for r in df.collect():
        for k, x in enumerate((r["text"] or "").split("\n") if r["text"] is not None else []):
            ws = set(WORD.findall(x))
            if ws:
                sets.append(((r["doc_id"] is not None, r["doc_id"] or 0, k), r["doc_id"], frozenset(ws)))
    first = {}
    for place, _, s in sets:
        first[s] = min(place, first.get(s, place))
    index = {}
    for s in first:
        for w in s:
            index.setdefault(w, []).append(s)
    keep = {}
    for s in first:
        near = Counter(t for w in s for t in index[w])
        keep[s] = min(first[t] for t, c in near.items() if 9 * c >= 4 * (len(s) + len(t)))
    want = {r["doc_id"]: [0, set()] for r in df.select("doc_id").collect()}
    for place, doc, s in sets:
        want[doc][0] += 1
        if place > keep[s]:
            want[doc][1].add(place[2])
    got = lines.dedup(df, **kw).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["n_lines"], set(r["removed_lines"])) == (want[r["doc_id"]][0], want[r["doc_id"]][1]), r["doc_id"]
    return want


def test_lines_match_brute_force(docs):
    want = check_lines(docs.filter("doc_id < 300"), cells=1 << 12)
    assert sum(len(v[1]) for v in want.values()) > 5


def test_lines_odd_and_empty(odd_docs, no_docs):
    check_lines(odd_docs, cells=1 << 10)
    assert lines.dedup(no_docs, cells=1 << 10).count() == 0
    out = lines.clean(odd_docs, cells=1 << 10)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert {r["doc_id"]: r["text"] for r in out.collect()}[9] == "Été où ça là\n\n"


def test_lines_differ_in_the_last_bitmap_bit(spark):
    """Words of bitmap bit 39, which is the sign of the packed long, on one side only."""
    ws = spark.range(4000).selectExpr("concat('w', id) as w").selectExpr(
        "w", "pmod(shiftrightunsigned(xxhash64(w), 40), 40) = 39 as last").collect()
    last, rest = [r["w"] for r in ws if r["last"]], [r["w"] for r in ws if not r["last"]]
    rows = []
    for k, word in enumerate(last[:20]):
        same = rest[20 * k:20 * k + 9]
        rows += [(2 * k, " ".join([*same, word])), (2 * k + 1, " ".join([*same, rest[20 * k + 10]]))]
    want = check_lines(spark.createDataFrame(rows, "doc_id long, text string"), cells=1 << 10)
    assert all(want[2 * k + 1] == [1, {0}] for k in range(20))


def test_lines_match_brute_force_on_all_documents(docs):
    check_lines(docs, cells=1 << 14)


def test_lines_of_rows_without_an_id_of_their_own(spark):
    top = "all rights of this page are reserved by its owner"
    rows = [(None, f"{top}\nonly the first says so"), (None, f"{top}\nand the second says another thing"),
            (None, None), (None, f"{top}\nand the second says another thing"),
            (7, f"a line seven begins with\n{top}"), (7, f"a line seven begins with\nunlike its other text"),
            (8, "\n\n"), (8, "eight again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = Counter((r["doc_id"], r["n_lines"], tuple(r["removed_lines"])) for r in lines.dedup(df, cells=1 << 10).collect())
    seven = [r for r in got if r[0] == 7]
    assert Counter(r for r in got.elements() if r[0] != 7) == Counter([
        (None, 2, ()), (None, 2, (0,)), (None, 0, ()), (None, 2, (0, 1)), (8, 0, ()), (8, 1, ())])
    # which of the texts of 7 comes first is the order of their hashes
    assert sorted(seven) in ([(7, 2, ()), (7, 2, (0, 1))], [(7, 2, (0,)), (7, 2, (1,))])
    out = lines.clean(df, cells=1 << 10)
    left = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert Counter(r for r in left.elements() if r[0] != 7) == Counter([
        rows[0], (None, "and the second says another thing"), (None, None), (None, ""), rows[6], rows[7]])
    assert out.columns == df.columns and sum("a line seven begins with" in (t or "") for _, t in left) == 1
    assert not any(top in (t or "") for i, t in left if i == 7)


def test_lines_of_near_copies_are_not_verified_pair_by_pair(spark, monkeypatch):
    """Copies of a line with a word changed all match the first: a pair a copy is verified, not one for every two."""
    verified, seen = lines.verified, []

    def counted(pairs, full):
        seen.append(pairs.count())
        return verified(pairs, full)
    monkeypatch.setattr(lines, "verified", counted)
    base = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join([*base[:k], f"own{k}", *base[k + 1:]])) for k in range(40)]
    rows.append((40, " ".join([*base[:28], *(f"far{k}" for k in range(12))])))       # matches none
    rows.append((41, " ".join([*base[:32], *(f"far{k}" for k in range(8))])))        # matches 40 only
    want = check_lines(spark.createDataFrame(rows, "doc_id long, text string"), cells=1 << 12)
    assert not want[0][1] and all(want[k][1] for k in range(1, 40)) and not want[40][1]
    assert len(seen) == 2 and sum(seen) < 120        # of 780 pairs of copies


def test_lines_of_many_words_are_told_apart_by_their_bitmaps(spark, monkeypatch):
    """Lines of 60 words that share their rarest words but are unlike: almost no pair is left to verify, and
    the planted match is found."""
    rng, spill, seen = random.Random(4), lines.spill, {}

    def counted(df, name):
        out = spill(df, name)
        seen[name] = out.count()
        return out
    monkeypatch.setattr(lines, "spill", counted)
    rare = [f"rare{k}" for k in range(6)]
    common = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rare + rng.sample(common, 54))) for k in range(80)]
    rows.append((80, rows[0][1].rsplit(" ", 1)[0]))
    want = check_lines(spark.createDataFrame(rows, "doc_id long, text string"), cells=1 << 12)
    assert [k for k, v in want.items() if v[1]] == [80]
    assert 1 <= seen["pairs"] < 200        # of 3240
