"""SimHash, sharding, mixing, chat and URL operators against brute force, and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bayes_ops.llm import chat, decontaminate, langid, lines, mixing, pack, simhash, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- simhash ------------------------------------------------------------------

def plain_print(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(t)
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i:i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, max_bits=4):
    fps = np.array(sorted(set(fps)), np.uint64)
    label = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.nonzero(np.bitwise_count(fps ^ fps[i]) <= max_bits)[0]
        old = set(label[near].tolist())
        label[np.isin(label, list(old))] = min(old)
    return {int(f): int(k) for f, k in zip(fps, label)}


def check_simhash(df, **kw):
    rows = df.collect()
    fp = {(r["doc_id"], r["text"]): plain_print(r["text"]) for r in rows}
    comp = brute_components(fp.values())
    least = {}
    for (i, _), f in fp.items():
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    want = Counter((r["doc_id"], f"{fp[r['doc_id'], r['text']]:016x}", least.get(comp[fp[r["doc_id"], r["text"]]])) for r in rows)
    assert Counter(tuple(r) for r in simhash.report(df, **kw).collect()) == want


def test_simhash_matches_brute_force(docs):
    check_simhash(docs)


def test_simhash_many_shards(docs):
    check_simhash(docs, shard_rows=20, sample_rows=600)


def test_simhash_odd_and_empty(odd_docs, no_docs):
    check_simhash(odd_docs)
    assert simhash.report(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 5, None} <= set(ids) and not {2, 3, 6} & set(ids)


@pytest.mark.parametrize("seed", range(3))
def test_shards_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = lambda x: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 5)).astype(np.uint64), initial=np.uint64(0))
    fps = np.unique(np.array([flips(x) for x in rng.choice(base, 3000)] + [flips(base[0]) for _ in range(1500)], np.uint64))
    masks, r = simhash.block_masks(4)
    a, b = [], []
    for m in masks:
        nodes = simhash.top_tree(rng.choice(fps, 400), m, 16)
        parts = defaultdict(lambda: ([], []))
        for shard, home, at in simhash.route(nodes, m, r, fps):
            parts[shard][0 if home else 1].append(fps[at])
        assert sum(len(x) for p in parts.values() for x in p[0]) == len(fps)
        for home, visit in parts.values():
            cat = lambda x: np.concatenate(x) if x else np.empty(0, np.uint64)
            x, y = simhash.shard_links(cat(home), cat(visit), m, r, 4, leaf=8)
            a.append(x)
            b.append(y)
    place = {int(f): i for i, f in enumerate(fps)}
    ia = np.array([place[int(v)] for v in np.concatenate(a)], np.int64)
    ib = np.array([place[int(v)] for v in np.concatenate(b)], np.int64)
    got = simhash.star_forest(len(fps), ia, ib)
    want = brute_components(fps)
    assert got.tolist() == [want[int(f)] for f in fps]


def test_more_shards_than_the_sample_holds(spark):
    """More than 1024 shards asked for: the sample grows with them, and no link is lost."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 7000, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 7000).astype(np.uint64))]))
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long").repartition(4)
    sizes = []
    real = simhash.top_tree
    try:
        def counted(*a):
            tree = real(*a)
            sizes.append(sum(len(n) == 1 for n in tree))
            return tree
        simhash.top_tree = counted
        got = simhash.components(simhash.links(df, shard_rows=10)).collect()
    finally:
        simhash.top_tree = real
    assert min(sizes[:3]) > 1024
    want = brute_components(fps)
    pairs = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in got}
    classes = defaultdict(set)
    for f in map(int, fps):
        classes[pairs.get(f, f)].add(f)
    brute = defaultdict(set)
    for f in map(int, fps):
        brute[want[f]].add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, brute.values()))


def test_many_fingerprints_of_one_block_value(spark):
    """Equal on a block, unlike elsewhere: cells of the second cut stay small, links are all there."""
    rng = np.random.default_rng(9)
    masks, _ = simhash.block_masks(4)
    free = ~np.uint64(masks[0])
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64) & free
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(22, 64, (1500, 4)).astype(np.uint64), axis=1) & free
    fps = np.unique(np.concatenate([base, base ^ flips]))
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long").repartition(4)
    cells = []
    real = simhash._linked
    try:
        def seen(dealt, keys, *a):
            cells.append((len(keys), [r["count"] for r in dealt.groupBy(*keys).count().collect()]))
            return real(dealt, keys, *a)
        simhash._linked = seen
        got = simhash.components(simhash.links(df, shard_rows=60, sample_rows=500)).collect()
    finally:
        simhash._linked = real
    again = [c for k, c in cells if k == 3]
    assert again and max(again[0]) < len(fps) / 3
    pairs = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in got}
    want = brute_components(fps)
    classes, brute = defaultdict(set), defaultdict(set)
    for f in map(int, fps):
        classes[pairs.get(f, f)].add(f)
        brute[want[f]].add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, brute.values()))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (600, 600)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


# --- sharding -------------------------------------------------------------------

def check_pack(df, near=None, **kw):
    n = kw.get("shards", 24)
    rows = pack.assign(df, **kw).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if near:
        size = Counter()
        for r in rows:
            size[r["shard"]] += r["size"]
        mean = sum(size.values()) / n
        assert max(abs(size[k] - mean) for k in range(n)) <= near * mean
    return rows


def test_sharding_is_even(docs):
    rows = check_pack(docs, near=0.02)
    assert rows


def test_sharding_odd_and_empty(odd_docs, no_docs):
    check_pack(odd_docs)
    check_pack(odd_docs, shards=2, items=4)
    assert pack.assign(no_docs).count() == 0


def test_sharding_splits_a_hot_group(spark):
    df = spark.createDataFrame([(i, "hot text " * 20 if i % 3 == 0 else f"text {i} " * 20) for i in range(6000)], "doc_id long, text string")
    rows = check_pack(df, near=0.02)
    of = defaultdict(set)
    for r in rows:
        if r["doc_id"] % 3:
            of[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in of.values())        # groups that fit stay together


@pytest.mark.parametrize("sf_dir", ["sf0.01", "sf0.1"])
def test_equal_texts_stay_together(spark, sf_dir):
    """No group of the fixture is too large for a shard, so none is torn; the law holds all the same."""
    df = spark.read.parquet(f"/root/testdata/{sf_dir}/documents.parquet")
    rows = check_pack(df, near=0.02)
    of, n = defaultdict(set), Counter()
    for r in rows:
        of[r["text_crc32"], r["size"]].add(r["shard"])
        n[r["text_crc32"], r["size"]] += 1
    assert max(n.values()) > 1 and all(len(s) == 1 for s in of.values())


def test_sharding_of_rows_without_an_id(spark):
    """A third of the rows have no id and one text, another third one id: near-equal bytes, the smaller groups whole."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "no id " * 9 if i % 3 == 0 else f"text {i % 50 if i % 3 == 2 else i} " * 9) for i in range(9000)]
    got = check_pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), near=0.02)
    of = defaultdict(set)
    for r in got:
        of[r["text_crc32"], r["size"]].add(r["shard"])
    assert sum(len(s) > 1 for s in of.values()) == 1       # the hot text alone is larger than a shard


def test_groups_that_find_no_room_are_cut():
    """24 groups of 0.7 shards fill the shards; the others find none with room."""
    sizes = np.array([[0.7, 0.7, 0.7]] * 30)
    whole = pack.uncut(sizes, np.array([24.0, 24.0, 24.0]), 24)
    assert whole.sum() == 24
    assert not pack.uncut(np.array([[1.5, 1.5, 1.5]]), np.array([24.0] * 3), 24).any()


def test_place_prefers_the_largest_dot_product():
    sizes = np.array([[8, 0, 1], [8, 0, 1], [0, 8, 1], [0, 8, 1]], float)
    at = pack.place(sizes, 2)
    assert at[0] != at[1] and at[2] != at[3]


# --- mixing ---------------------------------------------------------------------

def check_mix(df):
    rows = df.collect()
    size = lambda r: len(WORD.findall(r["text"] or ""))
    sources = Counter()
    for r in rows:
        sources[r["source"]] += size(r)
    order = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = sum(sources.values()), set(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * sources[s]}
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sources[s]
            left -= target[s]
        free -= over
    got = mixing.report(df).collect()
    by = {(r["doc_id"], r["text"]): r["source"] for r in rows}
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 4)) for r in got) == \
        Counter((r["doc_id"], size(r), sources[r["source"]], round(target.get(r["source"], 0.0), 4)) for r in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in got)
    if len(by) == len(rows) and len({i for i, _ in by}) == len(rows):
        taken, of, largest = Counter(), {i: s for (i, _), s in by.items()}, Counter()
        for r in got:
            taken[of[r["doc_id"]]] += r["taken"]
            largest[of[r["doc_id"]]] = max(largest[of[r["doc_id"]]], r["size"])
        for s in order:
            assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1, s
    return got


def test_mixing_matches_targets(docs):
    got = check_mix(docs)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.report(docs).collect()))


def test_mixing_odd_and_empty(odd_docs, no_docs):
    check_mix(odd_docs)
    assert mixing.report(no_docs).count() == 0


def test_mixing_caps_small_sources(spark):
    rows = [(i, "w " * 10, "a") for i in range(5)] + [(i, "w " * 10, "b") for i in range(5, 400)] + [(400 + i, "w " * 3, "c") for i in range(9)]
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_mixing_of_rows_without_an_id(spark):
    """Null and repeated ids, unlike and equal texts: every source comes within a document of its target."""
    rows = [(None, f"w {i} " * 5, "a") for i in range(3000)] + [(7, "same text here", "b")] * 3000 + [(i, "w x " * 5, "c") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    taken, target = Counter(), {}
    for r in mixing.report(df).collect():      # the sources' sizes differ, and tell them apart
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert len(target) == 3 and all(abs(taken[s] - t) <= 10 for s, t in target.items())
    assert Counter(r["source"] for r in mixing.take(df).collect()).keys() == {"a", "b", "c"}


def test_clashing_column_names(spark, docs):
    """Every name that a stage function might use for itself stays the caller's."""
    names = ["_row", "_of", "_copies", "_hits", "_p", "_k", "_s", "_c", "_b", "_at", "_id", "_gone", "row", "fp", "size"]
    few = docs.filter("doc_id < 120")
    odd = few.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    bench = spark.createDataFrame([(1, "nothing that occurs anywhere at all in here today ok")], "item_id long, text string")
    for f in (mixing.take, langid.keep_identified, simhash.keep_one, lines.clean, lambda d: decontaminate.clean(d, bench)):
        got = f(odd)
        assert got.columns == odd.columns
        rows = got.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)


def test_mixing_rows_follow_the_plan(docs):
    taken = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 0 for r in mixing.report(docs).collect()}
    rows = mixing.take(docs)
    assert rows.columns == docs.columns
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter({k: v for k, v in taken.items() if v})


# --- chat -------------------------------------------------------------------------

def check_chat(df):
    convs = defaultdict(list)
    for r in df.collect():
        convs[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    convs[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for k, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        want[k] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    got = chat.report(df).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == want and len(got) == len(want)


def test_chat_matches_brute_force(spark, sf):
    check_chat(spark.read.parquet(f"{sf}/conversations.parquet"))


def test_chat_odd_and_empty(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", None, 9), (1, 1, "assistant", "a\\!b<|end|>\n<|turn|>user<|text|>\\\\[INST]<s>\\", 9), (1, 1, "assistant", "tie", 9),
         (None, 0, "user", "no id", 9), (2, None, None, "", 9), (3, 0, "a\nb<|text|>", "multi\nline\n", 9), (3, 0, "a\nb<|text|>", "multi\nline\n", 9),
         (4, 0, "assistant", "z" * 200_000 + "<<SYS>>", 9)], "conv_id long, turn long, role string, text string, seq int")
    check_chat(df)
    check_chat(df.limit(0))


def test_no_control_string_survives(spark):
    df = spark.createDataFrame([(1, 0, "user", "</s>[INST] <|end|> <<SYS>> <|turn|> [/INST]<s>", 0)], "conv_id long, turn long, role string, text string, x int")
    f = chat.render(chat.from_turns(df)).first()["formatted"]
    inner = f.removeprefix("<|turn|>user<|text|>").removesuffix("<|end|>\n")
    assert not re.search(chat.CONTROL, inner)


def test_events_fold(spark):
    log = [
        (1, 1, 10, "message", "user", "hi"), (1, 2, 11, "message", "assistant", ""), (1, 4, 11, "delta", None, "lo"),
        (1, 3, 11, "delta", None, "hel"), (1, 5, 12, "message", "user", "thanks"), (1, 6, 11, "regenerate", None, None),
        (1, 7, 11, "delta", None, "good "), (1, 8, 11, "delta", None, "day"), (1, 9, 13, "message", "user", "bye"),
        (1, 10, 10, "edit", None, "hey"), (1, 11, 99, "delta", None, "lost"), (2, 1, 1, "message", "assistant", "a"),
        (2, 2, 1, "edit", None, "b"), (2, 3, 1, "delta", None, "c")]
    df = spark.createDataFrame(log, chat.EVENTS).repartition(5)
    got = sorted((r["conv_id"], r["place"]["opened"], r["role"], r["text"]) for r in chat.fold(df).collect())
    assert got == [(1, 1, "user", "hey"), (1, 2, "assistant", "good day"), (1, 9, "user", "bye"), (2, 1, "assistant", "bc")]
    r = {x["conv_id"]: x for x in chat.render(df).collect()}[2]
    span = r["turns"][0]
    assert r["formatted"][span["loss_start"]:span["loss_end"]] == "bc"


# --- urls ---------------------------------------------------------------------------

def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


def check_urls(df):
    weights, bias = urls.train(urls.LABELLED)
    want = Counter()
    for r in df.collect():
        host, path = plain_url(r["url"])
        fit = [(len(x), x, v) for v, x in urls.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0]))
               and path.startswith(x[x.index("/"):])]
        cells = urls.cells(host, path)
        score = bias + sum(weights[k] for k in cells) / max(1, len(cells)) ** 0.5
        rule = max(fit) if fit else (0, None, "block" if score >= 0 else "allow")
        want[(r["page_id"], host, path, rule[1], rule[2])] += 1
    assert Counter(tuple(r)[:5] for r in urls.judge(df).collect()) == want


def test_urls_match_brute_force(spark, sf):
    check_urls(spark.read.parquet(f"{sf}/pages.parquet"))


def test_urls_odd_and_empty(spark):
    df = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (3, "nothing", 1), (4, "HTTP://WWW.Example.COM/en/x?y#z", 1), (5, "http://example.com", 1),
         (6, "http://net/es/", 1), (7, "http://a.net/fr/x", 1), (8, "x://b?q=://net/es/", 1), (9, "http://notexample.com/en/", 1),
         (10, "http://h/" + "p" * 30_000, 1), (None, "http://É.org/ä", 1), (4, "HTTP://WWW.Example.COM/en/x?y#z", 1),
         (11, "http://a.org/x\ny", 1)], "page_id long, url string, host int")
    check_urls(df)
    check_urls(df.limit(0))


def test_url_model_on_hosts_it_was_not_trained_on():
    fit, held = urls.held_out(urls.LABELLED)
    assert len(held) > 150 and {y for _, y in held} == {0, 1} and not {u for u, _ in fit} & {u for u, _ in held}
    got = urls.measured(held, *urls.train(fit))
    assert got["precision"] >= 0.9 and got["recall"] >= 0.75, got
    own = urls.measured(urls.LABELLED, *urls.train(urls.LABELLED))
    assert own["precision"] > 0.99 and own["recall"] > 0.99


# Host names that the fixture's unwanted pages bear (fixed values); those of the labelled table are left out.
UNWANTED = ["casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x"]


def test_both_verdicts_of_the_model_occur_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    unseen = [h for h in UNWANTED if not any(h in url for url, _ in urls.LABELLED)]
    assert len(unseen) >= 3
    hits = Counter()
    for r in urls.judge(pages).filter("rule is null").collect():
        named = [h for h in UNWANTED if f"{h}." in r["host"]]
        if not named or named[0] in unseen:
            hits[bool(named), r["verdict"]] += 1
    assert hits[True, "block"] >= 0.9 * (hits[True, "block"] + hits[True, "allow"]) > 0
    assert hits[False, "allow"] >= 0.99 * (hits[False, "block"] + hits[False, "allow"]) > 0


def test_labelled_table_can_be_read(spark):
    pages = spark.createDataFrame([(1, "http://aaa.org/x"), (2, "http://zzz.org/x"), (3, None)], "page_id long, url string")
    labelled = spark.createDataFrame([("http://zzz.net/y", 1), ("http://aaa.net/y", 0)] * 4, "url string, label int")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, [], labelled).collect()}
    assert got[1] == "allow" and got[2] == "block"


def test_one_row_of_each_class_stays(spark):
    """Rows that repeat an id with unlike texts, and several rows without an id."""
    body = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcdefg"}
    near = next(t for t in (f"{body['f']} x{i}" for i in range(1000))
                if 0 < (plain_print(t) ^ plain_print(body["f"])).bit_count() <= 4)
    rows = [(1, "a"), (1, "b"), (3, "c"), (7, "c"), (7, "d"), (None, "e"), (None, "e"), (None, "a"), (None, "g"), (9, "f")]
    rows = [(i, body[k]) for i, k in rows] + [(None, near)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter([(1, body["a"]), (1, body["b"]), (3, body["c"]), (7, body["d"]), (None, body["e"]),
                    (None, body["g"]), (9, body["f"])])
    kept = simhash.keep_one(df)
    assert Counter(tuple(r) for r in kept.collect()) == want


# --- pipeline -------------------------------------------------------------------------

def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p
    from bayes_ops.llm import decontaminate, langid

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = [], docs
    for name, stage in p.STAGES:
        out = stage(spark, seen, sf).cache()
        if name == "language_id":
            good = {r["doc_id"] for r in langid.report(seen).filter("lang_pred <> 'und' and score >= 0.1").collect()}
            assert {r["doc_id"] for r in out.collect()} == good and len(good) > 0.95 * docs.count()
        elif name == "near_duplicates":
            rows = seen.collect()
            comp = brute_components(plain_print(r["text"]) for r in rows)
            least = {}
            for r in rows:
                k = comp[plain_print(r["text"])]
                least[k] = min(r["doc_id"], least.get(k, r["doc_id"]))
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(least.values())
        elif name == "decontamination":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            clean = {r["doc_id"] for r in decontaminate.report(seen, bench).filter("not contaminated").collect()}
            assert {r["doc_id"] for r in out.collect()} == clean
        elif name == "mixing":
            taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.report(seen).collect()}
            assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in taken.items() if v})
        else:
            assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in seen.collect())
        if name != "sharding":
            assert out.columns == docs.columns
        names.append(name)
        seen = out
    assert len(names) == 5


def test_pipeline_odd_and_empty(spark, sf, odd_docs, no_docs):
    import corpus_pipeline as p

    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in p.STAGES:
            docs = stage(spark, docs, sf).cache()
            docs.count()
