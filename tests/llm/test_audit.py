"""Filter audit against a plain count, in micro-batches whose smaller ids come late."""

import itertools
import random
import re
from collections import Counter

import pytest

from bayes_ops.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, s in docs:
        t = t or ""
        ws = WORD.findall(t)
        fails.append((s or "", i in good, i in toxic, {f for f, x in zip("ABCDE", (
            len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            re.search(r"[#$%&*|]", t) is not None, i is not None and i > least[t])) if x}))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        whole = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [x for x in own if f in x[3] and not x[3] & before]
                whole[f] += len(here)
                out[part, order, k + 1] = [
                    sum(not x[3] & (before | {f}) for x in own), len(here), sum(f in x[3] and bool(x[3] & before) for x in own),
                    sum(x[3] == {f} for x in own), sum(x[1] for x in here), sum(x[2] for x in here)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(whole[order[k - 1]])
    return out


def check(spark, path, docs, labels, **kw):
    got = audit.audit(spark, path, spark.createDataFrame(labels, LABELS), **kw).collect()
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got} == brute(docs, labels)
    assert len(got) == len({d[2] or "" for d in docs}) * 600


def texts(n, seed):
    rng = random.Random(seed)
    some = [" ".join(rng.choice(["word", "Word", f"w{rng.randrange(99)}", "#", "é€😀", "UP"]) for _ in range(rng.choice([3, 150, 260])))
            for _ in range(n // 4)]
    return [(rng.randrange(10 * n), rng.choice(some), rng.choice(["a", "b", None, ""])) for _ in range(n)]


@pytest.mark.parametrize("kw", [{"texts": 2, "files_per_batch": 1}, {"texts": 50, "files_per_batch": 2, "window": 7}])
def test_smaller_ids_that_come_later_retract(spark, workdir, kw):
    """A file a batch, ids falling from batch to batch, so nearly every batch retracts."""
    docs = sorted(texts(240, 1), key=lambda d: -d[0])
    docs += [(None, docs[0][1], "a"), (None, docs[0][1], "c"), (5, docs[0][1], None), (5, docs[0][1], None), (5, docs[0][1], "d")]
    path = f"{workdir}/documents.parquet"
    for k in range(0, len(docs), 50):
        spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in docs[k:k + 50]], DOCS).coalesce(1).write.mode("append").parquet(path)
    labels = [(d[0], k % 2, k % 3 == 0) for k, d in enumerate(docs[::2])]
    labels = [(i, q, int(t)) for i, q, t in labels] + [(5, 0, 1), (5, 1, None), (None, 1, 1)]
    check(spark, path, docs, labels, **kw)


def test_odd_documents(spark, workdir, odd_docs):
    path = f"{workdir}/documents.parquet"
    odd_docs.write.parquet(path)
    docs = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]
    check(spark, path, docs, [(5, 1, 0), (100, None, 1)])


def test_empty_table(spark, workdir, no_docs):
    path = f"{workdir}/documents.parquet"
    no_docs.write.parquet(path)
    assert audit.audit(spark, path, spark.createDataFrame([], LABELS)).collect() == []
