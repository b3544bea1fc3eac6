"""URL filter: domain rules first, then logistic regression on character n-grams.

The model is a logistic regression on hashed character 3- and 4-grams of host
and path, trained from a small labelled URL table (url, label: 1 is block;
at most ``MAX_LABELLED`` rows), by default one made from named hosts; ``held_out`` and ``measured``
give its precision and recall on hosts that it was not trained on.  A gram falls into one of ``DIMS`` cells by
its code points; the weights are a literal array of the plan, so scoring is
one native projection without join or shuffle.

Rules are (verdict, host/path): a rule fits its host and all subdomains if
the url's path starts with the rule's; the longest rule wins.  They are a
short list, held in the plan.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule and gets the model's verdict of the empty strings; repeated rows
are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayes_ops.llm.common import let

DIMS = 2048
GRAMS = (3, 4)
MAX_LABELLED = 10_000

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/")]

# Parts of the small labelled URL table (fixed values): words of hosts of either label, neutral words that stand
# beside them, what stands before a host, its domains and paths.
BLOCK_WORDS = "casino slots poker bets prizes pills meds viagra ads clicks banner tracker spam seo-links farm-links adult xxx singles".split()
ALLOW_WORDS = ("library museum weather recipes journal history physics gardening university archive encyclopedia novels dictionary "
               "council railways mountain orchestra painting woodwork astronomy school parliament translation cooking thunder "
               "otherwise northern therapy nation station motion fashion winter farmhouse trackside adventure window freedom "
               "clicker adulthood betterment address").split()
BESIDE = "online free win cheap best club world daily home city".split()
PREFIXES = ["", "www.", "blog.", "m."]
DOMAINS = ["example.com", "example.net", "example.org", "org", "net"]
PATHS = ["/en/{n}", "/de/{n}/", "/fr/{n}.html", "/es/{n}", "/page/{n}/index.html", "/", "/{n}/today"]


def labelled_urls(beside: int = 4, each: int = 3) -> list[tuple[str, int]]:
    """The labelled table (1: block): every word with several neutral ones before and after it, each such host
    with several prefixes, domains and paths; allowed words stand alone as well."""
    out = []
    for label, ws in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)):
        for i, w in enumerate(ws):
            near = [BESIDE[(3 * i + k) % len(BESIDE)] for k in range(beside)]
            hosts = [f"{w}-{b}" if k % 2 else f"{b}-{w}" for k, b in enumerate(near)] + ([] if label else [w])
            for j, host in enumerate(hosts):
                for k in range(each):
                    at = i + 2 * j + 5 * k
                    path = PATHS[at % len(PATHS)].format(n=(37 * at + 101 * k) % 1000)
                    out.append((f"{'https' if at % 3 else 'http'}://{PREFIXES[at % 4]}{host}.{DOMAINS[(at + k) % 5]}{path}", label))
    return out


LABELLED = labelled_urls()


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def split_url(url: str | None) -> tuple[str, str]:
    """The same in Python, for the labelled table."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    end = min([i for i in (rest.find(c, cut) for c in "?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, rest[cut:end]


def cells(host: str, path: str) -> list[int]:
    codes = [ord(c) for c in f"^{host}$^{path}$"]
    out = []
    for n in GRAMS:
        for i in range(len(codes) - n + 1):
            h = n
            for c in codes[i:i + n]:
                h = (h * 131 + c) % 1_000_003
            out.append(h % DIMS)
    return out


def train(labelled: list[tuple[str, int]], rounds: int = 3000, rate: float = 8.0, ridge: float = 1e-5) -> tuple[list[float], float]:
    """Weights and bias by gradient descent on the driver (at most ``MAX_LABELLED`` rows; weights rounded to 6 digits)."""
    return _train(tuple(labelled), rounds, rate, ridge)


def held_out(labelled: list[tuple[str, int]], part: int = 4) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(to train on, to measure on): hosts whose crc32 mod ``part`` is 0 are held out whole, so a
    measured host was never seen."""
    out = lambda url: zlib.crc32(re.sub(r"^(www|blog|m)\.", "", split_url(url)[0]).split(".")[0].encode()) % part == 0
    return [r for r in labelled if not out(r[0])], [r for r in labelled if out(r[0])]


def measured(labelled: list[tuple[str, int]], weights: list[float], bias: float) -> dict[str, float]:
    """Precision and recall of blocking on a labelled table."""
    hits = Counter()
    for url, y in labelled:
        at = cells(*split_url(url))
        hits[y, bias + sum(weights[k] for k in at) / math.sqrt(max(len(at), 1)) >= 0] += 1
    return {"precision": hits[1, True] / max(1, hits[1, True] + hits[0, True]), "recall": hits[1, True] / max(1, hits[1, True] + hits[1, False])}


@functools.lru_cache(maxsize=8)
def _train(labelled: tuple[tuple[str, int], ...], rounds: int, rate: float, ridge: float) -> tuple[list[float], float]:
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled table has over {MAX_LABELLED} rows")
    x, y = np.zeros((len(labelled), DIMS)), np.array([label for _, label in labelled], float)
    for i, (url, _) in enumerate(labelled):
        at = cells(*split_url(url))
        np.add.at(x[i], at, 1 / math.sqrt(len(at)))
    w, b = np.zeros(DIMS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(b + x @ w)))
        w -= rate * ((p - y) @ x / max(1, len(y)) + ridge * w)
        b -= rate * float((p - y).mean() if len(y) else 0.0)
    return [round(float(v), 6) for v in w], round(b, 6)


def fits(host: Column, path: Column, rule: str) -> Column:
    h, _, p = rule.partition("/")
    return ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)


def block_score(host: Column, path: Column, weights: list[float], bias: float) -> Column:
    """Logit of blocking."""
    w = F.array(*[F.lit(v) for v in weights])
    codes = F.transform(F.split(F.concat(F.lit("^"), host, F.lit("$^"), path, F.lit("$")), ""), F.ascii)

    def add(c: Column, n: int):
        def body(a: Column, i: Column) -> Column:
            h = F.lit(n).cast("long")
            for k in range(n):
                h = (h * 131 + F.get(c, i + k)) % 1_000_003
            return a + F.get(w, (h % DIMS).cast("int"))
        return body

    def score(c: Column) -> Column:
        total, count = F.lit(0.0), F.lit(0)
        for n in GRAMS:
            starts = F.when(F.size(c) >= n, F.sequence(F.lit(0), F.size(c) - n)).otherwise(F.array().cast("array<int>"))
            total = total + F.aggregate(starts, F.lit(0.0), add(c, n))
            count = count + F.size(starts)
        return F.lit(bias) + total / F.sqrt(F.greatest(count, F.lit(1)))
    return let(F.filter(codes, lambda x: x > 0), score)


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES,
          labelled: list[tuple[str, int]] | DataFrame = LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row.

    ``labelled``: rows (url, label), or a table of them with at most ``MAX_LABELLED`` rows."""
    if isinstance(labelled, DataFrame):
        rows = labelled.select("url", F.col("label").cast("int")).orderBy("url", "label").limit(MAX_LABELLED + 1).collect()
        labelled = [(r[0], r[1]) for r in rows]
    weights, bias = train(labelled)
    host, path = host_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):       # the longest is asked first
        rule = F.when(fits(F.col("host"), F.col("path"), r), r).otherwise(rule)
        verdict = F.when(fits(F.col("host"), F.col("path"), r), v).otherwise(verdict)
    p = p.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"),
                 block_score(F.col("host"), F.col("path"), weights, bias).alias("score"))
    return p.select("page_id", "host", "path", "rule", F.coalesce(
        "ruled", F.when(F.col("score") >= 0, "block").otherwise("allow")).alias("verdict"), F.round("score", 4).alias("score"))
