"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document's metrics are computed natively from its whole text.  The sketch
of a metric is its histogram over values rounded down to 7 significant bits
(integer arithmetic, relative error below 1/64 at any magnitude): sketches
merge by adding counts, so they are partial aggregates, the result does not
depend on the order of rows, and a reader of SQL can reproduce it.

Sketches are kept per (lang, source); merged over the sources of a language
and over everything they give the thresholds of groups with fewer than
``MIN_DOCS`` documents.  A threshold is a far-out fence of the group's own
distribution, Q75 + 3 * spread or Q25 - 3 * spread, where spread is Q75 - Q25
or the metric's least spread if that is larger (so that a group in which
nearly all documents have the value 0 does not reject the first that has not).
Documents are joined with their group's fences and kept if all hold.

Defined results: a null or empty text has no words and fails the base rule;
null lang and null source are groups of their own; documents that fail the
base rule take no part in the sketches; rows that repeat a doc_id are judged
each by itself; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bayes_ops.llm.common import let, spill, words

MIN_DOCS = 50
FENCE = 3
RUN = 5                  # words of a repeated run

# metric -> (least spread, side on which it rejects); integer units as in `metrics`
RULES = {
    "word_length": (500, "both"),       # code points per 1000 words
    "symbols": (30, "high"),            # symbols per 1000 words
    "dup_lines": (100, "high"),         # repeated lines per 1000 lines
    "repeats": (60, "high"),            # words in repeated runs per 1000 words
}


def _repeat_words(w: Column) -> Column:
    """Words inside a run of RUN words that occurs twice or more (first included)."""
    last = F.size(w) - RUN
    at = lambda: F.sequence(F.lit(0), last)
    hashed = F.transform(at(), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(RUN)]))
    runs = F.sort_array(F.transform(at(), lambda i: F.struct(
        F.concat_ws(" ", *[F.get(w, i + k) for k in range(RUN)]).alias("g"), i.alias("p"))))

    def covered(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"]))
        return let(F.sort_array(F.transform(same, lambda x: x["p"])), lambda p: F.when(F.size(p) > 0, F.aggregate(
            F.sequence(F.lit(1), F.size(p) - 1), F.lit(RUN), lambda n, k: n + F.when(
                F.size(p) > k, F.coalesce(F.least(F.lit(RUN), F.get(p, k) - F.get(p, k - 1)), F.lit(0))).otherwise(0)))
            .otherwise(0))

    distinct = let(hashed, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    # runs whose hashes all differ all differ; else they are compared as they are
    return F.when(F.size(w) <= RUN, 0).when(distinct, 0).otherwise(let(runs, covered)).cast("long")


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the rule metrics of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    d = docs.select(
        "doc_id", "lang", "source", of_words.alias("_w"), of_lines.alias("_l"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    d = d.select("doc_id", "lang", "source", "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines",
                 "_w.n_repeat_words", "_l.n_lines")
    return d.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def with_rules(d: DataFrame) -> DataFrame:
    return d.withColumns({
        "word_length": F.expr("1000 * word_chars div greatest(n_words, 1)"),
        "symbols": F.expr("1000 * n_symbols div greatest(n_words, 1)"),
        "dup_lines": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
        "repeats": F.expr("1000 * n_repeat_words div greatest(n_words, 1)")})


def sketches(d: DataFrame) -> DataFrame:
    """lang, source, metric, bucket -> n: the mergeable sketch of each metric."""
    long = d.filter("not base_failed").select(
        "lang", "source", F.explode(F.create_map(*[x for m in RULES for x in (F.lit(m), F.col(m))])).alias("metric", "v"))
    shift = "greatest(length(bin(v)) - 7, 0)"
    return (long.withColumn("bucket", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})"))
            .groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n")))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """n, q25, q75 of each (keys, metric): sketches merged, then read off."""
    by = [*keys, "metric"]
    merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    run = W.partitionBy(*by).orderBy("bucket")
    c = merged.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(W.partitionBy(*by)))
    return c.groupBy(*by).agg(
        F.max("all").alias("n"),
        F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("bucket"))).alias("q25"),
        F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, F.col("bucket"))).alias("q75"))


def fences(sketch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source -> <metric>_low, <metric>_high."""
    own = quartiles(sketch, ["lang", "source"]).alias("o")
    lang = quartiles(sketch, ["lang"]).alias("l")
    every = quartiles(sketch, []).alias("e")
    same = (F.col("o.metric") == F.col("l.metric")) & F.col("o.lang").eqNullSafe(F.col("l.lang"))
    j = own.join(lang, same).join(every, F.col("o.metric") == F.col("e.metric"))

    def pick(q: str) -> Column:
        return (F.when(F.col("o.n") >= min_docs, F.col(f"o.{q}")).when(F.col("l.n") >= min_docs, F.col(f"l.{q}"))
                .otherwise(F.col(f"e.{q}")))

    j = j.select("o.lang", "o.source", "o.metric", pick("q25").alias("q25"), pick("q75").alias("q75"))
    out = []
    for m, (least, side) in RULES.items():
        spread = F.greatest(F.col("q75") - F.col("q25"), F.lit(least))
        here = F.col("metric") == m
        if side != "low":
            out.append(F.max(F.when(here, F.col("q75") + FENCE * spread)).alias(f"{m}_high"))
        if side != "high":
            out.append(F.max(F.when(here, F.col("q25") - FENCE * spread)).alias(f"{m}_low"))
    return j.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the failed rules of every row."""
    d = spill(with_rules(metrics(docs)), "metrics")
    f = spill(fences(sketches(d), min_docs), "fences").alias("f")
    j = d.alias("d").join(f, F.col("d.lang").eqNullSafe(F.col("f.lang"))
                          & F.col("d.source").eqNullSafe(F.col("f.source")), "left")
    bad = []
    for m, (_, side) in RULES.items():
        if side != "low":
            bad.append(F.when(F.col(m) > F.col(f"{m}_high"), F.lit(f"{m}_high")))
        if side != "high":
            bad.append(F.when(F.col(m) < F.col(f"{m}_low"), F.lit(f"{m}_low")))
    j = j.withColumn("failed", F.concat_ws(",", *bad))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "failed")
