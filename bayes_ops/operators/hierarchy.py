"""Two-parameter hyper-posteriors of pooled groups, one row per group.

A group pools units (variants, cohorts).  Its hyper log posterior is a sum of
one term per unit plus a prior, over an outer parameter o (log concentration or log
shape) and an inner one x (logit or log of the mean rate), both on the whole line.
The trapezoid rule on such a plane converges exponentially, so few nodes do: outer rows at
most ``STEP`` apart, and within a row inner nodes at a fraction of the width that
the units' information on x gives at that o.

Units of a group are kept as arrays of about ``CHUNK``; node sums are array
functions over (units, nodes) in the chunk's row, and only groups of several chunks add theirs up
by node.  So there is no row per (unit, node), and a group with any number of units
is spread over as many rows as it has chunks.

The outer range starts wide (``Model.outer``), moves out while mass lies at an
end, and narrows to where the mass is until its sd spans a step; a range that does not
settle is an error.  The range of each group is a row of a checkpointed table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayes_ops.operators.arrays import let, normalised, total
from bayes_ops.operators.joins import join_groups
from bayes_ops.operators.materialize import reliable_checkpoint, spread_tasks

CHUNK = 256
LOCATE_ROWS = 64
STEP = 0.5            # outer step at most; the half-Cauchy priors have poles pi / 2 off the line
SD_STEP = 0.7         # and at most this part of the marginal sd
EDGE = 1e-13          # weight of a node that counts when the range is narrowed
DROP = 1e-13          # nodes of less weight are left out of the mixtures


@dataclass(frozen=True)
class Model:
    """Column builders.  ``u`` is a unit's struct; group constants are columns of the group's row."""
    consts: Callable[[], list[Column]]                      # aggregates over units, aliased
    outer: Callable[[], tuple[Column, Column]]              # first range of o, from the constants
    info: Callable[[Column, Column], tuple[Column, Column]]   # (u, o) -> information weight, weight * estimate
    inner: Callable[[Column, Column, Column], tuple[Column, Column, Column]]   # (o, weights, estimates) -> lo, hi, information
    row_term: Callable[[Column, Column], Column]            # (u, o) -> part of the term that x does not enter
    term: Callable[[Column, Column, Column], Column]        # (u, o, x)
    prior: Callable[[Column, Column], Column]               # (o, x), Jacobian included


def chunks_of(units: DataFrame, fields: list[str]) -> DataFrame:
    """(g, parts, units): arrays of about CHUNK unit structs."""
    sizes = units.groupBy("g").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    x = join_groups(units, sizes, ["g"])
    part = F.pmod(F.xxhash64("unit"), F.col("parts"))
    return x.groupBy("g", "parts", part.alias("part")).agg(F.collect_list(F.struct(*fields)).alias("units")).drop("part")


def _summed(chunks: DataFrame, groups: DataFrame, partial: Column) -> DataFrame:
    """``groups`` with ``sums``: the arrays ``partial`` of a group's chunks added up by position."""
    x = join_groups(chunks, groups, ["g"]).select("g", "parts", partial.alias("sums"))
    one = x.where("parts = 1").select("g", "sums")
    by_pos = x.where("parts > 1").select("g", F.posexplode("sums").alias("pos", "v")).groupBy("g", "pos").agg(F.sum("v").alias("v"))
    many = by_pos.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("sums"))
    return join_groups(groups, one.unionByName(many), ["g"])


def _rows(chunks: DataFrame, groups: DataFrame, model: Model, fine: float) -> DataFrame:
    """``groups`` (g, lo, hi, n, ..) with ``rows``: (i, o, lo, h, m) of every outer row, m inner nodes from lo, h apart."""
    def outer(i: Column) -> Column:
        return F.col("lo") + (i + F.lit(0.5)) * (F.col("hi") - F.col("lo")) / F.col("n")

    every = F.sequence(F.lit(0), F.col("n") - 1)
    pairs = F.flatten(F.transform(every, lambda i: let(outer(i), lambda o: F.array(
        total(F.col("units"), lambda u: model.info(u, o)[0]), total(F.col("units"), lambda u: model.info(u, o)[1])))))

    def row(i: Column) -> Column:
        def shape(o: Column) -> Column:
            lo, hi, info = model.inner(o, F.get("sums", 2 * i), F.get("sums", 2 * i + 1))
            h = F.least(F.lit(0.5), F.lit(fine) / F.sqrt(info))
            return F.struct(i.alias("i"), o.alias("o"), lo.alias("lo"), h.alias("h"), F.ceil((hi - lo) / h).cast("int").alias("m"))
        return let(outer(i), shape)
    return _summed(chunks, groups, pairs).withColumn("rows", F.transform(every, row)).drop("sums")


def _weights(chunks: DataFrame, groups: DataFrame, model: Model) -> DataFrame:
    """``groups`` (with ``rows``) with ``nodes``: (i, o, x, h, w), weights adding up to one."""
    def inner(r: Column) -> Column:
        return F.sequence(F.lit(0), r["m"] - 1)

    def of_row(r: Column) -> Column:
        return let(total(F.col("units"), lambda u: model.row_term(u, r["o"])), lambda base: F.transform(
            inner(r), lambda j: let(r["lo"] + (j + F.lit(0.5)) * r["h"], lambda x: base + total(
                F.col("units"), lambda u: model.term(u, r["o"], x)))))

    nodes = F.flatten(F.transform("rows", lambda r: F.transform(inner(r), lambda j: F.struct(
        r["i"].alias("i"), r["o"].alias("o"), (r["lo"] + (j + F.lit(0.5)) * r["h"]).alias("x"), r["h"].alias("h")))))

    def weighted(ns: Column) -> Column:
        return normalised(ns, lambda n: n["lp"], lambda n, w: F.struct(
            n["i"].alias("i"), n["o"].alias("o"), n["x"].alias("x"), n["h"].alias("h"), w.alias("w")))

    got = _summed(chunks, groups, F.flatten(F.transform("rows", of_row)))
    with_lp = F.zip_with(nodes, "sums", lambda n, s: F.struct(
        n["i"].alias("i"), n["o"].alias("o"), n["x"].alias("x"), n["h"].alias("h"),
        (s + model.prior(n["o"], n["x"]) + F.log(n["h"])).alias("lp")))
    return got.withColumn("nodes", let(with_lp, weighted)).drop("sums", "rows")


def hyper_nodes(units: DataFrame, fields: list[str], model: Model, fine: float = 0.3,
                max_passes: int = 40) -> DataFrame:
    """(g, nodes): the hyper-posterior of every group of ``units`` (g, unit, fields) as weighted nodes (o, x, h, w)."""
    chunks = reliable_checkpoint(chunks_of(units, fields))
    groups = units.groupBy("g").agg(*model.consts())
    keep = [c for c in groups.columns if c != "g"]
    lo, hi = model.outer()
    groups = reliable_checkpoint(groups.withColumn("lo", lo).withColumn("hi", hi)
                                 .withColumn("n", F.lit(LOCATE_ROWS)).withColumn("done", F.lit(False)))
    tasks = spread_tasks(groups)
    width, step = F.col("hi") - F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("n")
    for _ in range(max_passes):
        todo = groups.where(~F.col("done"))
        nodes = reliable_checkpoint(_weights(chunks, reliable_checkpoint(_rows(chunks, todo, model, 1.0)), model))
        heavy = F.transform(F.filter("nodes", lambda n: n["w"] > EDGE), lambda n: n["i"])
        seen = nodes.select("g", *keep, "lo", "hi", "n", F.array_min(heavy).alias("i0"), F.array_max(heavy).alias("i1"),
                            total(F.col("nodes"), lambda n: n["w"] * n["o"]).alias("m1"),
                            total(F.col("nodes"), lambda n: n["w"] * n["o"] * n["o"]).alias("m2"))
        sd = F.sqrt(F.greatest(F.col("m2") - F.col("m1") * F.col("m1"), F.lit(0.0)))
        at_lo, at_hi = F.col("i0") == 0, F.col("i1") == F.col("n") - 1
        lo = F.when(at_lo, F.col("lo") - width / 2).otherwise(F.col("lo") + (F.col("i0") - 1) * step)
        hi = F.when(at_hi, F.col("hi") + width / 2).otherwise(F.col("lo") + (F.col("i1") + 2) * step)
        settled = ~at_lo & ~at_hi & (sd >= F.lit(SD_STEP) * step)
        rows = F.ceil((hi - lo) / F.least(F.lit(STEP), F.lit(SD_STEP) * sd)).cast("int")
        moved = seen.select("g", *keep, lo.alias("lo"), hi.alias("hi"),
                            F.when(settled, rows).otherwise(F.lit(LOCATE_ROWS)).alias("n"), settled.alias("done"))
        groups = reliable_checkpoint(groups.where("done").unionByName(moved).repartition(tasks))
        if groups.where(~F.col("done")).isEmpty():
            last = reliable_checkpoint(_rows(chunks, groups, model, fine))
            out = _weights(chunks, last, model)
            return reliable_checkpoint(out.select("g", F.filter("nodes", lambda n: n["w"] > DROP).alias("nodes")))
    raise RuntimeError(f"the outer ranges of {groups.where(~F.col('done')).count()} groups did not settle in {max_passes} passes")


def mixture_density(comps: Column, xs: Column, logpdf: Callable[[Column, Column], Column]) -> Column:
    """Density at every x of ``xs`` of components (w, m, sd, r, ..): sum of w * pdf * correction.

    Nodes are h apart, so a component narrower than that would be a spike between the cells.  Its pdf is
    taken with sd at 0.7 node steps and corrected by 1 + (r - 1)(z^2 - 1) / 2, z in those
    sds and r the ratio of the true variance to that one, which leaves the second moment right."""
    return F.transform(xs, lambda x: F.greatest(F.lit(0.0), total(comps, lambda c: c["w"] * F.exp(logpdf(c, x)) * F.when(
        c["r"] >= 1, F.lit(1.0)).otherwise(let((x["x"] - c["m"]) / c["sd"], lambda z: 1.0 + (c["r"] - 1.0) * (z * z - 1.0) / 2.0)))))
