"""Adaptive quadrature of any posterior with 1 to 3 parameters, given by its log density.

Parameters are mapped to the whole line (positive ones by log, those in (0, 1) by logit; the
Jacobian is added), where the trapezoid rule converges exponentially for smooth
densities.  Every group is one row that holds its sufficient statistics and, per parameter,
a range; a pass evaluates the log density on the product grid as an array in that row
and moves each range: out where mass lies at an end, in to where the mass is.  A group is
settled when on every axis the nodes are at most ``SD_STEP`` conditional sds apart (for a ridge of
strongly correlated parameters the conditional sd is what a node must resolve).  Nothing per group passes
through the driver, which only counts unsettled groups; one that does not settle, or a
ridge that would need more than ``MOST`` nodes, is an error.

Means and sds are sums over the settled grid.  For each parameter one more
pass takes ``CELLS`` cells on its axis and the settled nodes on the others; the marginal density on those
cells gives the median, the 94 % HDI and the curve.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayes_ops.operators.arrays import edge_cdf, let, narrowest, normalised, quantile_at, total
from bayes_ops.operators.materialize import reliable_checkpoint, spread_tasks

NODES = {1: 64, 2: 32, 3: 14}     # per axis while the ranges are sought
SD_STEP = 0.8
EDGE = 1e-10                      # weight of a node that counts when a range is narrowed
CELLS = 256
MOST = 1 << 17
LogDensity = Callable[[Mapping[str, Column]], Column]


@dataclass(frozen=True)
class Parameter:
    """``support``: "real", "positive" or "unit"; ``start``: first range on the whole line (of log or logit)."""
    name: str
    support: str = "real"
    start: tuple[float, float] = (-12.0, 12.0)

    def value(self, z: Column) -> Column:
        return {"real": z, "positive": F.exp(z), "unit": F.lit(1.0) / (1.0 + F.exp(-z))}[self.support]

    def log_slope(self, z: Column) -> Column:
        """log of d value / d z."""
        return {"real": F.lit(0.0), "positive": z, "unit": -F.log1p(F.exp(-z)) - F.log1p(F.exp(z))}[self.support]


def _axes(parameters: Sequence[Parameter]) -> list[str]:
    if not 1 <= len(parameters) <= 3:
        raise ValueError("the grid takes 1 to 3 parameters")
    return [str(j) for j in range(len(parameters))]


def _step(j: str) -> Column:
    return (F.col(f"hi{j}") - F.col(f"lo{j}")) / F.col(f"n{j}")


def _nodes(parameters: Sequence[Parameter], logp: LogDensity, sizes: Sequence[Column]) -> Column:
    """The product grid as an array of (lp, k: index per axis, z: place per axis); lp of a density of zero is -1e300."""
    axes, count = _axes(parameters), sizes[0]
    for s in sizes[1:]:
        count = count * s

    def node(flat: Column) -> Column:
        ks, rest = [], flat
        for s in reversed(sizes):
            ks.insert(0, F.pmod(rest, s))
            rest = F.floor(rest / s).cast("int")

        def at(k: Column) -> Column:
            zs = F.array(*[F.col(f"lo{j}") + (k[int(j)] + F.lit(0.5)) * (F.col(f"hi{j}") - F.col(f"lo{j}")) / sizes[int(j)]
                           for j in axes])

            def density(z: Column) -> Column:
                lp = logp({p.name: p.value(z[int(j)]) for j, p in zip(axes, parameters)})
                for j, p in zip(axes, parameters):
                    lp = lp + p.log_slope(z[int(j)])
                return let(lp, lambda v: F.struct(F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(-1e300))
                                                  .otherwise(v).alias("lp"), k.alias("k"), z.alias("z")))
            return let(zs, density)
        return let(F.array(*ks), at)
    return F.transform(F.sequence(F.lit(0), count - 1), node)


def _weighted(nodes: Column) -> Column:
    return let(nodes, lambda ns: normalised(ns, lambda n: n["lp"], lambda n, w: F.struct(
        w.alias("w"), n["k"].alias("k"), n["z"].alias("z"))))


def _conditional_sds(axes: list[str]) -> list[Column]:
    """sd of each axis given the others, from the covariances c{i}{j} (1 / sqrt of the precision's diagonal)."""
    c = lambda i, j: F.col(f"c{min(i, j)}{max(i, j)}")
    if len(axes) == 1:
        return [F.sqrt(c("0", "0"))]
    minor = lambda i, j: c(i, i) * c(j, j) - c(i, j) * c(i, j)
    if len(axes) == 2:
        # one node may hold all weight on an axis (of variance 0 then, with no covariance)
        return [F.when(c(o, o) > 0, F.sqrt(F.greatest(minor("0", "1"), F.lit(0.0)) / c(o, o))).otherwise(F.sqrt(c(j, j)))
                for j, o in (("0", "1"), ("1", "0"))]
    det = (c("0", "0") * minor("1", "2") - c("0", "1") * (c("0", "1") * c("2", "2") - c("1", "2") * c("0", "2"))
           + c("0", "2") * (c("0", "1") * c("1", "2") - c("1", "1") * c("0", "2")))
    return [F.sqrt(F.greatest(det, F.lit(0.0)) / F.greatest(minor(i, j), F.lit(1e-300))) for i, j in (("1", "2"), ("0", "2"), ("0", "1"))]


def settle(stats: DataFrame, parameters: Sequence[Parameter], logp: LogDensity, max_passes: int = 60) -> DataFrame:
    """``stats`` (one row per group) with lo, hi, n of every axis, settled."""
    axes = _axes(parameters)
    first = stats
    for j, p in zip(axes, parameters):
        first = first.withColumns({f"lo{j}": F.lit(float(p.start[0])), f"hi{j}": F.lit(float(p.start[1])), f"n{j}": F.lit(NODES[len(axes)])})
    groups = reliable_checkpoint(first.withColumn("done", F.lit(False)))
    tasks = spread_tasks(groups)
    for _ in range(max_passes):
        todo = groups.where(~F.col("done")).repartition(tasks)
        seen = reliable_checkpoint(todo.withColumn("nodes", _weighted(_nodes(parameters, logp, [F.col(f"n{j}") for j in axes]))))
        heavy = lambda j: F.transform(F.filter("nodes", lambda n: n["w"] > EDGE), lambda n: n["k"][int(j)])
        seen = seen.withColumns({f"m{j}": total(F.col("nodes"), lambda n, j=j: n["w"] * n["z"][int(j)]) for j in axes})
        seen = reliable_checkpoint(seen)
        seen = seen.withColumns({f"c{i}{j}": total(F.col("nodes"), lambda n, i=i, j=j: n["w"] * (n["z"][int(i)] - F.col(f"m{i}")) * (
            n["z"][int(j)] - F.col(f"m{j}"))) for i in axes for j in axes if i <= j})
        seen = seen.withColumns({k: v for j in axes for k, v in ((f"a{j}", F.array_min(heavy(j))), (f"b{j}", F.array_max(heavy(j))))})
        seen = reliable_checkpoint(seen.drop("nodes"))
        moved, fit, moving, sds = {}, F.lit(True), F.lit(False), dict(zip(axes, _conditional_sds(axes)))
        for j in axes:
            at_lo, at_hi, width = F.col(f"a{j}") == 0, F.col(f"b{j}") == F.col(f"n{j}") - 1, F.col(f"hi{j}") - F.col(f"lo{j}")
            lo = F.when(at_lo, F.col(f"lo{j}") - 2 * width).otherwise(F.col(f"lo{j}") + (F.col(f"a{j}") - 1) * _step(j))
            hi = F.when(at_hi, F.col(f"hi{j}") + 2 * width).otherwise(F.col(f"lo{j}") + (F.col(f"b{j}") + 2) * _step(j))
            moved |= {f"lo{j}": lo, f"hi{j}": hi}
            fit = fit & ~at_lo & ~at_hi & (sds[j] >= F.lit(SD_STEP) * _step(j))
            moving = moving | at_lo | at_hi | (hi - lo < 0.75 * width)
        # a range that no longer narrows although its nodes are too far apart is a ridge: more nodes.
        # Apart from a range that moves out, nodes never get farther apart, so this ends.
        for j in axes:
            width, least = moved[f"hi{j}"] - moved[f"lo{j}"], F.lit(NODES[len(axes)])
            at_end = (F.col(f"a{j}") == 0) | (F.col(f"b{j}") == F.col(f"n{j}") - 1)
            wanted = F.ceil(width / (F.lit(SD_STEP) * sds[j])).cast("int")
            kept = F.ceil(width / _step(j)).cast("int")
            finer = F.when(sds[j] < F.lit(SD_STEP) * _step(j), kept * 2).otherwise(kept)
            moved[f"n{j}"] = F.when(fit, F.greatest(wanted, least)).when(at_end, F.col(f"n{j}")).when(
                moving, F.greatest(kept, least)).otherwise(F.greatest(finer, least))
        moved["done"] = fit
        groups = reliable_checkpoint(groups.where("done").unionByName(seen.withColumns(moved).select(*groups.columns)).repartition(tasks))
        left = groups.where(~F.col("done"))
        count = F.lit(1.0)
        for j in axes:
            count = count * F.col(f"n{j}")
        if not groups.where(count > MOST).isEmpty():
            raise RuntimeError(f"the parameters are too strongly correlated: over {MOST} nodes would be needed")
        if left.isEmpty():
            return groups
    raise RuntimeError(f"{groups.where(~F.col('done')).count()} groups did not settle in {max_passes} passes")


def _marginals(groups: DataFrame, parameters: Sequence[Parameter], logp: LogDensity, keys: Sequence[str], cells: int) -> DataFrame:
    """(keys, param, p, lo, hi, m): per parameter the marginal mass on ``cells`` cells of its axis, and the moments."""
    axes, out = _axes(parameters), None
    for j, p in zip(axes, parameters):
        sizes = [F.lit(cells) if i == j else F.col(f"n{i}") for i in axes]
        # the axis comes first, so the nodes of one of its cells lie together
        order = [int(j), *[int(i) for i in axes if i != j]]
        names = [parameters[k] for k in order]
        renamed = groups
        for new, old in zip(axes, order):
            renamed = renamed.withColumns({f"_{c}{new}": F.col(f"{c}{old}") for c in ("lo", "hi", "n")})
        renamed = renamed.drop(*[f"{c}{i}" for i in axes for c in ("lo", "hi", "n")])
        for i in axes:
            renamed = renamed.withColumnsRenamed({f"_{c}{i}": f"{c}{i}" for c in ("lo", "hi", "n")})
        rest = F.lit(1)
        for i in axes[1:]:
            rest = rest * F.col(f"n{i}")
        sizes = [F.lit(cells), *[F.col(f"n{i}") for i in axes[1:]]]
        weighted = reliable_checkpoint(renamed.repartition(spread_tasks(groups)).withColumn("rest", rest).withColumn("nodes", F.transform(
            _weighted(_nodes(names, logp, sizes)), lambda n: F.struct(n["w"].alias("w"), n["z"][0].alias("z")))))
        m = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: total(
            F.slice("nodes", i * F.col("rest") + 1, F.col("rest")), lambda n: n["w"]))
        mean = total(F.col("nodes"), lambda n, p=p: n["w"] * p.value(n["z"]))
        one = reliable_checkpoint(weighted.withColumn("m", m).withColumn("mean", mean))
        sd = F.sqrt(total(F.col("nodes"), lambda n, p=p: n["w"] * (p.value(n["z"]) - F.col("mean")) * (p.value(n["z"]) - F.col("mean"))))
        one = one.withColumn("sd", sd).select(
            *keys, F.lit(p.name).alias("param"), F.lit(p.support).alias("support"), F.col("lo0").alias("lo"), F.col("hi0").alias("hi"),
            "m", "mean", "sd")
        out = one if out is None else out.unionByName(one)
    return reliable_checkpoint(out)


def _by_support(z: Column, what: str) -> Column:
    each = {s: getattr(Parameter("", s), what)(z) for s in ("real", "positive", "unit")}
    return F.when(F.col("support") == "positive", each["positive"]).when(F.col("support") == "unit", each["unit"]).otherwise(each["real"])


def summaries(stats: DataFrame, keys: Sequence[str], parameters: Sequence[Parameter], logp: LogDensity,
              cells: int = CELLS) -> DataFrame:
    """(keys, param, mean, sd, median, hdi_3, hdi_97) of the posterior of every row of ``stats``."""
    rows = _marginals(settle(stats, parameters, logp), parameters, logp, list(keys), cells)
    place = lambda u: F.col("lo") + u * (F.col("hi") - F.col("lo")) / F.lit(float(cells))
    # density in x: that on the line divided by the slope there
    f = F.transform("m", lambda m, i: m * F.exp(-_by_support(place(i + F.lit(0.5)), "log_slope")))
    rows = reliable_checkpoint(rows.withColumn("f", f).withColumn("cdf", edge_cdf(F.col("m"))))
    value = lambda u: _by_support(place(u), "value")
    hdi = F.transform(narrowest(F.col("f"), F.col("cdf")), value)
    rows = rows.withColumn("median", let(quantile_at(F.col("cdf"), F.lit(0.5)), value)).withColumn("hdi", hdi)
    return rows.select(*keys, "param", "mean", "sd", "median", F.col("hdi")[0].alias("hdi_3"), F.col("hdi")[1].alias("hdi_97"))


def curves(stats: DataFrame, keys: Sequence[str], parameters: Sequence[Parameter], logp: LogDensity, cells: int = CELLS) -> DataFrame:
    """(keys, param, i, x, y): marginal density of every parameter at its cells."""
    rows = _marginals(settle(stats, parameters, logp), parameters, logp, list(keys), cells)
    dz = (F.col("hi") - F.col("lo")) / F.lit(float(cells))
    points = rows.select(*keys, "param", "support", "lo", "hi", F.posexplode("m").alias("i", "m"))
    z = F.col("lo") + (F.col("i") + F.lit(0.5)) * dz
    return points.select(*keys, "param", "i", _by_support(z, "value").alias("x"),
                         (F.col("m") / dz * F.exp(-_by_support(z, "log_slope"))).alias("y"))
