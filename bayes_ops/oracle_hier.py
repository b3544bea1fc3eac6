"""DuckDB SQL of the hierarchical fits (P2, P7 for P2, P11): another quadrature of the same models.

Where the Spark plans place inner nodes by a range and a step, the SQL takes a fixed grid
of log concentration (log shape) and, on each of its rows, the substitution
z = centre + S sinh(v) with v on a fixed grid, so its nodes and weights have nothing in common with
theirs; ``lgamma`` is DuckDB's.  Densities are summed on cells of their own, quantiles are read off their
running sum, and the HDI is where the densities at both of its ends agree.  Both sides are rounded to
the digits stated at the registered query.
"""

from __future__ import annotations

from bayes_ops.sqlcheck import HDI, rnd

DK, DV, REACH, CELLS = 0.25, 0.06, 6.0, 1000
KEEP = 1e-10

_V = f"v AS (SELECT (r.range + 0.5) * {DV} - {REACH} AS v FROM range({int(2 * REACH / DV)}) r)"


def _sinh(v: str) -> str:
    return f"((exp({v}) - exp(-({v}))) / 2)"


def _cosh(v: str) -> str:
    return f"((exp({v}) + exp(-({v}))) / 2)"


def _on(keys: str, a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k.strip()} IS NOT DISTINCT FROM {b}.{k.strip()}" for k in keys.split(","))


def _of(keys: str, a: str) -> str:
    return ", ".join(f"{a}.{k.strip()}" for k in keys.split(","))


def _summary(keys: str, density: str) -> str:
    """CTEs from ``mom`` (keys, mean, sd, lo, hi) and ``comp`` (keys, w, ..) to ``qs`` (median, hdi_3, hdi_97)."""
    return f"""cell AS (SELECT {keys}, lo, (hi - lo) / {CELLS} AS dx, r.range AS j, lo + (r.range + 0.5) * (hi - lo) / {CELLS} AS x
         FROM mom CROSS JOIN range({CELLS}) r),
den AS (SELECT {_of(keys, "cell")}, j, any_value(cell.x) AS x, any_value(cell.dx) AS dx, any_value(cell.lo) AS lo, sum(w * exp({density})) AS f
        FROM cell JOIN comp ON {_on(keys, "cell", "comp")} GROUP BY {_of(keys, "cell")}, j),
{_quantiles(keys)}"""


def _quantiles(keys: str) -> str:
    """CTEs from a density on cells, ``den`` (keys, j, x, dx, lo, f), to ``qs`` (median, hdi_3, hdi_97)."""
    on = lambda a, b: _on(keys, a, b)
    k_of = lambda a: _of(keys, a)
    return f"""nrm AS (SELECT *, f / (sum(f) OVER k * dx) AS p FROM den WINDOW k AS (PARTITION BY {keys})),
edge AS (SELECT {keys}, j, lo + (j + 1) * dx AS e, dx, p, (p + lead(p) OVER o) / 2 AS fe,
           sum(p * dx) OVER o + (lead(p) OVER o - p) * dx / 24 AS c FROM nrm WINDOW o AS (PARTITION BY {keys} ORDER BY j)),
seg AS (SELECT *, lead(c) OVER o AS c_next, lead(fe) OVER o AS fe_next FROM edge WINDOW o AS (PARTITION BY {keys} ORDER BY j)),
want AS (SELECT {keys}, j AS i, e, fe, dx, c + {HDI} AS q FROM edge WHERE c <= {1 - HDI} AND fe IS NOT NULL
         UNION ALL SELECT DISTINCT {keys}, -1, NULL::DOUBLE, NULL::DOUBLE, dx, 0.5 FROM edge),
got AS (SELECT {k_of("want")}, i, want.e, want.fe,
          seg.e + seg.dx * t AS r, seg.fe + t * (seg.fe_next - seg.fe) AS fr
        FROM want JOIN seg ON {on("want", "seg")} AND q >= seg.c AND q < seg.c_next,
        LATERAL (SELECT (q - seg.c) / (seg.c_next - seg.c) AS s),
        LATERAL (SELECT s + (seg.fe_next - seg.fe) / (seg.fe_next + seg.fe) * s * (1 - s) AS t)),
med AS (SELECT {keys}, r AS median FROM got WHERE i = -1),
gap AS (SELECT *, fe - fr AS g, lead(fe - fr) OVER o AS g2, lead(e) OVER o AS e2, lead(r) OVER o AS r2
        FROM got WHERE i >= 0 WINDOW o AS (PARTITION BY {keys} ORDER BY i)),
hdi AS (SELECT {keys}, min(e - g * (e2 - e) / (g2 - g)) AS hdi_3, min(r - g * (r2 - r) / (g2 - g)) AS hdi_97
        FROM gap WHERE g < 0 AND g2 >= 0 GROUP BY {keys}),
qs AS (SELECT {k_of("med")}, median, hdi_3, hdi_97 FROM med JOIN hdi ON {on("med", "hdi")})"""


def _ab_nodes(ab: str) -> str:
    return f"""{ab},
st AS (SELECT variant, count(CAST(outcome AS BIGINT)) AS trials,
         CAST(sum(CASE WHEN outcome IS NOT NULL THEN CAST(outcome AS BIGINT) ELSE 0 END) AS BIGINT) AS successes
       FROM ab WHERE variant IS NOT NULL GROUP BY variant),
u AS (SELECT variant, CAST(successes AS DOUBLE) AS s, CAST(trials - successes AS DOUBLE) AS f FROM st),
top AS (SELECT 9.2 + ln(1 + max(s + f)) AS hi FROM u), {_V},
ks AS (SELECT -12 + (r.range + 0.5) * {DK} AS lk, exp(-12 + (r.range + 0.5) * {DK}) AS kap FROM top, range(400) r WHERE -12 + r.range * {DK} < hi),
rw AS (SELECT lk, kap, sum(w) AS w, sum(w * (s + 0.5) / (s + f + 1)) / sum(w) AS m
       FROM (SELECT *, 1 / (1 / (s + f + 1) + 1 / (kap + 1)) AS w FROM ks, u) GROUP BY lk, kap),
nd AS (SELECT lk, kap, ln(m / (1 - m)) + sc * {_sinh("v")} AS z, ln(sc * {_cosh("v")}) AS jac
       FROM (SELECT *, least(2, 0.7 / sqrt(w * m * (1 - m))) AS sc FROM rw), v),
ab2 AS (SELECT *, kap / (1 + exp(-z)) AS a, kap / (1 + exp(z)) AS b FROM nd),
lp AS (SELECT lk, z, any_value(a) AS a, any_value(b) AS b, any_value(jac) + 2 * lk - ln(1 + exp(-z)) - ln(1 + exp(z))
         - ln(1 + any_value(a) * any_value(a) / 100) - ln(1 + any_value(b) * any_value(b) / 100)
         + sum(lgamma(a + s) - lgamma(a) + lgamma(b + f) - lgamma(b) - lgamma(kap + s + f) + lgamma(kap)) AS lp
       FROM ab2, u GROUP BY lk, z),
hw AS (SELECT *, exp(lp - max(lp) OVER ()) / sum(exp(lp - (SELECT max(lp) FROM lp))) OVER () AS w FROM lp),
mx AS (SELECT variant, w, a + s AS ca, b + f AS cb, (a + s) / (a + b + s + f) AS m1 FROM hw, u),
mo AS (SELECT variant, sum(w * m1) AS mean, sum(w * m1 * (ca + 1) / (ca + cb + 1)) AS m2 FROM mx GROUP BY variant),
mom AS (SELECT variant, mean, sqrt(m2 - mean * mean) AS sd, greatest(0, mean - 10 * sqrt(m2 - mean * mean)) AS lo,
          least(1, mean + 10 * sqrt(m2 - mean * mean)) AS hi FROM mo),
comp AS (SELECT variant, w, ca, cb, lgamma(ca + cb) - lgamma(ca) - lgamma(cb) AS ln_b FROM mx WHERE w > {KEEP})"""


_BETA = "(ca - 1) * ln(x) + (cb - 1) * ln(1 - x) + ln_b"


def ab_posterior_sql(ab: str) -> str:
    return f"""WITH {_ab_nodes(ab)},
{_summary("variant", _BETA)}
SELECT st.variant, successes, trials, {rnd("mean")}, {rnd("sd")}, {rnd("median", 5)}, {rnd("hdi_3", 4)}, {rnd("hdi_97", 4)}
FROM st JOIN mom USING (variant) JOIN qs USING (variant)"""


def ab_curve_sql(ab: str, points: int) -> str:
    return f"""WITH {_ab_nodes(ab)},
xs AS (SELECT variant, CAST(r.range AS INTEGER) AS i, greatest(0, mean - 5 * sd) + (r.range + 0.5) * (least(1, mean + 5 * sd) - greatest(0, mean - 5 * sd)) / {points} AS x
       FROM mom CROSS JOIN range({points}) r),
ys AS (SELECT xs.variant, i, any_value(xs.x) AS x, sum(w * exp({_BETA.replace("ln(x)", "ln(xs.x)").replace("1 - x", "1 - xs.x")})) AS y
       FROM xs JOIN comp ON xs.variant = comp.variant GROUP BY xs.variant, i)
SELECT variant, i, {rnd("x")}, {rnd("y", 3)} FROM ys"""


def hier_poisson_sql(ev: str, start: str, end: str, exposure: float) -> str:
    return f"""WITH {ev},
u AS (SELECT event_type, cohort, count(*) AS n_events, CAST(count(*) AS DOUBLE) AS k, CAST({exposure} AS DOUBLE) AS t FROM ev
      WHERE timestamp >= {start} AND timestamp < {end} GROUP BY event_type, cohort),
g AS (SELECT event_type, (sum(k) + 0.5) / sum(t) AS m0, 9.2 + ln(1 + max(k)) AS hi FROM u GROUP BY event_type), {_V},
ks AS (SELECT event_type, m0, -12 + (r.range + 0.5) * {DK} AS la, exp(-12 + (r.range + 0.5) * {DK}) AS a
       FROM g, range(400) r WHERE -12 + r.range * {DK} < hi),
rw AS (SELECT event_type, la, a, sum(w) AS w, sum(w * k / t) / sum(w) AS m
       FROM (SELECT ks.*, k, t, 1 / (1 / a + 1 / (m0 * t)) AS w FROM ks JOIN u ON ks.event_type IS NOT DISTINCT FROM u.event_type)
       GROUP BY event_type, la, a),
nd AS (SELECT event_type, la, a, ln(m) + sc * {_sinh("v")} AS z, ln(sc * {_cosh("v")}) AS jac
       FROM (SELECT *, least(2, 0.7 / sqrt(w)) AS sc FROM rw), v),
b2 AS (SELECT *, exp(la - z) AS b FROM nd),
lp AS (SELECT b2.event_type, la, z, any_value(a) AS a, any_value(b) AS b,
         any_value(jac) + 2 * la - z - ln(1 + any_value(a) * any_value(a) / 100) - ln(1 + any_value(b) * any_value(b) / 100)
         + sum(lgamma(a + k) - lgamma(a) - a * ln(1 + t / b) - k * ln(1 + b / t)) AS lp
       FROM b2 JOIN u ON b2.event_type IS NOT DISTINCT FROM u.event_type GROUP BY b2.event_type, la, z),
tp AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY event_type)) AS e FROM lp),
hw AS (SELECT *, e / sum(e) OVER (PARTITION BY event_type) AS w FROM tp),
mx AS (SELECT u.event_type, u.cohort, w, a + k AS ca, b + t AS cb, (a + k) / (b + t) AS m1
       FROM hw JOIN u ON hw.event_type IS NOT DISTINCT FROM u.event_type WHERE w > 0),
mo AS (SELECT event_type, cohort, sum(w * m1) AS mean, sum(w * m1 * (ca + 1) / cb) AS m2 FROM mx GROUP BY event_type, cohort),
mom AS (SELECT event_type, cohort, mean, sqrt(m2 - mean * mean) AS sd, greatest(0, mean - 10 * sqrt(m2 - mean * mean)) AS lo,
          mean + 10 * sqrt(m2 - mean * mean) AS hi FROM mo),
comp AS (SELECT event_type, cohort, w, ca, cb, ca * ln(cb) - lgamma(ca) AS ln_g FROM mx WHERE w > {KEEP}),
{_summary("event_type, cohort", "(ca - 1) * ln(x) - cb * x + ln_g")}
SELECT u.event_type, u.cohort, n_events, {rnd("t").replace("AS t", "AS exposure")}, {rnd("mean", 5)}, {rnd("sd", 5)},
       {rnd("median", 4)}, {rnd("hdi_3", 2)}, {rnd("hdi_97", 2)}
FROM u JOIN mom ON u.event_type IS NOT DISTINCT FROM mom.event_type AND u.cohort IS NOT DISTINCT FROM mom.cohort
JOIN qs ON u.event_type IS NOT DISTINCT FROM qs.event_type AND u.cohort IS NOT DISTINCT FROM qs.cohort"""


def lognormal_sql(surv: str) -> str:
    """Two-parameter kind: log t ~ Normal(mu, sigma), mu ~ Normal(0, 10), sigma ~ HalfNormal(1), by sums on two plain grids."""
    lp = "-n * ln(s) - (q - 2 * m * l + n * m * m) / (2 * s * s) - m * m / 200 - s * s / 2"
    def axis(i: str, k: int) -> str:
        return f"lo{i} + (r{i}.range + 0.5) * (hi{i} - lo{i}) / {k}"
    def grid(name: str, km: int, ks: int) -> str:
        return (f"{name} AS (SELECT *, {lp} AS lp FROM (SELECT grp, n, l, q, r0.range AS jm, r1.range AS js, {axis('0', km)} AS m, {axis('1', ks)} AS s, "
                f"(hi0 - lo0) / {km} AS dm, (hi1 - lo1) / {ks} AS ds, lo0, lo1 FROM bx, range({km}) r0, range({ks}) r1))")
    return f"""WITH {surv},
st AS (SELECT observed AS grp, count(ln(duration)) AS n, sum(ln(duration)) AS l, sum(ln(duration) * ln(duration)) AS q FROM surv
       WHERE duration > 0 GROUP BY observed),
bx AS (SELECT *, l / n - 10 * sd / sqrt(n) AS lo0, l / n + 10 * sd / sqrt(n) AS hi0, sd * (1 - 10 / sqrt(2 * n)) AS lo1, sd * (1 + 10 / sqrt(2 * n)) AS hi1
       FROM (SELECT *, sqrt(q / n - (l / n) * (l / n)) AS sd FROM st)),
{grid("ga", 1200, 300)}, {grid("gb", 300, 1200)},
wa AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY grp)) AS w FROM ga), wb AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY grp)) AS w FROM gb),
mom AS (SELECT grp, 'mu' AS param, sum(w * m) / sum(w) AS mean, sqrt(sum(w * (m - l / n) * (m - l / n)) / sum(w) - pow(sum(w * (m - l / n)) / sum(w), 2)) AS sd FROM wa GROUP BY grp
        UNION ALL SELECT grp, 'sigma', sum(w * s) / sum(w), sqrt(sum(w * (s - lo1) * (s - lo1)) / sum(w) - pow(sum(w * (s - lo1)) / sum(w), 2)) FROM wb GROUP BY grp),
den AS (SELECT grp, 'mu' AS param, jm AS j, any_value(m) AS x, any_value(dm) AS dx, any_value(lo0) AS lo, sum(w) AS f FROM wa GROUP BY grp, jm
        UNION ALL SELECT grp, 'sigma', js, any_value(s), any_value(ds), any_value(lo1), sum(w) FROM wb GROUP BY grp, js),
{_quantiles("grp, param")}
SELECT mom.grp AS observed, mom.param, {rnd("mean")}, {rnd("sd")}, {rnd("median", 5)}, {rnd("hdi_3", 4)}, {rnd("hdi_97", 4)}
FROM mom JOIN qs ON mom.grp = qs.grp AND mom.param = qs.param"""


def _weibull_den(surv: str) -> str:
    """CTEs to ``den`` and ``mom`` of the Weibull marginals: S from the counts of equal durations, alpha and beta on plain grids."""
    lp = "r * ln(a) - r * a * ln(b) + (a - 1) * l - exp(ls + a * ln(c / b)) - a * a / 2 - b * b / 200"
    return f"""{surv},
hs AS (SELECT duration AS t, count(*) AS k FROM surv WHERE duration IS NOT NULL AND observed IS NOT NULL GROUP BY duration),
st AS (SELECT count(*) AS n, CAST(sum(CASE WHEN observed THEN 1 ELSE 0 END) AS BIGINT) AS r, sum(CASE WHEN observed THEN ln(duration) END) AS l,
         max(duration) AS c FROM surv WHERE duration IS NOT NULL AND observed IS NOT NULL),
s0 AS (SELECT (x.range + 1) * 0.01 AS a, ln(sum(k * pow(t / c, (x.range + 1) * 0.01))) AS ls FROM range(900) x, hs, st GROUP BY x.range),
p0 AS (SELECT a, (SELECT r FROM st) * (ln(a) - ls) + a * ((SELECT l FROM st) - (SELECT r FROM st) * ln((SELECT c FROM st))) - a * a / 2 AS p FROM s0),
rg AS (SELECT min(a) - 0.01 AS lo, max(a) + 0.01 AS hi FROM p0 WHERE p > (SELECT max(p) FROM p0) - 40),
s1 AS (SELECT lo + (x.range + 0.5) * (hi - lo) / 1500 AS a, x.range AS j, any_value((hi - lo) / 1500) AS dx, any_value(lo) AS lo,
         ln(sum(k * pow(t / c, lo + (x.range + 0.5) * (hi - lo) / 1500))) AS ls FROM range(1500) x, hs, st, rg GROUP BY x.range, lo, hi),
mode AS (SELECT a, ls FROM s1, st ORDER BY r * (ln(a) - ls) + a * (l - r * ln(c)) - a * a / 2 DESC LIMIT 1),
bm AS (SELECT c * pow(exp(ls) / r, 1 / a) AS b0, 1 / (a * sqrt(r)) AS rel, r, l, c, n FROM mode, st),
bs AS (SELECT b0 * (1 - 14 * rel) + (y.range + 0.5) * 28 * rel * b0 / 1000 AS b, y.range AS i, 28 * rel * b0 / 1000 AS db, b0 * (1 - 14 * rel) AS blo, r, l, c FROM bm, range(1000) y),
jt AS (SELECT j, a, dx, lo, i, b, db, blo, {lp} AS lp FROM s1, bs WHERE j % 3 = 1 OR i % 2 = 0),
jw AS (SELECT *, exp(lp - max(lp) OVER ()) AS w FROM jt),
den AS (SELECT 'alpha' AS param, j, any_value(a) AS x, any_value(dx) AS dx, any_value(lo) AS lo, sum(w) AS f FROM jw WHERE i % 2 = 0 GROUP BY j
        UNION ALL SELECT 'beta', i, any_value(b), any_value(db), any_value(blo), sum(w) FROM jw WHERE j % 3 = 1 GROUP BY i),
mom AS (SELECT param, sum(f * x) / sum(f) AS mean, sqrt(sum(f * (x - lo) * (x - lo)) / sum(f) - pow(sum(f * (x - lo)) / sum(f), 2)) AS sd FROM den GROUP BY param)"""


def weibull_sql(surv: str) -> str:
    return f"""WITH {_weibull_den(surv)},
{_quantiles("param")}
SELECT mom.param, st.n, st.r, {rnd("mean")}, {rnd("sd")}, {rnd("median", 5)}, {rnd("hdi_3", 3)}, {rnd("hdi_97", 3)}
FROM mom JOIN qs ON mom.param = qs.param, st"""


def weibull_curve_sql(surv: str, points: int) -> str:
    """The density at the points: cubic through the logarithms of the four nearest cells."""
    def at(k: int) -> str:
        return f"ln(d{k}.f / tot.f / d{k}.dx)"
    s = "((x - d1.x) / d1.dx)"
    cubic = (f"-{s} * ({s} - 1) * ({s} - 2) / 6 * {at(0)} + ({s} + 1) * ({s} - 1) * ({s} - 2) / 2 * {at(1)} "
             f"- ({s} + 1) * {s} * ({s} - 2) / 2 * {at(2)} + ({s} + 1) * {s} * ({s} - 1) / 6 * {at(3)}")
    joins = " ".join(f"JOIN den d{k} ON d{k}.param = xs.param AND d{k}.j = CAST(floor((xs.x - dlo) / ddx - 0.5) AS BIGINT) + {k - 1}" for k in range(4))
    return f"""WITH {_weibull_den(surv)},
tot AS (SELECT param, sum(f) AS f, any_value(lo) AS dlo, any_value(dx) AS ddx FROM den GROUP BY param),
xs AS (SELECT param, CAST(q.range AS INTEGER) AS i, mean - 6 * sd + (q.range + 0.5) * 12 * sd / {points} AS x FROM mom, range({points}) q),
ys AS (SELECT xs.param, xs.i, xs.x AS x, exp({cubic.replace("(x -", "(xs.x -")}) AS y
       FROM xs JOIN tot ON tot.param = xs.param {joins})
SELECT param, i, {rnd("x", 5)}, {rnd("y", 3)} FROM ys"""


def weibull_traces_sql(surv: str, uniform, points: int, n: int) -> str:
    """``uniform(label, index)``: SQL of a draw's uniform."""
    return f"""WITH {_weibull_den(surv)},
nrm AS (SELECT *, f / (sum(f) OVER k * dx) AS p FROM den WINDOW k AS (PARTITION BY param)),
edge AS (SELECT param, j, lo + (j + 1) * dx AS e, dx, (p + lead(p) OVER o) / 2 AS fe,
           sum(p * dx) OVER o + (lead(p) OVER o - p) * dx / 24 AS c FROM nrm WINDOW o AS (PARTITION BY param ORDER BY j)),
seg AS (SELECT *, lead(c) OVER o AS c2, lead(fe) OVER o AS fe2 FROM edge WINDOW o AS (PARTITION BY param ORDER BY j)),
us AS (SELECT 'alpha' AS param, d.range AS draw_id, {uniform("'alpha'", "d.range")} AS u FROM range({n}) d
       UNION ALL SELECT 'beta', d.range, {uniform("'beta'", "d.range")} FROM range({n}) d),
dr AS (SELECT us.param, draw_id, e + dx * (s + (fe2 - fe) / (fe2 + fe) * s * (1 - s)) AS value FROM us JOIN seg ON us.param = seg.param AND u >= c AND u < c2,
       LATERAL (SELECT (u - c) / (c2 - c) AS s)),
q AS (SELECT quantile_cont(value, 0.95) * 1.5 AS x_max, quantile_cont(value, 0.5) AS med FROM dr WHERE param = 'beta'),
ln AS (SELECT a.draw_id, a.value AS alpha, b.value AS beta FROM dr a JOIN dr b ON a.draw_id = b.draw_id WHERE a.param = 'alpha' AND b.param = 'beta'
       UNION ALL SELECT -1, 1, med FROM q),
pts AS (SELECT draw_id, CAST(k.range AS INTEGER) AS k, alpha, beta, x_max / 10000 + k.range * x_max / {points} AS x FROM ln, q, range({points}) k)
SELECT draw_id, k, {rnd("alpha", 3)}, {rnd("beta", 3)}, {rnd("x", 2)},
       round(alpha / beta * pow(x / beta, alpha - 1) * exp(-pow(x / beta, alpha)), 3) + 0.0 AS y, draw_id < 0 AS reference FROM pts"""
