"""DuckDB oracle SQL for each registered query (same names as ``QUERIES``)."""

from __future__ import annotations

from bayes_ops.oracle_hier import (ab_curve_sql, ab_posterior_sql, hier_poisson_sql, lognormal_sql, weibull_curve_sql,
                                   weibull_sql, weibull_traces_sql)
from bayes_ops.sqlcheck import conjugate_curve_ctes, conjugate_summary_ctes, d, final_select

ORACLE: dict[str, str] = {}

START = "TIMESTAMP '2024-01-01 00:00:00'"
END = "TIMESTAMP '2024-01-31 00:00:00'"
EXPOSURE_DAYS = 30.0

# Adapter views, identical to bayes_ops.sources.adapters.
EV = ("ev AS (SELECT CAST(ts AS TIMESTAMP) AS timestamp, 'c' || CAST(user_id % 4 AS VARCHAR) AS cohort, "
      "event_type FROM events)")
AB = ("ab AS (SELECT CAST(o_orderdate AS TIMESTAMP) AS timestamp, o_orderpriority AS variant, "
      "CAST(o_orderstatus = 'F' AS BIGINT) AS outcome FROM orders)")
BE = "be AS (SELECT CAST(ts AS TIMESTAMP) AS timestamp, event_type = 'purchase' AS outcome FROM events)"
MAB = ("mab AS (SELECT CAST(l_shipdate AS TIMESTAMP) AS timestamp, p_brand AS arm, "
       "CASE WHEN l_returnflag = 'R' THEN 5.0::DOUBLE + 2.5::DOUBLE * (CAST(substr(p_brand, 7, 10) AS INTEGER) % 3) "
       "ELSE 0.0::DOUBLE END AS reward FROM lineitem JOIN part ON l_partkey = p_partkey)")
SURV = ("surv AS (SELECT CAST(l_quantity AS DOUBLE) AS duration, l_returnflag <> 'N' AS observed "
        "FROM lineitem)")

SUMMARY_DOUBLES = ["exposure", "alpha", "beta", "mean", "sd", "median", "hdi_3", "hdi_97"]


def _poisson_params(group_by: list[str]) -> str:
    gb = ", ".join(group_by)
    key = " || ':' || ".join(group_by)
    return f"""{EV},
st AS (SELECT {gb}, count(*) AS n_events FROM ev
       WHERE timestamp >= {START} AND timestamp < {END} GROUP BY {gb}),
params AS (SELECT {gb}, n_events, {d(EXPOSURE_DAYS)} AS exposure, {key} AS group_key, 'rate' AS param,
           {d(1)} + n_events AS alpha, {d(1)} + {d(EXPOSURE_DAYS)} AS beta FROM st)"""


ORACLE["p4_poisson_posterior"] = f"""WITH {_poisson_params(['cohort'])},
{conjugate_summary_ctes('params', ['cohort', 'param'], 'gamma')}
{final_select(['cohort', 'group_key', 'param', 'n_events', 'exposure', 'alpha', 'beta', 'mean', 'sd',
               'median', 'hdi_3', 'hdi_97'], SUMMARY_DOUBLES, 'cs')}"""


# ---------------------------------------------------------------- Bernoulli / bandit

def _bern_params(view: str, src: str) -> str:
    return f"""{view},
st AS (SELECT CAST(sum(CASE WHEN outcome IS NOT NULL THEN CAST(outcome AS BIGINT) ELSE 0 END) AS BIGINT) AS successes,
              count(CAST(outcome AS BIGINT)) AS trials,
              CAST(sum(CASE WHEN outcome IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped FROM {src}),
params AS (SELECT *, 'p' AS param, {d(1)} + successes AS alpha, {d(1)} + (trials - successes) AS beta FROM st)"""


_BERN_COLS = ['param', 'successes', 'trials', 'n_dropped', 'alpha', 'beta', 'mean', 'sd', 'median',
              'hdi_3', 'hdi_97']
LB = "lb AS (SELECT CAST(NULL AS TIMESTAMP) AS timestamp, quality = 1 AS outcome FROM labels)"

ORACLE["p1_bernoulli_posterior"] = f"""WITH {_bern_params(BE, 'be')},
{conjugate_summary_ctes('params', ['param'], 'beta')}
{final_select(_BERN_COLS, SUMMARY_DOUBLES, 'cs')}"""

ORACLE["p1_bernoulli_labels_posterior"] = f"""WITH {_bern_params(LB, 'lb')},
{conjugate_summary_ctes('params', ['param'], 'beta')}
{final_select(_BERN_COLS, SUMMARY_DOUBLES, 'cs')}"""

BANDIT_PARAMS = f"""{MAB},
hist AS (SELECT arm, reward, count(*) AS cnt FROM mab WHERE arm IS NOT NULL AND reward IS NOT NULL
         GROUP BY arm, reward),
hm AS (SELECT *, max(CASE WHEN reward > 0 THEN reward END) OVER (PARTITION BY arm) AS magnitude FROM hist),
bs AS (SELECT arm, CAST(sum(cnt) AS BIGINT) AS pulls, any_value(magnitude) AS magnitude,
       CAST(sum(CASE WHEN coalesce(reward = magnitude, false) THEN cnt ELSE 0 END) AS BIGINT) AS successes
       FROM hm GROUP BY arm),
bp AS (SELECT *, pulls - successes AS failures, {d(1)} + successes AS alpha,
       {d(1)} + (pulls - successes) AS beta FROM bs),
params AS (SELECT *, alpha / (alpha + beta) AS est_prob, alpha / (alpha + beta) * magnitude AS expected_reward,
           'p' AS param FROM bp)"""

_BANDIT_DOUBLES = ["magnitude", "alpha", "beta", "est_prob", "expected_reward", "mean", "sd", "median",
                   "hdi_3", "hdi_97", "prob_best"]

ORACLE["p3_bandit_posterior"] = f"""WITH {BANDIT_PARAMS},
{conjugate_summary_ctes('params', ['arm', 'param'], 'beta')}
{final_select(['arm', 'pulls', 'successes', 'failures', 'magnitude', 'alpha', 'beta', 'est_prob',
               'expected_reward', 'mean', 'sd', 'median', 'hdi_3', 'hdi_97'], _BANDIT_DOUBLES, 'cs')}"""


def _prob_best_ctes() -> str:
    """Every arm's log F at every arm's breakpoints, by an as-of join."""
    from bayes_ops.sqlcheck import family_sql, grid_ctes
    f = family_sql("beta")
    return f"""pay AS (SELECT * FROM params WHERE magnitude IS NOT NULL AND magnitude > 0),
{grid_ctes('pay', ['arm'], f['lo'], f['hi'], f['logp'], name='pg', t=f['t'])},
cl AS (SELECT arm, magnitude * x_lo AS v0, magnitude * x_hi AS v1, ln(greatest(cdf - w, 1e-300)) AS l0,
       ln(greatest(cdf, 1e-300)) AS l1 FROM pg3),
seg AS (SELECT arm, v0 AS s, l0, (l1 - l0) / (v1 - v0) AS b FROM cl
        UNION ALL SELECT arm, max(v1), 0, 0 FROM cl GROUP BY arm),
lo AS (SELECT max(s) AS s FROM (SELECT arm, min(s) AS s FROM seg GROUP BY arm)),
tp AS (SELECT DISTINCT s AS t FROM seg WHERE s >= (SELECT s FROM lo)),
atp AS (SELECT arm, t FROM (SELECT DISTINCT arm FROM seg) CROSS JOIN tp),
lf AS (SELECT atp.arm, atp.t, seg.l0 + seg.b * (atp.t - seg.s) AS l, seg.b
       FROM atp ASOF JOIN seg ON atp.arm = seg.arm AND atp.t >= seg.s),
tot AS (SELECT t, sum(l) AS g, sum(b) AS b FROM lf GROUP BY t),
iv AS (SELECT t, g, lead(t) OVER (ORDER BY t) - t AS dt, b * (lead(t) OVER (ORDER BY t) - t) AS rise FROM tot),
ar AS (SELECT t, exp(g + rise) * dt * CASE WHEN abs(rise) < 1e-5 THEN 1 - rise / 2 + rise * rise / 6
       ELSE (1 - exp(-rise)) / rise END AS area FROM iv WHERE dt IS NOT NULL),
nrm AS (SELECT arm, sum(lf.b * ar.area) AS prob_best FROM lf JOIN ar ON lf.t = ar.t GROUP BY arm),
pb0 AS (SELECT p.arm, p.magnitude, n.prob_best FROM params p LEFT JOIN nrm n ON p.arm = n.arm),
pb AS (SELECT arm, coalesce(prob_best, CASE WHEN max(CASE WHEN magnitude > 0 THEN 1 ELSE 0 END) OVER () = 0
        AND arm = min(arm) OVER () THEN {d(1)} ELSE {d(0)} END) AS prob_best FROM pb0)"""


_PB_COLS = ['arm', 'pulls', 'successes', 'failures', 'magnitude', 'alpha', 'beta', 'est_prob',
            'expected_reward', 'prob_best']

ORACLE["c3_bandit_prob_best"] = f"""WITH {BANDIT_PARAMS},
{_prob_best_ctes()},
res AS (SELECT p.*, pb.prob_best FROM params p LEFT JOIN pb ON p.arm = pb.arm)
{final_select(_PB_COLS, _BANDIT_DOUBLES, 'res')}"""

ORACLE["c6_next_arm"] = f"""WITH {BANDIT_PARAMS},
{_prob_best_ctes()},
res AS (SELECT p.*, pb.prob_best FROM params p LEFT JOIN pb ON p.arm = pb.arm),
rk AS (SELECT *, row_number() OVER (ORDER BY prob_best DESC, arm) AS rnk FROM res WHERE true)
{final_select(_PB_COLS, _BANDIT_DOUBLES, 'rk WHERE rnk = 1')}"""


# ---------------------------------------------------------------- hazard

NB = 10
_FR = ", ".join(repr(k / NB) for k in range(1, NB))
_LINSPACE = ", ".join(f"coalesce(max_t, {d(1)}) * {k} / {NB}" for k in range(1, NB))
HAZ_BOUNDS = f"""{SURV},
sv AS (SELECT * FROM surv WHERE duration IS NOT NULL AND observed IS NOT NULL),
bnd AS (SELECT CAST(sum(CASE WHEN observed THEN 1 ELSE 0 END) AS BIGINT) AS failures, max(duration) AS max_t,
        quantile_cont(duration, [{_FR}]) FILTER (WHERE observed) AS pct FROM sv),
b2 AS (SELECT *, CASE WHEN failures < {NB} THEN [{_LINSPACE}] ELSE pct END AS b FROM bnd)"""

_IDX = " + ".join(f"(CASE WHEN duration > b[{k}] THEN 1 ELSE 0 END)" for k in range(1, NB))
HAZ_STATS = f"""{HAZ_BOUNDS},
ix AS (SELECT duration, observed, b, {_IDX} AS j FROM sv, b2),
ix2 AS (SELECT *, CASE WHEN j = 0 THEN {d(0)} ELSE b[j] END AS e_j FROM ix),
per AS (SELECT j, count(*) AS n_rows, CAST(sum(CASE WHEN observed THEN 1 ELSE 0 END) AS BIGINT) AS events,
        sum(duration - e_j) AS partial_time FROM ix2 GROUP BY j),
ints AS (SELECT CAST(r.range AS INTEGER) AS j, b, max_t FROM range({NB}) r, b2),
ints2 AS (SELECT j, b, max_t, CASE WHEN j = 0 THEN {d(0)} ELSE b[j] END AS lower,
          CASE WHEN j = {NB - 1} THEN {d(0)} WHEN j = 0 THEN b[1] ELSE b[j + 1] - b[j] END AS length FROM ints),
hs AS (SELECT i.j, i.b, i.max_t, lower, length, coalesce(n_rows, 0) AS n_rows, coalesce(events, 0) AS events,
       coalesce(partial_time, {d(0)}) AS partial_time FROM ints2 i LEFT JOIN per p ON i.j = p.j),
hs2 AS (SELECT *, CAST(coalesce(sum(n_rows) OVER (ORDER BY j DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS BIGINT) AS n_beyond FROM hs),
hs3 AS (SELECT *, partial_time + length * n_beyond AS exposure FROM hs2)"""

ORACLE["a9_hazard_boundaries"] = f"""WITH {HAZ_BOUNDS},
ex AS (SELECT failures, max_t, CAST(unnest(range(0, {NB - 1})) AS INTEGER) AS k, unnest(pct) AS boundary FROM bnd)
{final_select(['failures', 'max_t', 'k', 'boundary'], ['max_t', 'boundary'], 'ex')}"""

ORACLE["a8_hazard_suffstats"] = f"""WITH {HAZ_STATS}
{final_select(['j', 'lower', 'length', 'n_rows', 'events', 'n_beyond', 'exposure'],
              ['lower', 'length', 'exposure'], 'hs3')}"""

HAZ_POST = f"""{HAZ_STATS},
params AS (SELECT *, 'lambda' AS param, {d(1)} + events AS alpha, {d(1)} + exposure AS beta FROM hs3),
{conjugate_summary_ctes('params', ['j', 'param'], 'gamma')},
hp AS (SELECT *, CASE WHEN j < {NB - 1} THEN b[j + 1]
        ELSE coalesce(greatest(max_t, list_max(b)), {d(1)}) END AS upper FROM cs),
hp2 AS (SELECT *, (lower + upper) / 2 AS mid FROM hp)"""

ORACLE["p6_hazard_posterior"] = f"""WITH {HAZ_POST}
{final_select(['j', 'param', 'lower', 'upper', 'mid', 'n_rows', 'events', 'exposure', 'alpha', 'beta', 'mean',
               'sd', 'median', 'hdi_3', 'hdi_97'],
              ['lower', 'upper', 'mid', 'exposure'] + SUMMARY_DOUBLES, 'hp2')}"""

ORACLE["p9_hazard_loglik"] = f"""WITH {HAZ_POST},
lam AS (SELECT j, mean AS lam, length, lower,
        coalesce(sum(mean * length) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {d(0)})
        AS H_before FROM hp2),
ll AS (SELECT x.j, CAST(x.observed AS DOUBLE) * ln(l.lam) - (l.H_before + l.lam * (x.duration - l.lower)) AS loglik
       FROM ix x JOIN lam l ON x.j = l.j),
agg AS (SELECT CAST(j AS INTEGER) AS j, count(*) AS n_rows, sum(loglik) AS loglik FROM ll GROUP BY j)
{final_select(['j', 'n_rows', 'loglik'], ['loglik'], 'agg')}"""


# ---------------------------------------------------------------- Weibull

_WB_ALPHAS = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0]
_WB_SUMS = ", ".join(f"sum(pow(duration / (SELECT max(duration) FROM sv), {d(a)})) AS s{k}" for k, a in enumerate(_WB_ALPHAS))
_WB_LONG = " UNION ALL ".join(
    f"SELECT n, r, sum_log_t_obs, CAST({k} AS INTEGER) AS k, {d(a)} AS alpha, s{k} AS s FROM one"
    for k, a in enumerate(_WB_ALPHAS))

ORACLE["a7_weibull_suffstats"] = f"""WITH {SURV},
sv AS (SELECT * FROM surv WHERE duration IS NOT NULL AND observed IS NOT NULL),
one AS (SELECT count(*) AS n, CAST(sum(CASE WHEN observed THEN 1 ELSE 0 END) AS BIGINT) AS r,
        sum(CASE WHEN observed THEN ln(duration) END) AS sum_log_t_obs, {_WB_SUMS} FROM sv),
lng AS ({_WB_LONG})
{final_select(['n', 'r', 'sum_log_t_obs', 'k', 'alpha', 's'], ['sum_log_t_obs', 'alpha', 's'], 'lng')}"""


# ---------------------------------------------------------------- A/B

ORACLE["a2_ab_suffstats"] = f"""WITH {AB},
st AS (SELECT variant,
       CAST(sum(CASE WHEN outcome IS NOT NULL THEN CAST(outcome AS BIGINT) ELSE 0 END) AS BIGINT) AS successes,
       count(CAST(outcome AS BIGINT)) AS trials,
       CAST(sum(CASE WHEN outcome IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped
       FROM ab GROUP BY variant)
SELECT variant, successes, trials, n_dropped, trials - successes AS failures FROM st WHERE variant IS NOT NULL"""


# ---------------------------------------------------------------- draws and decisions

SEED = 20240101
HDI_P = 0.94
TWO52 = "4503599627370496.0"


def _uniform(seed: int, label: str, idx: str) -> str:
    return (f"((CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {label}, CAST({idx} AS VARCHAR))), 1, 13)) "
            f"AS BIGINT) + 0.5) / {TWO52})")


def _draw_ctes(params: str, keys: list[str], family: str, n: int, label: str, name: str = "dw") -> str:
    from bayes_ops.sqlcheck import family_sql, grid_ctes
    f = family_sql(family)
    ks = ", ".join(keys)
    on = " AND ".join(f"d.{k} IS NOT DISTINCT FROM g.{k}" for k in keys)
    return f"""{grid_ctes(params, keys, f['lo'], f['hi'], f['logp'], name=name + 'g', t=f['t'])},
{name}_c AS (SELECT {ks}, cdf - w AS c_prev, w AS c_w, x_lo AS c_lo, x_hi - x_lo AS c_dx FROM {name}g3),
{name}_u AS (SELECT {ks}, r.range AS draw_id, {_uniform(SEED, label, 'r.range')} AS u
             FROM {params} CROSS JOIN range({n}) r),
{name} AS (SELECT {', '.join('d.' + k for k in keys)}, d.draw_id, d.u,
           g.c_lo + least(greatest((d.u - g.c_prev) / g.c_w, {d(0)}), {d(1)}) * g.c_dx AS value
           FROM {name}_u d ASOF JOIN {name}_c g ON {on} AND d.u >= g.c_prev)"""


ORACLE["c4_bandit_draws"] = f"""WITH {BANDIT_PARAMS},
{_draw_ctes('params', ['arm', 'magnitude'], 'beta', 1000, 'arm')},
res AS (SELECT arm, draw_id, value AS est_prob, value * magnitude AS expected_reward FROM dw)
{final_select(['arm', 'draw_id', 'est_prob', 'expected_reward'], ['est_prob', 'expected_reward'], 'res')}"""

ORACLE["c2_thompson_prob_best"] = f"""WITH {BANDIT_PARAMS},
{_draw_ctes('params', ['arm', 'magnitude'], 'beta', 10000, 'arm')},
rw AS (SELECT arm, draw_id, value * coalesce(magnitude, {d(0)}) AS reward FROM dw),
best AS (SELECT draw_id, arg_min(arm, struct_pack(nr := -reward, arm := arm)) AS arm FROM rw GROUP BY draw_id),
cnt AS (SELECT arm, count(*) / {d(10000)} AS prob_best FROM best GROUP BY arm),
res AS (SELECT p.arm, coalesce(c.prob_best, {d(0)}) AS prob_best FROM params p LEFT JOIN cnt c ON p.arm = c.arm)
{final_select(['arm', 'prob_best'], ['prob_best'], 'res')}"""

POISSON_DRAWS = f"""{_poisson_params(['cohort'])},
{_draw_ctes('params', ['cohort'], 'gamma', 5000, 'cohort')}"""

ORACLE["c5_poisson_draws"] = f"""WITH {POISSON_DRAWS}
{final_select(['cohort', 'draw_id', 'value'], ['value'], 'dw')}"""

ORACLE["n4_hdi_from_draws"] = f"""WITH {POISSON_DRAWS},
rv AS (SELECT cohort, value FROM dw),
o AS (SELECT cohort, value, row_number() OVER (PARTITION BY cohort ORDER BY value) - 1 AS idx,
      count(*) OVER (PARTITION BY cohort) AS n FROM rv),
o2 AS (SELECT *, CAST(floor({HDI_P} * n) AS INTEGER) AS k FROM o),
j AS (SELECT a.cohort, a.idx, a.value AS lo, b.value AS hi, b.value - a.value AS width
      FROM o2 a JOIN o2 b ON a.cohort = b.cohort AND b.idx = a.idx + a.k),
res AS (SELECT cohort, arg_min(lo, struct_pack(w := width, i := idx)) AS hdi_low,
        arg_min(hi, struct_pack(w := width, i := idx)) AS hdi_high FROM j GROUP BY cohort)
{final_select(['cohort', 'hdi_low', 'hdi_high'], ['hdi_low', 'hdi_high'], 'res')}"""

ORACLE["n6_quantile_band"] = f"""WITH {POISSON_DRAWS},
rv AS (SELECT cohort, value FROM dw),
o AS (SELECT cohort, value, row_number() OVER (PARTITION BY cohort ORDER BY value) - 1 AS idx,
      count(*) OVER (PARTITION BY cohort) AS n FROM rv),
res AS (SELECT cohort, max(CASE WHEN idx = floor(0.025 * (n - 1)) THEN value END) AS q_25,
        max(CASE WHEN idx = floor(0.975 * (n - 1)) THEN value END) AS q_975, avg(value) AS mean FROM o GROUP BY cohort)
{final_select(['cohort', 'q_25', 'q_975', 'mean'], ['q_25', 'q_975', 'mean'], 'res')}"""


def _prob_greater_sql() -> str:
    from bayes_ops.sqlcheck import family_sql, grid_ctes
    f = family_sql("gamma")
    return f"""{_poisson_params(['cohort'])},
{grid_ctes('params', ['cohort'], f['lo'], f['hi'], f['logp'], name='pgg', t=f['t'])},
pairs AS (SELECT cohort AS group_a, 'c0' AS group_b FROM params WHERE cohort <> 'c0'),
ga AS (SELECT p.group_a, p.group_b, g.x AS pos, g.w AS w_a FROM pgg3 g JOIN pairs p ON g.cohort = p.group_a),
gb AS (SELECT p.group_a, p.group_b, g.x_lo AS pos, g.cdf - g.w AS b_prev, g.w AS b_w,
       g.x_lo AS b_lo, g.x_hi - g.x_lo AS b_dx FROM pgg3 g JOIN pairs p ON g.cohort = p.group_b),
j AS (SELECT a.group_a, a.group_b, a.w_a,
      CASE WHEN b.b_prev IS NULL THEN {d(0)} ELSE least({d(1)}, b.b_prev
        + least(greatest((a.pos - b.b_lo) / b.b_dx, {d(0)}), {d(1)}) * b.b_w) END AS fb
      FROM ga a ASOF LEFT JOIN gb b ON a.group_a = b.group_a AND a.group_b = b.group_b AND a.pos >= b.pos),
res AS (SELECT group_a, group_b, sum(w_a * fb) AS p_a_gt_b FROM j GROUP BY group_a, group_b)"""


ORACLE["c1_prob_greater"] = f"""WITH {_prob_greater_sql()}
{final_select(['group_a', 'group_b', 'p_a_gt_b'], ['p_a_gt_b'], 'res')}"""


# ---------------------------------------------------------------- counts, variants, views

ISO = "'%Y-%m-%dT%H:%M:%S.%f'"

ORACLE["a5_event_counts_grouping_sets"] = f"""WITH {EV},
f AS (SELECT * FROM ev WHERE timestamp >= {START} AND timestamp < {END})
SELECT cohort, event_type, count(*) AS n_events, CAST(grouping(cohort, event_type) AS INTEGER) AS grouping_id
FROM f GROUP BY GROUPING SETS ((cohort), (event_type), (cohort, event_type))"""

_CELL_HOURS = 30 * 24 * 150.0
ORACLE["p4_poisson_cell_posterior"] = f"""WITH {EV},
st AS (SELECT cohort, event_type, count(*) AS n_events FROM ev
       WHERE timestamp >= {START} AND timestamp < {END} AND cohort IN ('c0', 'c1', 'c2')
       AND event_type IN ('click', 'purchase', 'view') GROUP BY cohort, event_type),
params AS (SELECT cohort, event_type, n_events, {d(_CELL_HOURS)} AS exposure,
           cohort || ':' || event_type AS group_key, 'rate' AS param,
           {d(0.5)} + n_events AS alpha, {d(0.1)} + {d(_CELL_HOURS)} AS beta FROM st),
{conjugate_summary_ctes('params', ['cohort', 'event_type', 'param'], 'gamma')}
{final_select(['cohort', 'event_type', 'group_key', 'param', 'n_events', 'exposure', 'alpha', 'beta', 'mean', 'sd',
               'median', 'hdi_3', 'hdi_97'], SUMMARY_DOUBLES, 'cs')}"""

ORACLE["a6_poisson_exposure_posterior"] = f"""WITH
evx AS (SELECT CAST(ts AS TIMESTAMP) AS timestamp, event_type, value AS exposure FROM events),
st AS (SELECT event_type, count(*) AS n_events, CAST(sum(exposure) AS DOUBLE) AS exposure FROM evx
       WHERE timestamp >= {START} AND timestamp < {END} GROUP BY event_type),
params AS (SELECT event_type, n_events, exposure, event_type AS group_key, 'rate' AS param,
           {d(1)} + n_events AS alpha, {d(1)} + exposure AS beta FROM st),
{conjugate_summary_ctes('params', ['event_type', 'param'], 'gamma')}
{final_select(['event_type', 'group_key', 'param', 'n_events', 'exposure', 'alpha', 'beta', 'mean', 'sd',
               'median', 'hdi_3', 'hdi_97'], SUMMARY_DOUBLES, 'cs')}"""

P7 = f"""{_poisson_params(['cohort'])},
{conjugate_curve_ctes('params', ['cohort', 'param'], 'gamma')}"""

ORACLE["p7_poisson_curve"] = f"""WITH {P7}
{final_select(['cohort', 'param', 'j', 'x', 'y'], ['x', 'y'], 'cc')}"""

ORACLE["v7_shared_axis"] = f"""WITH {P7},
res AS (SELECT min(x) AS x_min, max(x) AS x_max, max(y) * 1.1 AS y_max FROM cc)
{final_select(['x_min', 'x_max', 'y_max'], ['x_min', 'x_max', 'y_max'], 'res')}"""

ORACLE["v3_rescaled_rates"] = f"""WITH {_poisson_params(['cohort'])},
{conjugate_summary_ctes('params', ['cohort', 'param'], 'gamma')},
users AS (SELECT 'c' || CAST(user_id % 4 AS VARCHAR) AS group_key, CAST(count(DISTINCT user_id) AS DOUBLE) AS pop
          FROM events GROUP BY 1),
j AS (SELECT cs.*, CASE WHEN coalesce(u.pop, 0) = 0 THEN {d(1)} ELSE u.pop END * {d(24)} AS dd
      FROM cs LEFT JOIN users u ON cs.group_key = u.group_key),
res AS (SELECT cohort, mean / dd AS mean, sd / dd AS sd, median / dd AS median, hdi_3 / dd AS hdi_3,
        hdi_97 / dd AS hdi_97 FROM j)
{final_select(['cohort', 'mean', 'sd', 'median', 'hdi_3', 'hdi_97'], ['mean', 'sd', 'median', 'hdi_3', 'hdi_97'], 'res')}"""

ORACLE["l3_rank_arms_by_mean"] = f"""WITH {BANDIT_PARAMS},
res AS (SELECT arm, alpha / (alpha + beta) AS mean FROM params),
rk AS (SELECT arm, mean, CAST(row_number() OVER (ORDER BY mean, arm) AS INTEGER) AS rank FROM res)
{final_select(['arm', 'mean', 'rank'], ['mean'], 'rk')}"""

ORACLE["l4_cohorts_alphabetical"] = f"""WITH {EV},
c AS (SELECT cohort, count(*) AS n_events FROM ev GROUP BY cohort)
SELECT cohort, n_events, CAST(row_number() OVER (ORDER BY cohort) AS INTEGER) AS rank FROM c"""

ORACLE["l1_list_events"] = f"""WITH {EV},
f AS (SELECT * FROM ev WHERE cohort IN ('c1', 'c2') AND event_type IN ('click', 'view')
      AND timestamp >= TIMESTAMP '2024-01-03 00:00:00' AND timestamp < TIMESTAMP '2024-01-20 00:00:00'
      ORDER BY timestamp, cohort, event_type LIMIT 1000 OFFSET 100)
SELECT strftime(timestamp, {ISO}) AS timestamp, cohort, event_type FROM f"""

ORACLE["l2_inspect_experiment"] = f"""WITH {AB},
f AS (SELECT * FROM ab WHERE timestamp >= TIMESTAMP '1995-01-01 00:00:00' AND timestamp < TIMESTAMP '1996-01-01 00:00:00'),
tot AS (SELECT count(*) AS total_count FROM f),
pg AS (SELECT * FROM f ORDER BY timestamp NULLS FIRST, variant NULLS FIRST, outcome NULLS FIRST LIMIT 100 OFFSET 0)
SELECT strftime(timestamp, {ISO}) AS timestamp, variant, outcome, total_count FROM pg, tot"""

ORACLE["n7_trial_sequence"] = f"""WITH {AB},
s AS (SELECT variant, CAST(row_number() OVER (PARTITION BY variant ORDER BY timestamp NULLS FIRST, outcome NULLS FIRST)
      AS INTEGER) AS seq, timestamp, outcome,
      CAST(sum(outcome) OVER (PARTITION BY variant ORDER BY timestamp NULLS FIRST, outcome NULLS FIRST
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_successes FROM ab)
SELECT variant, seq, strftime(timestamp, {ISO}) AS timestamp, outcome, cum_successes FROM s"""

ORACLE["a12_time_extent"] = f"""WITH {EV}, {SURV}
SELECT strftime(min(timestamp), {ISO}) AS min_timestamp, strftime(max(timestamp), {ISO}) AS max_timestamp,
       count(*) AS n, (SELECT max(duration) FROM surv) AS max_duration FROM ev"""

ORACLE["v1_value_kde"] = f"""WITH
v AS (SELECT event_type, value FROM events WHERE value IS NOT NULL),
st AS (SELECT event_type, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS v_min,
       max(value) AS v_max FROM v GROUP BY event_type),
px AS (SELECT *, CAST(r.range AS INTEGER) AS j, v_min + r.range * ((v_max - v_min) / 199.0) AS x
       FROM st CROSS JOIN range(200) r),
k AS (SELECT px.event_type, j, any_value(x) AS x,
      sum(exp(-(((x - value) / h) * ((x - value) / h)) / 2) / (sqrt(2 * pi()) * h)) / any_value(n) AS y
      FROM px JOIN v ON v.event_type = px.event_type GROUP BY px.event_type, j)
{final_select(['event_type', 'j', 'x', 'y'], ['x', 'y'], 'k')}"""

ORACLE["v2_timeline_density"] = f"""WITH {EV},
v AS (SELECT cohort, CAST(epoch_us(timestamp) // 1000 AS DOUBLE) AS v FROM ev WHERE timestamp IS NOT NULL),
ext AS (SELECT min(v) AS t0, max(v) AS t1 FROM v),
ext2 AS (SELECT t0, CASE WHEN t1 > t0 THEN (t1 - t0) / 199 ELSE {d(1)} END AS step FROM ext),
st AS (SELECT cohort, count(*) AS n, stddev_samp(v) AS sd FROM v GROUP BY cohort),
st2 AS (SELECT cohort, n, 1.06 * CASE WHEN sd IS NULL OR sd = 0 THEN 1e-9 ELSE sd END / pow(CAST(n AS DOUBLE), 0.2)
        AS h FROM st),
pts AS (SELECT v.cohort, v.v, st2.h, ext2.t0, ext2.step FROM v JOIN st2 ON v.cohort = st2.cohort, ext2),
ex AS (SELECT cohort, v, h, t0, step,
       unnest(range(greatest(0, CAST(ceil((v - h - t0) / step) AS INTEGER) - 1),
                    least(199, CAST(floor((v + h - t0) / step) AS INTEGER) + 1) + 1)) AS j FROM pts),
kk AS (SELECT cohort, j, CASE WHEN abs((t0 + j * step - v) / h) <= 1
         THEN 0.75 * (1 - ((t0 + j * step - v) / h) * ((t0 + j * step - v) / h)) / h ELSE 0 END AS k FROM ex),
sums AS (SELECT cohort, j, sum(k) AS ksum FROM kk GROUP BY cohort, j),
grid AS (SELECT st2.cohort, st2.n, r.range AS j, ext2.t0 + r.range * ext2.step AS tick FROM st2, ext2, range(200) r),
res AS (SELECT g.cohort, CAST(g.j AS INTEGER) AS j, CAST(round(g.tick) AS BIGINT) AS tick_ms, g.n,
        coalesce(s.ksum, 0) / g.n * 86400000.0 AS density_per_day
        FROM grid g LEFT JOIN sums s ON g.cohort = s.cohort AND g.j = s.j)
{final_select(['cohort', 'j', 'tick_ms', 'n', 'density_per_day'], ['density_per_day'], 'res')}"""

ORACLE["v8_box_summary"] = f"""WITH {BANDIT_PARAMS},
{_draw_ctes('params', ['arm', 'magnitude'], 'beta', 1000, 'arm')},
rw AS (SELECT arm, value * magnitude AS v FROM dw),
q AS (SELECT arm, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM rw GROUP BY arm),
q2 AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q),
res AS (SELECT q2.arm, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
        min(CASE WHEN v >= lo_f AND v <= hi_f THEN v END) AS whisker_lo,
        max(CASE WHEN v >= lo_f AND v <= hi_f THEN v END) AS whisker_hi,
        CAST(sum(CASE WHEN v >= lo_f AND v <= hi_f THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
        FROM rw JOIN q2 ON rw.arm = q2.arm GROUP BY q2.arm)
{final_select(['arm', 'q1', 'median', 'q3', 'whisker_lo', 'whisker_hi', 'n_outliers'],
              ['q1', 'median', 'q3', 'whisker_lo', 'whisker_hi'], 'res')}"""

ORACLE["w3_validate_batch"] = """WITH
b AS (SELECT CAST(ts AS VARCHAR) AS ts_raw, TRY_CAST(CAST(ts AS VARCHAR) AS TIMESTAMP) AS timestamp,
      event_type AS variant, json_extract_string(props, '$.k') AS outcome_raw,
      TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS outcome FROM events),
r AS (SELECT CASE
        WHEN ts_raw IS NOT NULL AND timestamp IS NULL THEN 'bad_timestamp'
        WHEN outcome_raw IS NOT NULL AND outcome IS NULL THEN 'bad_outcome'
        WHEN coalesce(NOT outcome IN (0, 1), false) THEN 'outcome_not_binary'
        WHEN timestamp IS NULL THEN 'missing_timestamp'
        ELSE 'ok' END AS reason FROM b)
SELECT reason, count(*) AS n_rows FROM r GROUP BY reason"""

ORACLE["g9_delete_by_filter"] = f"""WITH {EV}
SELECT cohort,
  CAST(sum(CASE WHEN coalesce(cohort = 'c1' AND timestamp >= TIMESTAMP '2024-01-15 00:00:00', false) THEN 1 ELSE 0 END)
       AS BIGINT) AS deleted,
  CAST(sum(CASE WHEN coalesce(cohort = 'c1' AND timestamp >= TIMESTAMP '2024-01-15 00:00:00', false) THEN 0 ELSE 1 END)
       AS BIGINT) AS remaining
FROM ev GROUP BY cohort"""

ORACLE["g9_delete_rows"] = f"""WITH {EV}
SELECT cohort, count(*) AS n_rows FROM ev
WHERE NOT coalesce(cohort = 'c1' AND timestamp >= TIMESTAMP '2024-01-15 00:00:00', false) GROUP BY cohort"""

ORACLE["s4_csv_batch"] = f"""WITH {EV} SELECT cohort, event_type, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_rejected,
strftime(max(timestamp), '%Y-%m-%dT%H:%M:%S.%f') AS last_event FROM ev GROUP BY cohort, event_type"""


def _row_text(columns: dict[str, str]) -> str:
    """The text whose md5 is a row's hash: column name -> its text."""
    return " || ".join(f"'{c}:' || coalesce(length({x}) || ':' || {x}, '-') || ';'" for c, x in sorted(columns.items()))


_US, _TXT = "CAST(epoch_us({}) AS VARCHAR)", "CAST({} AS VARCHAR)"
_FRAMES = {
    "poisson-cohorts": ("ev", {"timestamp": _US, "cohort": _TXT, "event_type": _TXT}),
    "ab-test": ("ab", {"timestamp": _US, "variant": _TXT, "outcome": _TXT}),
    "bernoulli": ("be", {"timestamp": _US, "outcome": _TXT}),
    "multi-armed-bandits": ("mab", {"timestamp": _US, "arm": _TXT, "reward": _TXT}),
    "weibull": ("surv", {"duration": _TXT, "observed": _TXT}),
    "hazard-rate": ("surv", {"duration": _TXT, "observed": _TXT}),
}
_HASHES = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, CAST('0x' || substr(md5({_row_text({c: f.format(c) for c, f in cols.items()})}), 1, 15) "
    f"AS BIGINT) AS h FROM {view}" for kind, (view, cols) in _FRAMES.items())

ORACLE["k1_fingerprint"] = f"""WITH {EV}, {AB}, {BE}, {MAB}, {SURV},
hs AS ({_HASHES})
SELECT kind, count(*) AS n_rows,
  sha256(count(*) || '|' || bit_xor(h) || '|' || CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR)) AS fingerprint
FROM hs GROUP BY kind"""

ORACLE["g6_describe_table"] = """SELECT column_name, column_type, "null" = 'YES' AS nullable,
  CAST(row_number() OVER () - 1 AS INTEGER) AS position, (SELECT count(*) FROM lineitem) AS row_count
FROM (DESCRIBE lineitem)"""


# ---------------------------------------------------------------- streaming

ORACLE["t2_stream_poisson_posterior"] = f"""WITH {_poisson_params(['cohort'])},
{conjugate_summary_ctes('params', ['cohort', 'param'], 'gamma')}
{final_select(['cohort', 'param', 'n_events', 'exposure', 'alpha', 'beta', 'mean', 'sd',
               'median', 'hdi_3', 'hdi_97'], SUMMARY_DOUBLES, 'cs')}"""

ORACLE["t3_windowed_rates"] = f"""WITH {EV},
wc AS (SELECT time_bucket(INTERVAL '1 day', timestamp) AS ws, cohort, count(*) AS n_events FROM ev
       WHERE timestamp IS NOT NULL GROUP BY 1, 2),
params AS (SELECT strftime(ws, {ISO}) AS window_start, cohort, n_events, {d(1)} AS exposure, 'rate' AS param,
           {d(1)} + n_events AS alpha, {d(1)} + {d(1)} AS beta FROM wc),
{conjugate_summary_ctes('params', ['window_start', 'cohort', 'param'], 'gamma')}
{final_select(['window_start', 'cohort', 'n_events', 'exposure', 'alpha', 'beta', 'mean', 'sd', 'median',
               'hdi_3', 'hdi_97'], SUMMARY_DOUBLES, 'cs')}"""

ORACLE["j2_pull_outcomes"] = f"""WITH {MAB},
mg AS (SELECT arm, max(reward) AS magnitude FROM mab WHERE reward > 0 GROUP BY arm),
o AS (SELECT m.arm, g.magnitude, CAST(coalesce(m.reward = g.magnitude, false) AS BIGINT) AS outcome
      FROM mab m LEFT JOIN mg g ON m.arm = g.arm)
SELECT arm, any_value(magnitude) AS magnitude, count(*) AS pulls, CAST(sum(outcome) AS BIGINT) AS successes
FROM o GROUP BY arm"""

ORACLE["p7_bernoulli_curve"] = f"""WITH {_bern_params(BE, 'be')},
{conjugate_curve_ctes('params', ['param'], 'beta')}
{final_select(['param', 'j', 'x', 'y'], ['x', 'y'], 'cc')}"""


def _cdf_sql() -> str:
    from bayes_ops.sqlcheck import family_sql, grid_ctes
    f = family_sql("gamma")
    return f"""WITH {_poisson_params(['cohort'])},
p2 AS (SELECT cohort, param, alpha, beta FROM params),
{grid_ctes('p2', ['cohort', 'param'], f['lo'], f['hi'], f['logp'], name='cg', t=f['t'])},
res AS (SELECT cohort, CAST(i AS INTEGER) AS i, x, w, cdf FROM cg3)
{final_select(['cohort', 'i', 'x', 'w', 'cdf'], ['x', 'w', 'cdf'], 'res')}"""


ORACLE["n3_posterior_cdf"] = _cdf_sql()

ORACLE["e9_parse_timestamps"] = f"""WITH
t AS (SELECT event_type, CAST(ts AS TIMESTAMP) AS t FROM events),
txt AS (SELECT event_type, epoch_us(t) // 1000000 AS unix_s, strftime(t, '%Y-%m-%dT%H:%M:%S') AS iso,
        strftime(t, '%Y-%m-%d') AS day, strftime(t, '%Y%m%d') AS compact FROM t),
p AS (SELECT event_type, make_timestamp(unix_s * 1000000) AS pu, strptime(iso, '%Y-%m-%dT%H:%M:%S') AS pi,
      strptime(day, '%Y-%m-%d') AS pd, make_timestamp(CAST(compact AS BIGINT) * 1000000) AS pc FROM txt)
SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN pu = pi THEN 1 ELSE 0 END) AS BIGINT) AS n_unix_eq_iso,
  CAST(sum(CASE WHEN pc IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_compact_as_unix,
  strftime(min(pd), {ISO}) AS min_day, strftime(max(pd), {ISO}) AS max_day
FROM p GROUP BY event_type"""

ORACLE["t1_stream_ingest"] = """SELECT event_type, 'ok' AS status, count(*) AS n_rows FROM events GROUP BY event_type"""

ORACLE["t4_stream_dedupe"] = """SELECT event_type, count(*) AS n_rows, count(DISTINCT event_id) AS n_keys
FROM events GROUP BY event_type"""

ORACLE["t3_stream_window_counts"] = f"""WITH {EV},
wc AS (SELECT time_bucket(INTERVAL '1 day', timestamp) AS ws, cohort, count(*) AS n_events FROM ev
       WHERE timestamp IS NOT NULL GROUP BY 1, 2)
SELECT strftime(ws, {ISO}) AS window_start, cohort, n_events FROM wc"""


# ---------------------------------------------------------------- hierarchical fits

ORACLE["p2_ab_posterior"] = ab_posterior_sql(AB)
ORACLE["p7_ab_curve"] = ab_curve_sql(AB, 200)
ORACLE["p11_hier_poisson_posterior"] = hier_poisson_sql(EV, START, END, 30.0)
ORACLE["x1_density_kind"] = lognormal_sql(SURV)
ORACLE["p5_weibull_posterior"] = weibull_sql(SURV)
ORACLE["p7_weibull_curves"] = weibull_curve_sql(SURV, 200)
ORACLE["v5_weibull_traces"] = weibull_traces_sql(SURV, lambda label, i: _uniform(SEED, label, i), 200, 30)


# ---------------------------------------------------------------- table lifecycle and result cache

ORACLE["g1_registry_lifecycle"] = f"""WITH {EV}, {AB}, {SURV}
SELECT 'exp ' || kind AS name, kind AS type, upper(kind) AS display_name, 'created' AS status, n_rows FROM (
  SELECT 'poisson-cohorts' AS kind, count(*) AS n_rows FROM ev UNION ALL SELECT 'ab-test', count(*) FROM ab
  UNION ALL SELECT 'weibull', count(*) FROM surv)"""

_KINDS = {
    "poisson-cohorts": ("ev", [("timestamp", "timestamp"), ("cohort", "string"), ("event_type", "string")]),
    "ab-test": ("ab", [("timestamp", "timestamp"), ("variant", "string"), ("outcome", "bigint")]),
    "bernoulli": ("be", [("timestamp", "timestamp"), ("outcome", "boolean")]),
    "multi-armed-bandits": ("mab", [("timestamp", "timestamp"), ("arm", "string"), ("reward", "double")]),
    "weibull": ("surv", [("duration", "double"), ("observed", "boolean")]),
    "hazard-rate": ("surv", [("duration", "double"), ("observed", "boolean")]),
}
ORACLE["g7_kind_columns"] = f"WITH {EV}, {AB}, {BE}, {MAB}, {SURV} " + " UNION ALL ".join(
    f"SELECT '{kind}' AS experiment_type, CAST({i} AS INTEGER) AS position, '{c}' AS name, '{t}' AS type, count({c}) AS n_values FROM {view}"
    for kind, (view, cols) in _KINDS.items() for i, (c, t) in enumerate(cols))

ORACLE["g8_migrate_column"] = f"WITH {BE} SELECT outcome, count(*) AS n_rows, CAST(1 AS INTEGER) AS migrated FROM be GROUP BY outcome"

ORACLE["s3_json_batch"] = ORACLE["s4_csv_batch"]

_LATE = "timestamp >= TIMESTAMP '2024-01-15 00:00:00'"
ORACLE["s6_append_batch"] = f"""WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS timestamp, 'c' || CAST(user_id % 4 AS VARCHAR) AS cohort, user_id % 100 = 7 AS bad FROM events)
SELECT cohort, count(*) FILTER (NOT ({_LATE} AND bad)) AS n_rows, (SELECT count(*) FROM e WHERE {_LATE} AND bad) AS rejected,
  (SELECT count(*) FROM e WHERE {_LATE} AND NOT bad) AS accepted FROM e GROUP BY cohort"""

ORACLE["k2_result_cache"] = f"""WITH {_poisson_params(['cohort'])},
{conjugate_summary_ctes('params', ['cohort', 'param'], 'gamma')}
SELECT cohort, n_events, round(mean, 6) + 0.0 AS mean, round(hdi_3, 6) + 0.0 AS hdi_3, round(hdi_97, 6) + 0.0 AS hdi_97,
  false AS hit_first, true AS hit_second, CAST(1 AS BIGINT) AS listed, CAST(1 AS BIGINT) AS cleared, CAST(0 AS BIGINT) AS "left" FROM cs"""

ORACLE["t2_stream_bandit"] = f"""WITH {MAB},
mg AS (SELECT arm, max(reward) FILTER (reward > 0) AS magnitude, count(*) AS pulls FROM mab GROUP BY arm),
st AS (SELECT mg.arm, any_value(magnitude) AS magnitude, any_value(pulls) AS pulls, count(*) FILTER (mab.reward = mg.magnitude) AS successes
       FROM mab JOIN mg ON mab.arm = mg.arm GROUP BY mg.arm)
SELECT arm, magnitude, pulls, successes, 1.0::DOUBLE + successes AS alpha, 1.0::DOUBLE + pulls - successes AS beta,
  round((1.0::DOUBLE + successes) / (2.0::DOUBLE + pulls), 6) + 0.0 AS est_prob FROM st"""

ORACLE["t3_sliding_windows"] = f"""WITH {EV},
w AS (SELECT time_bucket(INTERVAL '1 day', timestamp) - k.k * INTERVAL '1 day' AS ws, cohort FROM ev, (VALUES (0), (1)) k(k) WHERE timestamp IS NOT NULL)
SELECT strftime(ws, {ISO}) AS window_start, strftime(ws + INTERVAL '2 days', {ISO}) AS window_end, cohort, count(*) AS n_events FROM w GROUP BY ws, cohort"""
