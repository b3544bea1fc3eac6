"""DuckDB SQL that recomputes the same results as the Spark plans.

Used by ``__spark_entry__.oracle_sql`` as the independent correctness check:
the SQL rebuilds each grid from ``range()`` with the same formulas, so both
engines evaluate identical points.  Doubles are rounded to 6 decimals on
both sides (``+ 0.0`` turns a negative zero into zero).
"""

from __future__ import annotations

from collections.abc import Sequence

GRID_N = 2000
CURVE_N = 200
HDI = 0.94


def d(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def rnd(col: str, digits: int = 6) -> str:
    return f"round({col}, {digits}) + 0.0 AS {col}"


def final_select(cols: Sequence[str], doubles: Sequence[str], src: str) -> str:
    parts = [rnd(c) if c in doubles else c for c in cols]
    return f"SELECT {', '.join(parts)} FROM {src}"


def xlog(coef: str, arg: str) -> str:
    return f"(CASE WHEN ({coef}) = 0 THEN {d(0)} ELSE ({coef}) * ln(1 + ({arg})) END)"


def family_sql(family: str, a: str = "alpha", b: str = "beta") -> dict[str, str]:
    if family == "gamma":
        mean = f"({a} / {b})"
        sd = f"(sqrt({a}) / {b})"
        k = f"(CASE WHEN {a} < 3 THEN {d(20)} ELSE {d(12)} END)"
        lo = f"greatest({d(0)}, {mean} - {k} * {sd})"
        hi = f"({mean} + {k} * {sd})"
        logp = lambda x: f"({xlog(f'{a} - 1', f'({x} - {mean}) / {mean}')} - {b} * ({x} - {mean}))"
        return dict(mean=mean, sd=sd, lo=lo, hi=hi, logp=logp, dom_hi=f"({mean} + {d(5)} * {sd})",
                    t=f"(CASE WHEN {a} < 3 THEN 1 ELSE 0 END)")
    s = f"({a} + {b})"
    mean = f"({a} / {s})"
    sd = f"sqrt({a} * {b} / ({s} * {s} * ({s} + 1)))"
    k = f"(CASE WHEN least({a}, {b}) < 3 THEN {d(20)} ELSE {d(12)} END)"
    lo = f"greatest({d(0)}, {mean} - {k} * {sd})"
    hi = f"least({d(1)}, {mean} + {k} * {sd})"
    logp = lambda x: (f"({xlog(f'{a} - 1', f'({x} - {mean}) / {mean}')} + "  # noqa: E731
                      f"{xlog(f'{b} - 1', f'({mean} - {x}) / (1 - {mean})')})")
    return dict(mean=mean, sd=sd, lo=lo, hi=hi, logp=logp, dom_hi=d(1),
                t=f"(CASE WHEN least({a}, {b}) < 3 THEN 2 ELSE 0 END)")


def _t_of(u: str) -> str:
    return (f"(g_lo + (g_hi - g_lo) * (CASE g_t WHEN 1 THEN ({u}) * ({u}) "
            f"WHEN 2 THEN (1 - cos(pi() * ({u}))) / 2 ELSE ({u}) END))")


def _log_jac(u: str) -> str:
    return (f"(ln(g_hi - g_lo) + ln(CASE g_t WHEN 1 THEN 2 * ({u}) "
            f"WHEN 2 THEN pi() / 2 * sin(pi() * ({u})) ELSE {d(1)} END))")


def grid_ctes(src: str, keys: Sequence[str], lo: str, hi: str, logp, n: int = GRID_N,
              name: str = "g", t: str = "0") -> str:
    """CTEs ``{name}0..{name}3``; {name}3 has i, x, x_lo, x_hi, g_du, lp, w, cdf, hmass."""
    pk = ", ".join(keys)
    u = f"((i + 0.5) / {n})"
    return f"""
{name}0 AS (SELECT s.*, {lo} AS g_lo, {hi} AS g_hi, {t} AS g_t, {d(1.0 / n)} AS g_du, r.range AS i
            FROM {src} s CROSS JOIN range({n}) r),
{name}0b AS (SELECT *, {_t_of(u)} AS x, {_t_of(f"(i / {n})")} AS x_lo, {_t_of(f"((i + 1) / {n})")} AS x_hi,
             {_log_jac(u)} AS ljac FROM {name}0),
{name}1 AS (SELECT *, {logp("x")} AS lp FROM {name}0b),
{name}1b AS (SELECT *, lp + ljac AS lw FROM {name}1),
{name}2 AS (SELECT *, max(lw) OVER (PARTITION BY {pk}) AS g_max FROM {name}1b),
{name}2b AS (SELECT *, exp(lw - g_max) AS e FROM {name}2),
{name}2c AS (SELECT *, sum(e) OVER (PARTITION BY {pk}) AS g_z FROM {name}2b),
{name}2d AS (SELECT *, e / g_z AS w FROM {name}2c),
{name}3 AS (SELECT *,
   sum(w) OVER (PARTITION BY {pk} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cdf,
   sum(w) OVER (PARTITION BY {pk} ORDER BY lp DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hmass
   FROM {name}2d)"""


def grid_summary_select(keys: Sequence[str], src: str, moments: bool = False) -> str:
    """Median and interpolated HDI per group (mirrors grid_summary_aggs + hdi_columns)."""
    pk = ", ".join(keys)
    extra = ""
    if moments:
        extra = (", sum(w * x) AS grid_mean, sqrt(greatest(sum(w * x * x) - sum(w * x) * sum(w * x), 0))"
                 " AS grid_sd")
    full = f"hmass <= {HDI}"
    edge = f"(hmass - w < {HDI} AND NOT hmass <= {HDI})"
    inner = f"""SELECT {pk},
  max(CASE WHEN cdf - w < 0.5 AND cdf >= 0.5 THEN x_lo + (0.5 - (cdf - w)) / w * (x_hi - x_lo) END) AS median,
  min(CASE WHEN {full} THEN x_lo END) AS f_lo, max(CASE WHEN {full} THEN x_hi END) AS f_hi,
  max(CASE WHEN {edge} THEN x_lo END) AS e_lo, max(CASE WHEN {edge} THEN x_hi END) AS e_hi,
  max(CASE WHEN {edge} THEN ({HDI} - (hmass - w)) / w END) AS e_f,
  any_value(g_max) AS g_max, any_value(g_z) AS g_z, any_value(g_du) AS g_du{extra}
  FROM {src} GROUP BY {pk}"""
    return f"""SELECT *,
  CASE WHEN f_lo IS NULL THEN e_lo + (e_hi - e_lo - e_f * (e_hi - e_lo)) / 2
       WHEN e_lo IS NULL THEN f_lo
       WHEN e_hi <= f_lo THEN e_hi - e_f * (e_hi - e_lo) ELSE f_lo END AS hdi_3,
  CASE WHEN f_lo IS NULL THEN e_hi - (e_hi - e_lo - e_f * (e_hi - e_lo)) / 2
       WHEN e_lo IS NULL THEN f_hi
       WHEN e_hi <= f_lo THEN f_hi ELSE e_lo + e_f * (e_hi - e_lo) END AS hdi_97
  FROM ({inner}) hq"""


def conjugate_summary_ctes(params: str, keys: Sequence[str], family: str, name: str = "cs",
                           a: str = "alpha", b: str = "beta") -> str:
    """CTEs ending in ``{name}`` = params + mean, sd, median, hdi_3, hdi_97."""
    f = family_sql(family, a, b)
    g = grid_ctes(params, keys, f["lo"], f["hi"], f["logp"], name=f"{name}_g", t=f["t"])
    on = " AND ".join(f"p.{k} = q.{k}" for k in keys)
    return f"""{g},
{name}_s AS ({grid_summary_select(keys, f"{name}_g3")}),
{name} AS (SELECT p.*, {f['mean']} AS mean,
   {f['sd']} AS sd, q.median, q.hdi_3, q.hdi_97
   FROM {params} p JOIN {name}_s q ON {on})"""


def conjugate_curve_ctes(params: str, keys: Sequence[str], family: str, name: str = "cc",
                         a: str = "alpha", b: str = "beta") -> str:
    f = family_sql(family, a, b)
    g = grid_ctes(params, keys, f["lo"], f["hi"], f["logp"], name=f"{name}_g", t=f["t"])
    on = " AND ".join(f"p.{k} = q.{k}" for k in keys)
    c_lo = f"greatest({d(0)}, {f['mean']} - {d(5)} * {f['sd']})"
    c_hi = f"least({f['dom_hi']}, {f['mean']} + {d(5)} * {f['sd']})"
    return f"""{g},
{name}_s AS ({grid_summary_select(keys, f"{name}_g3")}),
{name}_p AS (SELECT p.*, q.g_max, q.g_z, q.g_du, {c_lo} AS c_lo, ({c_hi} - {c_lo}) / {CURVE_N} AS c_dx
   FROM {params} p JOIN {name}_s q ON {on}),
{name}_x AS (SELECT *, r.range AS j, c_lo + (r.range + 0.5) * c_dx AS x FROM {name}_p CROSS JOIN range({CURVE_N}) r),
{name} AS (SELECT *, exp({f['logp']('x')} - g_max) / (g_z * g_du) AS y FROM {name}_x)"""
