"""Building blocks of the DuckDB oracle statements (plain ANSI SQL text).

Each oracle is written independently of the Spark code: the same observation
view, then the operator's semantics spelled out in SQL.
"""

from __future__ import annotations

from .profile import DRIVER


def obs_cte(with_missing: bool = False) -> str:
    ref = "CASE WHEN l_tax = 0.08 THEN NULL ELSE l_quantity END" if with_missing else "l_quantity"
    return f"""obs AS (
  SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS obs_date, {ref} AS ref,
         l_quantity * p_retailprice * (1 + l_tax) / 100 AS s2,
         l_extendedprice / 100 AS s3,
         l_quantity * (1 - l_discount) + (p_retailprice - 900) / 10 AS y,
         (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 1000003 AS rk
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


CC = """cc AS (SELECT * FROM obs WHERE ref IS NOT NULL AND s2 IS NOT NULL AND s3 IS NOT NULL AND y IS NOT NULL)"""


def class_case(v: str, cuts, nullable_low: bool = True) -> str:
    low = f"WHEN {v} IS NULL THEN NULL " + (f"WHEN {v} <= 0 THEN NULL " if nullable_low else "")
    return (f"CASE {low}WHEN {v} <= {cuts[0]} THEN 'Mesotrophic' WHEN {v} <= {cuts[1]} THEN 'Eutrophic' "
            f"ELSE 'Hypertrophic' END")


def ord_case(c: str) -> str:
    return (f"CASE WHEN {c} = 'Mesotrophic' THEN 0 WHEN {c} = 'Eutrophic' THEN 1 "
            f"WHEN {c} = 'Hypertrophic' THEN 2 END")


def site_cls_cte(cuts=DRIVER.site_cuts, src: str = "cc") -> str:
    return f"""sm AS (SELECT site, {class_case('avg(y)', cuts, False)} AS cls FROM {src} GROUP BY site),
clsd AS (SELECT {src}.*, sm.cls FROM {src} LEFT JOIN sm USING (site))"""


# holdout split: test when (rk div 5) mod 100 >= 70, i.e. 30 % of the key space
SPLIT = """sp AS (SELECT *, ((rk // 5) % 100) >= 70 AS is_test FROM cc)"""


METRIC_NAMES = ["n", "rmse", "mae", "r2", "mape", "mbe", "max_error"]


def metric_cols(y: str = "y", p: str = "pred", floor: float = 1e-6, rounded: bool = True) -> str:
    e = f"({y} - {p})"
    yv = f"CASE WHEN {p} IS NOT NULL THEN {y} END"
    r = (lambda x: f"round({x}, 6)") if rounded else (lambda x: x)
    return f"""CAST(count({e}) AS BIGINT) AS n,
  {r(f"sqrt(avg({e} * {e}))")} AS rmse,
  {r(f"avg(abs{e})")} AS mae,
  {r(f"CASE WHEN count({e}) > 1 AND var_pop({yv}) > 0 THEN 1 - sum({e} * {e}) / (var_pop({yv}) * count({e})) END")} AS r2,
  {r(f"avg(abs{e} / greatest({y}, {floor})) * 100")} AS mape,
  {r(f"avg({p} - {y})")} AS mbe,
  {r(f"max(abs{e})")} AS max_error"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# just above one half: exact decimal ties never sit on the snapping boundary
SNAP_HALF = 0.500314159
# from here on values are left alone: beyond about 9e12 the grid index would not fit 64 bits
SNAP_BELOW = 1e9


def grid_round(sql: str, digits: int = 6) -> str:
    """Rewrite every ``round(<expr>, 6)`` into the engine-neutral grid snap
    ``floor(<expr> * 1e6 + 0.5) / 1e6`` (matches ``catalog.snap`` on the Spark side)."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + len(key):k - 1]
        expr, _, d = inner.rpartition(",")
        if not d.strip().isdigit():
            out.append(sql[i:k])
        else:
            f = float(10 ** int(d.strip()))
            x = f"({grid_round(expr, digits)})"
            out.append(sql[i:j] + f"(CASE WHEN abs({x}) < {SNAP_BELOW} THEN floor({x} * {f} + {SNAP_HALF}) / {f} ELSE {x} END)")
        i = k
