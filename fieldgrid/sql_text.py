"""Pieces of DuckDB SQL for the oracles of the grouped trend surface."""

from __future__ import annotations

from .functions.geo import E, E2, K0, SEMI_MAJOR
from .operators.trend import TERMS

#: Measurement rows derived from ``lineitem``, as queries.measurements makes them.
RAW = """raw AS (
  SELECT 'G_' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS source_file,
    l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    CASE WHEN l_returnflag = 'R' THEN 'pm' ELSE 'am' END AS pass,
    -96.6e0 + (l_partkey % 640) / 100e0 AS lon,
    40.4e0 + (l_orderkey % 310) / 100e0 AS lat,
    CASE WHEN l_tax = 0.08e0 THEN -9999e0 WHEN l_quantity >= 49 THEN 1.2e0
      ELSE 0.12e0 + l_discount + 0.004e0 * (l_suppkey % 3) * ((l_partkey % 640) / 100e0)
        + 0.006e0 * (l_suppkey % 2) * power((l_orderkey % 310) / 100e0 - 1.5e0, 2) END AS soil_moisture
  FROM lineitem)"""
CLEAN = RAW + """,
clean AS (SELECT * FROM raw WHERE soil_moisture <> -9999 AND soil_moisture BETWEEN 0 AND 1)"""
PROJECTED = CLEAN + f""",
s AS (SELECT *, sin(radians(lat)) AS s FROM clean),
xy AS (
  SELECT * EXCLUDE (s), radians(lon) * {SEMI_MAJOR * K0!r}::DOUBLE AS x,
    (s / (1 - {E2!r}::DOUBLE * s * s) - ln((1 - {E!r}::DOUBLE * s) / (1 + {E!r}::DOUBLE * s)) / (2 * {E!r}::DOUBLE)) * (1 - {E2!r}::DOUBLE) * {SEMI_MAJOR!r}::DOUBLE / (2 * {K0!r}::DOUBLE) AS y
  FROM s)"""

KEYS = "source_file, pass"
OPTIONAL = {3: "x2", 4: "y2", 5: "xy"}


def _uv(t: int) -> str:
    a, b = TERMS[t]
    return " * ".join(["u"] * a + ["v"] * b) or "1e0"


def sums() -> str:
    """Gram matrix g{i}{j}, moments m{i} and tss per group, in centred and scaled coordinates."""
    gram = ", ".join(f"sum({_uv(i)} * {_uv(j)}) AS g{i}{j}" for i in range(6) for j in range(i, 6))
    moments = ", ".join(f"sum(w * {_uv(i)}) AS m{i}" for i in range(6))
    return PROJECTED + f""",
st AS (
  SELECT {KEYS}, count(*) AS n, avg(x) AS xm, avg(y) AS ym, avg(soil_moisture) AS zm,
    CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS xs, CASE WHEN stddev_pop(y) > 0 THEN stddev_pop(y) ELSE 1 END AS ys
  FROM xy GROUP BY {KEYS}),
uv AS (
  SELECT xy.*, st.n, st.zm, (x - xm) / xs AS u, (y - ym) / ys AS v, soil_moisture - zm AS w FROM xy JOIN st USING ({KEYS})),
g AS (SELECT {KEYS}, count(*) AS n, any_value(zm) AS zm, {gram}, {moments}, sum(w * w) AS tss FROM uv GROUP BY {KEYS})"""


def _eliminate(source: str, name: str, pivots: list[int], left: list[int]) -> str:
    """CTEs that sweep ``pivots`` out of the symmetric matrix over ``left`` and the value (z)."""
    out, at = "", source
    for k in pivots:
        left = [i for i in left if i != k]
        rest = [*left, "z"]
        g = lambda i, j: _cell(i, j)
        cols = ", ".join(f"{g(i, j)} - {g(k, i)} * {g(k, j)} / {g(k, k)} AS {g(i, j)}" for a, i in enumerate(rest) for j in rest[a:])
        here = f"{name}{k}"
        out += f",\n{here} AS (SELECT {KEYS}, n, {cols} FROM {at})"
        at = here
    return out


def _cell(i, j) -> str:
    if i == "z" and j == "z":
        return "tss"
    if j == "z":
        return f"m{i}"
    if i == "z":
        return f"m{j}"
    return f"g{min(i, j)}{max(i, j)}"


def selection() -> str:
    """``sel``: per group the kept optional terms (k3, k4, k5), their RSS, rank and TSS."""
    text = sums() + _eliminate("g", "base", [0, 1, 2], list(range(6)))
    subsets = [[t for t in (3, 4, 5) if bits >> (t - 3) & 1] for bits in range(8)]
    for bits, terms in enumerate(subsets):
        if terms:
            text += _eliminate("base2", f"r{bits}_", terms, [3, 4, 5])
    joins = " ".join(f"JOIN (SELECT {KEYS}, greatest(tss, 0) AS rss{bits} FROM {f'r{bits}_{terms[-1]}' if terms else 'base2'}) USING ({KEYS})" for bits, terms in enumerate(subsets))
    text += f",\nrss AS (SELECT g.source_file, g.pass, g.n, g.zm, g.tss, {', '.join(f'rss{b}' for b in range(8))} FROM g {joins})"
    aics = ", ".join(f"n * ln(rss{b} / n) + 2 * {3 + bin(b).count('1')} AS a{b}" for b in range(8))
    text += f",\naic AS (SELECT *, {aics} FROM rss)"
    # the greedy path: at most three removals, the first of equal ones
    at = "aic"
    text += f",\nstep0 AS (SELECT *, 7 AS pick FROM {at})"
    for step in (1, 2, 3):
        cases = []
        for b in range(1, 8):
            after = [b & ~(1 << t) for t in range(3) if b >> t & 1]
            for x in after:
                others = " AND ".join([f"a{x} < a{b}", *[f"a{x} <= a{y}" for y in after if y != x]])
                cases.append(f"WHEN pick = {b} AND {others} THEN {x}")
        text += f",\nstep{step} AS (SELECT * EXCLUDE (pick), CASE {' '.join(cases)} ELSE pick END AS pick FROM step{step - 1})"
    rss = " ".join(f"WHEN {b} THEN rss{b}" for b in range(8))
    names = " ".join(f"WHEN {b} THEN '{'+'.join(OPTIONAL[t] for t in terms) or 'none'}'" for b, terms in enumerate(subsets))
    text += f",\nsel AS (SELECT {KEYS}, n, zm, tss, pick, CASE pick {rss} END AS rss, CASE pick {names} END AS kept, 3 + bit_count(pick) AS rank FROM step3)"
    return text


def tested() -> str:
    """``test``: adds p, r2 and trend_removed to ``sel``. The tail is I_x(d2/2, d1/2): recurrences in
    both arguments from the closed forms at 1/2 and 1."""
    beta = lambda a, b: f"exp(lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))"
    half = f"""(CASE WHEN d2 % 2 = 1 THEN 2 / pi() * asin(sqrt(x)) ELSE 1 - sqrt(1 - x) END
      - coalesce(list_sum(list_transform(range(0, CAST(floor((d2 - 1) / 2) AS BIGINT)), lambda k: power(x, k + a0) * sqrt(1 - x) / ((k + a0) * {beta('(k + a0)', '0.5e0')}))), 0))"""
    three = f"{half} + power(x, a) * power(1 - x, 0.5e0) / (0.5e0 * {beta('a', '0.5e0')})"
    five = f"{three} + power(x, a) * power(1 - x, 1.5e0) / (1.5e0 * {beta('a', '1.5e0')})"
    return selection() + f""",
arg AS (
  SELECT *, rank - 1 AS d1, n - rank AS d2, rss / tss AS x, (n - rank) / 2e0 AS a, CASE WHEN (n - rank) % 2 = 1 THEN 0.5e0 ELSE 1e0 END AS a0, 1 - rss / tss AS r2
  FROM sel),
p AS (
  SELECT *, CASE d1 WHEN 2 THEN power(x, a) WHEN 4 THEN power(x, a) * (1 + a * (1 - x)) WHEN 3 THEN {three} ELSE {five} END AS p FROM arg),
test AS (SELECT *, p < 0.05 AND r2 > 0.01 AS trend_removed FROM p)"""


def fitted() -> str:
    """``fit``: every row with trend_hat, resid, sm_for_kriging of its group's selected model."""
    text = tested()
    text += f",\nj0 AS (SELECT g.*, test.pick, test.trend_removed, test.p, test.r2 FROM g JOIN test USING ({KEYS}))"
    cell = lambda i, j: f"c{i}{j}"
    first = ", ".join([f"{_cell(i, j)} AS {cell(i, j)}" for i in range(6) for j in range(6)] + [f"m{i} AS {cell(i, 'z')}" for i in range(6)])
    text += f",\nk0 AS (SELECT {KEYS}, zm, pick, trend_removed, p, r2, {first} FROM j0)"
    for k in range(6):  # Gauss-Jordan, a term only if it is kept
        held = "true" if k < 3 else f"(pick >> {k - 3}) & 1 = 1"
        cols = []
        for i in range(6):
            for j in [*range(6), "z"]:
                new = f"{cell(k, j)} / {cell(k, k)}" if i == k else f"{cell(i, j)} - {cell(i, k)} * {cell(k, j)} / {cell(k, k)}"
                cols.append(f"CASE WHEN {held} THEN {new} ELSE {cell(i, j)} END AS {cell(i, j)}")
        text += f",\nk{k + 1} AS (SELECT {KEYS}, zm, pick, trend_removed, p, r2, {', '.join(cols)} FROM k{k})"
    terms = " + ".join(f"c{t}z * {_uv(t)}" if t < 3 else f"CASE WHEN (pick >> {t - 3}) & 1 = 1 THEN c{t}z ELSE 0 END * {_uv(t)}" for t in range(6))
    text += f""",
hat AS (
  SELECT uv.*, k6.trend_removed, k6.p, k6.r2, CASE WHEN k6.trend_removed THEN k6.zm + {terms} ELSE k6.zm END AS trend_hat FROM uv JOIN k6 USING ({KEYS})),
fit AS (
  SELECT *, soil_moisture - trend_hat AS resid, CASE WHEN trend_removed THEN soil_moisture - trend_hat ELSE soil_moisture END AS sm_for_kriging FROM hat)"""
    return text
