import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldgrid import schemas
from fieldgrid.operators import audit, trend
from fieldgrid.plans import detrend


def rows_of(spark, groups):
    data = [(f, "", "am", float(x), float(y), float(z), i) for f, pts in groups.items() for i, (x, y, z) in enumerate(pts)]
    return spark.createDataFrame(data, "source_file string, date_tag string, pass string, x double, y double, soil_moisture double, p int")


def cloud(seed, n=80, quad=0.0, noise=0.01):
    r = np.random.default_rng(seed)
    x, y = r.uniform(-9e6, -8.9e6, n), r.uniform(4e6, 4.1e6, n)
    u, v = (x + 8.95e6) / 5e4, (y - 4.05e6) / 5e4
    return list(zip(x, y, 0.3 + 0.05 * u - 0.02 * v + quad * u * v + r.normal(0, noise, n)))


def lstsq(points, terms):
    x, y, z = np.array(points).T
    u, v = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
    cols = {"x": u, "y": v, "x2": u * u, "y2": v * v, "xy": u * v}
    a = np.column_stack([np.ones(len(z)), *[cols[t] for t in ("x", "y", *terms)]])
    hat = a @ np.linalg.lstsq(a, z, rcond=None)[0]
    return hat, float(((z - hat) ** 2).sum())


def test_models_agree_with_least_squares(spark):
    groups = {f"g{k}": cloud(k, quad=0.05 * (k % 3)) for k in range(6)}
    for m in trend.models_of(rows_of(spark, groups)).collect():
        pts, terms = groups[m.source_file], [] if m.kept == "none" else m.kept.split("+")
        hat, rss = lstsq(pts, terms)
        assert math.isclose(m.rss, rss, rel_tol=1e-7)
        z = np.array(pts)[:, 2]
        assert math.isclose(m.r2, 1 - rss / ((z - z.mean()) ** 2).sum(), rel_tol=1e-7)
        # no single removal, and none at all, has a lower AIC
        aic = lambda t: len(z) * math.log(lstsq(pts, t)[1] / len(z)) + 2 * (3 + len(t))
        assert all(aic(terms) <= aic([x for x in terms if x != t]) + 1e-9 for t in terms)


def test_residuals_add_up_and_gate(spark):
    r = np.random.default_rng(5)
    noise = [(x, y, 0.3 + r.normal(0, 0.01)) for x, y, _ in cloud(9)]
    rows = rows_of(spark, {"trend": cloud(1), "noise": noise})
    models = trend.models_of(rows)
    out = trend.residuals(rows, models).collect()
    for o in out:
        assert math.isclose(o.trend_hat + o.resid, o.soil_moisture, abs_tol=1e-12)
        assert o.sm_for_kriging == (o.resid if o.trend_removed else o.soil_moisture)
    assert {o.trend_removed for o in out if o.source_file == "trend"} == {True}
    check = audit.reconstruction(trend.residuals(rows, models), 1e-10).collect()
    assert len(check) == 2 and not any(c.warning for c in check)


def test_small_constant_and_collinear_groups(spark):
    line = [(k * 1e3, k * 2e3, 0.1 + 0.01 * k + (0.001 if k % 2 else 0)) for k in range(12)]
    six = cloud(3, n=6)
    groups = {"five": cloud(1, n=5), "six": six, "constant": [(x, y, 0.5) for x, y, _ in cloud(2)], "line": line}
    got = {m.source_file: m for m in trend.models_of(rows_of(spark, groups)).collect()}
    assert got["five"].note == got["constant"].note == "small_n_or_constant" and got["five"].p is None
    assert not got["five"].trend_removed and not got["constant"].trend_removed
    assert got["six"].note == "model_fitted"
    assert got["line"].note == "model_fitted" and got["line"]["rank"] <= 3


@pytest.mark.parametrize("d1,a", [(2, 7.5), (4, 12.0), (2, 30.0)])
def test_upper_tail_closed_forms(d1, a):
    for x in (0.05, 0.3, 0.9, 0.999):
        want = x**a if d1 == 2 else x**a * (1 + a * (1 - x))
        assert math.isclose(trend.upper_tail(x, d1, int(2 * a)), want, rel_tol=1e-10)


@settings(max_examples=60, deadline=None)
@given(d1=st.integers(2, 5), d2=st.integers(1, 200), x=st.floats(0.01, 0.99))
def test_upper_tail_is_the_integral(d1, d2, x):
    a, b = d2 / 2, d1 / 2
    # substitution t = s**2 takes the pole at 0 away
    s = np.linspace(0, math.sqrt(x), 40001)
    f = 2 * s ** (2 * a - 1) * (1 - s**2) ** (b - 1)
    h = s[1]
    area = h / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())
    want = area / math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    assert math.isclose(trend.upper_tail(x, d1, d2), want, rel_tol=1e-5, abs_tol=1e-12)


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(0, 10_000), shift=st.floats(-1e7, 1e7), scale=st.floats(0.1, 1e4))
def test_selection_does_not_depend_on_shift_and_scale(seed, shift, scale):
    def solve(points):
        x, y, z = np.array(points).T
        u, v, w = (x - x.mean()) / x.std(), (y - y.mean()) / y.std(), z - z.mean()
        a = np.column_stack([u**i * v**j for i, j in trend.TERMS])
        return trend.solve_group(a.T @ a, a.T @ w, float(w @ w), len(w))

    pts = cloud(seed, n=60, quad=0.02)
    one, two = solve(pts), solve([(x * scale + shift, y * scale - shift, z) for x, y, z in pts])
    assert one["kept"] == two["kept"] or abs(one["aic"] - two["aic"]) < 1e-6
    assert math.isclose(one["rss"], two["rss"], rel_tol=1e-5)


def test_whole_job_logs_every_file(spark):
    pts = [(f"f{k}_am.csv", "", "am", -96 + i % 9 / 10, 40 + i // 9 / 10, 0.2 + 0.01 * (i % 9) + 0.001 * (i % 5)) for k in range(2) for i in range(45)]
    pts += [("two.csv", "", "am", -96.0, 40.0, 0.1), ("two.csv", "", "pm", -96.0, 40.0, 0.1), ("small_pm.csv", "", "PM", -96.0, 40.0, 0.3)]
    rows = spark.createDataFrame(pts, "source_file string, date_tag string, pass string, lon double, lat double, soil_moisture double")
    files = spark.createDataFrame([("in/f0_am.csv",), ("in/empty_pm.csv",)], "file_name string")
    cells, log = detrend.detrend_all(rows, files=files)
    got = {r.source_file: r for r in log.collect()}
    assert got["f0_am.csv"].status == "written" and got["f0_am.csv"].note == "model_fitted" and got["f0_am.csv"].rows == 45
    assert got["two.csv"].status == "error" and "am, pm" in got["two.csv"].note
    assert got["small_pm.csv"].note == "small_n_or_constant" and got["small_pm.csv"]["pass"] == "pm"
    assert got["empty_pm.csv"].status == "written_empty" and got["empty_pm.csv"].rows == 0 and got["empty_pm.csv"]["pass"] == "pm"
    out = cells.where("source_file = 'f0_am.csv'").orderBy("pixel_id").collect()
    assert [o.pixel_id for o in out] == list(range(1, 46)) and len(out[0].geometry) == 93 and out[0].srid == 6933


def test_skip_existing(spark):
    from dataclasses import replace

    from fieldgrid.config import DEFAULT

    rows = spark.createDataFrame([("a.csv", "", "am", -96.0, 40.0, 0.1), ("b.csv", "", "am", -96.0, 40.0, 0.2)], "source_file string, date_tag string, pass string, lon double, lat double, soil_moisture double")
    done = spark.createDataFrame([("a.csv", "am")], "source_file string, pass string")
    cells, log = detrend.detrend_all(rows, done=done, settings=replace(DEFAULT, overwrite=False))
    assert {r.source_file: (r.status, r.rows) for r in log.collect()} == {"a.csv": ("skipped_existing", None), "b.csv": ("written", 1)}
    assert cells.select("source_file").distinct().count() == 1


def test_empty_input(spark):
    rows = spark.createDataFrame([], "source_file string, date_tag string, pass string, lon double, lat double, soil_moisture double")
    cells, log = detrend.detrend_all(rows)
    assert cells.count() == 0 and log.count() == 0
    assert [f.name for f in cells.schema] == [x.split()[0] for x in schemas.CELLS.split(", ")]


def test_missing_columns_and_errors_of_other_passes(spark):
    rows = spark.createDataFrame([("a_am.csv", "am", 0.1), ("b_pm.csv", "pm", 0.1)], "source_file string, pass string, soil_moisture double")
    cells, log = detrend.detrend_all(rows, label="am")
    assert cells.count() == 0 and [(r.source_file, r.status, r.note) for r in log.collect()] == [("a_am.csv", "error", "error: missing required columns: date_tag, lon, lat")]


def test_the_masks_do_not_repeat_the_value(spark):
    from pyspark.sql import functions as F

    from fieldgrid.operators import clean

    rows = spark.range(10).select(F.pow("id", F.lit(2.0)).alias("soil_moisture"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"))
    plan = clean.clean(rows, F.array(F.lit(-9999.0)), F.lit(None).cast("array<double>"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("POWER") <= 4


def test_all_groups_at_once_are_each_group_alone():
    """Stacked systems, among them aliased, empty and exact ones, against a plain loop over terms."""

    def alone(gram, moment, tss, n):
        def fit(terms):
            kept = []
            for t in terms:
                trial = [*kept, t]
                g = gram[np.ix_(trial, trial)]
                rest = g[-1, -1] - (g[-1, :-1] @ np.linalg.solve(g[:-1, :-1], g[:-1, -1]) if kept else 0.0)
                kept = trial if rest > trend.RANK_TOLERANCE * max(g[-1, -1], 1e-300) else kept
            return max(0.0, tss - float(np.linalg.solve(gram[np.ix_(kept, kept)], moment[kept]) @ moment[kept])) if kept else tss, kept

        aic = lambda f: n * math.log(f[0] / n) + 2 * len(f[1]) if f[0] > 0 else -math.inf
        now = fit(range(6))
        terms = [t for t in range(6) if t < 3 or t in now[1]]
        while True:
            tried = [(aic(fit([x for x in terms if x != t])), t) for t in terms if t > 2]
            if not tried or min(tried)[0] >= aic(now):
                return terms[3:], now
            terms.remove(min(tried)[1])
            now = fit(terms)

    r = np.random.default_rng(11)
    systems = []
    for k in range(300):
        n = int(r.integers(6, 60))
        u, v = r.normal(size=n), r.normal(size=n)
        if k % 5 == 0:
            v = 2 * u  # on a line: y, y2 and xy are aliased
        if k % 7 == 0:
            u = np.sign(u)  # x2 is the constant
        w = 0.3 * u - 0.2 * v + (k % 3) * 0.2 * u * v + r.normal(0, 0.3, n)
        w -= w.mean()
        a = np.column_stack([u**i * v**j for i, j in trend.TERMS])
        systems.append((a.T @ a, a.T @ w, float(w @ w), n))
    out = trend.solve_groups(*(np.stack([s[k] for s in systems]) for k in range(2)), *(np.array([s[k] for s in systems]) for k in (2, 3)))
    for k, s in enumerate(systems):
        terms, (rss, kept) = alone(*s)
        assert trend.KEPT[out["bits"][k]] == ("+".join(trend.OPTIONAL[t - 3] for t in terms) or "none")
        assert math.isclose(out["rss"][k], rss, rel_tol=1e-6, abs_tol=1e-9) and out["rank"][k] == len(kept)
    zero = trend.solve_groups(np.zeros((1, 6, 6)), np.zeros((1, 6)), np.zeros(1), np.ones(1, int))
    assert np.isnan(zero["p"][0]) and zero["rank"][0] == 0


def test_surface_of_a_singular_group_has_its_rank(spark):
    line = [(k * 1e3, k * 2e3, 0.1 + 0.01 * k + (0.001 if k % 2 else 0)) for k in range(12)]
    rows = rows_of(spark, {"line": line, "cloud": cloud(4)})
    sums = trend.group_sums(rows, trend.guarded(trend.group_stats(rows)))
    got = {r.source_file: r for r in trend.fit_surfaces(sums).collect()}
    assert got["line"]["rank"] == 3 and got["cloud"]["rank"] == 6 and math.isclose(got["cloud"].rss, lstsq(cloud(4), ["x2", "y2", "xy"])[1], rel_tol=1e-7)
    assert [r.b1 is None for r in trend.fit_planes(sums).orderBy("source_file").collect()] == [False, True]


def test_means_are_joined_back_and_null_keys_are_a_group(spark):
    df = spark.createDataFrame([("a", "am", 1.0), ("a", "am", 3.0), (None, "am", 5.0), (None, "am", None)], "source_file string, pass string, soil_moisture double")
    got = sorted(map(tuple, trend.mean_residuals(df).collect()), key=str)
    assert got == sorted([("a", "am", 1.0, 2.0, -1.0), ("a", "am", 3.0, 2.0, 1.0), (None, "am", 5.0, 5.0, 0.0), (None, "am", None, 5.0, None)], key=str)


def test_pixel_ids_of_a_large_file_are_many_tasks(spark):
    from pyspark.sql import functions as F

    from fieldgrid.operators import granules

    df = spark.range(4000).select(F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source_file"), F.lit("am").alias("pass"), (F.col("id") * 7919 % 4001).alias("o"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = granules.pixel_ids(df, ["o"])
        parts = {r[0] for r in out.where("source_file = 'large'").select(F.spark_partition_id()).distinct().collect()}
        got = sorted((r.source_file, r.o, r.pixel_id) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for f in ("large", "small"):
        assert [p for s, _, p in got if s == f] == list(range(1, 1 + sum(s == f for s, _, _ in got)))
    assert len(parts) > 1 and out.columns == [*df.columns, "pixel_id"]
