import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldgrid import schemas
from fieldgrid.functions import geo
from fieldgrid.operators import granules
from fieldgrid.plans import extract
from fieldgrid.sources.manifest import NoFiles

P = "Soil_Moisture_Retrieval_Data_AM"


def chunks(granule, variable, grid, dims=None):
    """Rows of the array table of a grid in storage order (first dimension fast)."""
    grid = np.asarray(grid, dtype=float)
    if grid.ndim == 1:
        return [(granule, variable, dims or [len(grid)], 0, grid.tolist())]
    d1, d2 = grid.shape
    return [(granule, variable, dims or [d1, d2], j, grid[:, j].tolist()) for j in range(d2)]


def run(spark, rows, attributes=(), **more):
    arrays = spark.createDataFrame(rows, schemas.ARRAYS)
    out, log = extract.extract_all(arrays, spark.createDataFrame(list(attributes), schemas.ATTRIBUTES), **more)
    got = sorted((r.source_file, r["pass"], r.p, r.lon, r.lat, r.soil_moisture) for r in out.collect())
    return got, {(r.source_file, r["pass"]): (r.rows, r.status) for r in log.collect()}


V = np.array([[0.1, 0.2, 0.3], [0.4, 0.5, 0.6]])
LON, LAT = np.array([[1.0, 1, 1], [2, 2, 2]]), np.array([[5.0, 6, 7], [5, 6, 7]])
WANT = [(p, LON[p % 2, p // 2], LAT[p % 2, p // 2], V[p % 2, p // 2]) for p in range(6)]


def test_every_layout_gives_the_same_rows(spark):
    rows = []
    rows += chunks("a_20200711.nc4", f"{P}/soil_moisture", V) + chunks("a_20200711.nc4", f"{P}/longitude", LON) + chunks("a_20200711.nc4", f"{P}/latitude", LAT)
    rows += chunks("b.nc4", f"{P}/soil_moisture", V) + chunks("b.nc4", f"{P}/longitude", LON.T) + chunks("b.nc4", f"{P}/latitude", LAT.T)
    rows += chunks("c.nc", f"{P}/soil_moisture", V) + chunks("c.nc", "longitude", [1, 2]) + chunks("c.nc", "latitude", [5, 6, 7])
    rows += chunks("d.nc", f"{P}/soil_moisture", V) + chunks("d.nc", "longitude", [1, 2, 3]) + chunks("d.nc", "latitude", [5, 6])
    got, log = run(spark, rows)
    for name in ("a_20200711.nc4", "b.nc4", "c.nc"):
        assert [g[2:] for g in got if g[0] == name] == WANT
        assert log[name, "am"] == (6, "written")
    assert [g[3:5] for g in got if g[0] == "d.nc"] == [(p // 2 + 1.0, p % 2 + 5.0) for p in range(6)]


def test_errors_are_rows_and_the_rest_goes_on(spark):
    good = chunks("ok.nc4", f"{P}/soil_moisture", V) + chunks("ok.nc4", "lon", [1, 2]) + chunks("ok.nc4", "lat", [5, 6, 7])
    flat = chunks("flat.nc4", f"{P}/soil_moisture", [1.0, 2]) + chunks("flat.nc4", "lon", [1, 2]) + chunks("flat.nc4", "lat", [5, 6])
    mixed = chunks("mixed.nc4", f"{P}/soil_moisture", V) + chunks("mixed.nc4", "lon", LON) + chunks("mixed.nc4", "lat", [5, 6, 7])
    none = chunks("none.nc4", "other", V)
    lost = chunks("lost.nc4", "sm_am", V) + chunks("lost.nc4", "lat", [5, 6, 7])
    got, log = run(spark, good + flat + mixed + none + lost)
    assert {g[0] for g in got} == {"ok.nc4"}
    assert log["ok.nc4", "am"] == (6, "written") and ("ok.nc4", "pm") not in log
    assert log["flat.nc4", "am"][1].startswith("error: value is not 2-D")
    assert log["mixed.nc4", "am"][1].startswith("error: shapes")
    assert log["none.nc4", "am"][1] == "error: no pass found"
    assert log["lost.nc4", "am"][1] == "error: no longitude"


def test_fill_range_priority_and_limit(spark):
    v = np.array([[-9999.0, 0.0, 1.0], [-0.01, 1.01, float("nan")]])
    rows = chunks("a.nc4", f"{P}/soil_moisture_dca", V) + chunks("a.nc4", f"{P}/soil_moisture", v, [2, 3, 1]) + chunks("a.nc4", "lon", [1, 2]) + chunks("a.nc4", "lat", [5, 6, 7]) + chunks("b.nc4", "sm_am", V)
    got, log = run(spark, rows, [("a.nc4", f"{P}/soil_moisture", "_FillValue", [-9999.0])], limit=1)
    assert [g[5] for g in got] == [0.0, 1.0] and set(log) == {("a.nc4", "am")}


def test_no_granules_are_an_error_unless_allowed(spark):
    with pytest.raises(NoFiles):
        run(spark, [])
    got, log = run(spark, [], must=False)
    assert got == [] and log == {}


def test_granules_of_one_base_name_are_counted_apart(spark):
    rows = [r for d in ("x", "y") for r in chunks(f"{d}/a.nc4", "sm_am", V if d == "x" else V + [[1], [0]]) + chunks(f"{d}/a.nc4", "lon", [1, 2]) + chunks(f"{d}/a.nc4", "lat", [5, 6, 7])]
    _, log = extract.extract_all(spark.createDataFrame(rows, schemas.ARRAYS), spark.createDataFrame([], schemas.ATTRIBUTES))
    assert sorted((r.source_file, r.rows, r.status) for r in log.collect()) == [("a.nc4", 3, "written"), ("a.nc4", 6, "written")]


def test_catalogue(spark):
    df = spark.createDataFrame(chunks("g", "A/x", V) + chunks("g", "b", V), schemas.ARRAYS)
    assert sorted(map(tuple, granules.catalogue(df).collect())) == [("g", "A/x", "A"), ("g", "b", "b")]
    assert granules.catalogue_lists(df).first()["variables"] == ["A/x", "b"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(d1=st.integers(2, 4), d2=st.integers(2, 4))
def test_flattening_does_not_depend_on_transposition(spark, d1, d2):
    v, x, y = (np.arange(d1 * d2, dtype=float).reshape(d1, d2) + k for k in (0, 100, 200))
    df = lambda g: spark.createDataFrame(chunks("g", "v", g), schemas.ARRAYS)
    key = lambda r: r.p
    same = sorted(granules.flatten_same(df(v), df(x), df(y)).collect(), key=key)
    turned = sorted(granules.flatten_transposed(df(v), df(x.T), df(y.T)).collect(), key=key)
    assert same == turned and [r.value for r in same] == v.ravel(order="F").tolist()


def test_projection_anchors_and_poles(spark):
    df = spark.createDataFrame([(180.0, 0.0), (0.0, 85.0445664), (-180.0, -85.0445664), (0.0, 91.0)], "lon double, lat double")
    got = [tuple(r) for r in df.select(geo.project_x(F.col("lon")), geo.project_y(F.col("lat"))).collect()]
    assert math.isclose(got[0][0], 17367530.445, abs_tol=1e-2) and math.isclose(got[0][1], 0, abs_tol=1e-9)
    assert math.isclose(got[1][1], 7314540.831, abs_tol=1e-1) and math.isclose(got[2][1], -7314540.831, abs_tol=1e-1)
    assert got[3][1] is None


def test_square_and_wkb(spark):
    import struct

    pts = [(0.0, 0.0), (-9316413.87, 4837211.5), (1.0, -2.0), (4512.155, 1e-3), (123456.789, -0.1)]
    df = spark.createDataFrame(pts, "x double, y double")
    s = geo.square(F.col("x"), F.col("y"), 9024.31)
    for row, (x, y) in zip(df.select(s.alias("s"), geo.well_known_binary(s).alias("w")).collect(), pts):
        want = [(x + a, y + b) for a, b in ((-4512.155, -4512.155), (4512.155, -4512.155), (4512.155, 4512.155), (-4512.155, 4512.155), (-4512.155, -4512.155))]
        assert [(p.x, p.y) for p in row.s] == want
        assert bytes(row.w) == struct.pack("<BIII", 1, 3, 1, 5) + b"".join(struct.pack("<dd", *p) for p in want)
