import pytest
from pyspark.sql import functions as F

from fieldgrid.functions import names
from fieldgrid.operators import audit, clean


def one(df):
    return [tuple(r) for r in df.collect()]


def test_masks_keep_both_ends_and_null_the_rest(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([-9999.0, 0.0, 1.0, -0.01, 1.01, float("nan"), None, 0.5])], "i int, soil_moisture double").withColumn("lon", F.lit(1.0)).withColumn("lat", F.lit(2.0))
    out = clean.clean(df, F.array(F.lit(-9999.0)), F.lit(None).cast("array<double>"))
    assert sorted(r.soil_moisture for r in out.collect()) == [0.0, 0.5, 1.0]


def test_a_missing_attribute_masks_nothing(spark):
    df = spark.createDataFrame([(1.0, None, [1.0, 2.0]), (3.0, None, None), (2.0, [2.0], None)], "v double, fill array<double>, missing array<double>")
    assert [r[0] for r in df.select(clean.mask_fill(F.col("v"), F.col("fill"), F.col("missing"))).collect()] == [None, 3.0, None]


def test_casts_give_null_for_bad_text(spark):
    df = spark.createDataFrame([("3",), ("x",), ("NaN",), (None,), ("2.5",)], "t string")
    assert one(df.select(clean.to_int(F.col("t")), clean.to_double(F.col("t")))) == [(3, 3.0), (None, None), (None, None), (None, None), (None, 2.5)]


def test_names(spark):
    df = spark.createDataFrame([("d/SM_20200711_R1.nc4", "PM"), ("plain.tar", "am"), ("a/b_19991231_20200101.nc", "xx")], "p string, l string")
    got = one(df.select(names.date_tag(F.col("p")), names.stem(F.col("p")), names.extracted_path(F.col("p"), F.col("l")), names.detrended_path(F.col("p"), F.col("l"))))
    assert got[0] == ("20200711", "SM_20200711_R1", "extracted/pm/SM_20200711_R1_pm.csv", "detrended/pm/SM_20200711_R1.rds")
    assert got[1][:2] == ("", "plain")
    assert got[2][0] == "19991231" and got[2][2] is None and got[2][3] is None


def test_pass_checks(spark):
    files = spark.createDataFrame([("a_pm.csv", "am"), ("a_PM.CSV", "PM"), ("a_am.csv", None)], "file_name string, pass string")
    got = {r.file_name: (r.pass_guess, r.mismatch, r.pass_used) for r in audit.pass_consistency(files).collect()}
    assert got == {"a_pm.csv": ("pm", True, "am"), "a_PM.CSV": ("pm", False, "pm"), "a_am.csv": ("am", False, "am")}
    rows = spark.createDataFrame([("f", "am"), ("f", "AM"), ("g", "am"), ("g", "pm"), ("h", "am"), ("h", None)], "source_file string, pass string")
    got = {r.source_file: (r.n_passes, r.status) for r in audit.single_pass(rows).collect()}
    assert got["f"] == (1, "ok") and got["g"] == (2, "error: expected exactly one pass, found: am, pm") and got["h"][0] == 2


def test_required_columns_and_status_counts(spark):
    h = spark.createDataFrame([("a", ["source_file", "date_tag", "pass", "lon", "lat", "soil_moisture", "extra"]), ("b", ["pass", "lat"])], "source_file string, header array<string>")
    got = {r.source_file: r.status for r in audit.required_columns(h).collect()}
    assert got == {"a": "ok", "b": "error: missing required columns: source_file, date_tag, lon, soil_moisture"}
    log = spark.createDataFrame([("x",), ("x",), (None,), ("y",)], "status string")
    assert sorted(one(audit.status_counts(log))) == [("x", 2), ("y", 1)]


@pytest.mark.parametrize("token", ["NA", "", " NA ", "N/A"])
def test_na_tokens(spark, token):
    df = clean.na_to_null(spark.createDataFrame([(token, 1)], "a string, b int"))
    assert one(df) == [(None, 1)]
