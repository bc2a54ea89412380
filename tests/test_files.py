"""Files at the paths of the logs: sinks, what is on disk, headers, mixed folders, geometry."""

import gzip
import math
import os
import struct
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldgrid import schemas
from fieldgrid.config import DEFAULT
from fieldgrid.functions import geo
from fieldgrid.plans import detrend, extract
from fieldgrid.sources import io, manifest, named

from .test_granules import V, chunks

HEADER = "source_file,date_tag,pass,lon,lat,soil_moisture"


def files_of(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.startswith("."))


def put(root, **files):
    for name, text in files.items():
        path = root / f"{name}.csv"
        path.write_bytes(text) if isinstance(text, bytes) else path.write_text(text)


def test_one_file_a_path_others_stay_and_staging_goes(spark, tmp_path):
    root = str(tmp_path / "o ut")
    rows = lambda v, *paths: spark.createDataFrame([(p, v, k) for p in paths for k in range(3)], "output_file string, v int, k int")
    assert named.write_named(rows(1, "am/a b=1.csv", "pm/c%2F.csv", None), root) == 2
    assert files_of(root) == ["am/a b=1.csv", "pm/c%2F.csv"]
    empty = spark.createDataFrame([("pm/none.csv",), ("am/a b=1.csv",), (None,)], "output_file string")
    assert named.write_named(rows(2, "am/a b=1.csv"), root, empty=empty) == 2
    assert files_of(root) == ["am/a b=1.csv", "pm/c%2F.csv", "pm/none.csv"]
    text = {p: open(os.path.join(root, p)).read().split() for p in files_of(root)}
    assert text["am/a b=1.csv"] == ["v,k", "2,0", "2,1", "2,2"] and text["pm/none.csv"] == ["v,k"] and text["pm/c%2F.csv"][1] == "1,0"
    assert named.write_named(rows(1).limit(0), str(tmp_path / "none")) == 0 and files_of(str(tmp_path / "none")) == []


def test_an_error_leaves_no_staging_folder(spark, tmp_path):
    bad = spark.range(3).select(F.lit("a.csv").alias("output_file"), F.raise_error(F.lit("no")).cast("int").alias("v"))
    with pytest.raises(Exception, match="no"):
        named.write_named(bad, str(tmp_path))
    assert files_of(str(tmp_path)) == []


def odd_rows(spark):
    rows = [(f"d{k % 3}/a b=%2F{k % 5}.csv", t, 1.5e-7 * k, k, k % 2 == 0) for k, t in enumerate(["x", "", None, 'q"u', "a,b", " s ", "l\\n", "é", "\t", "0"] * 7)]
    df = spark.createDataFrame(rows, "output_file string, t string, `d.e` double, n int, b boolean")
    return df.withColumn("at", -F.col("n")).withColumn("day", F.expr("timestamp_seconds(n * 100000.5)")).withColumn("m", F.expr("cast(n / 8 as decimal(9, 3))"))


@pytest.mark.parametrize("form", ["csv", "parquet"])
def test_files_are_written_by_tasks_as_spark_writes_them(spark, tmp_path, monkeypatch, form):
    df, empty = odd_rows(spark), spark.createDataFrame([("d0/none.csv",), ("d0/a b=%2F0.csv",)], "output_file string")
    mine, its = str(tmp_path / "mi ne"), str(tmp_path / "its")
    with monkeypatch.context() as m:
        m.setattr(named, "_writable", lambda *_: False)
        assert named.write_named(df, its, form=form, empty=empty, order=["at"]) == 16
    refuse = lambda *_: pytest.fail("a file passes the driver")
    for name in ("move", "copy", "files"):
        monkeypatch.setattr(named.Store, name, refuse)
    assert named.write_named(df, mine, form=form, empty=empty, order=["at"]) == 16
    assert files_of(mine) == files_of(its)
    if form == "csv":
        for f in files_of(its):
            assert (tmp_path / "mi ne" / f).read_bytes() == (tmp_path / "its" / f).read_bytes()
    read = lambda root: spark.read.option("recursiveFileLookup", True).parquet(root)
    if form == "parquet":
        assert read(mine).schema == read(its).schema and sorted(map(str, read(mine).collect())) == sorted(map(str, read(its).collect()))
        assert spark.read.parquet(f"{mine}/d0/none.csv").schema == read(its).schema


def test_a_file_that_spark_wrote_is_replaced_with_its_checksum(spark, tmp_path, monkeypatch):
    rows = lambda v: spark.createDataFrame([("a.csv", v)], "output_file string, v string")
    with monkeypatch.context() as m:
        m.setattr(named, "_writable", lambda *_: False)
        named.write_named(rows("old"), str(tmp_path))
    named.write_named(rows("new and longer"), str(tmp_path))
    assert [r.value for r in spark.read.text(str(tmp_path)).collect()] == ["v", "new and longer"]


def test_a_listing_is_made_once_and_has_files_of_no_bytes(spark, tmp_path):
    put(tmp_path, full="x\n", none="", other="y\n")
    there = manifest.on_disk(spark, str(tmp_path))
    os.remove(tmp_path / "other.csv")
    assert sorted(map(tuple, there.collect())) == [("full.csv", 2), ("none.csv", 0), ("other.csv", 2)]


def test_what_is_on_disk_drives_skipping_and_reconciliation(spark, tmp_path):
    root = str(tmp_path)
    work = spark.createDataFrame([(f"f{k}", p, f"extracted/{p}/f{k}_{p}.csv") for k in range(3) for p in ("am", "pm")], "source_file string, pass string, output_file string")
    assert manifest.on_disk(spark, root + "/not there").count() == 0
    named.write_named(work, root)
    os.remove(tmp_path / "extracted/am/f1_am.csv")
    there = manifest.on_disk(spark, root, DEFAULT.table_pattern)
    assert sorted(r.output_file for r in there.collect()) == files_of(root)
    assert [tuple(r)[:2] for r in manifest.pending(work, there, ["output_file"], replace(DEFAULT, overwrite=False)).select("source_file", "pass").collect()] == [("f1", "am")]
    assert manifest.done_on_disk(work, there).count() == 5
    named.write_named(work.where("source_file = 'f0'").withColumn("output_file", F.concat(F.lit("detrended/"), "pass", F.lit("/f0_"), "pass", F.lit(".rds"))), root, form="parquet")
    stage = lambda s: manifest.stage_files(manifest.on_disk(spark, root).where(F.col("output_file").startswith(s)))
    assert sorted(map(tuple, manifest.reconcile(stage("extracted"), stage("detrended")).collect())) == [("am", 2, 1, 1), ("pm", 3, 1, 2)]
    assert {r.output_file: r["rows"] for r in manifest.rows_on_disk(spark, root + "/detrended", "parquet").collect()} == {"am/f0_am.rds": 1, "pm/f0_pm.rds": 1}


def test_headers_are_read_without_the_rest(spark, tmp_path):
    put(tmp_path, a=f"{HEADER}\n1,2,3,4,5,6\n", b='lat,"lo,n" \r\n1,2\r\n', none="", only=HEADER, bom="﻿x,y\n")
    big = "u,v\n" + "1,2\n" * 700_000
    put(tmp_path, big=big)
    got = {r.file_name: list(r.header) for r in io.read_headers(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": HEADER.split(","), "b.csv": ["lat", "lo,n"], "only.csv": HEADER.split(","), "bom.csv": ["x", "y"], "big.csv": ["u", "v"]}


def test_files_of_differing_columns_are_one_table(spark, tmp_path):
    put(tmp_path, a="x,y,t\n1,2.5,NA\n2,3,\"q,r\"\n", b="y,x\n4,3\n", c="t,z\n#N/A N/A,7\n-1.#IND,8\n", d="x,y\n1\n1,2,3\n\n", e="x,y,t\n")
    df = io.read_delimited(spark, str(tmp_path))
    assert df.columns == ["file_name", "malformed", "t", "x", "y", "z"]
    got = sorted(map(tuple, df.collect()), key=str)
    want = [("a.csv", False, None, "1", "2.5", None), ("a.csv", False, "q,r", "2", "3", None), ("b.csv", False, None, "3", "4", None), ("c.csv", False, None, None, None, "7"), ("c.csv", False, None, None, None, "8"), ("d.csv", True, None, "1", None, None), ("d.csv", True, None, "1", "2", None)]
    assert got == sorted(want, key=str)
    assert dict(io.inferred(df.where("not malformed"), keep=("file_name", "malformed")).dtypes) == {"file_name": "string", "malformed": "boolean", "t": "string", "x": "bigint", "y": "double", "z": "bigint"}


def tasks_of(spark, name, job):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out, tracker = job(), spark.sparkContext.statusTracker()
    finally:
        spark.sparkContext.setJobGroup("", "")
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds]
    return out, sum(s.numTasks for s in stages if s)


def test_many_small_files_are_few_tasks(spark, tmp_path):
    put(tmp_path, **{f"f{k}": f"x,y{k % 3}\n{k},2\n" for k in range(80)})
    headers, n = tasks_of(spark, "headers", lambda: io.read_headers(spark, str(tmp_path)))
    assert headers.count() == 80 and n < 40
    counted, n = tasks_of(spark, "rows", lambda: manifest.rows_on_disk(spark, str(tmp_path)))
    assert {r["rows"] for r in counted.collect()} == {1} and n < 100


def test_lines_are_those_of_the_reader_of_lines(spark, tmp_path):
    put(tmp_path, cr=b"x,y\r1,2\r\r\n3,4\r\n", bom="\ufeffx,y\n5,6\n".encode(), bytes=b"x,\xff\xfe\n7,\xff\n", end=b"x,y\n8,9", empty=b"", feeds=b"\n\n", big=b"x,y\n" + b"1,2\n" * 300_000 + b"11,12")
    (tmp_path / "packed.csv.gz").write_bytes(gzip.compress(b"x,y\n13,14\n"))
    rows = {r.output_file: r["rows"] for r in manifest.rows_on_disk(spark, str(tmp_path)).collect()}
    lines = spark.read.option("recursiveFileLookup", True).text(str(tmp_path)).groupBy(F.col("_metadata.file_name").alias("f")).count().collect()
    assert rows == {r.f: r["count"] - 1 for r in lines} | {"empty.csv": 0}
    got = io.read_delimited(spark, str(tmp_path), ["x", "y"]).groupBy("file_name", "malformed", "x", "y").count().collect()
    want = {("cr.csv", "1", "2", 1), ("cr.csv", "3", "4", 1), ("bom.csv", "5", "6", 1), ("bytes.csv", "7", None, 1), ("end.csv", "8", "9", 1), ("big.csv", "1", "2", 300_000), ("big.csv", "11", "12", 1), ("packed.csv.gz", "13", "14", 1)}
    assert {(r.file_name, r.x, r.y, r["count"]) for r in got} == want and not any(r.malformed for r in got)


def test_types_are_those_of_the_casts(spark):
    columns = [["1", " 2 ", "+3", "-4"], ["1", "2.0"], ["1e3", ".5"], ["inf", "-Infinity", "NaN"], ["1", "x"], ["9223372036854775808"], ["1 2"], ["\t7\n", None], ["1d"], ["--1"], [None]]
    for texts in columns:
        df = spark.createDataFrame([(t,) for t in texts], "c string")
        fits = [k for k in ("bigint", "double") if df.where(F.col("c").isNotNull() & F.col("c").try_cast(k).isNull()).isEmpty()]
        assert io.inferred(df).dtypes == [("c", [*fits, "string"][0])], texts


def test_a_folder_of_good_and_bad_files_gives_a_log_row_each(spark, tmp_path):
    line = lambda k, lat=40.0: f"g,20200711,am,{-96 + k / 10},{lat},{0.2 + k / 100}"
    good = "\n".join([HEADER, *map(line, range(5))]) + "\n"
    turned = "\n".join(",".join(reversed(x.split(","))) for x in good.split("\n") if x) + "\n"
    put(tmp_path, good_am=good, turned_am=turned, torn_am=good.rsplit(",", 1)[0], short_am="source_file,pass\ng,am\n", binary_pm=bytes(range(256)) * 4, nothing_pm="", head_pm=HEADER + "\n", words_am=good.replace("0.2", "x"))
    (tmp_path / "notes.txt").write_text("left out")
    cells, log = detrend.detrend_files(spark, str(tmp_path))
    got = {r.source_file[:-4]: (r["pass"], r.status, r["rows"], r.note) for r in log.collect()}
    assert len(got) == log.count() == 8
    assert got["good_am"] == got["turned_am"] == ("am", "written", 5, "small_n_or_constant")
    assert got["torn_am"] == ("am", "error", None, "error: 1 malformed records")
    assert got["short_am"][3] == "error: missing required columns: date_tag, lon, lat, soil_moisture"
    assert got["binary_pm"][1] == "error" and got["nothing_pm"] == ("pm", "error", None, "error: no header can be read")
    assert got["head_pm"] == ("pm", "written_empty", 0, "empty_input_csv")
    assert got["words_am"] == ("am", "error", None, "error: no usable rows")
    assert {r[0] for r in cells.select("source_file").distinct().collect()} == {"good_am.csv", "turned_am.csv"}
    only = detrend.detrend_files(spark, str(tmp_path), label="pm")[1]
    assert {r.source_file for r in only.collect()} == {"binary_pm.csv", "nothing_pm.csv", "head_pm.csv"}
    (tmp_path / "none").mkdir()
    assert detrend.detrend_files(spark, str(tmp_path / "none"))[1].count() == 0


def test_empty_files_have_all_columns(spark, tmp_path):
    rows = spark.createDataFrame([("a_am.csv", "", "am", -96.0, 40.0, 0.1)], schemas.EXTRACTED)
    files = spark.createDataFrame([("in/a_am.csv",), ("in/e_pm.csv",)], "file_name string")
    cells, log = detrend.detrend_all(rows, files=files)
    assert detrend.write_cells(cells, log, str(tmp_path)) == 2
    assert files_of(str(tmp_path)) == sorted(r.output_file for r in log.collect()) == ["detrended/am/a_am.rds", "detrended/pm/e_pm.rds"]
    empty = spark.read.parquet(str(tmp_path / "detrended/pm/e_pm.rds"))
    assert empty.count() == 0 and empty.dtypes == cells.dtypes


def test_extracted_files_are_the_logs_files_and_are_skipped(spark, tmp_path):
    p = "Soil_Moisture_Retrieval_Data_AM"
    rows = lambda name, v, lat=(5, 6, 7): chunks(name, f"{p}/soil_moisture", v) + chunks(name, "lon", [1, 2]) + chunks(name, "lat", lat)
    arrays = spark.createDataFrame(rows("a.nc4", V) + rows("none.nc4", V + 5) + rows("bad.nc4", V, [5, 6]), schemas.ARRAYS)
    attributes = spark.createDataFrame([], schemas.ATTRIBUTES)
    log = {r.source_file: (r["rows"], r.output_file, r.status) for r in extract.extract_to_files(arrays, attributes, str(tmp_path)).collect()}
    assert log["a.nc4"] == (6, "extracted/am/a_am.csv", "written") and log["none.nc4"] == (0, "extracted/am/none_am.csv", "written")
    assert files_of(str(tmp_path)) == sorted(x[1] for x in log.values() if x[1])
    os.remove(tmp_path / "extracted/am/none_am.csv")
    again = extract.extract_to_files(arrays, attributes, str(tmp_path), settings=replace(DEFAULT, overwrite=False))
    assert {r.source_file: r.status for r in again.collect() if not r.status.startswith("error")} == {"a.nc4": "skipped_existing", "none.nc4": "written"}


NUMBERS = st.floats(allow_nan=False, allow_infinity=False, min_value=-1e300, max_value=1e300).filter(lambda v: v == 0 or abs(v) > 1e-300)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(NUMBERS, NUMBERS), min_size=1, max_size=6))
def test_geometry_is_read_back(spark, ring):
    wkb = struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
    bad = [wkb[:-1], b"\x00" + wkb[1:], b"", struct.pack("<BII", 1, 3, 2) + wkb[9:]]
    df = spark.createDataFrame([(0, bytearray(wkb))] + [(1, bytearray(b)) for b in bad] + [(1, None)], "k int, g binary")
    got = [r.v for r in df.select("k", geo.vertices(F.col("g")).alias("v")).orderBy("k").collect()]
    assert [tuple(p) for p in got[0]] == [(x + 0.0, y + 0.0) for x, y in ring] and got[1:] == [None] * 5


def test_square_binary_is_the_polygon_of_square(spark):
    df = spark.createDataFrame([(-9e6, 4e6), (0.0, 0.0), (4512.155, -4512.155), (1e-3, 7e6)], "x double, y double")
    made = df.select(geo.square_binary(F.col("x"), F.col("y"), 9024.31).alias("a"), geo.well_known_binary(geo.square(F.col("x"), F.col("y"), 9024.31)).alias("b"), geo.square(F.col("x"), F.col("y"), 9024.31).alias("s"))
    for r in made.withColumn("back", geo.vertices(F.col("a"))).collect():
        assert r.a == r.b and all(math.isclose(p.x, q.x) and math.isclose(p.y, q.y) for p, q in zip(r.s, r.back))


def test_geometry_of_any_number_is_read_back(spark):
    odd = [5e-324, -2.2e-308, 1.7976931348623157e308, -0.0, math.inf, 1 / 3]
    wkb = struct.pack("<BIII", 1, 3, 1, 3) + struct.pack("<6d", *odd)
    df = spark.createDataFrame([(k, bytearray(wkb) if k % 3 else None) for k in range(50)], "k int, g binary")
    got = {r.k: r.v for r in df.select("k", geo.vertices(F.col("g")).alias("v")).collect()}
    assert all((struct.pack("<6d", *(c for p in v for c in p)) == wkb[13:]) if k % 3 else v is None for k, v in got.items())
    made = spark.createDataFrame([(1.0, None), (None, 2.0), (5e-324, 0.0)], "x double, y double").select(geo.square_binary(F.col("x"), F.col("y"), 0.0).alias("g")).collect()
    assert [r.g is None for r in made] == [True, True, False] and made[2].g[13:29] == struct.pack("<2d", 5e-324, 0.0)


def by_tasks_alone(monkeypatch):
    for name in ("move", "copy", "files"):
        monkeypatch.setattr(named.Store, name, lambda *_: pytest.fail("a file passes the driver"))


def test_extracted_files_do_not_pass_the_driver(spark, tmp_path, monkeypatch):
    by_tasks_alone(monkeypatch)
    p = "Soil_Moisture_Retrieval_Data_AM"
    rows = lambda name, v: chunks(name, f"{p}/soil_moisture", v) + chunks(name, "lon", [1, 2]) + chunks(name, "lat", [5, 6, 7])
    arrays = spark.createDataFrame(rows("a.nc4", V) + rows("none.nc4", V + 5), schemas.ARRAYS)
    log = extract.extract_to_files(arrays, spark.createDataFrame([], schemas.ATTRIBUTES), str(tmp_path))
    assert {r.output_file: r["rows"] for r in log.collect()} == {"extracted/am/a_am.csv": 6, "extracted/am/none_am.csv": 0}
    assert (tmp_path / "extracted/am/none_am.csv").read_text() == HEADER + "\n"


def test_a_job_over_many_files_is_few_tasks(spark, tmp_path):
    line = lambda k: f"g,20200711,am,{-96 + k / 10},{40 + k % 3},{0.2 + k / 100}"
    put(tmp_path, **{f"g{k}_am": "\n".join([HEADER, *map(line, range(6 + k % 3))]) + "\n" for k in range(60)})
    log, n = tasks_of(spark, "job", lambda: detrend.detrend_files(spark, str(tmp_path), numbered=False)[1].collect())
    assert {(r.status, r["rows"]) for r in log} == {("written", 6), ("written", 7), ("written", 8)} and len(log) == 60 and n < 150


def test_cells_and_empty_files_do_not_pass_the_driver(spark, tmp_path, monkeypatch):
    by_tasks_alone(monkeypatch)
    rows = spark.createDataFrame([("a_am.csv", "", "am", -96.0, 40.0, 0.1)], schemas.EXTRACTED)
    cells, log = detrend.detrend_all(rows, files=spark.createDataFrame([("in/a_am.csv",), ("in/e_pm.csv",)], "file_name string"))
    assert detrend.write_cells(cells, log, str(tmp_path)) == 2
    assert {r.output_file: r["rows"] for r in manifest.rows_on_disk(spark, str(tmp_path), "parquet").collect()} == {"detrended/am/a_am.rds": 1, "detrended/pm/e_pm.rds": 0}
