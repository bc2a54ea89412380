import pytest

import __spark_entry__ as entry
from fieldgrid.operators import enrich
from fieldgrid.sources import io, manifest


def test_manifest(spark):
    arrays = spark.createDataFrame([("b.nc4",), ("a.NC",), ("c.txt",), ("b.nc4",)], "granule string")
    assert [r[0] for r in manifest.granules(arrays).collect()] == ["a.NC", "b.nc4"]
    assert [r[0] for r in manifest.granules(arrays, limit=1).collect()] == ["a.NC"]
    with pytest.raises(manifest.NoFiles):
        manifest.granules(arrays.where("granule = 'c.txt'"))
    assert manifest.granules(arrays.where("granule = 'c.txt'"), must=False).isEmpty()


def test_left_join_multiplies_and_matches_nulls(spark):
    readings = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "station string, v int")
    meta = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "n"), ("z", "w")], "stid string, name string")
    out = enrich.enrich_left(readings, meta, "station", "stid", ["name"])
    assert out.columns == ["station", "v", "name"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", 1, "x"), ("a", 1, "y"), ("b", 2, None), (None, 3, "n")], key=str)
    assert enrich.key_coverage(readings, "station", meta, "stid").first() == (3, 3, 2, 1, 1)
    assert [r[0] for r in enrich.keys_only_in(readings, "station", meta, "stid").collect()] == ["b"]
    assert enrich.duplicate_keys(meta, "stid").first()[0] == 1
    assert enrich.null_counts(out, ["name"]).first()[0] == 1


def test_csv_round_trips(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("station,n,x,t\na,1,1.5,NA\nb,NA,2,hi\n")
    df = io.read_csv(spark, str(p))
    assert dict(df.dtypes) == {"station": "string", "n": "bigint", "x": "double", "t": "string"}
    assert sorted(map(tuple, df.collect())) == [("a", 1, 1.5, None), ("b", None, 2.0, "hi")]
    io.write_table(df, str(tmp_path / "out"))
    assert io.read_csv(spark, str(tmp_path / "out")).count() == 2
    typed = io.read_csv(spark, str(p), "station string, n int, x double, t string")
    assert dict(typed.dtypes)["n"] == "int"
    assert [r["name"] for r in io.columns_of(df).collect()] == ["station", "n", "x", "t"]


def test_partitioned_rows_are_replaced_one_by_one(spark, tmp_path):
    rows = lambda v, *files: spark.createDataFrame([(f, "am", v) for f in files], "source_file string, pass string, v int")
    out = str(tmp_path / "rows")
    io.write_rows(rows(1, "a", "b"), out)
    io.write_rows(rows(2, "b"), out)
    assert {(r.source_file, r.v) for r in spark.read.parquet(out).collect()} == {("a", 1), ("b", 2)}


def test_files_in(spark, tmp_path):
    for name in ("a.nc4", "b.NC", "c.csv"):
        (tmp_path / name).write_text("x")
    assert manifest.files_in(spark, str(tmp_path), r"(?i)\.(nc4|nc)$").count() == 2


def test_every_oracle_has_a_query_and_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
