"""The driver's queries for the gridded-measurement operators, each with its SQL.

Measurement rows are derived from ``lineitem`` (see ``measurements``); doubles are rounded on both
sides, to 6 decimals or, for metres, to 2.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql_text as sql
from .config import DEFAULT
from .functions import geo, names
from .operators import audit, clean, enrich, granules, trend
from .plans import detrend, extract
from .sources import io, manifest, named, scratch

FILL = -9999.0
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
KEYS = ["source_file", "pass"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    east, north = (F.col("l_partkey") % 640) / 100.0, (F.col("l_orderkey") % 310) / 100.0
    value = F.lit(0.12) + F.col("l_discount") + F.lit(0.004) * (F.col("l_suppkey") % 3) * east + F.lit(0.006) * (F.col("l_suppkey") % 2) * F.pow(north - 1.5, F.lit(2.0))
    raw = F.when(F.col("l_tax") == 0.08, F.lit(FILL)).when(F.col("l_quantity") >= 49, F.lit(1.2)).otherwise(value)
    return li.select(
        F.concat(F.lit("G_"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0")).alias("source_file"),
        F.lit("").alias("date_tag"),
        F.when(F.col("l_returnflag") == "R", "pm").otherwise("am").alias("pass"),
        (east - 96.6).alias("lon"),
        (north + 40.4).alias("lat"),
        raw.alias("soil_moisture"),
        *ORDER,
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(measurements(spark, sf_dir), F.array(F.lit(FILL)), F.lit(None).cast("array<double>"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detrend.projected(cleaned(spark, sf_dir))


def r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# ---------------------------------------------------------------- sources


@query(f"WITH {sql.RAW} SELECT DISTINCT source_file || '.csv' AS granule FROM raw WHERE pass = 'am' ORDER BY granule LIMIT 50")
def granule_manifest(spark, sf_dir):
    """The first 50 extracted files of one pass, in order."""
    files = measurements(spark, sf_dir).select(F.concat("source_file", F.lit(".csv")).alias("file_name"), "pass")
    return manifest.extracted(files, "am", limit=50).withColumnRenamed("file_name", "granule")


@query("""WITH v AS (SELECT DISTINCT 'g' || CAST(page_id % 20 AS VARCHAR) AS granule, split_part(url, '/', 3) || '/' || split_part(url, '/', 4) AS variable FROM pages)
SELECT granule, variable, split_part(variable, '/', 1) AS "group" FROM v""")
def variable_catalogue(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    part = F.split("url", "/")
    at = lambda i: F.coalesce(F.try_element_at(part, F.lit(i)), F.lit(""))
    arrays = pages.select(F.concat(F.lit("g"), (F.col("page_id") % 20).cast("string")).alias("granule"), F.concat_ws("/", at(3), at(4)).alias("variable"))
    return granules.catalogue(arrays)


def _variables(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("granule"), F.concat("l_returnflag", "l_linestatus").alias("variable"))


def _roles(spark):
    rows = [("am_value", 0, "RF"), ("am_value", 1, "RO"), ("pm_value", 0, "NF"), ("pm_value", 1, "AO"), ("am_lon", 0, "AF"), ("am_lat", 0, "AF"), ("pm_lon", 0, "AF"), ("pm_lat", 0, "RF")]
    return spark.createDataFrame(rows, "role string, rank int, variable string")


_ROLES_SQL = """roles(role, rank, variable) AS (VALUES ('am_value', 0, 'RF'), ('am_value', 1, 'RO'), ('pm_value', 0, 'NF'), ('pm_value', 1, 'AO'), ('am_lon', 0, 'AF'), ('am_lat', 0, 'AF'), ('pm_lon', 0, 'AF'), ('pm_lat', 0, 'RF')),
v AS (SELECT DISTINCT l_orderkey AS granule, l_returnflag || l_linestatus AS variable FROM lineitem),
res AS (SELECT granule, role, arg_min(variable, rank) AS variable FROM v JOIN roles USING (variable) GROUP BY granule, role)"""


@query(f"WITH {_ROLES_SQL} SELECT * FROM res")
def resolve_first_candidate(spark, sf_dir):
    return granules.resolve(_variables(spark, sf_dir), _roles(spark))


@query(f"""WITH {_ROLES_SQL},
g AS (SELECT DISTINCT granule FROM v),
w AS (SELECT granule, max(variable) FILTER (role = 'am_value') AS am_value, max(variable) FILTER (role = 'pm_value') AS pm_value,
  max(variable) FILTER (role = 'am_lon') AS am_lon, max(variable) FILTER (role = 'am_lat') AS am_lat, max(variable) FILTER (role = 'pm_lon') AS pm_lon, max(variable) FILTER (role = 'pm_lat') AS pm_lat
  FROM g LEFT JOIN res USING (granule) GROUP BY granule),
b AS (SELECT granule, 'am' AS pass, am_value AS value, am_lon AS lon, am_lat AS lat, coalesce(am_value, pm_value) AS any_value FROM w
  UNION ALL SELECT granule, 'pm', pm_value, pm_lon, pm_lat, coalesce(am_value, pm_value) FROM w)
SELECT granule, pass, value, lon, lat, CASE WHEN any_value IS NULL THEN 'error: no pass found' WHEN value IS NULL THEN 'absent' WHEN lon IS NULL THEN 'error: no longitude' WHEN lat IS NULL THEN 'error: no latitude' ELSE 'ok' END AS status FROM b""")
def resolve_status(spark, sf_dir):
    v = _variables(spark, sf_dir)
    return granules.resolve_status(v, granules.resolve(v, _roles(spark)))


@query("""WITH h AS (SELECT o_orderkey AS source_file, list_filter(['source_file', 'date_tag', 'pass', 'lon', 'lat', 'soil_moisture'], lambda c: NOT ((o_orderkey % 3 = 0 AND c = 'lon') OR (o_orderkey % 5 = 0 AND c = 'pass'))) AS header FROM orders),
m AS (SELECT source_file, list_filter(['source_file', 'date_tag', 'pass', 'lon', 'lat', 'soil_moisture'], lambda c: NOT list_contains(header, c)) AS missing FROM h)
SELECT source_file, array_to_string(missing, ', ') AS missing, CASE WHEN len(missing) = 0 THEN 'ok' ELSE 'error: missing required columns: ' || array_to_string(missing, ', ') END AS status FROM m""")
def required_columns_audit(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    every = F.array(*[F.lit(c) for c in audit.REQUIRED])
    header = F.filter(every, lambda c: ~(((k % 3 == 0) & (c == "lon")) | ((k % 5 == 0) & (c == "pass"))))
    out = audit.required_columns(o.select(k.alias("source_file"), header.alias("header")))
    return out.select("source_file", F.array_join("missing", ", ").alias("missing"), "status")


@query("""WITH e AS (SELECT o_orderkey, count(l_orderkey) AS rows FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
SELECT o_orderkey AS source_file, rows, CASE WHEN rows = 0 THEN 'written_empty' ELSE 'written' END AS status, CASE WHEN rows = 0 THEN 'empty_input_csv' END AS note FROM e""")
def empty_granule_audit(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_file"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_file"))
    return manifest.counts_with_empty(files, rows, ["source_file"])


@query(f"""WITH {sql.RAW}, w AS (SELECT DISTINCT source_file, pass, l_suppkey FROM (SELECT *, CAST(substr(source_file, 3) AS BIGINT) AS l_suppkey FROM raw))
SELECT source_file, pass, CASE WHEN l_suppkey % 2 = 0 THEN 'skipped_existing' ELSE 'pending' END AS status FROM w""")
def incremental_skip(spark, sf_dir):
    work = measurements(spark, sf_dir).select(*KEYS).distinct()
    done = work.where(F.substring("source_file", 3, 10).cast("long") % 2 == 0)
    todo = manifest.pending(work, done, KEYS, replace(DEFAULT, overwrite=False)).select(*KEYS, F.lit("pending").alias("status"))
    return todo.unionByName(manifest.skipped(work, done, KEYS).select(*KEYS, "status"))


@query(f"""WITH {sql.CLEAN}, b AS (SELECT pass, count(DISTINCT source_file || ':' || l_orderkey) AS n_before FROM raw GROUP BY pass),
a AS (SELECT pass, count(DISTINCT source_file || ':' || l_orderkey) AS n_after FROM clean GROUP BY pass)
SELECT coalesce(a.pass, b.pass) AS pass, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after, coalesce(n_before, 0) - coalesce(n_after, 0) AS n_missing FROM b FULL JOIN a ON a.pass = b.pass""")
def stage_reconcile(spark, sf_dir):
    """A file is what one supplier has in one order: cleaning leaves some without rows."""
    files = lambda df: df.withColumn("source_file", F.concat_ws(":", "source_file", "l_orderkey"))
    return manifest.reconcile(files(measurements(spark, sf_dir)), files(cleaned(spark, sf_dir)))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 6")
def preview_topn(spark, sf_dir):
    return io.preview(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")


# ---------------------------------------------------------------- names and passes


@query("""WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'data/SM_L3_untagged_' ELSE 'data/SM_L3_' || strftime(o_orderdate, '%Y%m%d') || '_' END || o_orderkey || '.nc4' AS name FROM orders)
SELECT o_orderkey, name, regexp_extract(split_part(name, '/', 2), '(19|20)\\d{6}', 0) AS date_tag FROM n""")
def date_tags(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tag = F.when(F.col("o_orderkey") % 10 == 0, F.lit("data/SM_L3_untagged_")).otherwise(F.concat(F.lit("data/SM_L3_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_")))
    named = o.select("o_orderkey", F.concat(tag, F.col("o_orderkey").cast("string"), F.lit(".nc4")).alias("name"))
    return named.withColumn("date_tag", names.date_tag(F.col("name")))


@query(f"""WITH {sql.RAW}, f AS (SELECT DISTINCT 'in/' || source_file || '.nc4' AS path, upper(pass) AS pass FROM raw)
SELECT path, pass, regexp_replace(split_part(path, '/', 2), '\\.[A-Za-z0-9]+$', '') AS stem,
  'extracted/' || lower(pass) || '/' || regexp_replace(split_part(path, '/', 2), '\\.[A-Za-z0-9]+$', '') || '_' || lower(pass) || '.csv' AS extracted,
  'detrended/' || lower(pass) || '/' || regexp_replace(split_part(path, '/', 2), '\\.[A-Za-z0-9]+$', '') || '.rds' AS detrended FROM f""")
def output_names(spark, sf_dir):
    files = measurements(spark, sf_dir).select(F.concat(F.lit("in/"), "source_file", F.lit(".nc4")).alias("path"), F.upper("pass").alias("pass")).distinct()
    return files.select("path", "pass", names.stem(F.col("path")).alias("stem"), names.extracted_path(F.col("path"), F.col("pass")).alias("extracted"), names.detrended_path(F.col("path"), F.col("pass")).alias("detrended"))


@query(f"""WITH {sql.RAW}, k AS (SELECT DISTINCT source_file, pass, CAST(substr(source_file, 3) AS BIGINT) AS n FROM raw),
f AS (SELECT source_file || '_' || CASE WHEN n % 7 = 0 THEN CASE pass WHEN 'am' THEN 'pm' ELSE 'am' END ELSE pass END || '.csv' AS file_name, pass FROM k),
g AS (SELECT *, CASE WHEN regexp_matches(file_name, '_pm\\.csv$') THEN 'pm' ELSE 'am' END AS pass_guess FROM f)
SELECT file_name, pass, pass_guess, pass <> pass_guess AS mismatch, pass AS pass_used FROM g""")
def pass_consistency(spark, sf_dir):
    k = measurements(spark, sf_dir).select(*KEYS).distinct()
    flipped = F.when(F.col("pass") == "am", "pm").otherwise("am")
    shown = F.when(F.substring("source_file", 3, 10).cast("long") % 7 == 0, flipped).otherwise(F.col("pass"))
    return audit.pass_consistency(k.select(F.concat("source_file", F.lit("_"), shown, F.lit(".csv")).alias("file_name"), "pass"))


@query("""WITH p AS (SELECT l_orderkey AS source_file, CASE WHEN l_returnflag = 'R' THEN 'PM' ELSE 'am' END AS pass FROM lineitem),
a AS (SELECT source_file, count(DISTINCT lower(pass)) AS n_passes, string_agg(DISTINCT lower(pass), ', ' ORDER BY lower(pass)) AS passes FROM p GROUP BY source_file)
SELECT source_file, n_passes, passes, CASE WHEN n_passes = 1 THEN 'ok' ELSE 'error: expected exactly one pass, found: ' || passes END AS status FROM a""")
def single_pass_check(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_file"), F.when(F.col("l_returnflag") == "R", "PM").otherwise("am").alias("pass"))
    return audit.single_pass(rows)


# ---------------------------------------------------------------- cleaning


@query(f"WITH {sql.RAW} SELECT source_file, l_orderkey, l_linenumber, l_partkey, CASE WHEN soil_moisture <> -9999 THEN round(soil_moisture, 6) END AS soil_moisture FROM raw")
def mask_fill(spark, sf_dir):
    masked = clean.mask_fill(F.col("soil_moisture"), F.array(F.lit(FILL)), F.lit(None).cast("array<double>"))
    return measurements(spark, sf_dir).select("source_file", "l_orderkey", "l_linenumber", "l_partkey", F.round(masked, 6).alias("soil_moisture"))


@query(f"WITH {sql.RAW} SELECT source_file, l_orderkey, l_linenumber, l_partkey, CASE WHEN soil_moisture BETWEEN 0 AND 1 THEN round(soil_moisture, 6) END AS soil_moisture FROM raw")
def mask_range(spark, sf_dir):
    masked = clean.mask_range(F.col("soil_moisture"), DEFAULT.value_min, DEFAULT.value_max)
    return measurements(spark, sf_dir).select("source_file", "l_orderkey", "l_linenumber", "l_partkey", F.round(masked, 6).alias("soil_moisture"))


@query(f"WITH {sql.CLEAN} SELECT source_file, '' AS date_tag, pass, round(lon, 6) AS lon, round(lat, 6) AS lat, round(soil_moisture, 6) AS soil_moisture FROM clean")
def clean_measurements(spark, sf_dir):
    return cleaned(spark, sf_dir).select("source_file", "date_tag", "pass", r("lon"), r("lat"), r("soil_moisture"))


@query("""SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE left(o_orderpriority, 1) END AS INTEGER) AS as_int,
  TRY_CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE left(o_orderpriority, 1) || '.5' END AS DOUBLE) AS as_double FROM orders""")
def cast_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    bad = F.col("o_orderkey") % 4 == 0
    first = F.substring("o_orderpriority", 1, 1)
    text = lambda tail: F.when(bad, F.col("o_orderpriority")).otherwise(F.concat(first, F.lit(tail)))
    return o.select("o_orderkey", clean.to_int(text("")).alias("as_int"), clean.to_double(text(".5")).alias("as_double"))


@query(f"WITH {sql.CLEAN} SELECT source_file, pass, CAST(count(*) AS INTEGER) AS rows, 'extracted/' || pass || '/' || source_file || '_' || pass || '.csv' AS output_file, 'written' AS status FROM clean GROUP BY source_file, pass")
def extract_log(spark, sf_dir):
    return extract.extract_log(cleaned(spark, sf_dir))


# ---------------------------------------------------------------- enrichment


#: Keys of the metadata are shifted, so that both sides have keys that the other lacks.
SHIFT = 7


def _meta(spark, sf_dir):
    return table(spark, sf_dir, "customer").withColumn("c_key", F.col("c_custkey") + SHIFT)


def _joined(spark, sf_dir):
    return enrich.enrich_left(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _meta(spark, sf_dir), "o_custkey", "c_key", ["c_name", "c_nationkey", "c_acctbal"])


_JOINED_SQL = f"SELECT o_orderkey, o_custkey, c_name, c_nationkey, c_acctbal FROM orders LEFT JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey + {SHIFT}"


@query(_JOINED_SQL)
def enrich_left(spark, sf_dir):
    return _joined(spark, sf_dir)


def _sides(spark, sf_dir):
    return table(spark, sf_dir, "orders"), "o_custkey", _meta(spark, sf_dir), "c_key"


@query(f"SELECT o_custkey AS key FROM orders EXCEPT SELECT c_custkey + {SHIFT} FROM customer")
def keys_only_left(spark, sf_dir):
    return enrich.keys_only_in(*_sides(spark, sf_dir))


@query(f"SELECT c_custkey + {SHIFT} AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def keys_only_right(spark, sf_dir):
    left, key, right, other = _sides(spark, sf_dir)
    return enrich.keys_only_in(right, other, left, key)


@query(f"""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey + {SHIFT} AS k FROM customer)
SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM a JOIN b USING (k)) AS n_matched,
  (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS n_left_only, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS n_right_only""")
def key_coverage(spark, sf_dir):
    return enrich.key_coverage(*_sides(spark, sf_dir))


@query(f"SELECT count(*) FILTER (c_name IS NULL) AS c_name, count(*) FILTER (c_nationkey IS NULL) AS c_nationkey, count(*) FILTER (c_acctbal IS NULL) AS c_acctbal FROM ({_JOINED_SQL})")
def null_counts(spark, sf_dir):
    return enrich.null_counts(_joined(spark, sf_dir), ["c_name", "c_nationkey", "c_acctbal"])


@query("SELECT count(*) - count(DISTINCT o_custkey) AS n_duplicates FROM orders")
def duplicate_keys(spark, sf_dir):
    return enrich.duplicate_keys(table(spark, sf_dir, "orders"), "o_custkey")


# ---------------------------------------------------------------- geometry


@query(f"WITH {sql.PROJECTED} SELECT source_file, l_orderkey, l_linenumber, l_partkey, round(x, 2) AS x, round(y, 2) AS y FROM xy")
def project_equal_area(spark, sf_dir):
    return placed(spark, sf_dir).select("source_file", "l_orderkey", "l_linenumber", "l_partkey", r("x", 2), r("y", 2))


@query(f"""WITH {sql.PROJECTED}, h AS (SELECT *, 4512.155e0 AS h FROM xy)
SELECT source_file, l_orderkey, l_linenumber, l_partkey, round(lon, 2) AS px, round(lat, 2) AS py, 5 AS n_vertices, round(x - h, 2) AS x0, round(y - h, 2) AS y0, round(x + h, 2) AS x1, round(y - h, 2) AS y1,
  round(x + h, 2) AS x2, round(y + h, 2) AS y2, round(x - h, 2) AS x3, round(y + h, 2) AS y3, true AS closed FROM h""")
def cell_squares(spark, sf_dir):
    at = placed(spark, sf_dir).withColumn("s", geo.square(F.col("x"), F.col("y"), DEFAULT.cell_size)).withColumn("pt", geo.point(F.col("lon"), F.col("lat")))
    vertices = [F.round(F.col("s")[k][c], 2).alias(f"{c}{k}") for k in range(4) for c in "xy"]
    return at.select("source_file", "l_orderkey", "l_linenumber", "l_partkey", F.round("pt.x", 2).alias("px"), F.round("pt.y", 2).alias("py"), F.size("s").alias("n_vertices"), *vertices, (F.col("s")[0] == F.col("s")[4]).alias("closed"))


@query(f"WITH {sql.CLEAN} SELECT source_file, pass, l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY source_file, pass ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS pixel_id FROM clean")
def pixel_ids(spark, sf_dir):
    return granules.pixel_ids(cleaned(spark, sf_dir), ORDER).select("source_file", "pass", "l_orderkey", "l_linenumber", "l_partkey", "pixel_id")


# ---------------------------------------------------------------- grids: each vector is a grid of 8 x 8, a chunk a row


def _grids(spark, sf_dir):
    """granule, chunk (slow index), data (fast index) of each vector as an 8 x 8 grid."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("granule"), F.col("embedding").cast("array<double>").alias("e"))
    return v.select("granule", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.slice("e", j * 8 + 1, 8))).alias("chunk", "data"))


def _next(grids):
    return grids.withColumn("granule", F.col("granule") - 1)


_FLAT_SQL = "v AS (SELECT vec_id AS granule, unnest(range(64)) AS p, unnest(embedding) AS value FROM embeddings)"


@query(f"WITH {_FLAT_SQL} SELECT a.granule, CAST(a.p AS INTEGER) AS p, round(CAST(a.value AS DOUBLE), 6) AS value, round(CAST(b.value AS DOUBLE), 6) AS lon, round(-CAST(b.value AS DOUBLE), 6) AS lat FROM v a JOIN v b ON b.granule = a.granule + 1 AND a.p = b.p")
def grid_flatten(spark, sf_dir):
    g = _grids(spark, sf_dir)
    lat = _next(g).withColumn("data", F.transform("data", lambda x: -x))
    return granules.flatten_same(g, _next(g), lat).select("granule", "p", r("value"), r("lon"), r("lat"))


@query(f"WITH {_FLAT_SQL} SELECT a.granule, CAST(a.p AS INTEGER) AS p, round(CAST(a.value AS DOUBLE), 6) AS value, round(CAST(b.value AS DOUBLE), 6) AS lon, round(-CAST(b.value AS DOUBLE), 6) AS lat FROM v a JOIN v b ON b.granule = a.granule + 1 AND b.p = a.p // 8 + 8 * (a.p % 8)")
def grid_transposed(spark, sf_dir):
    g = _grids(spark, sf_dir)
    lat = _next(g).withColumn("data", F.transform("data", lambda x: -x))
    return granules.flatten_transposed(g, _next(g), lat).select("granule", "p", r("value"), r("lon"), r("lat"))


@query(f"""WITH {_FLAT_SQL}, f AS (SELECT granule, p, value, p % 8 AS i, p // 8 AS j FROM v)
SELECT granule, CAST(p AS INTEGER) AS p, round(CAST(value AS DOUBLE), 6) AS value, CASE WHEN granule % 2 = 0 THEN -96e0 + i / 4e0 ELSE -96e0 + j / 4e0 END AS lon, CASE WHEN granule % 2 = 0 THEN 40e0 + j / 4e0 ELSE 40e0 + i / 4e0 END AS lat FROM f""")
def grid_axes_join(spark, sf_dir):
    g = _grids(spark, sf_dir)
    axis = lambda start: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.lit(start) + k / 4.0)
    ids = g.select("granule").distinct()
    lon, lat = ids.withColumn("data", axis(-96.0)), ids.withColumn("data", axis(40.0))
    even = F.col("granule") % 2 == 0
    both = granules.flatten_axes(g.where(even), lon, lat, True).unionByName(granules.flatten_axes(g.where(~even), lon, lat, False))
    return both.select("granule", "p", r("value"), "lon", "lat")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, 2 + l_partkey % 3 AS d1, 2 + l_suppkey % 3 AS d2, l_orderkey % 6 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE k
  WHEN 0 THEN 'same'
  WHEN 1 THEN CASE WHEN d1 = d2 THEN 'same' ELSE 'transposed' END
  WHEN 2 THEN 'lon_first'
  WHEN 3 THEN CASE WHEN d1 = d2 THEN 'lon_first' ELSE 'lat_first' END
  WHEN 4 THEN 'error: value is not 2-D [' || d1 || ']'
  ELSE 'error: shapes [' || d1 || 'x' || d2 || '] [' || d1 || 'x' || d2 || '] [' || d2 || ']' END AS layout FROM d""")
def grid_shape_status(spark, sf_dir):
    d1, d2, k = 2 + F.col("l_partkey") % 3, 2 + F.col("l_suppkey") % 3, F.col("l_orderkey") % 6
    a = lambda *x: F.array(*[F.lit(v) if isinstance(v, int) else v for v in x]).cast("array<int>")
    value = F.when(k == 4, a(d1, 1)).otherwise(a(d1, d2, 1))
    lon = F.when(k == 0, a(d1, d2)).when(k == 1, a(d2, d1)).when(k == 2, a(d1)).when(k == 3, a(d2)).otherwise(a(d1, 1, d2))
    lat = F.when(k == 0, a(d1, d2)).when(k == 1, a(d2, d1)).when(k == 2, a(d2)).when(k == 3, a(d1)).otherwise(a(d2))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", granules.layout(value, lon, lat).alias("layout"))


# ---------------------------------------------------------------- trend


@query(f"WITH {sql.CLEAN} SELECT source_file, pass, count(*) AS n, count(*) < 6 OR min(soil_moisture) = max(soil_moisture) AS small FROM clean GROUP BY source_file, pass")
def trend_guard(spark, sf_dir):
    return trend.guarded(trend.group_stats(placed(spark, sf_dir))).select(*KEYS, "n", "small")


@query(f"WITH {sql.CLEAN}, m AS (SELECT *, avg(soil_moisture) OVER (PARTITION BY source_file, pass) AS h FROM clean) SELECT source_file, pass, l_orderkey, l_linenumber, l_partkey, round(h, 6) AS trend_hat, round(soil_moisture - h, 6) AS resid FROM m")
def mean_residuals(spark, sf_dir):
    return trend.mean_residuals(cleaned(spark, sf_dir)).select(*KEYS, "l_orderkey", "l_linenumber", "l_partkey", r("trend_hat"), r("resid"))


def _sums(spark, sf_dir):
    rows = placed(spark, sf_dir)
    return trend.group_sums(rows, trend.guarded(trend.group_stats(rows)))


@query(f"""WITH {sql.sums()}, d AS (SELECT *, g11 * g22 - g12 * g12 AS det FROM g), b AS (SELECT *, (m1 * g22 - m2 * g12) / det AS b1, (m2 * g11 - m1 * g12) / det AS b2 FROM d), q AS (SELECT *, tss - b1 * m1 - b2 * m2 AS rss FROM b)
SELECT source_file, pass, round(b1, 6) AS b1, round(b2, 6) AS b2, round(rss, 6) AS rss, round(1 - rss / tss, 6) AS r2, round(power(rss / tss, (n - 3) / 2e0), 6) AS p FROM q""")
def trend_plane(spark, sf_dir):
    """The plane alone; its p is a closed form."""
    return trend.fit_planes(_sums(spark, sf_dir)).select(*KEYS, r("b1"), r("b2"), r("rss"), r("r2"), r("p"))


@query(f"WITH {sql.selection()} SELECT source_file, pass, n, round(rss7, 6) AS rss, round(1 - rss7 / tss, 6) AS r2 FROM rss")
def trend_fit(spark, sf_dir):
    """The full quadratic surface: residual sum of squares and R2."""
    return trend.fit_surfaces(_sums(spark, sf_dir)).select(*KEYS, "n", r("rss"), r("r2"))


@query(f"WITH {sql.selection()} SELECT source_file, pass, kept, CAST(rank AS INTEGER) AS rank, round(rss, 6) AS rss FROM sel")
def trend_select(spark, sf_dir):
    return trend.models_of(placed(spark, sf_dir)).select(*KEYS, "kept", "rank", r("rss"))


@query(f"WITH {sql.tested()} SELECT source_file, pass, kept, round(p, 6) AS p, round(r2, 6) AS r2, trend_removed FROM test")
def trend_test(spark, sf_dir):
    return trend.models_of(placed(spark, sf_dir)).select(*KEYS, "kept", r("p"), r("r2"), "trend_removed")


def _residuals(spark, sf_dir):
    rows = placed(spark, sf_dir)
    return trend.residuals(rows, trend.models_of(rows))


@query(f"WITH {sql.fitted()} SELECT source_file, pass, l_orderkey, l_linenumber, l_partkey, round(trend_hat, 6) AS trend_hat, round(resid, 6) AS resid, round(sm_for_kriging, 6) AS sm_for_kriging, trend_removed, CAST(trend_removed AS INTEGER) AS trend_ind FROM fit")
def trend_residuals(spark, sf_dir):
    return _residuals(spark, sf_dir).select(*KEYS, "l_orderkey", "l_linenumber", "l_partkey", r("trend_hat"), r("resid"), r("sm_for_kriging"), "trend_removed", "trend_ind")


@query(f"WITH {sql.fitted()} SELECT source_file, pass, round(max(abs(soil_moisture - (trend_hat + resid))), 9) AS max_error, max(abs(soil_moisture - (trend_hat + resid))) > 1e-10 AS warning FROM fit GROUP BY source_file, pass")
def reconstruction_check(spark, sf_dir):
    return audit.reconstruction(_residuals(spark, sf_dir), DEFAULT.reconstruction_limit).select(*KEYS, r("max_error", 9), "warning")


# A file a pass; the names of every seventh tell the other pass. Files of suppliers whose number ends in 5
# also come without any usable row, and one manifest entry a supplier has no rows at all.
_FILES_SQL = f"""{sql.tested()},
named AS (SELECT *, CASE WHEN CAST(substr(source_file, 3) AS BIGINT) % 7 = 0 THEN CASE pass WHEN 'am' THEN 'pm' ELSE 'am' END ELSE pass END AS guess FROM test),
files AS (SELECT source_file || '_' || guess AS stem, * EXCLUDE (source_file) FROM named),
sup AS (SELECT DISTINCT source_file FROM test)"""


def _named(rows):
    other = F.when(F.col("pass") == "am", "pm").otherwise("am")
    guess = F.when(F.substring("source_file", 3, 10).cast("long") % 7 == 0, other).otherwise(F.col("pass"))
    return rows.withColumn("source_file", F.concat("source_file", F.lit("_"), guess, F.lit(".csv")))


@query(f"""WITH {_FILES_SQL}
SELECT stem || '.csv' AS source_file, pass, CAST(n AS INTEGER) AS rows, 'detrended/' || pass || '/' || stem || '.rds' AS output_file, trend_removed, round(p, 6) AS p_trend, round(r2, 6) AS r2_trend, 'written' AS status, 'model_fitted' AS note,
  CASE WHEN pass <> guess THEN 'pass of the name is ' || guess END AS warning FROM files
UNION ALL SELECT source_file || '_null_am.csv', 'am', NULL, NULL, NULL, NULL, NULL, 'error', 'error: no usable rows', NULL FROM sup WHERE source_file LIKE '%5'
UNION ALL SELECT source_file || '_empty_pm.csv', 'pm', 0, 'detrended/pm/' || source_file || '_empty_pm.rds', NULL, NULL, NULL, 'written_empty', 'empty_input_csv', NULL FROM sup""")
def detrend_log(spark, sf_dir):
    """The job over a file a pass: good files, names that tell another pass, files of nulls, empty files."""
    rows = cleaned(spark, sf_dir)
    first = rows.where((F.col("pass") == "am") & F.col("source_file").endswith("5"))
    nulls = first.withColumn("source_file", F.concat("source_file", F.lit("_null_am.csv"))).withColumn("soil_moisture", F.lit(None).cast("double"))
    files = rows.select(F.concat(F.lit("in/"), "source_file", F.lit("_empty_pm.csv")).alias("file_name")).distinct()
    _, log = detrend.detrend_all(_named(rows).unionByName(nulls), files=files, order=ORDER, numbered=False)
    return log.withColumn("p_trend", F.round("p_trend", 6)).withColumn("r2_trend", F.round("r2_trend", 6))


@query(f"WITH {sql.fitted()} SELECT source_file || '_' || pass || '.csv' AS source_file, pass, round(x, 2) AS x, round(y, 2) AS y, round(trend_hat, 6) AS trend_hat, round(resid, 6) AS resid, round(sm_for_kriging, 6) AS sm_for_kriging, CAST(row_number() OVER (PARTITION BY source_file, pass ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS pixel_id, 93 AS wkb_bytes, 6933 AS srid FROM fit")
def detrend_cells(spark, sf_dir):
    """The cells of the same job over plainly named files."""
    rows = cleaned(spark, sf_dir).withColumn("source_file", F.concat(F.concat_ws("_", "source_file", "pass"), F.lit(".csv")))
    cells, _ = detrend.detrend_all(rows, order=ORDER)
    return cells.select(*KEYS, r("x", 2), r("y", 2), r("trend_hat"), r("resid"), r("sm_for_kriging"), "pixel_id", F.length("geometry").alias("wkb_bytes"), "srid")


@query(f"""WITH {sql.CLEAN}, f AS (SELECT DISTINCT source_file, pass, CAST(substr(source_file, 3) AS BIGINT) AS k FROM clean),
g AS (SELECT DISTINCT CASE k % 3 WHEN 0 THEN source_file || '.csv' ELSE source_file || '_' || pass || '.csv' END AS file, CASE k % 3 WHEN 0 THEN 'am' ELSE pass END AS pass, k FROM f),
c AS (SELECT source_file, count(DISTINCT pass) AS passes FROM f GROUP BY source_file)
SELECT file AS source_file, g.pass, CASE WHEN k % 3 = 0 AND passes > 1 THEN 'error: expected exactly one pass, found: am, pm' WHEN k % 3 = 1 THEN 'error: missing required columns: lon, lat' ELSE 'error: unknown pass label: ' || g.pass || '2' END AS note
FROM g JOIN c ON c.source_file = 'G_' || lpad(CAST(k AS VARCHAR), 5, '0') WHERE k % 3 <> 0 OR passes > 1""")
def detrend_errors(spark, sf_dir):
    """The job over files that hold both passes, that lack columns, and whose pass is unknown; each is a log row."""
    rows = cleaned(spark, sf_dir)
    k = F.substring("source_file", 3, 10).cast("long") % 3
    file = F.when(k == 0, F.concat("source_file", F.lit(".csv"))).otherwise(F.concat(F.concat_ws("_", "source_file", "pass"), F.lit(".csv")))
    rows = rows.withColumn("label", F.when(k == 2, F.concat("pass", F.lit("2"))).otherwise(F.col("pass"))).withColumn("source_file", file).withColumn("pass", F.col("label"))
    columns = F.array(*[F.lit(c) for c in audit.REQUIRED])
    number = F.regexp_extract("source_file", "[0-9]+", 0).cast("long") % 3
    headers = rows.select("source_file").distinct().withColumn("header", F.when(number == 1, F.array_except(columns, F.array(F.lit("lon"), F.lit("lat")))).otherwise(columns))
    _, log = detrend.detrend_all(rows, headers=headers, order=ORDER, numbered=False)
    return log.where("status = 'error'").select(*KEYS, "note")


@query(f"WITH {sql.CLEAN}, n AS (SELECT source_file, count(DISTINCT pass) AS k FROM clean GROUP BY source_file), l AS (SELECT CASE WHEN CAST(substr(source_file, 3) AS BIGINT) % 3 = 0 AND k > 1 THEN 'error' ELSE 'written' END AS status FROM n, range(2) WHERE k > 0 AND (CAST(substr(source_file, 3) AS BIGINT) % 3 <> 0 OR range = 0)) SELECT status, count(*) AS n FROM l GROUP BY status")
def status_counts(spark, sf_dir):
    """Every third file keeps both passes, and so is an error; the others are a file a pass."""
    rows = cleaned(spark, sf_dir)
    both = F.substring("source_file", 3, 10).cast("long") % 3 == 0
    rows = rows.withColumn("source_file", F.when(both, F.col("source_file")).otherwise(F.concat_ws("_", "source_file", "pass")))
    _, log = detrend.detrend_all(rows, order=ORDER, numbered=False)
    return audit.status_counts(log)


# ---------------------------------------------------------------- extraction: each vector is a granule of 16 x 4

_EXTRACT_SQL = """v AS (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding) AS e FROM embeddings),
g AS (SELECT vec_id, p, p % 16 AS i, p // 16 AS j, CASE WHEN p % 11 = 0 THEN -9999 ELSE round(4 * CAST(e AS DOUBLE), 3) END AS value, vec_id % 6 AS k FROM v),
x AS (SELECT 'G' || vec_id || '_20200711.nc4' AS source_file, CASE WHEN k = 4 THEN 'pm' ELSE 'am' END AS pass, k, p, value,
  -96e0 + CASE k WHEN 3 THEN j ELSE i END / 4e0 AS lon, 40e0 + CASE k WHEN 3 THEN i ELSE j END / 4e0 AS lat FROM g),
kept AS (SELECT * FROM x WHERE k <> 5 AND value BETWEEN 0 AND 1)"""


def _granule_tables(spark, sf_dir):
    """The array and attribute tables of granules by vec_id % 6: coordinates of the same shape, transposed,
    axes with the longitude first, with the latitude first, an evening pass, and a shape that doesn't fit."""
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("in/G"), F.col("vec_id").cast("string"), F.lit("_20200711.nc4")).alias("granule"), (F.col("vec_id") % 6).alias("k"), F.col("embedding").alias("e"))
    k = F.col("k")
    upto = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    grid = lambda slow, fast, of: F.transform(upto(slow), lambda j: F.transform(upto(fast), lambda i: of(i, j)))
    lon, lat = lambda n: F.lit(-96.0) + n / 4.0, lambda n: F.lit(40.0) + n / 4.0
    value = grid(4, 16, lambda i, j: F.when((16 * j + i) % 11 == 0, F.lit(FILL)).otherwise(F.round(4 * F.col("e")[16 * j + i].cast("double"), 3)))
    axis = lambda n, of: F.array(F.transform(upto(n), of))
    dims = lambda *d: F.array(*map(F.lit, d)).cast("array<int>")
    named = lambda stem, sep="_": F.concat(F.lit(stem), F.when(k == 4, f"{sep}pm").otherwise("" if stem != "sm" else "_am"))
    two = F.when(k == 0, dims(16, 4)).when(k == 1, dims(4, 16))
    lons = F.when(k == 0, grid(4, 16, lambda i, j: lon(i))).when(k == 1, grid(16, 4, lambda j, i: lon(i))).when(k == 3, axis(4, lon)).otherwise(axis(16, lon))
    lats = F.when(k == 0, grid(4, 16, lambda i, j: lat(j))).when(k == 1, grid(16, 4, lambda j, i: lat(j))).when(k == 3, axis(16, lat)).when(k == 5, axis(7, lat)).otherwise(axis(4, lat))
    lon_dims = F.coalesce(two, F.when(k == 3, dims(4)).otherwise(dims(16)))
    lat_dims = F.coalesce(two, F.when(k == 3, dims(16)).when(k == 5, dims(7)).otherwise(dims(4)))
    parts = [(named("sm"), dims(16, 4), value), (named("lon"), lon_dims, lons), (named("lat"), lat_dims, lats)]
    every = F.array(*[F.struct(n.alias("variable"), d.alias("dims"), c.alias("chunks")) for n, d, c in parts])
    arrays = v.select("granule", F.inline(every)).select("granule", "variable", "dims", F.posexplode("chunks").alias("chunk", "data"))
    attributes = v.select("granule", named("sm").alias("variable"), F.explode(F.array(F.lit("_FillValue"), F.lit("units"))).alias("attr"), F.array(F.lit(FILL)).alias("values"))
    return arrays, attributes


@query(f"WITH {_EXTRACT_SQL} SELECT source_file, '20200711' AS date_tag, pass, p, lon, lat, value AS soil_moisture FROM kept")
def extract_job(spark, sf_dir):
    rows, _ = extract.extract_all(*_granule_tables(spark, sf_dir))
    return rows.select("source_file", "date_tag", "pass", F.col("p").cast("long").alias("p"), "lon", "lat", "soil_moisture")


@query(f"""WITH {_EXTRACT_SQL}, n AS (SELECT source_file, pass, k, CAST(count(*) FILTER (value BETWEEN 0 AND 1) AS INTEGER) AS rows FROM x GROUP BY source_file, pass, k)
SELECT source_file, pass, CASE WHEN k <> 5 THEN rows END AS rows, CASE WHEN k <> 5 THEN 'extracted/' || pass || '/' || split_part(source_file, '.', 1) || '_' || pass || '.csv' END AS output_file,
  CASE WHEN k = 5 THEN 'error: shapes [16x4] [16] [7]' ELSE 'written' END AS status FROM n""")
def extract_job_log(spark, sf_dir):
    _, log = extract.extract_all(*_granule_tables(spark, sf_dir))
    return log


@query(f"WITH {_EXTRACT_SQL} SELECT 'in/' || source_file AS granule, CASE WHEN k = 4 THEN 'sm_pm' ELSE 'sm_am' END AS variable, p // 16 AS chunk, count(*) AS n, round(sum(value), 3) AS total FROM x GROUP BY source_file, k, p // 16")
def array_scan(spark, sf_dir):
    """The array table written and read again, two variables of it."""
    arrays, _ = _granule_tables(spark, sf_dir)
    arrays.write.parquet(path := scratch.place(spark, "arrays"))
    found = io.read_arrays(spark, path, ["sm_am", "sm_pm"])
    return found.select("granule", "variable", F.col("chunk").cast("long").alias("chunk"), F.size("data").cast("long").alias("n"), F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("SELECT 'in/G' || vec_id || '_20200711.nc4' AS granule, CASE WHEN vec_id % 6 = 4 THEN 'sm_pm' ELSE 'sm_am' END AS variable, -9999e0 AS fill, false AS has_missing FROM embeddings")
def attribute_scan(spark, sf_dir):
    _, attributes = _granule_tables(spark, sf_dir)
    found = granules.attribute_values(attributes)
    return found.select("granule", "variable", F.col("fill")[0].alias("fill"), F.col("missing").isNotNull().alias("has_missing"))


@query(f"WITH {_EXTRACT_SQL} SELECT source_file, pass, p, lon, lat, value AS soil_moisture FROM kept")
def extract_csv_sink(spark, sf_dir):
    """The job's rows as delimited files, a folder a pass and file, read again."""
    rows, _ = extract.extract_all(*_granule_tables(spark, sf_dir))
    io.write_rows(rows.repartition("pass", "source_file"), path := scratch.place(spark, "csv"), "csv")
    back = io.read_csv(spark, path, "date_tag string, lon double, lat double, soil_moisture double, p bigint, pass string, source_file string")
    return back.select("source_file", "pass", "p", "lon", "lat", "soil_moisture")


@query(f"WITH {sql.CLEAN} SELECT 'G_' || right(source_file, 1) AS source_file, pass, l_orderkey, l_linenumber, l_partkey, round(soil_moisture, 6) AS soil_moisture FROM clean")
def object_sink(spark, sf_dir):
    """Rows as typed objects, a folder a pass and file (suppliers by their last digit), read again."""
    rows = cleaned(spark, sf_dir).withColumn("source_file", F.concat(F.lit("G_"), F.substring("source_file", -1, 1)))
    io.write_rows(rows, path := scratch.place(spark, "objects"))
    return spark.read.parquet(path).select(*KEYS, "l_orderkey", "l_linenumber", "l_partkey", r("soil_moisture"))


@query(f"SELECT o_orderkey, o_custkey, c_name, c_nationkey, c_acctbal FROM ({_JOINED_SQL})")
def joined_sink(spark, sf_dir):
    """The joined table as delimited text, read again with types found from the data."""
    io.write_table(_joined(spark, sf_dir), path := scratch.place(spark, "joined"))
    back = io.read_csv(spark, path)
    return back.select("o_orderkey", "o_custkey", "c_name", F.col("c_nationkey").cast(_joined(spark, sf_dir).schema["c_nationkey"].dataType).alias("c_nationkey"), "c_acctbal")


# ---------------------------------------------------------------- files: what the logs name and what is there


def _extracted(spark, sf_dir):
    """Clean rows with the path of their file."""
    rows = cleaned(spark, sf_dir).select("source_file", "date_tag", "pass", "lon", "lat", "soil_moisture")
    return rows.withColumn("output_file", names.extracted_path(F.col("source_file"), F.col("pass")))


_PATH = "'extracted/' || pass || '/' || source_file || '_' || pass || '.csv'"


@query(f"WITH {sql.CLEAN} SELECT {_PATH} AS output_file, pass, CAST(count(*) AS INTEGER) AS rows, CAST(count(*) AS INTEGER) AS rows_in_file, 'written' AS status FROM clean GROUP BY source_file, pass")
def named_csv_sink(spark, sf_dir):
    """One file a granule and pass, at the path of the log: the log beside what the folder holds. A file
    that only one side has would be a row with nulls."""
    named.write_named(_extracted(spark, sf_dir), root := scratch.place(spark, "files"))
    found = manifest.rows_on_disk(spark, root).withColumnRenamed("rows", "rows_in_file")
    return extract.extract_log(cleaned(spark, sf_dir)).join(found, "output_file", "full").select("output_file", "pass", "rows", "rows_in_file", "status")


@query(f"WITH {sql.CLEAN}, w AS (SELECT DISTINCT source_file, pass, {_PATH} AS output_file FROM clean) SELECT source_file, pass, output_file, CASE WHEN output_file = (SELECT min(output_file) FROM w) THEN 'pending' ELSE 'skipped_existing' END AS status FROM w")
def skip_by_files(spark, sf_dir):
    """What is done is what has a file: all files are written and the first is deleted."""
    rows = _extracted(spark, sf_dir)
    work = rows.select("source_file", "pass").distinct()
    work = scratch.cut(work.withColumn("output_file", names.extracted_path(F.col("source_file"), F.col("pass"))))
    named.write_named(rows, root := scratch.place(spark, "files"))
    named.Store(spark, root).delete(work.agg(F.min("output_file")).first()[0])
    there = manifest.on_disk(spark, root)
    todo = manifest.pending(work, there, ["output_file"], replace(DEFAULT, overwrite=False)).withColumn("status", F.lit("pending"))
    return todo.unionByName(work.join(manifest.skipped(work, there, ["output_file"]).select("output_file", "status"), "output_file"))


@query(f"WITH {sql.CLEAN}, n AS (SELECT pass, count(DISTINCT source_file) AS n_before FROM clean GROUP BY pass) SELECT pass, n_before, n_before - CAST(pass = 'am' AS BIGINT) AS n_after, CAST(pass = 'am' AS BIGINT) AS n_missing FROM n")
def reconcile_by_files(spark, sf_dir):
    """Two stages compared by the files of their folders: the second stage's first file is deleted."""
    rows = _extracted(spark, sf_dir)
    named.write_named(rows, root := scratch.place(spark, "files"))
    later = rows.select("source_file", "pass", "soil_moisture").withColumn("output_file", names.detrended_path(F.concat_ws("_", "source_file", "pass"), F.col("pass")))
    named.write_named(later, root, form="parquet")
    named.Store(spark, root).delete(later.agg(F.min("output_file")).first()[0])
    stage = lambda name: manifest.stage_files(manifest.on_disk(spark, root).where(F.col("output_file").startswith(name)))
    return manifest.reconcile(stage("extracted"), stage("detrended"))


#: Columns of the files of suppliers by number % 6: in order, turned around, one more, two fewer; 4: in order, but the last line is cut off; 5: no table.
_LAYOUTS = (
    ("source_file", "date_tag", "pass", "lon", "lat", "soil_moisture"),
    ("soil_moisture", "lat", "lon", "pass", "date_tag", "source_file"),
    ("source_file", "date_tag", "pass", "lon", "lat", "soil_moisture", "l_orderkey"),
    ("source_file", "date_tag", "pass", "soil_moisture"),
)


def _mixed_folder(spark, sf_dir):
    """Delimited files of all kinds in one folder, a file a supplier and pass."""
    rows = cleaned(spark, sf_dir).withColumn("k", F.substring("source_file", 3, 10).cast("long") % 6)
    rows = rows.withColumn("output_file", names.extracted_path(F.col("source_file"), F.col("pass")))
    root = scratch.place(spark, "mixed")
    k = F.col("k")
    by_layout = lambda of: F.when(k == 0, of(_LAYOUTS[0])).when(k == 1, of(_LAYOUTS[1])).when(k == 2, of(_LAYOUTS[2])).otherwise(of(_LAYOUTS[3]))
    lines = rows.where("k < 4").select("output_file", F.lit(1).alias("at"), by_layout(lambda c: F.to_csv(F.struct(*c))).alias("value"))
    heads = rows.where("k < 4").select("source_file", "pass", "k").distinct().select(names.extracted_path(F.col("source_file"), F.col("pass")).alias("output_file"), F.lit(0).alias("at"), by_layout(lambda c: F.lit(",".join(c))).alias("value"))
    texts = rows.where("k > 3").select("output_file", "k", F.concat_ws(",", *_LAYOUTS[0]).alias("line"))
    first = scratch.cut(texts.groupBy("output_file", "k").agg(F.max("line").alias("line")))
    # the greatest line comes once more, without its last field; what is no table is bytes of hashes
    torn = first.where("k = 4").select("output_file", F.posexplode(F.array(F.lit(",".join(_LAYOUTS[0])), F.col("line"), F.substring_index("line", ",", 5))).alias("at", "value"))
    noise = first.where("k = 5").select("output_file", F.lit(0).alias("at"), F.decode(F.unhex(F.sha2("line", 512)), "ISO-8859-1").alias("value"))
    named.write_named(lines.unionByName(heads).unionByName(torn).unionByName(noise), root, form="text", order=["at"])
    return root


_MIXED_SQL = f"""{sql.CLEAN}, f AS (SELECT source_file || '_' || pass || '.csv' AS file_name, source_file, pass, CAST(substr(source_file, 3) AS BIGINT) % 6 AS k, count(*) AS n FROM clean GROUP BY source_file, pass)"""


@query(f"""WITH {_MIXED_SQL} SELECT file_name AS source_file, array_to_string(CASE k {' '.join(f"WHEN {k} THEN {list(c)}" for k, c in enumerate(_LAYOUTS))} ELSE {list(_LAYOUTS[0])} END, ',') AS header,
  CASE WHEN k = 3 THEN 'error: missing required columns: lon, lat' ELSE 'ok' END AS status FROM f WHERE k <> 5""")
def header_scan(spark, sf_dir):
    """Required columns by the files' own first lines; files that are no tables are left out here."""
    found = io.read_headers(spark, _mixed_folder(spark, sf_dir))
    checked = audit.required_columns(found.select(F.col("file_name").alias("source_file"), "header"))
    return checked.where(F.array_contains("header", "pass")).select("source_file", F.array_join("header", ",").alias("header"), "status")


@query(f"WITH {sql.CLEAN}, k AS (SELECT *, CAST(substr(source_file, 3) AS BIGINT) % 6 AS k FROM clean) SELECT source_file || '_' || pass || '.csv' AS file_name, pass, CASE WHEN k = 3 THEN NULL ELSE round(lon, 6) END AS lon, CASE WHEN k = 3 THEN NULL ELSE round(lat, 6) END AS lat, round(soil_moisture, 6) AS soil_moisture, CASE WHEN k = 2 THEN l_orderkey END AS l_orderkey FROM k WHERE k < 4")
def delimited_union(spark, sf_dir):
    """Files of different columns as one table, types found over all of them."""
    root = _mixed_folder(spark, sf_dir)
    headers = io.read_headers(spark, root).where(F.array_contains("header", "pass"))
    with scratch.opening(spark):
        every = scratch.cut(io.read_delimited(spark, root, ["pass", "lon", "lat", "soil_moisture", "l_orderkey"], headers))
    whole = every.join(every.where("malformed").select("file_name").distinct(), "file_name", "left_anti").drop("malformed")
    read = io.inferred(whole, keep=("file_name", "pass"))
    return read.select("file_name", "pass", r("lon"), r("lat"), r("soil_moisture"), "l_orderkey")


@query(f"""WITH {_MIXED_SQL} SELECT file_name AS source_file, pass, CASE WHEN k < 3 THEN CAST(n AS INTEGER) END AS rows, CASE WHEN k < 3 THEN 'detrended/' || pass || '/' || source_file || '_' || pass || '.rds' END AS output_file, CASE WHEN k < 3 THEN 'written' ELSE 'error' END AS status,
  CASE WHEN k < 3 THEN 'model_fitted' WHEN k = 3 THEN 'error: missing required columns: lon, lat' WHEN k = 4 THEN 'error: 1 malformed records' ELSE 'error: missing required columns: source_file, date_tag, pass, lon, lat, soil_moisture' END AS note FROM f""")
def detrend_files_log(spark, sf_dir):
    """The job over a folder of good, reordered, short, torn and unreadable files: a log row each."""
    _, log = detrend.detrend_files(spark, _mixed_folder(spark, sf_dir), numbered=False)
    return log.select("source_file", "pass", "rows", "output_file", "status", "note")


@query(f"""WITH {sql.CLEAN}, f AS (SELECT source_file, pass, CAST(count(*) AS INTEGER) AS n FROM clean GROUP BY source_file, pass)
SELECT 'detrended/' || pass || '/' || source_file || '_' || pass || '.rds' AS output_file, n AS rows_in_file, 'written' AS status FROM f
UNION ALL SELECT DISTINCT 'detrended/pm/' || source_file || '_empty_pm.rds', 0, 'written_empty' FROM f""")
def typed_empty_output(spark, sf_dir):
    """Every file of the log is there, an empty one with all columns and no row."""
    rows = cleaned(spark, sf_dir)
    files = rows.select(F.concat(F.lit("in/"), "source_file", F.lit("_empty_pm.csv")).alias("file_name")).distinct()
    whole = rows.withColumn("source_file", F.concat(F.concat_ws("_", "source_file", "pass"), F.lit(".csv")))
    cells, log = detrend.detrend_all(whole, files=files, order=ORDER)
    detrend.write_cells(cells, log, root := scratch.place(spark, "cells"))
    found = manifest.rows_on_disk(spark, root, "parquet").withColumnRenamed("rows", "rows_in_file")
    return log.select("output_file", "status").join(found, "output_file", "full").select("output_file", "rows_in_file", "status")


@query(f"""WITH {sql.PROJECTED}, h AS (SELECT *, 4512.155e0 AS h FROM xy)
SELECT source_file, pass, l_orderkey, l_linenumber, l_partkey, 6933 AS srid, 5 AS n_vertices, round(x - h, 2) AS x0, round(y - h, 2) AS y0, round(x + h, 2) AS x1, round(y - h, 2) AS y1, round(x + h, 2) AS x2, round(y + h, 2) AS y2, round(x - h, 2) AS x3, round(y + h, 2) AS y3, true AS closed FROM h""")
def geometry_round_trip(spark, sf_dir):
    """Cells written as typed objects with their geometry, read again and taken apart."""
    at = placed(spark, sf_dir)
    cells = at.select(*KEYS, "l_orderkey", "l_linenumber", "l_partkey", geo.square_binary(F.col("x"), F.col("y"), DEFAULT.cell_size).alias("geometry"), F.lit(DEFAULT.projected_srid).alias("srid"))
    named.write_named(cells.withColumn("output_file", names.detrended_path(F.col("source_file"), F.col("pass"))), root := scratch.place(spark, "cells"), form="parquet")
    back = spark.read.option("recursiveFileLookup", True).parquet(root).withColumn("s", geo.vertices(F.col("geometry")))
    corners = [F.round(F.col("s")[k][c], 2).alias(f"{c}{k}") for k in range(4) for c in "xy"]
    with scratch.opening(spark):
        return scratch.cut(back.select(*KEYS, "l_orderkey", "l_linenumber", "l_partkey", "srid", F.size("s").alias("n_vertices"), *corners, (F.col("s")[0] == F.col("s")[4]).alias("closed")))


@query(f"""WITH {_EXTRACT_SQL}, n AS (SELECT source_file, pass, k, CAST(count(*) FILTER (value BETWEEN 0 AND 1) AS INTEGER) AS rows FROM x GROUP BY source_file, pass, k)
SELECT source_file, pass, CASE WHEN k <> 5 THEN rows END AS rows, CASE WHEN k <> 5 THEN 'extracted/' || pass || '/' || split_part(source_file, '.', 1) || '_' || pass || '.csv' END AS output_file,
  CASE WHEN k = 5 THEN 'error: shapes [16x4] [16] [7]' ELSE 'written' END AS status FROM n""")
def extract_files_log(spark, sf_dir):
    """The extract job with its files; rows are counted in the files."""
    return extract.extract_to_files(*_granule_tables(spark, sf_dir), scratch.place(spark, "files"))
