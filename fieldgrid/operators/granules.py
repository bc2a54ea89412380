"""Arrays of granules: catalogue, choice of variables, shapes, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut


def catalogue(arrays: DataFrame) -> DataFrame:
    """granule, variable, group: the distinct variables; the group is what stands before the slash."""
    return arrays.select("granule", "variable").distinct().withColumn("group", F.substring_index("variable", "/", 1))


def catalogue_lists(arrays: DataFrame) -> DataFrame:
    """granule, variables (sorted)."""
    return arrays.groupBy("granule").agg(F.sort_array(F.collect_set("variable")).alias("variables"))


def attribute_values(attributes: DataFrame) -> DataFrame:
    """granule, variable, fill, missing: one row a variable."""
    of = lambda name: F.first(F.when(F.col("attr") == name, F.col("values")), ignorenulls=True)
    return attributes.groupBy("granule", "variable").agg(of("_FillValue").alias("fill"), of("missing_value").alias("missing"))


def resolve(variables: DataFrame, candidates: DataFrame) -> DataFrame:
    """granule, role, variable: of each role's candidates the first by rank that the granule has."""
    known = variables.select("granule", "variable").distinct().join(candidates, "variable")
    return known.groupBy("granule", "role").agg(F.min_by("variable", "rank").alias("variable"))


def resolve_status(granules: DataFrame, resolved: DataFrame) -> DataFrame:
    """granule, pass, value, lon, lat, status for both passes of every granule.

    A granule with neither pass is an error, as is a pass with a value but no place; a missing
    pass beside a found one is ``absent``."""
    chosen = F.map_from_entries(F.collect_list(F.struct("role", "variable")))
    known = granules.select("granule").distinct().join(resolved.groupBy("granule").agg(chosen.alias("of")), "granule", "left")
    rows = known.withColumn("pass", F.explode(F.array(F.lit("am"), F.lit("pm"))))
    pick = lambda p, what: F.try_element_at("of", F.concat(p, F.lit("_" + what)))
    rows = rows.select("granule", "pass", *[pick(F.col("pass"), w).alias(w) for w in ("value", "lon", "lat")], F.coalesce(pick(F.lit("am"), "value"), pick(F.lit("pm"), "value")).alias("any_value"))
    status = (
        F.when(F.col("any_value").isNull(), "error: no pass found")
        .when(F.col("value").isNull(), "absent")
        .when(F.col("lon").isNull(), "error: no longitude")
        .when(F.col("lat").isNull(), "error: no latitude")
        .otherwise("ok")
    )
    return rows.withColumn("status", status).drop("any_value")


def squeezed(dims: Column) -> Column:
    """Without dimensions of length 1."""
    return F.filter(dims, lambda d: d > 1)


def layout(value: Column, lon: Column, lat: Column) -> Column:
    """How coordinates lie to a value grid: same, transposed, lon_first, lat_first, or an error.

    The order of the cases decides square grids."""
    v, x, y = squeezed(value), squeezed(lon), squeezed(lat)
    two = (F.size(x) == 2) & (F.size(y) == 2)
    one = (F.size(x) == 1) & (F.size(y) == 1)
    shown = lambda d: F.concat(F.lit("["), F.array_join(d.cast("array<string>"), "x"), F.lit("]"))
    return (
        F.when(F.size(v) != 2, F.concat(F.lit("error: value is not 2-D "), shown(v)))
        .when(two & (x == v) & (y == v), "same")
        .when(two & (x == F.reverse(v)) & (y == F.reverse(v)), "transposed")
        .when(one & (x[0] == v[0]) & (y[0] == v[1]), "lon_first")
        .when(one & (y[0] == v[0]) & (x[0] == v[1]), "lat_first")
        .otherwise(F.concat(F.lit("error: shapes "), shown(v), F.lit(" "), shown(x), F.lit(" "), shown(y)))
    )


def coordinates(lon: DataFrame, lat: DataFrame) -> DataFrame:
    """granule, chunk, x, y: the coordinate arrays side by side."""
    return lon.select("granule", "chunk", F.col("data").alias("x")).join(lat.select("granule", "chunk", F.col("data").alias("y")), ["granule", "chunk"])


def turned(coords: DataFrame) -> DataFrame:
    """The same for grids whose coordinates are transposed: chunk j gathers place j of every chunk, in order."""
    cells = coords.select("granule", F.col("chunk").alias("i"), F.posexplode(F.arrays_zip("x", "y")).alias("j", "z"))
    whole = cells.groupBy("granule", "j").agg(F.sort_array(F.collect_list(F.struct("i", "z"))).alias("c"))
    return whole.select("granule", F.col("j").alias("chunk"), F.col("c.z.x").alias("x"), F.col("c.z.y").alias("y"))


def flatten_chunks(value: DataFrame, coords: DataFrame) -> DataFrame:
    """granule, p, value, lon, lat by position. Chunks are joined before anything is exploded."""
    joined = value.select("granule", "chunk", F.col("data").alias("v")).join(coords, ["granule", "chunk"])
    rows = joined.select("granule", "chunk", F.size("v").alias("d1"), F.posexplode(F.arrays_zip("v", "x", "y")).alias("i", "z"))
    return rows.select("granule", (F.col("chunk") * F.col("d1") + F.col("i")).alias("p"), F.col("z.v").alias("value"), F.col("z.x").alias("lon"), F.col("z.y").alias("lat"))


def flatten_along(value: DataFrame, axes: DataFrame, lon_first: Column) -> DataFrame:
    """The same where x and y of ``axes`` (one row a granule) are axes: the fast index picks from the
    first axis, the chunk is the place in the other. No cell is shuffled."""
    joined = value.select("granule", "chunk", F.col("data").alias("v")).join(axes.select("granule", "x", "y", lon_first.alias("first")), "granule")
    fast, slow = F.when(F.col("first"), F.col("x")).otherwise(F.col("y")), F.when(F.col("first"), F.col("y")).otherwise(F.col("x"))
    joined = joined.select("granule", "chunk", "first", F.size("v").alias("d1"), F.try_element_at(slow, F.col("chunk") + 1).alias("s"), F.arrays_zip("v", fast.alias("f")).alias("z"))
    rows = joined.select("granule", "chunk", "first", "d1", "s", F.posexplode("z").alias("i", "z"))
    pick = lambda at_fast: F.when(at_fast, F.col("z.f")).otherwise(F.col("s"))
    return rows.select("granule", (F.col("chunk") * F.col("d1") + F.col("i")).alias("p"), F.col("z.v").alias("value"), pick(F.col("first")).alias("lon"), pick(~F.col("first")).alias("lat"))


def flatten_same(value: DataFrame, lon: DataFrame, lat: DataFrame) -> DataFrame:
    """granule, p, value, lon, lat by position, where all grids have one shape."""
    return flatten_chunks(value, coordinates(lon, lat))


def flatten_transposed(value: DataFrame, lon: DataFrame, lat: DataFrame) -> DataFrame:
    """The same where coordinate grids are transposed: the coordinate of (i, j) stands at (j, i)."""
    return flatten_chunks(value, turned(coordinates(lon, lat)))


def flatten_axes(value: DataFrame, lon: DataFrame, lat: DataFrame, lon_first: bool = True) -> DataFrame:
    """The same where coordinates are axes: the fast index picks from the first axis."""
    axes = lon.select("granule", F.col("data").alias("x")).join(lat.select("granule", F.col("data").alias("y")), "granule")
    return flatten_along(value, axes, F.lit(lon_first))


def pixel_ids(df: DataFrame, order: list[str], keys: tuple[str, ...] = ("source_file", "pass")) -> DataFrame:
    """``pixel_id``: a running number from 1 in each file, by an explicit order.

    In two levels, so that no file is one task's work: rows are dealt into ranges of file and order,
    numbered within their range, and lifted by the rows of the file's earlier ranges, which are one
    count a file and range. The dealt rows are written once, for the counts and the numbers."""
    dealt = cut(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    same = [F.col(f"_d.{k}").eqNullSafe(F.col(f"_s.{k}")) for k in (*keys, "_range")]
    out = here.alias("_d").join(starts.alias("_s"), same)
    return out.select(*[F.col(f"_d.{c}") for c in df.columns], (F.col("_before") + F.col("_at")).cast("int").alias("pixel_id"))
