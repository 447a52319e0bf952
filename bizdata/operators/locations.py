"""Places: code resolution, location lists, coverage and search (F-17, S-08/S-09 helpers, J-21, U-01, X-59)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.presence import as_col, icontains
from .joins import without


def resolve_region(df: DataFrame, regions: DataFrame, country: str = "country_code", region: str = "region") -> DataFrame:
    """F-17: add region_filter, the state name behind a code or name.

    `regions` has country_code, state_code, state_name.  An unknown text of one to three letters
    gives NULL (no filter); any other unknown text is kept.
    """
    spelled = regions.select(
        F.lower("country_code").alias("_country"), "state_name",
        F.explode(F.array_distinct(F.array(F.lower("state_code"), F.lower("state_name")))).alias("_spelling"))
    known = spelled.groupBy("_country", "_spelling").agg(F.min("state_name").alias("state_name"))
    code = F.lower(as_col(country))
    code = F.when(code == "uk", F.lit("gb")).otherwise(code)
    joined = df.join(known, (code == F.col("_country")) & (F.lower(as_col(region)) == F.col("_spelling")), "left")
    unknown = F.when(~as_col(region).rlike("(?i)^[a-z]{1,3}$"), as_col(region))
    return joined.withColumn("region_filter", F.coalesce("state_name", unknown)).drop(
        "_country", "_spelling", "state_name")


def union_locations(us: DataFrame, *others: DataFrame) -> DataFrame:
    """S-09: location lists with default priority 3 (US) or 2 and population 0."""
    def defaults(df: DataFrame, priority: int) -> DataFrame:
        for name, value in (("priority", priority), ("population", 0)):
            current = F.col(name) if name in df.columns else F.lit(None).cast("int")
            df = df.withColumn(name, F.coalesce(current, F.lit(value)))
        return df

    out = defaults(us, 3)
    for other in others:
        out = out.unionByName(defaults(other, 2), allowMissingColumns=True)
    return out


def location_backlog(locations: DataFrame, accounts: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """J-21: locations with their present number of accounts; order with backlog_order()."""
    totals = accounts.groupBy(
        F.lower("city").alias("_city"), F.lower("state_region").alias("_state"),
        F.lower("country").alias("_country")).agg(F.count(F.lit(1)).alias("existing"))
    on = ((F.lower("city") == F.col("_city")) & (F.lower("state_region") == F.col("_state"))
          & (F.lower("country") == F.col("_country")))
    out = locations.join(totals, on, "left").drop("_city", "_state", "_country")
    out = out.withColumn("existing", F.coalesce("existing", F.lit(0)))
    if done is None:
        return out
    return without(out, done, [(c, c) for c in ("city", "state_region", "country")])


def backlog_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc("priority"), F.asc("existing"), F.desc("population"), F.asc("country"),
                      F.asc("state_region"), F.asc("city"))


def search_locations(term: str, countries: DataFrame, states: DataFrame, cities: DataFrame) -> DataFrame:
    """U-01: cities, states and countries whose name contains the term."""
    co = countries.select("country_id", "country_name")
    st = states.select("state_id", "state_name", F.col("country_id").alias("_c")).join(
        co, F.col("_c") == F.col("country_id"))
    city_rows = cities.filter(icontains("city_name", term)).select("city_id", "city_name", "state_id").join(
        st, "state_id").select(
        F.lit("city").alias("type"), F.col("city_id").alias("id"), F.col("city_name").alias("name"),
        F.col("state_id").alias("parent_id"), F.col("state_name").alias("parent_name"), "country_name")
    state_rows = st.filter(icontains("state_name", term)).select(
        F.lit("state").alias("type"), F.col("state_id").alias("id"), F.col("state_name").alias("name"),
        F.col("country_id").alias("parent_id"), F.col("country_name").alias("parent_name"), "country_name")
    country_rows = co.filter(icontains("country_name", term)).select(
        F.lit("country").alias("type"), F.col("country_id").alias("id"), F.col("country_name").alias("name"),
        F.lit(None).cast("int").alias("parent_id"), F.lit(None).cast("string").alias("parent_name"),
        "country_name")
    return city_rows.unionByName(state_rows).unionByName(country_rows).orderBy(
        F.asc("country_name"), F.asc_nulls_last("parent_name"), F.asc("name"), F.asc("id"))


def grid_cells(boxes: DataFrame, step: float = rules.GRID_DEGREES) -> DataFrame:
    """X-59: split bounding boxes (south, north, west, east) into cells; the last ones are clipped."""
    def steps(low: str, high: str) -> Column:
        n = F.ceil(F.round((F.col(high) - F.col(low)) / step, 9)).cast("int")
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    cells = boxes.withColumn("_i", F.explode(steps("south", "north"))).withColumn(
        "_j", F.explode(steps("west", "east")))
    others = [c for c in boxes.columns if c not in ("south", "north", "west", "east")]
    return cells.select(
        *others,
        F.round(F.col("south") + F.col("_i") * step, 6).alias("south"),
        F.round(F.least(F.col("south") + (F.col("_i") + 1) * step, F.col("north")), 6).alias("north"),
        F.round(F.col("west") + F.col("_j") * step, 6).alias("west"),
        F.round(F.least(F.col("west") + (F.col("_j") + 1) * step, F.col("east")), 6).alias("east"))
