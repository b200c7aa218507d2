"""Summaries of counts by site, stratum, species and year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.columns import as_double, ascending, count_true, rounded, strict_sum
from tallyfield.functions.geo import Grid
from tallyfield.operators.aggregates import (
    frequency_profile,
    histogram,
    joint_start_abundance,
    kernel_density,
    largest_count,
    profile_of_counts,
    richness,
    screen_groups,
    standardise,
    start_abundance,
    start_occupancy,
    totals,
)
from tallyfield.operators.joins import natural_join, with_every
from tallyfield.operators.pivots import fold_stops, wide_counts
from tallyfield.operators.ranks import top_rows
from tallyfield.operators.spatial import complete_grid, grid_cells, to_cells
from tallyfield.plans.route_counts import stop_columns, widen_stops
from tallyfield.queries.registry import Tables, query

# the study rectangle in cells of 200 km and of 20 km
COARSE = Grid(-2350000.0, 330000.0, 200000.0, 11, 16)
FINE = Grid(-2350000.0, 330000.0, 20000.0, 106, 159)


def cell_sql(grid: Grid, x: str = "x", y: str = "y") -> str:
    ix = f"floor(({x} - ({grid.x0})) / {grid.size})"
    iy = f"floor(({y} - ({grid.y0})) / {grid.size})"
    return f"CAST({iy} * {grid.nx} + {ix} AS BIGINT)"


_GROUPS_SQL = ", ".join(
    f"CAST(sum(CASE WHEN (stop - 1) // 5 = {i} THEN cnt ELSE 0 END) AS BIGINT) AS count{i + 1}" for i in range(10)
)


@query("stop_group_sums", f"""
SELECT route, CAST(yr AS INTEGER) AS yr, obs_n, {_GROUPS_SQL}, CAST(sum(cnt) AS BIGINT) AS total_count FROM v_stops GROUP BY 1, 2, 3""")
def stop_group_sums(t: Tables) -> DataFrame:
    """Fifty stop columns folded to ten sums and a total."""
    wide = widen_stops(t.v_stops, ["route", "yr", "obs_n"], "stop", "cnt")
    return fold_stops(wide, stop_columns())


@query("screen_sites", """
WITH f AS (SELECT l_suppkey || '-' || (l_orderkey % 16) AS transect, l_shipdate, l_returnflag FROM lineitem),
s AS (SELECT transect, CAST(min(l_shipdate) AS DATE) AS start_date, count(DISTINCT l_returnflag) AS num_species, count(*) AS num_obs FROM f GROUP BY 1)
SELECT transect, CAST(start_date AS VARCHAR) AS start_date, num_species, num_obs FROM s
WHERE NOT (num_species < 2 OR num_obs < 30 OR start_date > DATE '1995-03-31')""")
def screen_sites(t: Tables) -> DataFrame:
    """Transects are screened on start, species and rows; the rest keeps its summary."""
    rows = t.lineitem.select(
        F.concat_ws("-", F.col("l_suppkey").cast("string"), (F.col("l_orderkey") % 16).cast("string")).alias("transect"),
        F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("species"),
    )
    screened = screen_groups(rows, "transect", "date", "species", 2, 30, F.to_date(F.lit("1995-03-31")))
    kept = screened.where(~F.col("failing")).drop("failing")
    return kept.withColumn("start_date", F.col("start_date").cast("string"))


_SITE_CELLS = f"(SELECT site, {cell_sql(COARSE)} AS cell_id, stratum, state FROM v_sites)"


def _site_cells(t: Tables) -> DataFrame:
    return to_cells(t.v_sites, COARSE).select("site", "cell_id")


@query("site_totals_null_propagating", f"""
WITH j AS (SELECT cell_id, cnt FROM v_site_year v JOIN {_SITE_CELLS} s ON s.site = v.site)
SELECT cell_id, CAST(CASE WHEN count(cnt) = count(*) THEN sum(cnt) END AS DOUBLE) AS total_count,
  count(*) - count(cnt) AS n_missing FROM j GROUP BY 1""")
def site_totals_null_propagating(t: Tables) -> DataFrame:
    """Cell totals that go missing with any missing count.

    Counts are summed per site before the join; a missing part makes the whole missing.
    """
    per_site = t.v_site_year.groupBy("site").agg(
        strict_sum("cnt").alias("c"), F.sum(F.col("cnt").isNull().cast("long")).alias("m")
    )
    joined = natural_join(per_site, _site_cells(t), "inner", ["site"], nulls_match=False)
    return joined.groupBy("cell_id").agg(
        strict_sum("c").cast("double").alias("total_count"), F.sum("m").alias("n_missing")
    )


@query("site_observation_counts", """
WITH s AS (SELECT site, CASE WHEN count(cnt) = count(*) THEN sum(cnt) END AS total FROM v_site_year GROUP BY 1)
SELECT sum(CASE WHEN total IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS with_total,
  sum(CASE WHEN total IS NULL THEN 1 ELSE 0 END)::BIGINT AS without_total,
  sum(CASE WHEN total < 5 THEN 1 ELSE 0 END)::BIGINT AS below_five FROM s""")
def site_observation_counts(t: Tables) -> DataFrame:
    """Sites with a total, without one, and with a small one."""
    per_site = totals(t.v_site_year, ["site"], "cnt", "total", skip_missing=False)
    total = F.col("total")
    return per_site.agg(
        count_true(total.isNotNull()).alias("with_total"), count_true(total.isNull()).alias("without_total"),
        count_true(total < 5).alias("below_five"),
    )


@query("grid_year_totals", f"""
WITH j AS (SELECT cell_id, CAST(yr AS INTEGER) AS yr, sum(cnt) AS total FROM v_site_year v JOIN {_SITE_CELLS} s ON s.site = v.site GROUP BY 1, 2)
SELECT cell_id, yr, CAST(total AS BIGINT) AS total_count FROM j WHERE NOT total = 0""")
def grid_year_totals(t: Tables) -> DataFrame:
    """Cell and year totals joined to the grid, zero cells left out."""
    per_site = totals(t.v_site_year, ["site", "yr"], "cnt", "c")
    joined = natural_join(per_site, _site_cells(t), "inner", ["site"], nulls_match=False)
    sums = totals(joined, ["cell_id", "yr"], "c", "total_count")
    cells = grid_cells(t.spark, COARSE).select("cell_id")
    return cells.join(sums, "cell_id", "left").where(F.col("total_count") != 0)


@query("grid_complete", f"""
WITH cells AS (SELECT unnest(generate_series(0, {FINE.nx * FINE.ny - 1})) AS cell_id),
j AS (SELECT cell_id, CAST(yr AS INTEGER) AS yr, sum(cnt) AS total FROM v_site_year v
  JOIN (SELECT site, {cell_sql(FINE)} AS cell_id FROM v_sites) s ON s.site = v.site GROUP BY 1, 2)
SELECT cells.cell_id, CAST(yr AS DOUBLE) AS yr, CAST(total AS DOUBLE) AS total_count FROM cells LEFT JOIN j ON j.cell_id = cells.cell_id""")
def grid_complete(t: Tables) -> DataFrame:
    """Yearly totals on the whole 20 km grid; empty cells stay as rows."""
    sites = to_cells(t.v_sites, FINE).select("site", "cell_id")
    per_site = totals(t.v_site_year, ["site", "yr"], "cnt", "c")
    joined = natural_join(per_site, sites, "inner", ["site"], nulls_match=False)
    sums = totals(joined, ["cell_id", "yr"], "c", "total_count")
    return as_double(complete_grid(sums, grid_cells(t.spark, FINE).select("cell_id")), ["yr", "total_count"])


@query("richness_by_stratum", """
WITH m AS (SELECT s.stratum, v.species, v.yr, avg(cnt) AS mean FROM v_site_year v JOIN v_sites s ON s.site = v.site GROUP BY 1, 2, 3),
g AS (SELECT stratum || '-' || yr AS stratum, species, mean FROM m)
SELECT stratum, sum(CASE WHEN mean > 0 THEN 1 ELSE 0 END)::BIGINT AS richness FROM g GROUP BY 1""")
def richness_by_stratum(t: Tables) -> DataFrame:
    """Species with a positive mean count per stratum and year.

    Counts of a site, year and species are averaged before the join; a mean of
    such means is positive exactly when the mean of the rows is.
    """
    strata = t.v_sites.select("site", "stratum")
    means = t.v_site_year.groupBy("site", "yr", "species").agg(F.avg("cnt").alias("cnt"))
    rows = natural_join(means, strata, "inner", ["site"], nulls_match=False)
    named = rows.withColumn("stratum", F.concat_ws("-", "stratum", F.col("yr").cast("string")))
    return richness(named, "stratum", "species", "cnt")


def _profile_sql(i: str, by: str = "", table: str = "f") -> str:
    return f"""count(*) AS n_{i}, CAST(sum(n) - count(*) AS BIGINT) AS n_rep_{i}, round(avg(n), 9) + 0.0 AS mean_rep_{i},
  median(n) + 0.0 AS med_rep_{i}, max(n) AS max_rep_{i}, round(CAST(sum(n) - count(*) AS DOUBLE) / count(*), 9) + 0.0 AS rep_share_{i}"""


def _rounded_profile(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_{i}": rounded(F.col(f"{c}_{i}"), 9) for i in ids for c in ("mean_rep", "rep_share")})


@query("replicate_profile", f"""
WITH f AS (SELECT s.state, v.site, count(*) AS n FROM v_site_year v JOIN v_sites s ON s.site = v.site GROUP BY 1, 2)
SELECT state, {_profile_sql('site')} FROM f GROUP BY 1""")
def replicate_profile(t: Tables) -> DataFrame:
    """Repeat visits per site, by state; visits are counted per site before the join."""
    visits = t.v_site_year.groupBy("site").agg(F.count("*").alias("n"))
    rows = natural_join(visits, t.v_sites.select("site", "state"), "inner", ["site"], nulls_match=False)
    return _rounded_profile(profile_of_counts(rows, "site", "n", ["state"]), ["site"])


@query("replicate_profile_global", f"""
WITH f AS (SELECT site, count(*) AS n FROM v_site_year GROUP BY 1), g AS (SELECT yr, count(*) AS n FROM v_site_year GROUP BY 1)
SELECT a.*, b.* FROM (SELECT {_profile_sql('site')} FROM f) a, (SELECT {_profile_sql('yr')} FROM g) b""")
def replicate_profile_global(t: Tables) -> DataFrame:
    return _rounded_profile(frequency_profile(t.v_site_year, ["site", "yr"]), ["site", "yr"])


YEAR_COLS = [f"y{y}" for y in range(1995, 2002)]
_WIDE_SQL = ", ".join(f"CAST(sum(CASE WHEN yr = {c[1:]} THEN coalesce(cnt, 0) ELSE 0 END) AS DOUBLE) AS {c}" for c in YEAR_COLS)


@query("standardise_covariates", f"""
WITH w AS (SELECT site, {_WIDE_SQL} FROM v_site_year GROUP BY 1),
u AS ({' UNION ALL '.join(f'SELECT {c} AS v FROM w' for c in YEAR_COLS)}),
s AS (SELECT avg(v) AS m, stddev_samp(v) AS sd FROM u)
SELECT site, {', '.join(f'round(({c} - m) / sd, 6) + 0.0 AS {c}' for c in YEAR_COLS)},
  round((y1995 - 0.5) * 4, 6) + 0.0 AS scaled FROM w, s""")
def standardise_covariates(t: Tables) -> DataFrame:
    """One mean and deviation over the whole site x year block, and the fixed rescaling."""
    years = {int(c[1:]): c for c in YEAR_COLS}
    wide = as_double(wide_counts(t.v_site_year, ["site"], "yr", "cnt", years, skip_missing=True), YEAR_COLS)
    scaled = wide.withColumn("scaled", rounded((F.col("y1995") - 0.5) * 4))
    out = standardise(scaled, YEAR_COLS)
    return out.withColumns({c: rounded(F.col(c)) for c in YEAR_COLS})


@query("model_constants", """
WITH per_site AS (SELECT site, count(DISTINCT yr) AS n FROM v_site_year GROUP BY 1)
SELECT (SELECT count(*) FROM v_site_year) AS n_obs, (SELECT count(*) FROM per_site) AS n_sites, (SELECT max(n) FROM per_site) AS max_years,
  (SELECT count(DISTINCT route) FROM v_stops) AS n_routes, (SELECT count(DISTINCT obs_n) FROM v_stops) AS n_observers,
  (SELECT count(DISTINCT transect) FROM v_distance) AS n_transects,
  CAST(least((SELECT min(yr) FROM v_site_year), (SELECT min(yr) FROM v_stops), (SELECT min(yr) FROM v_distance)) AS INTEGER) AS first_year""")
def model_constants(t: Tables) -> DataFrame:
    """Sizes and the first year over all feeds, one row; each feed is read once.

    A feed's keys are reduced to distinct combinations, which every distinct
    count then starts from.
    """
    visits = t.v_site_year.groupBy("site", "yr").agg(F.count("*").alias("n")).groupBy("site").agg(
        F.sum("n").alias("n"), F.count("*").alias("years"), F.min("yr").alias("y")
    )
    visits = visits.agg(
        F.sum("n").alias("n_obs"), F.count("*").alias("n_sites"), F.max("years").alias("max_years"), F.min("y").alias("y1")
    )
    routes = t.v_stops.select("route", "obs_n", "yr").distinct().agg(
        F.count_distinct("route").alias("n_routes"), F.count_distinct("obs_n").alias("n_observers"), F.min("yr").alias("y2")
    )
    survey = t.v_distance.groupBy("transect").agg(F.min("yr").alias("y")).agg(
        F.count("*").alias("n_transects"), F.min("y").alias("y3")
    )
    r, d = (df.agg(F.first(F.struct("*"))).scalar() for df in (routes, survey))
    return visits.select(
        "n_obs", "n_sites", "max_years", r.getField("n_routes").alias("n_routes"), r.getField("n_observers").alias("n_observers"),
        d.getField("n_transects").alias("n_transects"), F.least("y1", r.getField("y2"), d.getField("y3")).alias("first_year"),
    )


def site_years(t: Tables) -> DataFrame:
    """Every site with every year of the visits."""
    years = t.v_site_year.select("yr").distinct()
    return with_every(t.v_sites.select("site"), years, ["site"])


def largest_by_site_year(t: Tables) -> DataFrame:
    visits = t.v_site_year.select("site", "yr", "cnt")
    stops = t.v_stops.select(F.col("route").alias("site"), "yr", "cnt")
    survey = t.v_distance.select(F.col("transect").alias("site"), "yr", "point", "cnt")
    survey = totals(survey, ["site", "yr", "point"], "cnt", "cnt")
    return largest_count([(visits, ["cnt"]), (stops, ["cnt"]), (survey, ["cnt"])], ["site", "yr"], "largest")


_LARGEST_SQL = """frame AS (SELECT s.site, y.yr FROM v_sites s CROSS JOIN (SELECT DISTINCT yr FROM v_site_year) y),
top AS (SELECT site, yr, CAST(max(cnt) AS DOUBLE) AS largest FROM (
  SELECT site, yr, cnt FROM v_site_year UNION ALL SELECT route, yr, cnt FROM v_stops
  UNION ALL SELECT transect, yr, sum(cnt) FROM v_distance GROUP BY transect, yr, point) u GROUP BY 1, 2),
j AS (SELECT frame.site, CAST(frame.yr AS INTEGER) AS yr, largest FROM frame LEFT JOIN top ON top.site = frame.site AND top.yr = frame.yr)"""
_START_SQL = "CASE WHEN largest IS NULL THEN 10.0::DOUBLE ELSE greatest(largest, 10.0::DOUBLE) * 3 END"


@query("initial_abundance", f"WITH {_LARGEST_SQL} SELECT site, yr, {_START_SQL} AS n_start FROM j")
def initial_abundance(t: Tables) -> DataFrame:
    """Start values for every site and year from the largest count of any feed."""
    starts = start_abundance(site_years(t), largest_by_site_year(t), ["site", "yr"], "largest")
    return starts.select("site", "yr", "n_start")


@query("initial_occupancy", f"""
WITH {_LARGEST_SQL}, n AS (SELECT site, sum({_START_SQL}) AS total_start, count(*) AS n_years FROM j GROUP BY 1)
SELECT site, total_start, n_years, CAST(CASE WHEN total_start = 10 * n_years THEN 0 ELSE 1 END AS INTEGER) AS z_start FROM n""")
def initial_occupancy(t: Tables) -> DataFrame:
    starts = start_abundance(site_years(t), largest_by_site_year(t), ["site", "yr"], "largest")
    return start_occupancy(starts, "site", "n_start")


@query("initial_abundance_joint", f"""
WITH {_LARGEST_SQL}, n AS (SELECT *, coalesce(largest, 5.0::DOUBLE) AS n_base FROM j)
SELECT n.site, n.yr, n_base * 2 + 10 AS n_start, CAST(CASE WHEN total = 0 THEN 0 ELSE 1 END AS INTEGER) AS z_start
FROM n JOIN (SELECT site, sum(n_base) AS total FROM n GROUP BY 1) s ON s.site = n.site""")
def initial_abundance_joint(t: Tables) -> DataFrame:
    """The form for several feeds: doubled counts plus ten; empty sites start unoccupied."""
    starts = joint_start_abundance(site_years(t), largest_by_site_year(t), ["site", "yr"], "largest")
    occupied = start_occupancy(starts, "site", "n_base", empty=0.0).select("site", "z_start")
    return starts.join(occupied, "site").select("site", "yr", "n_start", "z_start")


@query("histogram", """
SELECT 'distance' AS what, CAST(floor(distance / 12.5) AS BIGINT) AS bin, count(*) AS n FROM v_distance GROUP BY 1, 2
UNION ALL SELECT parameter, CAST(floor(value / 5) AS BIGINT), count(*) FROM v_draws GROUP BY 1, 2""")
def histograms(t: Tables) -> DataFrame:
    """Distances in 12.5 m bins, and the marginal of every sampled parameter."""
    distances = histogram(t.v_distance, "distance", 12.5).select(F.lit("distance").alias("what"), "bin", "n")
    draws = histogram(t.v_draws.withColumnRenamed("parameter", "what"), "value", 5.0, ["what"])
    return distances.unionByName(draws)


@query("marginal_density", """
WITH s AS (SELECT parameter, count(*) AS n, stddev_samp(value) AS sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, min(value) AS low, max(value) AS high
  FROM v_draws WHERE value IS NOT NULL GROUP BY 1),
b AS (SELECT *, 0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) AS bw FROM s),
f AS (SELECT *, low - 3 * bw AS origin, (high + 3 * bw - (low - 3 * bw)) / 511 AS step FROM b),
p AS (SELECT parameter, (value - origin) / step AS place FROM v_draws JOIN f USING (parameter) WHERE value IS NOT NULL),
m AS (SELECT parameter, k, sum(m) AS m FROM (
  SELECT parameter, CAST(floor(place) AS BIGINT) AS k, 1 - (place - floor(place)) AS m FROM p
  UNION ALL SELECT parameter, CAST(floor(place) AS BIGINT) + 1, place - floor(place) FROM p) GROUP BY 1, 2)
SELECT f.parameter, CAST(g.i AS INTEGER) AS i, round(any_value(origin + g.i * step), 8) + 0.0 AS at,
  round(sum(CASE WHEN abs(m.k - g.i) * step / bw <= 8 THEN m.m * exp(-0.5 * pow((m.k - g.i) * step / bw, 2)) ELSE 0 END) / any_value(n * bw) / sqrt(2 * pi()), 10) + 0.0 AS density
FROM f JOIN m USING (parameter) CROSS JOIN range(512) g(i) GROUP BY f.parameter, g.i""")
def marginal_density(t: Tables) -> DataFrame:
    """Kernel density of every sampled parameter on 512 places."""
    out = kernel_density(t.v_draws, "value", ["parameter"])
    return out.select("parameter", "i", rounded(F.col("at"), 8).alias("at"), rounded(F.col("density"), 10).alias("density"))


@query("top_species", """
SELECT species, observer, count(*) AS n FROM v_observations GROUP BY 1, 2 ORDER BY n DESC, species, observer LIMIT 10""")
def top_species(t: Tables) -> DataFrame:
    """The ten most frequent species and observer pairs."""
    counts = t.v_observations.groupBy("species", "observer").agg(F.count("*").alias("n"))
    return top_rows(counts, "n", ["species", "observer"], 10)


@query("ordered_feed", """
SELECT species AS alpha, CAST(yr AS INTEGER) AS yr, transect, point, time_period, distance, cnt FROM v_distance""")
def ordered_feed(t: Tables) -> DataFrame:
    cols = ["alpha", "yr", "transect", "point", "time_period"]
    rows = t.v_distance.select(F.col("species").alias("alpha"), "yr", "transect", "point", "time_period", "distance", "cnt")
    return rows.orderBy(*ascending(cols))


@query("distinct_rows", "SELECT DISTINCT CAST(yr AS INTEGER) AS yr, transect, point FROM v_distance")
def distinct_rows(t: Tables) -> DataFrame:
    return t.v_distance.select("yr", "transect", "point").distinct()
