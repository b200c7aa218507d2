"""Sequence numbers, ids, first rows, and the feed preparations built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.columns import as_double
from tallyfield.operators.aggregates import totals
from tallyfield.operators.checklists import thin_zero_sites
from tallyfield.operators.ranks import first_per_key, flag_first, id_by_first_seen, id_by_value, numbered
from tallyfield.operators.spatial import grid_cells, to_cells
from tallyfield.plans.distance_blocks import cell_blocks, clean_survey, visit_blocks
from tallyfield.plans.integrated import harmonise
from tallyfield.plans.integrated import harmonise_records
from tallyfield.plans.route_counts import of_codes, on_grid, route_points, widen_stops
from tallyfield.queries.counts import COARSE, _GROUPS_SQL, cell_sql
from tallyfield.queries.registry import Tables, query
from tallyfield.session import cut_lineage


@query("time_step", """
SELECT route, CAST(yr AS INTEGER) AS yr, obs_n, stop, row_number() OVER (PARTITION BY route ORDER BY yr, obs_n, stop) AS time_step,
  count(*) OVER (PARTITION BY route) AS nyears_site, CAST(yr - min(yr) OVER () + 1 AS INTEGER) AS year_no FROM v_stops""")
def time_step(t: Tables) -> DataFrame:
    """Rows numbered within their route, the rows of the route, and a calendar index beside them."""
    rows = t.v_stops.select("route", "yr", "obs_n", "stop")
    first = t.v_distance.agg(F.min("yr")).scalar()
    return numbered(rows, ["yr", "obs_n", "stop"], ["route"], "time_step", "nyears_site").withColumn("year_no", F.col("yr") - first + 1)


def _route_years(t: Tables) -> DataFrame:
    """Totals per route, year and observer, written once as every id reads them twice."""
    return cut_lineage(totals(t.v_stops, ["route", "yr", "obs_n"], "cnt", "total_count"))


_ROUTE_YEARS = "(SELECT route, CAST(yr AS INTEGER) AS yr, obs_n, CAST(sum(cnt) AS BIGINT) AS total_count FROM v_stops GROUP BY 1, 2, 3)"


@query("new_observer_flag", f"""
SELECT *, CAST(CASE WHEN yr = min(yr) OVER (PARTITION BY route, obs_n) THEN 1 ELSE 0 END AS INTEGER) AS new FROM {_ROUTE_YEARS} r""")
def new_observer_flag(t: Tables) -> DataFrame:
    """1 in the first year of an observer on a route."""
    return flag_first(_route_years(t), ["route", "obs_n"], ["yr"], "new")


@query("id_first_appearance", f"""
WITH r AS (SELECT * FROM {_ROUTE_YEARS} r), n AS (SELECT obs_n, row_number() OVER (ORDER BY route, yr, obs_n) AS k FROM r),
f AS (SELECT obs_n, row_number() OVER (ORDER BY min(k)) AS obs_id FROM n GROUP BY 1)
SELECT r.*, f.obs_id FROM r JOIN f ON f.obs_n = r.obs_n""")
def id_first_appearance(t: Tables) -> DataFrame:
    return id_by_first_seen(_route_years(t), "obs_n", ["route", "yr", "obs_n"], "obs_id")


@query("id_sorted", f"""
SELECT *, dense_rank() OVER (ORDER BY route) AS route_no, dense_rank() OVER (ORDER BY obs_n) AS obs_no FROM {_ROUTE_YEARS} r""")
def id_sorted(t: Tables) -> DataFrame:
    return id_by_value(id_by_value(_route_years(t), "route", "route_no"), "obs_n", "obs_no")


@query("observed_sites", """
WITH s AS (SELECT site, CAST(yr AS INTEGER) AS yr, sum(cnt) AS total FROM v_site_year GROUP BY 1, 2),
o AS (SELECT * FROM s WHERE coalesce(total > 0, false))
SELECT site, yr, CAST(total AS BIGINT) AS total_count, dense_rank() OVER (ORDER BY site) AS obs_site_id FROM o""")
def observed_sites(t: Tables) -> DataFrame:
    """Site years with a positive total, their sites numbered."""
    sums = totals(t.v_site_year, ["site", "yr"], "cnt", "total_count")
    flagged = sums.withColumn("is_observed", F.coalesce(F.col("total_count") > 0, F.lit(False)))
    return id_by_value(flagged.where("is_observed").drop("is_observed"), "site", "obs_site_id")


@query("first_per_key", """
SELECT observer, CAST(obs_date AS VARCHAR) AS obs_date, event_id, protocol, CAST(duration AS INTEGER) AS duration FROM v_checklists
QUALIFY row_number() OVER (PARTITION BY observer, obs_date ORDER BY duration, event_id) = 1""")
def first_of_day(t: Tables) -> DataFrame:
    """The shortest checklist of every observer and day, all its columns kept."""
    rows = t.v_checklists.select("observer", F.col("obs_date").cast("string").alias("obs_date"), "event_id", "protocol", "duration")
    return first_per_key(rows, ["observer", "obs_date"], ["duration", "event_id"])


_MISSING_IN_EMPTY_CELLS = ["route", "yr", "obs_n", "new", "obs_id", "total_count", *[f"count{i}" for i in range(1, 11)]]
_MAYBE = ", ".join(f"CAST(n.{c} AS DOUBLE) AS {c}" for c in _MISSING_IN_EMPTY_CELLS)


@query("route_counts_on_grid", f"""
WITH w AS (SELECT route, CAST(yr AS INTEGER) AS yr, obs_n, {_GROUPS_SQL}, CAST(sum(cnt) AS BIGINT) AS total_count FROM v_stops GROUP BY 1, 2, 3),
p AS (SELECT w.*, {cell_sql(COARSE)} AS cell_id FROM w JOIN v_sites s ON s.site = w.route),
q AS (SELECT *, cell_id || '-' || route AS route_id FROM p),
k AS (SELECT obs_n, row_number() OVER (ORDER BY route_id, yr, obs_n) AS k FROM q),
f AS (SELECT obs_n, row_number() OVER (ORDER BY min(k)) AS obs_id FROM k GROUP BY 1),
n AS (SELECT q.*, f.obs_id, CAST(CASE WHEN yr = min(yr) OVER (PARTITION BY route_id, q.obs_n) THEN 1 ELSE 0 END AS INTEGER) AS new FROM q JOIN f ON f.obs_n = q.obs_n),
c AS (SELECT unnest(generate_series(0, 175)) AS cell_id)
SELECT c.cell_id, {_MAYBE}, route_id, coalesce(total_count > 0, false) AS is_observed,
  row_number() OVER (PARTITION BY c.cell_id ORDER BY route_id NULLS LAST, n.yr, n.obs_n) AS time_step,
  count(*) OVER (PARTITION BY c.cell_id) AS nyears_site
FROM c LEFT JOIN n ON n.cell_id = c.cell_id""")
def route_counts_on_grid(t: Tables) -> DataFrame:
    """Stop counts to gridded route years with flags, ids and time steps."""
    wide = widen_stops(t.v_stops, ["route", "yr", "obs_n"], "stop", "cnt")
    routes = t.v_sites.select(F.col("site").alias("route"), "x", "y")
    gridded = on_grid(route_points(wide, routes, COARSE), grid_cells(t.spark, COARSE))
    return as_double(gridded, _MISSING_IN_EMPTY_CELLS)


@query("route_species_on_grid", f"""
WITH v AS (SELECT l_linenumber AS aou, l_suppkey AS route, year(l_shipdate) AS yr, l_partkey % 20 AS obs_n, l_orderkey % 50 + 1 AS stop, CAST(sum(l_quantity) AS BIGINT) AS cnt
  FROM lineitem GROUP BY 1, 2, 3, 4, 5),
w AS (SELECT alpha, route, CAST(yr AS INTEGER) AS yr, obs_n, {_GROUPS_SQL}, CAST(sum(cnt) AS BIGINT) AS total_count
  FROM v JOIN v_taxa t ON TRY_CAST(t.aou AS BIGINT) = v.aou GROUP BY 1, 2, 3, 4),
p AS (SELECT w.*, {cell_sql(COARSE)} AS cell_id FROM w JOIN v_sites s ON s.site = w.route),
q AS (SELECT *, cell_id || '-' || route AS route_id FROM p),
k AS (SELECT alpha, obs_n, row_number() OVER (PARTITION BY alpha ORDER BY route_id, yr, obs_n) AS k FROM q),
f AS (SELECT alpha, obs_n, row_number() OVER (PARTITION BY alpha ORDER BY min(k)) AS obs_id FROM k GROUP BY 1, 2),
n AS (SELECT q.*, f.obs_id, CAST(CASE WHEN yr = min(yr) OVER (PARTITION BY q.alpha, route_id, q.obs_n) THEN 1 ELSE 0 END AS INTEGER) AS new
  FROM q JOIN f ON f.obs_n = q.obs_n AND f.alpha = q.alpha),
g AS (SELECT alpha FROM n GROUP BY 1 HAVING sum(CASE WHEN total_count > 0 THEN 1 ELSE 0 END) >= 30),
c AS (SELECT cell_id, alpha FROM (SELECT unnest(generate_series(0, 175)) AS cell_id), g)
SELECT c.alpha, c.cell_id, {_MAYBE}, route_id, coalesce(total_count > 0, false) AS is_observed,
  row_number() OVER (PARTITION BY c.alpha, c.cell_id ORDER BY route_id NULLS LAST, n.yr, n.obs_n) AS time_step,
  count(*) OVER (PARTITION BY c.alpha, c.cell_id) AS nyears_site
FROM c LEFT JOIN n ON n.cell_id = c.cell_id AND n.alpha = c.alpha""")
def route_species_on_grid(t: Tables) -> DataFrame:
    """Stop counts of the taxa whose text code is the count's number, each species on its own grid with its own flags, ids and steps."""
    counted = t.lineitem.groupBy(
        F.col("l_linenumber").alias("aou"), F.col("l_suppkey").alias("route"), F.year("l_shipdate").alias("yr"),
        (F.col("l_partkey") % 20).alias("obs_n"), (F.col("l_orderkey") % 50 + 1).alias("stop"),
    ).agg(F.sum("l_quantity").cast("bigint").alias("cnt"))
    taxa = t.v_taxa.select("alpha", F.col("aou").alias("text_code"))
    stops = of_codes(counted, taxa, "aou", "text_code", ["alpha"])
    wide = widen_stops(stops, ["alpha", "route", "yr", "obs_n"], "stop", "cnt")
    routes = t.v_sites.select(F.col("site").alias("route"), "x", "y")
    points = route_points(wide, routes, COARSE, by=["alpha"])
    return as_double(on_grid(points, grid_cells(t.spark, COARSE), by=["alpha"], at_least=30), _MISSING_IN_EMPTY_CELLS)


_KEPT_SQL = """feeds AS (SELECT transect AS site, yr FROM v_distance UNION ALL SELECT route, yr FROM v_stops UNION ALL SELECT site, yr FROM v_site_year),
info AS (SELECT site, row_number() OVER (ORDER BY site) AS site_no FROM (SELECT DISTINCT site FROM feeds WHERE site IN (SELECT site FROM v_sites))),
y AS (SELECT min(yr) AS first FROM feeds WHERE site IN (SELECT site FROM info))"""
_FACTORS = {
    "points": {"point_no": "point", "period_no": "time_period"}, "routes": {"route_no": "site", "observer_no": "obs_n"},
    "checklists": {"locality_no": "obs_id", "species_no": "species"},
}


def _records(t: Tables) -> dict[str, DataFrame]:
    feeds = {
        "points": t.v_distance.withColumnRenamed("transect", "site"),
        "routes": t.v_stops.withColumnRenamed("route", "site"), "checklists": t.v_site_year,
    }
    return harmonise_records(t.v_sites, feeds, "site", "yr", _FACTORS)


@query("harmonised_points", f"""
WITH {_KEPT_SQL}
SELECT site_no, CAST(d.yr - first + 1 AS BIGINT) AS year_no, point, dense_rank() OVER (ORDER BY point) AS point_no,
  dense_rank() OVER (ORDER BY time_period) AS period_no, distance, cnt
FROM v_distance d JOIN info ON info.site = d.transect, y""")
def harmonised_points(t: Tables) -> DataFrame:
    """Distance records on the sites and years of all feeds, a row each."""
    return _records(t)["points"].select("site_no", "year_no", "point", "point_no", "period_no", "distance", "cnt")


@query("harmonised_routes", f"""
WITH {_KEPT_SQL}
SELECT site_no, CAST(s.yr - first + 1 AS BIGINT) AS year_no, dense_rank() OVER (ORDER BY route) AS route_no,
  dense_rank() OVER (ORDER BY obs_n) AS observer_no, stop, cnt
FROM v_stops s JOIN info ON info.site = s.route, y""")
def harmonised_routes(t: Tables) -> DataFrame:
    """Stop records with route and observer ids beside site and year."""
    return _records(t)["routes"].select("site_no", "year_no", "route_no", "observer_no", "stop", "cnt")


@query("harmonised_checklists", f"""
WITH {_KEPT_SQL}
SELECT site_no, CAST(c.yr - first + 1 AS BIGINT) AS year_no, dense_rank() OVER (ORDER BY obs_id) AS locality_no,
  dense_rank() OVER (ORDER BY species) AS species_no, CAST(cnt AS DOUBLE) AS cnt
FROM v_site_year c JOIN info ON info.site = c.site, y""")
def harmonised_checklists(t: Tables) -> DataFrame:
    """Checklist records with locality and species ids; counts may be missing."""
    rows = _records(t)["checklists"]
    return rows.select("site_no", "year_no", "locality_no", "species_no", F.col("cnt").cast("double").alias("cnt"))


_YEARS = (1996, 2000)
_BLOCK = ", ".join(
    f"CAST(sum(CASE WHEN time_period = {p} AND least(floor(distance / 50), 4) = {b} THEN cnt ELSE 0 END) AS BIGINT) AS count_{b * 50}_{b * 50 + 50}_{p}"
    for p in range(1, 7) for b in range(5)
)
_BLOCK_NAMES = [f"count_{b * 50}_{b * 50 + 50}_{p}" for p in range(1, 7) for b in range(5)]
_CLEAN = f"""clean AS (SELECT *, lower(species) AS alpha FROM v_distance
  WHERE yr BETWEEN {_YEARS[0]} AND {_YEARS[1]} AND distance BETWEEN 0 AND 250 AND time_period <> -1)"""


@query("distance_blocks_by_species", f"""
WITH {_CLEAN}, enough AS (SELECT alpha FROM clean GROUP BY 1 HAVING sum(CASE WHEN cnt > 0 THEN 1 ELSE 0 END) >= 30)
SELECT alpha, CAST(yr AS INTEGER) AS yr, transect, point, {_BLOCK} FROM clean WHERE alpha IN (SELECT alpha FROM enough) GROUP BY 1, 2, 3, 4""")
def distance_blocks_by_species(t: Tables) -> DataFrame:
    """Cleaned survey rows to blocks per species and visit, for species with enough rows."""
    return visit_blocks(clean_survey(t.v_distance, _YEARS))


@query("distance_blocks_on_grid", f"""
WITH {_CLEAN}, enough AS (SELECT alpha FROM clean GROUP BY 1 HAVING sum(CASE WHEN cnt > 0 THEN 1 ELSE 0 END) >= 30),
cells AS (SELECT * FROM (SELECT unnest(generate_series(0, 175)) AS cell_id), enough), located AS (SELECT site AS transect, {cell_sql(COARSE)} AS cell_id FROM v_sites),
b AS (SELECT cell_id, alpha, CAST(yr AS INTEGER) AS yr, clean.transect, point, {_BLOCK} FROM clean JOIN located ON located.transect = clean.transect
  WHERE alpha IN (SELECT alpha FROM enough) GROUP BY 1, 2, 3, 4, 5)
SELECT cells.cell_id, cells.alpha, CAST(yr AS DOUBLE) AS yr, CAST(transect AS DOUBLE) AS transect, CAST(point AS DOUBLE) AS point, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _BLOCK_NAMES)} FROM cells LEFT JOIN b ON b.cell_id = cells.cell_id AND b.alpha = cells.alpha""")
def distance_blocks_on_grid(t: Tables) -> DataFrame:
    """Blocks per species, cell and visit on one whole grid per species; empty cells hold zeros."""
    located = to_cells(t.v_sites, COARSE).select(F.col("site").alias("transect"), "cell_id")
    blocks = cell_blocks(clean_survey(t.v_distance, _YEARS), located, grid_cells(t.spark, COARSE))
    return as_double(blocks, ["yr", "transect", "point"])


@query("harmonise_three_feeds", """
WITH pos AS (SELECT * FROM v_site_year WHERE cnt > 0), zero AS (SELECT * FROM v_site_year WHERE cnt = 0),
years AS (SELECT site FROM zero WHERE site NOT IN (SELECT site FROM pos) GROUP BY site HAVING count(DISTINCT yr) >= 5),
keep AS (SELECT site FROM pos UNION SELECT site FROM years),
r AS (SELECT *, row_number() OVER (PARTITION BY site, yr ORDER BY md5('thin' || obs_id), obs_id) AS k
  FROM zero WHERE site IN (SELECT site FROM keep)),
u AS (SELECT 'survey' AS feed, transect AS site, yr, count(*) AS n, sum(cnt) AS total FROM v_distance GROUP BY 2, 3
  UNION ALL SELECT 'routes', route, yr, count(*), sum(cnt) FROM v_stops GROUP BY 2, 3
  UNION ALL SELECT 'checklists', site, yr, count(*), sum(cnt) FROM (SELECT site, yr, cnt FROM pos UNION ALL SELECT site, yr, cnt FROM r WHERE k = 1) x GROUP BY 2, 3),
info AS (SELECT c_custkey AS site, row_number() OVER (ORDER BY c_custkey) AS site_no FROM customer WHERE c_custkey IN (SELECT site FROM u)),
j AS (SELECT feed, site_no, yr, n, total FROM u JOIN info ON info.site = u.site)
SELECT feed, site_no, CAST(yr - (SELECT min(yr) FROM j) + 1 AS INTEGER) AS year_no, n, CAST(total AS BIGINT) AS total FROM j""")
def harmonise_three_feeds(t: Tables) -> DataFrame:
    """Three feeds summed per site and year on common site and year numbers."""
    per = lambda df, site: df.groupBy(F.col(site).alias("site"), "yr").agg(F.count("*").alias("n"), F.sum("cnt").alias("total"))
    thinned = thin_zero_sites(t.v_site_year, "site", "yr", "cnt", "obs_id", min_years=5, seed="thin")
    feeds = {"survey": per(t.v_distance, "transect"), "routes": per(t.v_stops, "route"), "checklists": per(thinned, "site")}
    covariates = t.customer.select(F.col("c_custkey").alias("site"))
    parts = [
        f.select(F.lit(name).alias("feed"), "site_no", "year_no", "n", "total")
        for name, f in harmonise(covariates, feeds, "site", "yr").items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
