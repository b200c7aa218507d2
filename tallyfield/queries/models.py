"""Detection, abundance, dispersal and posterior tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.bins import bin_index, spaced
from tallyfield.functions.columns import rounded
from tallyfield.functions.geo import Grid
from tallyfield.functions.text import indexed_name
from tallyfield.operators.abundance import (
    abundance_path,
    arrivals,
    density_growth,
    disperse,
    log_linear,
    space_time_mean,
    totals_by_year,
)
from tallyfield.operators.detection import (
    detection_table,
    effort_columns,
    effort_scale,
    gather,
    logistic_detection,
)
from tallyfield.operators.joins import natural_join, with_every
from tallyfield.operators.pivots import usable_distances
from tallyfield.operators.posterior import derived_totals, indexed_parameters, kept_draws, potential_scale, summarise, to_grid
from tallyfield.operators.ranks import flag_first
from tallyfield.operators.spatial import radius_pairs, to_cells
from tallyfield.queries.counts import COARSE, cell_sql
from tallyfield.queries.registry import Tables, query
from tallyfield.session import cut_lineage
from tallyfield.sources.readers import lookup

# fixed values: start values of the detection model, block limits
SIGMA, THETA, CUTOFF, N_BINS, PERIODS = 60.0, 0.4, 250.0, 5, 6

DETECTION_SQL = f"""bins AS (SELECT d, 2 * {SIGMA} * {SIGMA} * (exp(-pow((d - 1) * 50.0, 2) / (2 * {SIGMA} * {SIGMA})) - exp(-pow(d * 50.0, 2) / (2 * {SIGMA} * {SIGMA}))) / ({CUTOFF} * {CUTOFF}) AS psi
  FROM (SELECT unnest([1, 2, 3, 4, 5]) AS d)),
periods AS (SELECT r, pow(1 - {THETA}, r - 1) * {THETA} AS phi FROM (SELECT unnest([1, 2, 3, 4, 5, 6]) AS r)),
pis AS (SELECT d, r, CAST((r - 1) * 5 + d AS INTEGER) AS cell, psi / (SELECT sum(psi) FROM bins) AS psi_share, phi / (SELECT sum(phi) FROM periods) AS phi_share FROM bins CROSS JOIN periods)"""
BLOCK_SQL = """block AS (SELECT yr, transect, point, species, least(floor(distance / 50), 4) + 1 AS d, time_period AS r, sum(cnt) AS y
  FROM v_distance WHERE distance BETWEEN 0 AND 250 AND time_period <> -1 GROUP BY 1, 2, 3, 4, 5, 6)"""


def binned_counts(t: Tables, keys: list[str]) -> DataFrame:
    """Counts per ``keys``, distance bin ``d`` and period ``r`` in long form."""
    rows = t.v_distance.where(usable_distances(F.col("distance"), F.col("time_period")))
    d = (bin_index(F.col("distance"), 50, N_BINS) + 1).cast("int").alias("d")
    return rows.groupBy(*keys, d, F.col("time_period").cast("int").alias("r")).agg(F.sum("cnt").alias("y"))


@query("detection_bins", f"""
WITH {DETECTION_SQL}, {BLOCK_SQL}, o AS (SELECT species, d, r, sum(y) AS y FROM block GROUP BY 1, 2, 3), n AS (SELECT species, sum(y) AS n FROM o GROUP BY 1)
SELECT n.species, p.d, p.r, p.cell, round(psi_share, 9) + 0.0 AS psi_share, round(phi_share, 9) + 0.0 AS phi_share,
  round(psi_share * phi_share, 9) + 0.0 AS pi, CAST(coalesce(o.y, 0) AS BIGINT) AS observed, round(n.n * psi_share * phi_share, 6) + 0.0 AS expected
FROM n CROSS JOIN pis p LEFT JOIN o ON o.species = n.species AND o.d = p.d AND o.r = p.r""")
def detection_bins(t: Tables) -> DataFrame:
    """Detection shares of the distance x period block beside observed and expected counts per species."""
    observed = cut_lineage(binned_counts(t, ["species"]))
    per_species = observed.groupBy("species").agg(F.sum("y").alias("n"))
    shares = detection_table(per_species, F.lit(SIGMA), F.lit(THETA), CUTOFF, N_BINS, PERIODS)
    joined = shares.join(observed, ["species", "d", "r"], "left")
    return joined.select(
        "species", "d", "r", "cell",
        *[rounded(F.col(c), 9).alias(c) for c in ("psi_share", "phi_share", "pi")],
        F.coalesce("y", F.lit(0)).alias("observed"), rounded(F.col("n") * F.col("pi")).alias("expected"),
    )


_EFFECTS = "(SELECT c_custkey AS k, c_acctbal / 10000 AS eff FROM customer)"


def _effects(t: Tables, key: str) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias(key), (F.col("c_acctbal") / 10000).alias("eff"))


@query("effort_covariates", f"""
WITH c AS (SELECT event_id, observer, CASE WHEN protocol = 'Stationary' THEN 0 ELSE 1 END AS type,
  CASE WHEN duration > 0 THEN ln(duration) END AS ld, ln(1 + observer % 4) AS lo, lat / 10 AS dist FROM v_checklists)
SELECT event_id, CAST(type AS INTEGER) AS type, round(ld, 9) + 0.0 AS log_duration, round(lo, 9) + 0.0 AS log_observers,
  round(exp(-6 + 0.1 * type + 0.5 * ld + 0.2 * dist + 0.3 * lo + eff), 9) + 0.0 AS scale
FROM c JOIN {_EFFECTS} e ON e.k = c.observer""")
def effort_covariates(t: Tables) -> DataFrame:
    """Effort columns of checklists and the count scale they give; no minutes, no scale."""
    lists = t.v_checklists.select("event_id", "observer", "protocol", "duration", (F.col("lat") / 10).alias("dist"))
    cols = effort_columns(F.col("protocol"), F.col("duration"), 1 + F.col("observer") % 4)
    rows = gather(lists.withColumns(cols), _effects(t, "observer"), "observer", "eff", "eff")
    scale = effort_scale(
        [-6.0, 0.1, 0.5, 0.2, 0.3], [F.col("type"), F.col("log_duration"), F.col("dist"), F.col("log_observers")], F.col("eff")
    )
    return rows.select(
        "event_id", "type", rounded(F.col("log_duration"), 9).alias("log_duration"),
        rounded(F.col("log_observers"), 9).alias("log_observers"), rounded(scale, 9).alias("scale"),
    )


@query("detection_logistic", f"""
WITH a AS (SELECT 'survey' AS feed, CAST(yr AS VARCHAR) AS part, 1 / (1 + exp(-(0.5 - 0.01 * distance - 0.2 * time_period + 0.1 * (transect % 3)))) AS p FROM v_distance),
b AS (SELECT 'checklists', protocol, 1 / (1 + exp(-(-1 + 0.005 * duration + eff))) FROM v_checklists JOIN {_EFFECTS} e ON e.k = observer),
c AS (SELECT 'visits', v.species, 1 / (1 + exp(-(-0.5 + 0.3 * CAST(substr(v.species, 1, 1) AS INTEGER) + n_regionkey * 0.1)))
  FROM v_site_year v JOIN v_sites s ON s.site = v.site JOIN nation ON n_nationkey = s.state)
SELECT feed, part, count(*) AS n, round(avg(p), 9) + 0.0 AS mean_p FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) u GROUP BY 1, 2""")
def detection_logistic(t: Tables) -> DataFrame:
    """Detection on the logit scale for three feeds with covariates and group effects; mean per feed part."""
    d = t.v_distance
    survey = d.select(F.lit("survey").alias("feed"), F.col("yr").cast("string").alias("part"), logistic_detection(
        0.5, [(-0.01, F.col("distance")), (-0.2, F.col("time_period")), (0.1, F.col("transect") % 3)]).alias("p"))
    # rows with the same covariates and group share their detection, so they are counted before the joins
    lists = t.v_checklists.groupBy("observer", "protocol", "duration").agg(F.count("*").alias("w"))
    lists = gather(lists, _effects(t, "observer"), "observer", "eff", "eff")
    checklists = lists.select(F.lit("checklists").alias("feed"), F.col("protocol").alias("part"), "w",
                              logistic_detection(-1.0, [(0.005, F.col("duration"))], F.col("eff")).alias("p"))
    regions = t.nation.select(F.col("n_nationkey").alias("state"), (F.col("n_regionkey") * 0.1).alias("eff"))
    sites = gather(t.v_sites.select("site", "state"), regions, "state", "eff", "eff")
    visits = t.v_site_year.groupBy("site", "species").agg(F.count("*").alias("w"))
    placed = natural_join(visits, sites, "inner", ["site"], nulls_match=False)
    visited = placed.select(F.lit("visits").alias("feed"), F.col("species").alias("part"), "w", logistic_detection(
        -0.5, [(0.3, F.substring("species", 1, 1).cast("int"))], F.col("eff")).alias("p"))
    every = survey.withColumn("w", F.lit(1).cast("long")).unionByName(checklists).unionByName(visited)
    return every.groupBy("feed", "part").agg(
        F.sum("w").alias("n"), rounded(F.sum(F.col("p") * F.col("w")) / F.sum("w"), 9).alias("mean_p")
    )


ROUTE_YEARS_SQL = "route_years AS (SELECT route, CAST(yr AS INTEGER) AS yr, obs_n, sum(cnt) AS total FROM v_stops GROUP BY 1, 2, 3)"
_STOPS_AT = spaced(-2.0, 2.0, 10)


@query("linear_predictor_gather", f"""
WITH {ROUTE_YEARS_SQL},
n AS (SELECT *, CASE WHEN yr = min(yr) OVER (PARTITION BY route, obs_n) THEN 1 ELSE 0 END AS new FROM route_years),
e AS (SELECT n.*, -5 + s_acctbal / 10000 + eff + 0.5 * new AS eta FROM n JOIN supplier ON s_suppkey = route JOIN {_EFFECTS} e ON e.k = obs_n),
j AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) AS j)
SELECT route, yr, obs_n, CAST(new AS INTEGER) AS new, j.j, round(exp(eta), 9) + 0.0 AS scale, round(exp(-1 + 0.1 * (-2 + (j.j - 1) * 4 / 9.0)), 9) + 0.0 AS stop_sd
FROM e CROSS JOIN j""")
def linear_predictor_gather(t: Tables) -> DataFrame:
    """Count scale per route year from route, observer and first-year effects, and the spread of each stop group."""
    route_years = cut_lineage(t.v_stops.select("route", "yr", "obs_n").distinct())
    flagged = flag_first(route_years, ["route", "obs_n"], ["yr"], "new")
    routes = t.supplier.select(F.col("s_suppkey").alias("route"), (F.col("s_acctbal") / 10000).alias("eff"))
    rows = gather(gather(flagged, routes, "route", "eff", "route_eff"), _effects(t, "obs_n"), "obs_n", "eff", "obs_eff")
    scaled = rows.withColumn("scale", F.exp(-5 + F.col("route_eff") + F.col("obs_eff") + 0.5 * F.col("new")))
    spread = scaled.select("route", "yr", "obs_n", "new", "scale", F.posexplode(F.array(*map(F.lit, _STOPS_AT))).alias("j", "at"))
    return spread.select(
        "route", "yr", "obs_n", "new", (F.col("j") + 1).alias("j"), rounded(F.col("scale"), 9).alias("scale"),
        rounded(F.exp(-1 + 0.1 * F.col("at")), 9).alias("stop_sd"),
    )


COVARIATES_SQL = """cov_seen AS (SELECT site, yr, avg(coalesce(cnt, 0)) AS gra, CAST(count(*) - 1 AS DOUBLE) AS tem, sum(cnt) AS total FROM v_site_year GROUP BY 1, 2),
cov AS (SELECT s.site, CAST(y.yr AS INTEGER) AS yr, coalesce(gra, 0) AS gra, coalesce(tem, 0) AS tem, CAST(coalesce(total, 0) AS BIGINT) AS total
  FROM (SELECT DISTINCT site FROM v_site_year) s CROSS JOIN (SELECT DISTINCT yr FROM v_site_year) y LEFT JOIN cov_seen c ON c.site = s.site AND c.yr = y.yr)"""


def covariates(t: Tables) -> DataFrame:
    """Covariates of every site in every year, 0 where a year has no visit, so that recursions meet no gap."""
    rows = t.v_site_year
    seen = rows.groupBy("site", "yr").agg(
        F.avg(F.coalesce("cnt", F.lit(0))).alias("gra"), (F.count("*") - 1).cast("double").alias("tem"), F.sum("cnt").alias("total")
    )
    frame = with_every(rows.select("site").distinct(), rows.select("yr").distinct(), ["site"])
    return frame.join(seen, ["site", "yr"], "left").na.fill(0, ["gra", "tem", "total"])


@query("loglinear_abundance", f"""
WITH {COVARIATES_SQL}
SELECT site, yr, round(exp(2 + 0.5 * gra - tem - tem * tem), 9) + 0.0 AS first_abundance, round(exp(0.1 - 0.1 * tem - 0.1 * tem * tem), 9) + 0.0 AS growth FROM cov""")
def loglinear_abundance(t: Tables) -> DataFrame:
    gra, tem = F.col("gra"), F.col("tem")
    return covariates(t).select(
        "site", "yr", rounded(log_linear([2.0, 0.5, -1.0, -1.0], gra, tem), 9).alias("first_abundance"),
        rounded(log_linear([0.1, 0.0, -0.1, -0.1], gra, tem), 9).alias("growth"),
    )


@query("space_time_abundance", """
WITH y AS (SELECT CAST(yr AS INTEGER) AS yr, (yr - 1998) / 3.0 AS temp, count(*) % 10 / 10.0 AS eff FROM v_site_year GROUP BY yr),
s AS (SELECT c_custkey AS site, c_acctbal / 10000 AS habitat, n_regionkey * 0.1 AS eff FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT site, yr, round(exp(0.5 + 0.4 * habitat - 0.2 * temp + s.eff + y.eff + (site % 7 - 3) * (yr - 1998) / 100.0), 9) + 0.0 AS mean_abundance FROM s CROSS JOIN y""")
def space_time_abundance(t: Tables) -> DataFrame:
    """Log-link mean for every site and year from habitat, temperature and three kinds of effects."""
    years = t.v_site_year.groupBy("yr").agg((F.count("*") % 10 / 10).alias("year_eff")).withColumn("temp", (F.col("yr") - 1998) / 3)
    regions = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") * 0.1).alias("site_eff"))
    sites = gather(t.customer, regions, "c_nationkey", "site_eff", "site_eff").select(
        F.col("c_custkey").alias("site"), (F.col("c_acctbal") / 10000).alias("habitat"), "site_eff"
    )
    joint = (F.col("site") % 7 - 3) * (F.col("yr") - 1998) / 100
    means = space_time_mean(sites, "site", years, 0.5, 0.4, -0.2, "habitat", "temp", "site_eff", "year_eff", joint)
    return means.select("site", "yr", rounded(F.col("mean_abundance"), 9).alias("mean_abundance"))


@query("abundance_recursion", f"""
WITH RECURSIVE {COVARIATES_SQL},
step AS (SELECT site, yr, exp(1 + 0.3 * gra) AS start, exp(0.1 - 0.1 * tem) AS g, row_number() OVER (PARTITION BY site ORDER BY yr) AS k,
  CASE WHEN sum(total) OVER (PARTITION BY site) > 0 THEN 1 ELSE 0 END AS z FROM cov),
path AS (SELECT site, k, yr, start * z + 0.1 * (1 - z) AS n FROM step WHERE k = 1
  UNION ALL SELECT s.site, s.k, s.yr, p.n * s.g * s.z + 0.1 * (1 - s.z) FROM path p JOIN step s ON s.site = p.site AND s.k = p.k + 1)
SELECT site, yr, round(n, 9) + 0.0 AS expected FROM path""")
def abundance_recursion(t: Tables) -> DataFrame:
    """Expected abundance carried from year to year; empty sites keep a small constant."""
    rows = covariates(t).select(
        "site", "yr", F.exp(1 + 0.3 * F.col("gra")).alias("start"), F.exp(0.1 - 0.1 * F.col("tem")).alias("g"), "total"
    )
    # the state is 1 where any year of the site has a count, the largest flag of its rows
    flagged = rows.withColumn("z", F.when(F.col("total") > 0, 1).otherwise(0))
    path = abundance_path(flagged, "site", "yr", "start", "g", "z", 0.1)
    return path.select("site", "yr", rounded(F.col("expected"), 9).alias("expected"))


@query("total_abundance_by_year", "SELECT species, CAST(yr AS INTEGER) AS yr, CAST(sum(cnt) AS BIGINT) AS total_abundance FROM v_site_year GROUP BY 1, 2")
def total_abundance_by_year(t: Tables) -> DataFrame:
    return totals_by_year(t.v_site_year, "yr", "cnt", ["species"])


_PATCHES = Grid(-1.0, -1.0, 0.1, 20, 20)


@query("dispersal_step", """
WITH c AS (SELECT CAST(floor((x - (-1.0)) / 0.1) AS BIGINT) AS ix, CAST(floor((y - (-1.0)) / 0.1) AS BIGINT) AS iy, CAST(sum(label) AS DOUBLE) * 1.1 AS v FROM v_points GROUP BY 1, 2),
p AS (SELECT a.iy * 20 + a.ix AS src, b.iy * 20 + b.ix AS dst, a.v, exp(-2 * 0.1 * sqrt((a.ix - b.ix) * (a.ix - b.ix) + (a.iy - b.iy) * (a.iy - b.iy))) AS eta FROM c a CROSS JOIN c b),
k AS (SELECT dst, v * eta / sum(eta) OVER (PARTITION BY src) AS w FROM p)
SELECT dst AS cell_id, round(sum(w), 8) + 0.0 AS arrivals, count(*) AS n_origins FROM k GROUP BY 1""")
def dispersal_step(t: Tables) -> DataFrame:
    """Movement between all occupied patches of a fixed grid; points are summed per patch first."""
    x, y = F.col("x"), F.col("y")
    placed = t.v_points.select(_PATCHES.ix(x).alias("ix"), _PATCHES.iy(y).alias("iy"), "label")
    patches = placed.groupBy("ix", "iy").agg((F.sum("label").cast("double") * 1.1).alias("v"))
    patches = cut_lineage(patches.withColumn("cell_id", _PATCHES.cell_of(F.col("ix"), F.col("iy"))))
    out = disperse(patches, "v", _PATCHES.size, 2.0, 28)
    return out.withColumn("arrivals", rounded(F.col("arrivals"), 8))


_SPECIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_SLOPES = [
    row
    for i, s in enumerate(_SPECIES)
    for row in [(s, "intercept", 0.02 * i), (s, "covariate", 0.05 - 0.01 * i)]
    + [(s, f"species:{o}", -0.3 if o == s else 0.02 * (k - i)) for k, o in enumerate(_SPECIES)]
]
_SLOPES_SQL = ", ".join(f"('{a}', '{b}', {c!r}::DOUBLE)" for a, b, c in _SLOPES)


# start abundance on the log scale and decay of movement (per km) of each species
_STARTS = [(s, 0.2 * i - 0.5, 0.05 + 0.01 * i) for i, s in enumerate(_SPECIES)]
_STARTS_SQL = ", ".join(f"('{a}', {b!r}::DOUBLE, {c!r}::DOUBLE)" for a, b, c in _STARTS)

_GROWTH_SQL = f"""{COVARIATES_SQL}, w(species, term, slope) AS (VALUES {_SLOPES_SQL}), b(species, base, rate) AS (VALUES {_STARTS_SQL}),
begin AS (SELECT site, min(yr) AS y0, arg_min(gra, yr) AS g0 FROM cov GROUP BY 1),
frame AS (SELECT c.site, c.yr, gra - g0 AS dx, g0 FROM cov c JOIN begin i ON i.site = c.site WHERE c.yr > y0),
n AS (SELECT site, yr, species, sum(coalesce(cnt, 0)) AS n FROM v_site_year GROUP BY 1, 2, 3),
terms AS (SELECT f.site, f.yr, 'species:' || b.species AS term, (coalesce(n.n, 0) - exp(base + 0.2 * g0)) / exp(base + 0.2 * g0) AS x
    FROM frame f CROSS JOIN b LEFT JOIN n ON n.site = f.site AND n.yr = f.yr - 1 AND n.species = b.species
  UNION ALL SELECT site, yr, 'intercept', 1.0::DOUBLE FROM frame UNION ALL SELECT site, yr, 'covariate', dx FROM frame),
growing AS (SELECT site, yr, w.species, exp(sum(slope * x)) AS growth FROM terms JOIN w ON w.term = terms.term GROUP BY 1, 2, 3)"""


def _counted_species(t: Tables) -> DataFrame:
    return t.v_site_year.groupBy("site", "yr", "species").agg(F.sum(F.coalesce("cnt", F.lit(0))).alias("n"))


def _growing(t: Tables, counts: DataFrame) -> DataFrame:
    frame = cut_lineage(covariates(t).select("site", "yr", "gra"))
    begin = frame.groupBy("site").agg(F.min("yr").alias("y0"), F.min_by("gra", "yr").alias("g0"))
    every = lookup(t.spark, _STARTS, "species string, base double, rate double")
    bases = F.inline(every.select(F.collect_list(F.struct("species", "base"))).scalar())
    starts = begin.select("site", "g0", bases).select("site", "species", F.exp(F.col("base") + 0.2 * F.col("g0")).alias("expected"))
    wanted = frame.join(begin, "site").where(F.col("yr") > F.col("y0")).withColumn("dx", F.col("gra") - F.col("g0"))
    slopes = lookup(t.spark, _SLOPES, "species string, term string, slope double")
    return density_growth(counts, wanted, starts, slopes, "site", "yr", "species", "n", "dx", "expected")


@query("density_dependent_growth", f"WITH {_GROWTH_SQL} SELECT site, yr, species, round(growth, 8) + 0.0 AS growth FROM growing")
def density_dependent_growth(t: Tables) -> DataFrame:
    """Growth of every species into each year from all species' densities a year before, absent ones too, and the habitat's change."""
    return _growing(t, _counted_species(t)).withColumn("growth", rounded(F.col("growth"), 8))


@query("dispersal_growth", f"""
WITH {_GROWTH_SQL},
pairs AS (SELECT a.site AS src, c.site AS dst, sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)) AS d FROM v_sites a JOIN v_sites c
  ON c.x BETWEEN a.x - 50000 AND a.x + 50000 AND c.y BETWEEN a.y - 50000 AND a.y + 50000
  WHERE (a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) <= 2500000000),
sums AS (SELECT src, species, sum(exp(-rate * d / 1000)) AS s FROM pairs CROSS JOIN b GROUP BY 1, 2),
sent AS (SELECT g.site, g.yr, g.species, n.n * growth / s AS v, rate FROM growing g JOIN n ON n.site = g.site AND n.yr = g.yr - 1 AND n.species = g.species
  JOIN sums ON sums.src = g.site AND sums.species = g.species JOIN b ON b.species = g.species WHERE n.n > 0)
SELECT dst AS site, yr, species, round(sum(v * exp(-rate * d / 1000)), 7) + 0.0 AS arrivals, count(*) AS n_origins
FROM sent JOIN pairs ON pairs.src = sent.site GROUP BY 1, 2, 3""")
def dispersal_growth(t: Tables) -> DataFrame:
    """One step of the metapopulation: last year's animals grow with their site's rate and move up to 50 km, per species."""
    counts = cut_lineage(_counted_species(t))
    # a site's counts are one row, by the year after, so that growth stays where it was summed
    after = F.struct(F.struct((F.col("yr") + 1).alias("yr"), "species"), "n")
    before = counts.groupBy("site").agg(F.map_from_entries(F.collect_list(after)).alias("before"))
    grown = _growing(t, counts).join(before, "site").withColumn("n", F.try_element_at("before", F.struct("yr", "species")))
    leaving = grown.select("site", "yr", "species", (F.col("n") * F.col("growth")).alias("leaving"))
    sites = t.v_sites.select("site", "x", "y")
    pairs = radius_pairs(sites, ["site"], "x", "y", 50_000.0, placed=True)
    near = pairs.withColumn("distance", F.col("distance") / 1000)

    def meet(origins: DataFrame) -> DataFrame:
        others = sites.join(origins.withColumnRenamed("src_site", "site"), "site")
        reached = radius_pairs(sites, ["site"], "x", "y", 50_000.0, others, placed=True)
        return reached.drop("dst_site").withColumnRenamed("src_site", "site").withColumn("distance", F.col("distance") / 1000)

    decay = lookup(t.spark, _STARTS, "species string, base double, rate double").select("species", "rate")
    out = arrivals(near, leaving, decay, "yr", "species", "leaving", meet)
    return out.withColumn("arrivals", rounded(F.col("arrivals"), 7))


_SUMMARY_SQL = """summary AS (SELECT 'N[' || site || ', ' || yr || ']' AS parameter, avg(cnt) AS mean FROM v_site_year GROUP BY site, yr
  UNION ALL SELECT 's[' || site || ']', avg(cnt) FROM v_site_year GROUP BY site),
n AS (SELECT parameter, CAST(regexp_extract(parameter, '\\[(\\d+), (\\d+)\\]', 1) AS BIGINT) AS site, CAST(regexp_extract(parameter, '\\[(\\d+), (\\d+)\\]', 2) AS BIGINT) AS year, mean
  FROM summary WHERE regexp_matches(parameter, '^N\\['))"""


def _named_summary(t: Tables) -> DataFrame:
    rows = t.v_site_year
    n = rows.groupBy("site", "yr").agg(F.avg("cnt").alias("mean")).select(indexed_name("N", F.col("site"), F.col("yr")).alias("parameter"), "mean")
    s = rows.groupBy("site").agg(F.avg("cnt").alias("mean")).select(indexed_name("s", F.col("site")).alias("parameter"), "mean")
    return n.unionByName(s)


@query("parse_parameter_names", f"WITH {_SUMMARY_SQL} SELECT parameter, site, year, round(mean, 9) + 0.0 AS mean FROM n")
def parse_parameter_names(t: Tables) -> DataFrame:
    return indexed_parameters(_named_summary(t), "parameter", "N").withColumn("mean", rounded(F.col("mean"), 9))


@query("posterior_to_grid", f"""
WITH {_SUMMARY_SQL}, c AS (SELECT site, {cell_sql(COARSE)} AS cell_id FROM v_sites)
SELECT n.site, year, cell_id, round(mean, 9) + 0.0 AS mean, round(ln(mean + 1), 9) + 0.0 AS log_mean FROM n LEFT JOIN c ON c.site = n.site WHERE year = 1998""")
def posterior_to_grid(t: Tables) -> DataFrame:
    """Site means of one year with their cell, on the log scale maps use."""
    indexed = indexed_parameters(_named_summary(t), "parameter", "N").where(F.col("year") == 1998)
    out = to_grid(indexed.drop("parameter"), to_cells(t.v_sites, COARSE).select("site", "cell_id"))
    return out.select("site", "year", "cell_id", rounded(F.col("mean"), 9).alias("mean"), rounded(F.col("log_mean"), 9).alias("log_mean"))


_KEPT_SQL = "kept AS (SELECT * FROM v_draws WHERE iter > 100 AND (iter - 100) % 2 = 0 AND parameter IN ('click', 'error', 'signup', 'view'))"


def _kept(t: Tables) -> DataFrame:
    return kept_draws(t.v_draws, "iter", 100, 2, "parameter", ["click", "error", "signup", "view"])


@query("posterior_summary", f"""
WITH {_KEPT_SQL}
SELECT parameter, count(*) AS n_draws, round(avg(value), 7) + 0.0 AS mean, round(stddev_samp(value), 7) + 0.0 AS sd, round(median(value), 6) + 0.0 AS median,
  round(quantile_cont(value, 0.025), 6) + 0.0 AS low, round(quantile_cont(value, 0.975), 6) + 0.0 AS high FROM kept GROUP BY 1""")
def posterior_summary(t: Tables) -> DataFrame:
    """Mean, sd, median and bounds per monitored parameter after burn-in and thinning."""
    out = summarise(_kept(t), ["parameter"], "value")
    digits = {"mean": 7, "sd": 7, "median": 6, "low": 6, "high": 6}
    return out.withColumns({c: rounded(F.col(c), d) for c, d in digits.items()})


@query("posterior_summary_chains", f"""
WITH {_KEPT_SQL}
SELECT parameter, chain, count(*) AS n_draws, round(avg(value), 7) + 0.0 AS mean, round(stddev_samp(value), 7) + 0.0 AS sd, round(median(value), 6) + 0.0 AS median,
  round(quantile_cont(value, 0.025), 6) + 0.0 AS low, round(quantile_cont(value, 0.975), 6) + 0.0 AS high FROM kept GROUP BY 1, 2""")
def posterior_summary_chains(t: Tables) -> DataFrame:
    """The summary of every chain by itself."""
    out = summarise(_kept(t), ["parameter", "chain"], "value")
    digits = {"mean": 7, "sd": 7, "median": 6, "low": 6, "high": 6}
    return out.withColumns({c: rounded(F.col(c), d) for c, d in digits.items()})


@query("total_abundance_draws", """
WITH s AS (SELECT site, CAST(yr AS BIGINT) AS yr, coalesce(sum(cnt), 0) AS n FROM v_site_year GROUP BY 1, 2),
d AS (SELECT yr, chain, iter, sum(n + (site * 31 + yr * 7 + iter * 17 + chain * 11) % 5) AS total
  FROM s, (SELECT unnest([0, 1]) AS chain), (SELECT unnest(generate_series(1, 10)) AS iter) GROUP BY 1, 2, 3)
SELECT yr AS year, count(*) AS n_draws, round(avg(total), 6) + 0.0 AS mean, round(stddev_samp(total), 6) + 0.0 AS sd, round(median(total), 6) + 0.0 AS median,
  round(quantile_cont(total, 0.025), 6) + 0.0 AS low, round(quantile_cont(total, 0.975), 6) + 0.0 AS high FROM d GROUP BY 1""")
def total_abundance_draws(t: Tables) -> DataFrame:
    """Totals over all sites within each draw of ``N[site, year]``, then their summary per year."""
    sites = t.v_site_year.groupBy("site", "yr").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"))
    draws = sites.withColumn("chain", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(10))))
    jitter = (F.col("site") * 31 + F.col("yr") * 7 + F.col("iter") * 17 + F.col("chain") * 11) % 5
    named = draws.select("chain", "iter", indexed_name("N", F.col("site"), F.col("yr")).alias("parameter"), (F.col("n") + jitter).alias("value"))
    totals = derived_totals(named, "parameter", "N", "value", ["chain", "iter"])
    out = summarise(totals, ["year"], "total")
    return out.withColumns({c: rounded(F.col(c)) for c in ("mean", "sd", "median", "low", "high")})


@query("trace_table", f"WITH {_KEPT_SQL} SELECT parameter, chain, iter, value FROM kept")
def trace_table(t: Tables) -> DataFrame:
    """Kept draws in the order a trace shows them."""
    return _kept(t).select("parameter", "chain", "iter", "value").orderBy("parameter", "chain", "iter")


@query("gelman_rhat", """
WITH c AS (SELECT parameter, chain, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM v_draws GROUP BY 1, 2),
s AS (SELECT parameter, count(*) AS k, avg(n) AS n, avg(v) AS w, var_samp(m) AS b, avg(m) AS mu, var_samp(v) / count(*) AS var_w,
  covar_samp(v, m * m) - 2 * avg(m) * covar_samp(v, m) AS c FROM c GROUP BY 1),
d AS (SELECT *, w * (n - 1) / n + (1 + 1.0 / k) * b AS pooled,
  (pow(n - 1, 2) * var_w + pow(1 + 1.0 / k, 2) * 2 * pow(b * n, 2) / (k - 1) + 2 * (n - 1) * (1 + 1.0 / k) * n / k * c) / (n * n) AS var_p FROM s)
SELECT parameter, k AS n_chains, round(w, 6) + 0.0 AS within, round(b * n, 6) + 0.0 AS between, round(sqrt((w * (n - 1) / n + b) / w), 8) + 0.0 AS rhat,
  round(sqrt((2 * pooled * pooled / var_p + 3) / (2 * pooled * pooled / var_p + 1) * pooled / w), 8) + 0.0 AS psrf,
  -- three chains: two degrees of freedom above, where the F quantile has a closed form
  round(sqrt((2 * pooled * pooled / var_p + 3) / (2 * pooled * pooled / var_p + 1) * ((n - 1) / n
    + w * w / var_w * (pow(0.025, -var_w / (w * w)) - 1) * (1 + 1.0 / k) * b / w)), 6) + 0.0 AS upper FROM d""")
def gelman_rhat(t: Tables) -> DataFrame:
    out = potential_scale(t.v_draws, "parameter", "chain", "value")
    return out.withColumns({"within": rounded(F.col("within")), "between": rounded(F.col("between")), "rhat": rounded(F.col("rhat"), 8), "psrf": rounded(F.col("psrf"), 8), "upper": rounded(F.col("upper"), 6)})
