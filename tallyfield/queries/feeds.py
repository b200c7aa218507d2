"""Sources, sinks, filters and joins on feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.bins import bin_columns, bin_index, bin_label
from tallyfield.functions.columns import as_double, clean_names, drop_positions, rounded
from tallyfield.operators.aggregates import sufficient_keys
from tallyfield.operators.checklists import (
    collapse_groups,
    counted,
    roll_up_taxa,
    thin_zero_sites,
    zero_fill,
)
from tallyfield.operators.joins import keep_common, keep_known, natural_join
from tallyfield.operators.pivots import bin_name, distance_period_block, usable_distances
from tallyfield.plans.checklist_points import MINUTES, PROTOCOLS, STUDY_BOX, species_points, usable_checklists, zero_filled_points
from tallyfield.queries.registry import Tables, query
from tallyfield.schemas import field_names
from tallyfield.session import cut_lineage, scratch_path
from tallyfield.sources.readers import load_bundle, lookup, read_csv, read_table, read_tsv, stack_csv, stack_folder
from tallyfield.sources.writers import write_by_key, write_csv, write_table, write_tsv
from tallyfield.streaming.pending import pending_keys, without, written_keys

_ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"
)
_ORDERS_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders"""


def _dated_orders(t: Tables) -> DataFrame:
    return t.orders.select(*field_names(_ORDERS)).withColumn("o_orderdate", F.to_date("o_orderdate"))


@query("src_csv_roundtrip", _ORDERS_SQL)
def src_csv_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "orders-csv")
    write_csv(_dated_orders(t), path)
    return read_csv(t.spark, path, _ORDERS).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("src_tsv_roundtrip", """
SELECT o.event_id, o.species, o.count_text, c.protocol, CAST(c.duration AS INTEGER) AS duration,
  CAST(o.obs_date AS VARCHAR) AS obs_date
FROM v_observations o JOIN v_checklists c ON o.event_id = c.event_id WHERE c.complete""")
def src_tsv_roundtrip(t: Tables) -> DataFrame:
    observations, checklists = scratch_path(t.spark, "observations"), scratch_path(t.spark, "checklists")
    complete = t.v_checklists.where("complete").select("event_id", "protocol", "duration")
    seen = t.v_observations.select("event_id", "species", "count_text", "obs_date")
    write_tsv(keep_known(seen, complete, ["event_id"], nulls_match=False), observations)
    write_tsv(complete, checklists)
    left = read_tsv(t.spark, observations, "event_id bigint, species string, count_text string, obs_date date")
    right = read_tsv(t.spark, checklists, "event_id bigint, protocol string, duration int")
    joined = natural_join(left, right, "inner", ["event_id"], nulls_match=False)
    return joined.withColumn("obs_date", F.col("obs_date").cast("string"))


@query("src_multi_file_union", """
SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice FROM orders""")
def src_multi_file_union(t: Tables) -> DataFrame:
    """Folders with different headers and column types, stacked by name."""
    full = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"
    short = "o_orderkey bigint, o_custkey double, o_orderstatus string"
    layouts = []
    for tag, cond, layout in (("done", "o_orderstatus <> 'P'", full), ("open", "o_orderstatus = 'P'", short)):
        path = scratch_path(t.spark, tag)
        write_csv(t.orders.where(cond).select(*field_names(layout)), path)
        layouts.append((path, layout))
    return stack_csv(t.spark, layouts, {"o_custkey": "double"})


@query("src_folder_layouts", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_custkey AS DOUBLE) END AS o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS o_orderpriority FROM orders""")
def src_folder_layouts(t: Tables) -> DataFrame:
    """One folder of text files under three headers, found by listing it."""
    path = scratch_path(t.spark, "states")
    headers = [["o_orderkey", "o_custkey", "o_totalprice"], ["o_custkey", "o_orderkey"], ["o_orderkey", "o_orderpriority"]]
    for k, names in enumerate(headers):
        t.orders.where(F.col("o_orderkey") % 3 == k).select(*names).write.mode("append").option("header", True).csv(path)
    return stack_folder(t.spark, path, {"o_orderkey": "bigint", "o_custkey": "double", "o_totalprice": "double"})


@query("sink_partitioned", """
SELECT o_orderkey, o_custkey, o_totalprice, lower(substr(o_orderpriority, 3, 4)) AS alpha FROM orders""")
def sink_partitioned(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "by-species")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", F.lower(F.substring("o_orderpriority", 3, 4)).alias("alpha"))
    write_by_key(rows, path, "alpha")
    return read_table(t.spark, path)


@query("pending_species", """
WITH all_species AS (SELECT DISTINCT species FROM v_observations),
point_done AS (SELECT species FROM v_observations GROUP BY species HAVING min(species) < 'r'),
cell_done AS (SELECT species FROM v_observations GROUP BY species HAVING min(species) > 'd')
SELECT species FROM all_species WHERE species NOT IN (SELECT species FROM point_done)
UNION SELECT species FROM all_species WHERE species NOT IN (SELECT species FROM cell_done)""")
def pending_species(t: Tables) -> DataFrame:
    """Species that miss one of two partitioned outputs of earlier runs."""
    outputs = []
    per_day = t.v_observations.groupBy("species", "obs_date").agg(F.count("*").alias("n"))
    for tag, cond in (("points", F.col("species") < "r"), ("cells", F.col("species") > "d")):
        path = scratch_path(t.spark, tag)
        write_by_key(per_day.where(cond), path, "species")
        outputs.append(written_keys(t.spark, path, "species"))
    return pending_keys(t.v_observations, "species", outputs)


@query("exclude_list", """
SELECT species, observer, count(*) AS n FROM v_observations WHERE species NOT IN ('error', 'view') GROUP BY 1, 2""")
def exclude_list(t: Tables) -> DataFrame:
    kept = without(t.v_observations, "species", ["error", "view"])
    return kept.groupBy("species", "observer").agg(F.count("*").alias("n"))


# fixed values: state names and numbers of the route survey
STATES = [
    ("Arizona", 6), ("California", 14), ("Colorado", 17), ("Idaho", 33), ("Iowa", 36), ("Kansas", 38),
    ("Minnesota", 50), ("Missouri", 52), ("Montana", 53), ("North Dakota", 64), ("Nebraska", 54), ("Nevada", 55),
    ("New Mexico", 60), ("Oklahoma", 67), ("Oregon", 69), ("South Dakota", 81), ("Texas", 83), ("Utah", 85),
    ("Washington", 89), ("Wyoming", 92),
]
_STATES_SQL = ", ".join(f"('{name}', {num}, {i})" for i, (name, num) in enumerate(STATES))


@query("lookup_broadcast", f"""
WITH states(state, state_num, nationkey) AS (VALUES {_STATES_SQL})
SELECT state, CAST(state_num AS DOUBLE) AS state_num, count(*) AS n_sites, round(avg(c_acctbal), 8) + 0.0 AS mean_bal
FROM customer LEFT JOIN states ON c_nationkey = nationkey GROUP BY 1, 2""")
def lookup_broadcast(t: Tables) -> DataFrame:
    """Sites joined to an inline table of states; sites elsewhere get a missing state."""
    rows = [(name, float(num), i) for i, (name, num) in enumerate(STATES)]
    states = lookup(t.spark, rows, "state string, state_num double, c_nationkey int")
    joined = t.customer.select("c_nationkey", "c_acctbal").join(states, "c_nationkey", "left")
    return joined.groupBy("state", "state_num").agg(
        F.count("*").alias("n_sites"), rounded(F.avg("c_acctbal"), 8).alias("mean_bal")
    )


@query("clean_names", """
SELECT p_partkey AS part_key, p_name AS part_name, p_brand AS part_brand, p_type AS part_type,
  p_size AS part_size, p_retailprice AS part_size_2 FROM part""")
def names_cleaned(t: Tables) -> DataFrame:
    messy = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return clean_names(messy.toDF("Part Key", "PartName", "part.brand", "PART_type", "partSize", "Part-Size"))


@query("rename_select", """
SELECT p_partkey AS taxon, p_name AS en_common_name, p_brand AS family, p_size AS spp_num FROM part""")
def rename_select(t: Tables) -> DataFrame:
    renamed = t.part.withColumnsRenamed(
        {"p_partkey": "taxon", "p_name": "en_common_name", "p_brand": "family", "p_size": "spp_num"}
    )
    return renamed.select("taxon", "en_common_name", "family", "spp_num")


@query("drop_columns", "SELECT p_partkey, p_name, p_type, p_size FROM part")
def drop_columns(t: Tables) -> DataFrame:
    """Drop by name, and the last column by its position in the table."""
    return drop_positions(t.part.drop("p_brand"), -1)


@query("clean_distance_survey", """
SELECT CAST(yr AS INTEGER) AS yr, transect, point, distance, time_period, cnt, lower(species) AS alpha
FROM v_distance
WHERE species IS NOT NULL AND distance IS NOT NULL AND distance <> -1 AND NOT distance > 250
  AND NOT time_period = -1 AND yr IN (1996, 1997, 1998, 1999, 2000)""")
def clean_distance_survey(t: Tables) -> DataFrame:
    d = t.v_distance
    ok = d.species.isNotNull() & usable_distances(d.distance, d.time_period) & d.yr.between(1996, 2000)
    return d.where(ok).withColumn("alpha", F.lower("species")).drop("species")


@query("distance_bins", """
WITH b AS (SELECT distance, CASE WHEN distance >= 0 AND distance < 50 THEN '0_50' WHEN distance >= 50 AND distance < 100 THEN '50_100'
  WHEN distance >= 100 AND distance < 150 THEN '100_150' WHEN distance >= 150 AND distance < 200 THEN '150_200'
  WHEN distance >= 200 AND distance <= 250 THEN '200_250' END AS bin FROM v_distance)
SELECT bin, distance, count(*) AS n FROM b GROUP BY 1, 2""")
def distance_bins(t: Tables) -> DataFrame:
    """Left-closed 50 m bins; 250 belongs to the last one, larger distances to none."""
    label = F.when(bin_index(F.col("distance"), 50, 5).isNotNull(), bin_label(F.col("distance"), 50, 5))
    return t.v_distance.groupBy(label.alias("bin"), "distance").agg(F.count("*").alias("n"))


_PIVOT_SQL = ", ".join(
    f"CAST(sum(CASE WHEN time_period = {p} AND least(floor(distance / 50), 4) = {b} THEN cnt ELSE 0 END) AS BIGINT) AS count_{b * 50}_{b * 50 + 50}_{p}"
    for p in range(1, 7) for b in range(5)
)


@query("distance_time_pivot", f"""
SELECT CAST(yr AS INTEGER) AS yr, transect, point, {_PIVOT_SQL}
FROM v_distance WHERE distance BETWEEN 0 AND 250 AND time_period <> -1 GROUP BY 1, 2, 3""")
def distance_time_pivot(t: Tables) -> DataFrame:
    d = t.v_distance
    rows = d.where(usable_distances(d.distance, d.time_period))
    return distance_period_block(rows, ["yr", "transect", "point"], "distance", "time_period", "cnt")


@query("bin_column_catalogue", """
WITH bins AS (SELECT lo, p FROM (SELECT unnest([0, 50, 100, 150, 200, 250]) AS lo) CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS p)),
have AS (SELECT least(floor(distance / 50), 4) * 50 AS lo, time_period AS p, count(*) AS n FROM v_distance
  WHERE distance BETWEEN 0 AND 250 AND time_period <> -1 GROUP BY 1, 2)
SELECT 'count_' || bins.lo || '_' || (bins.lo + 50) || '_' || bins.p AS col_name, coalesce(n, 0) AS n_rows,
  n IS NULL AS missing
FROM bins LEFT JOIN have ON bins.lo = have.lo AND bins.p = have.p""")
def bin_column_catalogue(t: Tables) -> DataFrame:
    """All block columns of a 6 x 7 design, with the rows that feed each and the absent ones marked."""
    names = t.spark.range(1).select(F.explode(F.array(*map(F.lit, bin_columns(50, 6, 7)))).alias("col_name"))
    d = t.v_distance
    label = bin_name(d.distance, d.time_period, 50, 5)
    have = d.where(usable_distances(d.distance, d.time_period)).groupBy(label.alias("col_name")).agg(F.count("*").alias("n"))
    return names.join(have, "col_name", "left").select(
        "col_name", F.coalesce("n", F.lit(0)).alias("n_rows"), F.col("n").isNull().alias("missing")
    )


_COUNT = "TRY_CAST(count_text AS INTEGER)"


@query("presence_only_counts", f"""
SELECT event_id, species, observer, {_COUNT} AS count, CAST(year(obs_date) AS INTEGER) AS year,
  CAST(month(obs_date) AS INTEGER) AS month, CAST(day(obs_date) AS INTEGER) AS day
FROM v_observations WHERE count_text <> 'X'""")
def presence_only_counts(t: Tables) -> DataFrame:
    rows = counted(t.v_observations, "count_text", "count")
    parts = {"year": F.year("obs_date"), "month": F.month("obs_date"), "day": F.dayofmonth("obs_date")}
    return rows.withColumns(parts).select("event_id", "species", "observer", "count", *parts)


_USABLE_SQL = f"""lon BETWEEN {STUDY_BOX[0]} AND {STUDY_BOX[2]} AND lat BETWEEN {STUDY_BOX[1]} AND {STUDY_BOX[3]}
  AND duration BETWEEN {MINUTES[0]} AND {MINUTES[1]} AND protocol = '{PROTOCOLS[0]}' AND complete"""


@query("checklist_filter", f"""
SELECT c.event_id, o.species, c.observer, c.protocol, CAST(c.duration AS INTEGER) AS duration, c.lon, c.lat
FROM v_checklists c JOIN v_observations o ON o.event_id = c.event_id
WHERE o.species IN ('click', 'view', 'purchase') AND {_USABLE_SQL}""")
def checklist_filter(t: Tables) -> DataFrame:
    """Species list, box, effort, protocol and completeness, all before the join."""
    wanted = lookup(t.spark, [("click",), ("view",), ("purchase",)], "species string")
    named = keep_known(t.v_observations.select("event_id", "species"), wanted, ["species"], nulls_match=False)
    usable = usable_checklists(t.v_checklists).select("event_id", "observer", "protocol", "duration", "lon", "lat")
    return natural_join(usable, named, "inner", ["event_id"], nulls_match=False)


@query("sufficient_species", f"""
WITH c AS (SELECT concat(species, '-', observer) AS taxon, {_COUNT} AS count FROM v_observations WHERE count_text <> 'X'),
g AS (SELECT taxon FROM c GROUP BY taxon HAVING sum(CASE WHEN count > 0 THEN 1 ELSE 0 END) >= 12)
SELECT taxon, count, count(*) AS n FROM c WHERE taxon IN (SELECT taxon FROM g) GROUP BY 1, 2""")
def sufficient_species(t: Tables) -> DataFrame:
    """Only taxa with enough positive rows go on, all of them in one plan."""
    rows = counted(t.v_observations, "count_text", "count").select(
        F.concat_ws("-", "species", F.col("observer").cast("string")).alias("taxon"), "count"
    )
    kept = keep_known(rows, sufficient_keys(rows, "taxon", "count", 12), ["taxon"], nulls_match=False)
    return kept.groupBy("taxon", "count").agg(F.count("*").alias("n"))


@query("collapse_groups", """
WITH j AS (SELECT coalesce(c.group_id, 'S' || c.event_id) AS checklist_id, o.species, c.event_id, c.observer
  FROM v_checklists c JOIN v_observations o ON o.event_id = c.event_id),
r AS (SELECT *, row_number() OVER (PARTITION BY checklist_id, species ORDER BY event_id) AS k FROM j)
SELECT checklist_id, species, event_id, observer FROM r WHERE k = 1""")
def groups_collapsed(t: Tables) -> DataFrame:
    lists = t.v_checklists.select("event_id", "group_id", "observer")
    rows = natural_join(lists, t.v_observations.select("event_id", "species"), "inner", ["event_id"], nulls_match=False)
    return collapse_groups(rows, "event_id", "group_id", ["species"], "checklist_id").select(
        "checklist_id", "species", "event_id", "observer"
    )


@query("mutual_semi_join", """
WITH o AS (SELECT observer, obs_date, event_id FROM v_observations WHERE count_text <> 'X' AND species <> 'view'),
c AS (SELECT observer, obs_date, event_id FROM v_checklists WHERE complete AND protocol = 'Stationary')
SELECT 'observation' AS feed, o.event_id, o.observer FROM o
  WHERE EXISTS (SELECT 1 FROM c WHERE c.observer = o.observer AND c.obs_date = o.obs_date)
UNION ALL SELECT 'checklist', c.event_id, c.observer FROM c
  WHERE EXISTS (SELECT 1 FROM o WHERE c.observer = o.observer AND c.obs_date = o.obs_date)""")
def mutual_semi_join(t: Tables) -> DataFrame:
    """Observations and checklists cut to the observer days they share."""
    observations = t.v_observations.where("count_text <> 'X' AND species <> 'view'").select("observer", "obs_date", "event_id")
    lists = t.v_checklists.where("complete AND protocol = 'Stationary'").select("observer", "obs_date", "event_id")
    a, b = keep_common(observations, lists, ["observer", "obs_date"])
    tagged = [df.select(F.lit(tag).alias("feed"), "event_id", "observer") for tag, df in (("observation", a), ("checklist", b))]
    return tagged[0].unionByName(tagged[1])


@query("zero_fill", f"""
WITH lists AS (SELECT DISTINCT observer, obs_date, observer || '@' || obs_date AS checklist FROM v_checklists WHERE complete),
species AS (SELECT DISTINCT species FROM v_observations),
seen AS (SELECT observer || '@' || obs_date AS checklist, species, sum(CASE WHEN count_text <> 'X' THEN {_COUNT} END) AS c, true AS observed
  FROM v_observations GROUP BY 1, 2)
SELECT lists.checklist, species.species, CAST(CASE WHEN observed THEN c ELSE 0 END AS DOUBLE) AS count, coalesce(observed, false) AS observed
FROM lists CROSS JOIN species LEFT JOIN seen ON seen.checklist = lists.checklist AND seen.species = species.species""")
def zero_filled(t: Tables) -> DataFrame:
    """Every observer day with a complete checklist, with every species; seen but uncounted ones keep a missing count."""
    key = F.concat_ws("@", F.col("observer").cast("string"), F.col("obs_date").cast("string")).alias("checklist")
    lists = t.v_checklists.where("complete").select(key).distinct()
    rows = t.v_observations.select(key, "species", F.col("count_text").try_cast("bigint").alias("count"))  # X has none
    return as_double(zero_fill(lists, rows, t.v_observations.select("species"), "checklist", "species", "count"), ["count"])


_TAXA = [("click", "press"), ("view", "look"), ("purchase", "press"), ("signup", "look"), ("error", "error")]
_TAXA_SQL = ", ".join(f"('{a}', '{b}')" for a, b in _TAXA)


@query("taxon_rollup", f"""
WITH m(species, parent) AS (VALUES {_TAXA_SQL}),
j AS (SELECT v.observer || '@' || v.obs_date AS checklist, m.parent, v.count_text FROM v_observations v JOIN m ON m.species = v.species)
SELECT checklist, parent, CASE WHEN max(CASE WHEN count_text = 'X' THEN 1 ELSE 0 END) = 1 THEN 'X'
  ELSE CAST(sum(TRY_CAST(count_text AS BIGINT)) AS VARCHAR) END AS count_text FROM j GROUP BY 1, 2""")
def taxon_rollup(t: Tables) -> DataFrame:
    key = F.concat_ws("@", F.col("observer").cast("string"), F.col("obs_date").cast("string")).alias("checklist")
    taxonomy = lookup(t.spark, _TAXA, "species string, parent string")
    return roll_up_taxa(t.v_observations.select(key, "species", "count_text"), taxonomy, "checklist", "species", "parent", "count_text")


@query("zero_site_thinning", """
WITH pos AS (SELECT * FROM v_site_year WHERE cnt > 0), zero AS (SELECT * FROM v_site_year WHERE cnt = 0),
years AS (SELECT site FROM zero WHERE site NOT IN (SELECT site FROM pos) GROUP BY site HAVING count(DISTINCT yr) >= 5),
keep AS (SELECT site FROM pos UNION SELECT site FROM years),
r AS (SELECT *, row_number() OVER (PARTITION BY site, yr ORDER BY md5('thin' || obs_id), obs_id) AS k
  FROM zero WHERE site IN (SELECT site FROM keep))
SELECT site, CAST(yr AS INTEGER) AS yr, species, cnt, obs_id FROM pos
UNION ALL SELECT site, CAST(yr AS INTEGER), species, cnt, obs_id FROM r WHERE k = 1""")
def zero_site_thinning(t: Tables) -> DataFrame:
    return thin_zero_sites(t.v_site_year, "site", "yr", "cnt", "obs_id", min_years=5, seed="thin")


_HALF_L = "SELECT p_partkey AS taxon, nullif(p_brand, 'Brand#5') AS family, nullif(p_type, 'PROMO') AS genus FROM part"
_HALF_R = """SELECT nullif(p_brand, 'Brand#5') AS family, nullif(p_type, 'PROMO') AS genus, count(*) AS n,
  round(avg(p_retailprice), 8) + 0.0 AS mean_price FROM part WHERE p_size > 40 GROUP BY 1, 2"""


def _taxon_halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    family = F.nullif(F.col("p_brand"), F.lit("Brand#5")).alias("family")
    genus = F.nullif(F.col("p_type"), F.lit("PROMO")).alias("genus")
    left = t.part.select(F.col("p_partkey").alias("taxon"), family, genus)
    right = t.part.where("p_size > 40").groupBy(family, genus).agg(
        F.count("*").alias("n"), rounded(F.avg("p_retailprice"), 8).alias("mean_price")
    )
    return left, right


@query("natural_left_join", f"""
SELECT l.taxon, l.family, l.genus, CAST(r.n AS DOUBLE) AS n, r.mean_price FROM ({_HALF_L}) l LEFT JOIN ({_HALF_R}) r
ON l.family IS NOT DISTINCT FROM r.family AND l.genus IS NOT DISTINCT FROM r.genus""")
def natural_left_join(t: Tables) -> DataFrame:
    """Left join on the shared columns, missing keys matching each other."""
    left, right = _taxon_halves(t)
    return as_double(natural_join(left, right), ["n"])


@query("natural_full_join", """
WITH l AS (SELECT nullif(p_brand, 'Brand#5') AS family, p_size AS size, count(*) AS n_left FROM part WHERE p_size <= 40 GROUP BY 1, 2),
r AS (SELECT nullif(p_brand, 'Brand#5') AS family, p_size AS size, max(p_retailprice) AS top_price FROM part WHERE p_size >= 10 GROUP BY 1, 2)
SELECT coalesce(l.family, r.family) AS family, coalesce(l.size, r.size) AS size, CAST(n_left AS DOUBLE) AS n_left, top_price
FROM l FULL JOIN r ON l.family IS NOT DISTINCT FROM r.family AND l.size IS NOT DISTINCT FROM r.size""")
def natural_full_join(t: Tables) -> DataFrame:
    family, size = F.nullif(F.col("p_brand"), F.lit("Brand#5")).alias("family"), F.col("p_size").alias("size")
    left = t.part.where("p_size <= 40").groupBy(family, size).agg(F.count("*").alias("n_left"))
    right = t.part.where("p_size >= 10").groupBy(family, size).agg(F.max("p_retailprice").alias("top_price"))
    return as_double(natural_join(left, right, "full"), ["n_left"])



def albers_sql(lon: str, lat: str) -> tuple[str, str]:
    """The projection as SQL text, with its constants written in."""
    from tallyfield.functions.geo import Albers

    a = Albers()
    n, c, rho0 = a.constants()
    rho = f"sqrt({c!r} - 2 * {n!r} * sin(radians({lat}))) * {a.radius / n!r}"
    theta = f"(radians({lon} - ({a.lon0})) * {n!r})"
    return f"({rho} * sin{theta})", f"({rho0!r} - {rho} * cos{theta})"


_X, _Y = albers_sql("lon", "lat")


@query("species_points", f"""
WITH j AS (SELECT o.event_id, o.species, {_COUNT} AS count, c.* EXCLUDE (event_id) FROM v_observations o
  JOIN v_checklists c ON c.event_id = o.event_id WHERE o.count_text <> 'X' AND {_USABLE_SQL}),
g AS (SELECT species FROM j GROUP BY species HAVING sum(CASE WHEN count > 0 THEN 1 ELSE 0 END) >= 30)
SELECT event_id, species, observer, count, CAST(duration AS INTEGER) AS duration, CAST(year(obs_date) AS INTEGER) AS year,
  CAST(month(obs_date) AS INTEGER) AS month, CAST(day(obs_date) AS INTEGER) AS day,
  round({_X}, 3) + 0.0 AS x, round({_Y}, 3) + 0.0 AS y
FROM j WHERE species IN (SELECT species FROM g)""")
def points_by_species(t: Tables) -> DataFrame:
    """Checklists to located, gated species rows in one plan."""
    rows = species_points(t.v_checklists, t.v_observations)
    return rows.select(
        "event_id", "species", "observer", "count", "duration", "year", "month", "day",
        rounded(F.col("x"), 3).alias("x"), rounded(F.col("y"), 3).alias("y"),
    )


@query("zero_filled_points", f"""
WITH u AS (SELECT * FROM v_checklists WHERE {_USABLE_SQL}),
o AS (SELECT * FROM v_observations WHERE event_id IN (SELECT event_id FROM u)),
l AS (SELECT *, coalesce(group_id, 'S' || event_id) AS checklist_id FROM u WHERE event_id IN (SELECT event_id FROM o)),
shared AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY checklist_id ORDER BY event_id) = 1),
once AS (SELECT l.checklist_id, o.species, {_COUNT} AS c FROM o JOIN l ON l.event_id = o.event_id
  QUALIFY row_number() OVER (PARTITION BY l.checklist_id, o.species ORDER BY o.event_id) = 1),
z AS (SELECT s.*, sp.species, once.checklist_id IS NOT NULL AS observed, CASE WHEN once.checklist_id IS NULL THEN 0 ELSE once.c END AS count
  FROM shared s CROSS JOIN (SELECT DISTINCT species FROM o) sp LEFT JOIN once ON once.checklist_id = s.checklist_id AND once.species = sp.species),
g AS (SELECT species FROM z GROUP BY species HAVING sum(CASE WHEN count > 0 THEN 1 ELSE 0 END) >= 30)
SELECT checklist_id, event_id, species, observer, protocol, observed, CAST(count AS INTEGER) AS count, CAST(duration AS INTEGER) AS duration,
  CAST(year(obs_date) AS INTEGER) AS year, CAST(month(obs_date) AS INTEGER) AS month, CAST(day(obs_date) AS INTEGER) AS day,
  round({_X}, 3) + 0.0 AS x, round({_Y}, 3) + 0.0 AS y
FROM z WHERE count IS NOT NULL AND species IN (SELECT species FROM g)""")
def whole_checklist_feed(t: Tables) -> DataFrame:
    """Events to zero-filled, gated, located rows per group checklist and species."""
    rows = zero_filled_points(t.v_checklists, t.v_observations)
    return rows.select(
        "checklist_id", "event_id", "species", "observer", "protocol", "observed", F.col("count").cast("int").alias("count"),
        "duration", "year", "month", "day", rounded(F.col("x"), 3).alias("x"), rounded(F.col("y"), 3).alias("y"),
    )


@query("src_bundle_roundtrip", """
SELECT s.route, CAST(s.yr AS INTEGER) AS yr, s.obs_n, s_nationkey AS state, s.n_stops, s.total
FROM (SELECT route, yr, obs_n, count(*) AS n_stops, CAST(sum(cnt) AS BIGINT) AS total FROM v_stops GROUP BY 1, 2, 3) s JOIN supplier ON s_suppkey = s.route""")
def src_bundle_roundtrip(t: Tables) -> DataFrame:
    """A survey saved as a bundle of tables and opened again by name: stops, runs and routes put together."""
    folder = scratch_path(t.spark, "bundle")
    stops = cut_lineage(t.v_stops)
    runs = stops.groupBy("route", "yr", "obs_n").agg(F.count("*").alias("n_stops"))
    saved = {"stops": stops, "runs": runs, "routes": t.supplier.select(F.col("s_suppkey").alias("route"), F.col("s_nationkey").alias("state"))}
    for name, table in saved.items():
        write_table(table, f"{folder}/{name}.parquet")
    bundle = load_bundle(t.spark, folder, list(saved))
    totals = bundle["stops"].groupBy("route", "yr", "obs_n").agg(F.sum("cnt").alias("total"))
    return bundle["runs"].join(totals, ["route", "yr", "obs_n"]).join(bundle["routes"], "route").select(
        "route", "yr", "obs_n", "state", "n_stops", "total"
    )
