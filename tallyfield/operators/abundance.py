"""Expected abundance over sites and years, dispersal and growth."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.joins import with_every
from tallyfield.operators.spatial import PLACE, lattice_pairs


def log_linear(b: Sequence[float], first: Column, second: Column) -> Column:
    """``exp(b1 + b2 x + b3 t + b4 t^2)``."""
    return F.exp(b[0] + b[1] * first + b[2] * second + b[3] * second * second)


def space_time_mean(
    sites: DataFrame, site: str, years: DataFrame, b0: float, b_site: float, b_year: float,
    site_value: str, year_value: str, site_effect: str, year_effect: str, joint_effect: Column,
) -> DataFrame:
    """Log-link mean for every site and year from site, year and joint effects."""
    both = with_every(sites, years, [site])
    eta = (
        b0 + b_site * F.col(site_value) + b_year * F.col(year_value)
        + F.col(site_effect) + F.col(year_effect) + joint_effect
    )
    return both.withColumn("mean_abundance", F.exp(eta))


def abundance_path(
    df: DataFrame, site: str, step: str, start: str, growth: str, occupied: str, leak: float
) -> DataFrame:
    """Expected abundance per step: ``N1 = start z + leak (1 - z)``, then
    ``N[t] = N[t-1] growth[t] z + leak (1 - z)``.

    ``df`` has one row per site and step, without gaps, so a site's list is as
    long as the survey has years; the recursion runs inside the row, without a
    year loop. A site with a missing step is an error.
    """
    rows = F.sort_array(F.collect_list(F.struct(F.col(step).alias("t"), F.col(growth).alias("g"))))
    packed = df.groupBy(site).agg(
        rows.alias("_rows"), F.min_by(start, step).alias("_start"), F.max(F.col(occupied).cast("double")).alias("_z")
    )
    span = F.element_at("_rows", -1).getField("t") - F.element_at("_rows", 1).getField("t") + 1
    gap = F.raise_error(F.concat(F.lit("a step is missing at site "), F.col(site).cast("string"))).cast("double")
    z = F.when(span == F.size("_rows"), F.col("_z")).otherwise(gap)
    rest = (1 - z) * leak
    path = F.aggregate(
        F.slice("_rows", F.lit(2), F.size("_rows")),
        F.array(F.col("_start") * z + rest),
        lambda acc, row: F.concat(acc, F.array(F.element_at(acc, -1) * row.getField("g") * z + rest)),
    )
    steps = packed.select(site, F.explode(F.arrays_zip(F.col("_rows.t").alias("t"), path.alias("n"))).alias("_p"))
    return steps.select(site, F.col("_p.t").alias(step), F.col("_p.n").alias("expected"))


def totals_by_year(df: DataFrame, year: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, year).agg(F.sum(value).alias("total_abundance"))


def dispersal_kernel(cells: DataFrame, size: float, kappa: float, radius: int) -> DataFrame:
    """Movement shares ``exp(-kappa d)`` between occupied cells, summing to 1 per origin.

    ``radius`` (in cells) bounds movement; one that spans the grid links every
    pair. The normalising sum is joined back on the origin, which occurs at
    most once per offset.
    """
    pairs = lattice_pairs(cells, radius).withColumn("eta", F.exp(-kappa * size * F.col("steps")))
    sums = pairs.groupBy("src").agg(F.sum("eta").alias("_sum"))
    return pairs.join(sums, "src").select("src", "dst", (F.col("eta") / F.col("_sum")).alias("theta"))


def disperse(cells: DataFrame, value: str, size: float, kappa: float, radius: int) -> DataFrame:
    """Expected arrivals per cell: ``sum_i value_i theta_ij``."""
    moves = dispersal_kernel(cells, size, kappa, radius)
    leaving = cells.select(F.col("cell_id").alias("src"), F.col(value).alias("_v"))
    arrived = moves.join(leaving, "src").groupBy(F.col("dst").alias("cell_id"))
    return arrived.agg(F.sum(F.col("_v") * F.col("theta")).alias("arrivals"), F.count("*").alias("n_origins"))


def density_growth(
    counts: DataFrame, frame: DataFrame, starts: DataFrame, slopes: DataFrame, site: str, step: str, species: str,
    value: str, change: str, expected: str,
) -> DataFrame:
    """Growth into each step, ``exp(b0 + sum_k b_k (N_k[t-1] - L_k) / L_k + b_x dx[t])``, per site, step and species.

    ``counts`` has at most one row per site, step and species; a species
    without a row was not there, so its pressure is -1. ``frame`` names the
    sites and steps wanted with their covariate change, ``starts`` every
    species' expected abundance ``L`` at the start (positive) per site.
    ``slopes`` has rows (species, term, slope); a term is ``intercept``,
    ``covariate`` or ``species:`` and a name. Counts of species without a start
    belong to no term.

    Steps, starts and counts of a site are packed into one row each and meet by
    site, so that starts are sent once and not for every step; terms, products
    and sums follow where they are.
    """
    name = F.concat(F.lit("species:"), F.col(species)).alias("term")
    packed = lambda df, out, *cols: df.groupBy(site).agg(F.collect_list(F.struct(*cols)).alias(out))
    wanted = packed(frame, "_steps", F.col(step).alias("_t"), F.col(change).cast("double").alias("_c"))
    begun = packed(starts, "_starts", name, F.col(expected).cast("double").alias("_l"))
    # a count speaks of the step after its own
    held = packed(counts, "_counts", (F.col(step) + 1).cast(frame.schema[step].dataType).alias("_t"), name, F.col(value).cast("double").alias("_n"))
    nothing = F.lit(None).cast("double")
    row = lambda t, term, x=nothing, l=nothing, n=nothing: F.struct(  # noqa: E731, E741
        t.alias("_t"), term.alias("term"), x.alias("_x"), l.alias("_l"), n.alias("_n"))
    rows = F.concat(
        F.transform("_steps", lambda s: row(s["_t"], F.lit("intercept"), F.lit(1.0))),
        F.transform("_steps", lambda s: row(s["_t"], F.lit("covariate"), s["_c"])),
        F.flatten(F.transform("_steps", lambda s: F.transform(
            F.coalesce("_starts", F.array()), lambda b: row(s["_t"], b["term"], l=b["_l"])))),
        F.transform(F.coalesce("_counts", F.array()), lambda c: row(c["_t"], c["term"], n=c["_n"])),
    )
    parts = wanted.join(begun, site, "left").join(held, site, "left").select(site, F.inline(rows))
    terms = parts.groupBy(site, F.col("_t").alias(step), "term").agg(
        F.max("_x").alias("_x"), F.max("_l").alias("_l"), F.coalesce(F.sum("_n"), F.lit(0.0)).alias("_n")
    )
    pressure = F.coalesce(F.col("_x"), (F.col("_n") - F.col("_l")) / F.col("_l"))
    held = terms.select(site, step, "term", pressure.alias("_x")).where(F.col("_x").isNotNull())
    summed = held.join(slopes, "term").groupBy(site, step, species)
    return summed.agg(F.exp(F.sum(F.col("slope") * F.col("_x"))).alias("growth"))


LANES = 8  # species whose kernel sums one row of a pair adds to


def arrivals(
    pairs: DataFrame, leaving: DataFrame, decay: DataFrame, step: str, species: str, value: str,
    meet: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Expected arrivals per site, step and species: ``sum_i value_i exp(-k d_ij) / sum_j exp(-k d_ij)``.

    ``pairs`` are ordered site pairs with their distance, each site with itself
    included (see ``radius_pairs``); ``decay`` has a rate per species.
    Leaving animals are divided by their origin's kernel sum first and packed
    into one row per origin, so the pairs meet them once and one grouped sum,
    with partial sums, is left. Origins that nothing leaves are dropped; they
    add nothing.

    ``meet`` gives for a table of origins (``src_site``, ``sent``) the pairs that
    start there, as ``site``, ``distance`` and ``sent``. By default the pairs are
    sent to their origins; ``radius_pairs`` with these origins as ``others`` sends
    the origins instead, and no pair. Pairs that know their ``PLACE`` are
    summed where they are.
    """
    named = F.array_sort(F.collect_list(F.struct(F.col(species).alias("name"), F.col("rate").alias("rate"))))
    rates = decay.select(named).scalar()
    names = decay.select(F.transform(named, lambda r: r["name"])).scalar()
    place = [c for c in PLACE if c in pairs.columns]
    # rates side by side, so a pair is one row for LANES species
    lanes = F.transform(F.sequence(F.lit(0), F.greatest(F.size(named) - 1, F.lit(0)), F.lit(LANES)), lambda k: F.struct(
        k.alias("_k"), *[F.get(named, k + i)["rate"].alias(f"_r{i}") for i in range(LANES)]))
    per = pairs.select(*place, "src_site", "distance", F.inline(decay.select(lanes).scalar())).groupBy(*place, "src_site", "_k")
    per = per.agg(*[F.sum(F.exp(-F.col(f"_r{i}") * F.col("distance"))).alias(f"_s{i}") for i in range(LANES)])
    side = F.struct("_k", F.array(*[f"_s{i}" for i in range(LANES)]).alias("_s"))
    sums = per.groupBy(*place, "src_site").agg(F.flatten(F.sort_array(F.collect_list(side))["_s"]).alias("_sums"))
    coded = leaving.where(F.col(value) > 0).withColumn("_k", F.array_position(names, F.col(species)).cast("int") - 1)
    packed = coded.where("_k >= 0").groupBy(F.col("site").alias("src_site")).agg(F.collect_list(F.struct(
        F.col(step).alias("_t"), "_k", F.get(rates, F.col("_k"))["rate"].alias("_rate"), F.col(value).alias("_v"))).alias("_leaving"))
    share = lambda r: r.withField("_v", r["_v"] / F.get("_sums", r["_k"]))
    sent = packed.join(sums.drop(*place), "src_site").select("src_site", F.transform("_leaving", share).alias("sent"))
    met = pairs.join(sent, "src_site").select(F.col("dst_site").alias("site"), "distance", "sent") if meet is None else meet(sent)
    place = [c for c in PLACE if c in met.columns]
    moved = met.select(*place, "site", "distance", F.inline("sent")).groupBy(*place, "site", "_t", "_k")
    out = moved.agg(F.sum(F.col("_v") * F.exp(-F.col("_rate") * F.col("distance"))).alias("arrivals"), F.count("*").alias("n_origins"))
    return out.select("site", F.col("_t").alias(step), F.get(names, F.col("_k")).alias(species), "arrivals", "n_origins")
