"""Closed forms of detection, abundance, densities and posterior tables."""

from __future__ import annotations

import datetime
import glob
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyfield.functions import density
from tallyfield.operators.abundance import abundance_path, arrivals, density_growth, dispersal_kernel, disperse
from tallyfield.operators.aggregates import kernel_density
from tallyfield.operators.detection import detection_table, distance_total, gather, multinomial_blocks, removal_total
from tallyfield.operators.likelihood import (
    binomial_term,
    block_statistics,
    effect_statistics,
    effect_term,
    multinomial_term,
    one_row,
    staged_total,
    visit_statistics,
)
from tallyfield.operators.posterior import derived_totals, kept_draws, potential_scale, summarise
from tallyfield.operators.spatial import radius_pairs
from tallyfield.queries import ORACLES, QUERIES
from tallyfield.session import shared_folder


def _one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_log_factorial(spark):
    values = [0, 1, 2, 14, 15, 16, 17, 50, 1000, 10**6, 10**12]
    df = spark.createDataFrame([(v,) for v in values], "k long")
    for r in df.select("k", density.log_factorial(F.col("k")).alias("f")).collect():
        assert r.f == pytest.approx(math.lgamma(r.k + 1), rel=1e-13, abs=1e-13)
    assert _one(spark, density.log_factorial(F.lit(None).cast("int")))[0] is None


def test_densities(spark):
    x = F.lit(1.7)
    got = _one(
        spark, density.poisson(F.lit(3), F.lit(2.5)), density.binomial(F.lit(2), F.lit(5), F.lit(0.3)), density.normal(x, 1.0, 2.0),
        density.half_normal(x, 2.0), density.gamma(x, 2.0, 3.0), density.inverse_gamma(x, 2.0, 1.0), density.uniform(x, 0.0, 4.0),
        density.half_normal(F.lit(-1.0), 2.0), density.inv_logit(density.logit(F.lit(0.3))),
    )
    norm = -0.5 * math.log(2 * math.pi) - math.log(2)
    want = [
        math.log(2.5**3 * math.exp(-2.5) / 6), math.log(10 * 0.3**2 * 0.7**3), norm - 0.5 * 0.35**2, math.log(2) + norm - 0.5 * 0.85**2,
        math.log(9 * 1.7 * math.exp(-5.1)), math.log(1.7**-3 * math.exp(-1 / 1.7)), -math.log(4), -math.inf, 0.3,
    ]
    assert [pytest.approx(v) for v in want] == list(got)


def test_densities_at_the_edges(spark):
    zero = F.lit(0.0)
    got = _one(
        spark, density.poisson(F.lit(0), zero), density.poisson(F.lit(2), zero), density.binomial(F.lit(0), F.lit(3), zero),
        density.binomial(F.lit(3), F.lit(3), F.lit(1.0)), density.binomial(F.lit(4), F.lit(3), F.lit(0.5)), density.gamma(zero, 0.01, 0.01),
        density.gamma(zero, 1.0, 2.0), density.gamma(zero, 3.0, 2.0), density.inverse_gamma(zero, 2.0, 1.0), density.uniform(F.lit(5.0), 0.0, 4.0),
        density.normal(F.lit(None).cast("double"), 0.0, 1.0), density.gamma(F.lit(None).cast("double"), 1.0, 1.0),
    )
    never = -math.inf
    assert list(got) == [0.0, never, 0.0, 0.0, never, math.inf, math.log(2.0), never, never, never, None, None]


def test_detection_shares(spark):
    draws = spark.createDataFrame([(1, 60.0, 0.4), (2, 20.0, 0.1)], "draw int, sigma double, theta double")
    table = detection_table(draws, F.col("sigma"), F.col("theta"), 200.0, 20, 6)
    sums = table.groupBy("draw").agg(F.sum("pi").alias("p"), F.count("*").alias("n"), F.count_distinct("cell").alias("c"))
    assert all(r.p == pytest.approx(1.0) and r.n == r.c == 120 for r in sums.collect())
    total, caught = _one(spark, distance_total(F.lit(60.0), 200.0), removal_total(F.lit(0.4), 6))
    edges = [i * 10.0 for i in range(21)]
    psi = [2 * 3600 * (math.exp(-a * a / 7200) - math.exp(-b * b / 7200)) / 40000 for a, b in zip(edges, edges[1:])]
    assert total == pytest.approx(sum(psi)) and caught == pytest.approx(sum(0.6**r * 0.4 for r in range(6)))


def test_multinomial_ignores_empty_bins(spark):
    cells = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.3)], "v int, y int, p double")
    both = cells.union(spark.createDataFrame([(1, 0, 0.2)], "v int, y int, p double"))
    a, b = (multinomial_blocks(d, ["v"], "y", "p").first().log_density for d in (cells, both))
    assert a == pytest.approx(math.log(3 * 0.25 * 0.3)) and a == pytest.approx(b)


def test_abundance_path(spark):
    rng = random.Random(1)
    data = [(s, t, 5.0, rng.uniform(0.5, 1.5), z) for s, z in ((1, 1.0), (2, 0.0), (3, 0.4)) for t in range(2000, 2008)]
    df = spark.createDataFrame(data + [(4, 2000, 7.0, 1.0, 1.0)], "s int, t int, n0 double, g double, z double")
    got = {(r.s, r.t): r.expected for r in abundance_path(df, "s", "t", "n0", "g", "z", 0.1).collect()}
    for s, t, n0, g, z in data:
        prev = got.get((s, t - 1))
        want = (n0 if prev is None else prev * g) * z + 0.1 * (1 - z)
        assert got[s, t] == pytest.approx(want)
    assert got[4, 2000] == 7.0 and len(got) == 25
    flat = abundance_path(df.withColumn("g", F.lit(1.0)).where("s = 1"), "s", "t", "n0", "g", "z", 0.1)
    assert {r.expected for r in flat.collect()} == {5.0}
    with pytest.raises(Exception, match="a step is missing at site 1"):
        abundance_path(df.where("s = 1 AND t <> 2003"), "s", "t", "n0", "g", "z", 0.1).collect()


def test_dispersal(spark):
    cells = spark.createDataFrame([(0, 0, 0, 4.0), (1, 3, 0, 1.0), (2, 0, 4, 0.0)], "cell_id int, ix int, iy int, v double")
    kernel = dispersal_kernel(cells, 2.0, 0.1, 10)
    assert all(r.t == pytest.approx(1.0) for r in kernel.groupBy("src").agg(F.sum("theta").alias("t")).collect())
    out = disperse(cells, "v", 2.0, 0.1, 10)
    assert out.agg(F.sum("arrivals")).first()[0] == pytest.approx(5.0)
    e = {(0, 0): 1.0, (0, 1): math.exp(-0.6), (0, 2): math.exp(-0.8), (1, 2): math.exp(-1.0)}
    want = 4.0 * e[0, 1] / (1 + e[0, 1] + e[0, 2]) + 1.0 / (1 + e[0, 1] + e[1, 2])
    assert out.where("cell_id = 1").first().arrivals == pytest.approx(want)


def test_density_growth_of_absent_species_and_the_year_before(spark):
    counts = spark.createDataFrame([(1, 1, "a", 10), (1, 2, "a", 99), (1, 2, "b", 7), (1, 1, "stranger", 5)], "s int, t int, sp string, n int")
    frame = spark.createDataFrame([(1, 2, 2.0)], "s int, t int, dx double")
    starts = spark.createDataFrame([(1, "a", 5.0), (1, "b", 6.0)], "s int, sp string, l double")
    slopes = spark.createDataFrame(
        [("a", "intercept", 0.1), ("a", "species:a", -0.5), ("a", "species:b", 0.2), ("a", "covariate", 0.3)], "sp string, term string, slope double")
    got = density_growth(counts, frame, starts, slopes, "s", "t", "sp", "n", "dx", "l").collect()
    assert [(r.t, r.sp) for r in got] == [(2, "a")]
    # b was absent a year before: its pressure is -1
    assert got[0].growth == pytest.approx(math.exp(0.1 - 0.5 * 1.0 + 0.2 * -1.0 + 0.3 * 2))


def test_arrivals_keep_what_leaves(spark):
    spots = {1: (0.0, 0.0), 2: (3.0, 4.0), 3: (6.0, 0.0), 4: (90.0, 0.0)}
    points = spark.createDataFrame([(k, *v) for k, v in spots.items()], "site int, x double, y double")
    pairs = radius_pairs(points, ["site"], "x", "y", 5.5)
    leaving = spark.createDataFrame([(1, 7, "a", 4.0), (2, 7, "a", 1.0), (4, 7, "a", 2.0), (3, 7, "a", 0.0)], "site int, t int, sp string, v double")
    decay = spark.createDataFrame([("a", 0.3)], "sp string, rate double")
    got = {r.site: r.arrivals for r in arrivals(pairs, leaving, decay, "t", "sp", "v").collect()}
    e = math.exp(-0.3 * 5)
    assert got[4] == pytest.approx(2.0) and sum(got.values()) == pytest.approx(7.0)
    assert got[1] == pytest.approx(4 / (1 + e) + e / (1 + 2 * e)) and got[3] == pytest.approx(e / (1 + 2 * e))


def test_arrivals_met_by_points_are_those_of_pairs(spark):
    rng = random.Random(5)
    points = spark.createDataFrame([(k, rng.uniform(0, 40), rng.uniform(0, 40)) for k in range(150)], "site int, x double, y double")
    names = [f"s{i:02d}" for i in range(11)]  # more than one row of LANES
    decay = spark.createDataFrame([(s, 0.02 * i) for i, s in enumerate(names)], "sp string, rate double")
    rows = [(k, t, s, rng.uniform(-1, 3)) for k in range(150) for t in (1, 2) for s in rng.sample(names, 3)] + [(3, 1, "stranger", 2.0), (4, 1, None, 2.0)]
    leaving = spark.createDataFrame(rows, "site int, t int, sp string, v double")
    near = radius_pairs(points, ["site"], "x", "y", 9.0, placed=True)
    meet = lambda o: radius_pairs(
        points, ["site"], "x", "y", 9.0, points.join(o.withColumnRenamed("src_site", "site"), "site"), placed=True
    ).drop("dst_site").withColumnRenamed("src_site", "site")
    by_pairs, by_points = arrivals(near, leaving, decay, "t", "sp", "v"), arrivals(near, leaving, decay, "t", "sp", "v", meet)
    want = {(r.site, r.t, r.sp): (r.arrivals, r.n_origins) for r in by_pairs.collect()}
    got = {(r.site, r.t, r.sp): (r.arrivals, r.n_origins) for r in by_points.collect()}
    assert want == {k: (pytest.approx(a), n) for k, (a, n) in got.items()}
    left = sum(v for *_, s, v in rows if v > 0 and s in names)
    assert sum(a for a, _ in got.values()) == pytest.approx(left)


def test_dispersal_of_crowded_sites_writes_no_pairs(spark, tmp_path):
    # the sites of one corner of 80 by 80 km, and what they count
    keys = [k for k in range(600_000) if k * 7919 % 2110 < 80 and k * 104729 % 3170 < 80]
    customer = spark.createDataFrame([(k, "A", 1) for k in keys], "c_custkey long, c_mktsegment string, c_nationkey int")
    day = datetime.datetime(1995, 5, 5)
    rng = random.Random(7)
    orders = [(9 * i + y + 1, k, day.replace(year=1995 + y), rng.choice(["1-URGENT", "5-LOW"])) for i, k in enumerate(keys) for y in range(3)]
    customer.write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    before = set(glob.glob(f"{shared_folder(spark)}/scratch-*/*"))
    got = {(r.site, r.yr, r.species): (r.arrivals, r.n_origins) for r in QUERIES["dispersal_growth"](spark, str(tmp_path)).collect()}
    tables = set(glob.glob(f"{shared_folder(spark)}/scratch-*/*")) - before
    assert sum(spark.read.parquet(t).count() for t in tables) <= 10 * len(orders) < len(keys) ** 2 / 10
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = {r[:3]: (pytest.approx(r[3], abs=2e-7), r[4]) for r in con.execute(
        f"SELECT site, yr, species, arrivals, n_origins FROM ({ORACLES['dispersal_growth']})").fetchall()}
    assert len(want) > len(keys) and got == want


def test_terms_from_statistics_are_sums_of_rows(spark):
    rng = random.Random(3)
    cells = [(v, d, r, rng.randint(1, 5)) for v in range(20) for d in (1, 2) for r in (1, 2, 3) if rng.random() < 0.7]
    totals = {}
    for v, _, _, y in cells:
        totals[v] = totals.get(v, 0) + y
    frame = spark.createDataFrame(cells, "v int, d int, r int, y int")
    sizes = spark.createDataFrame([(v, n, n + 9) for v, n in totals.items()], "v int, total int, size int")
    sigma, theta, cutoff = 60.0, 0.4, 100.0
    ring = [2 * sigma**2 * (math.exp(-a * a / (2 * sigma**2)) - math.exp(-b * b / (2 * sigma**2))) / cutoff**2 for a, b in ((0, 50), (50, 100))]
    phi = [(1 - theta) ** k * theta for k in range(3)]
    p = sum(ring) * sum(phi)
    fact = lambda n: math.lgamma(n + 1)
    binomial = sum(fact(n + 9) - fact(n) - fact(9) + n * math.log(p) + 9 * math.log(1 - p) for n in totals.values())
    blocks = sum(map(fact, totals.values())) + sum(y * math.log(ring[d - 1] * phi[r - 1] / p) - fact(y) for _, d, r, y in cells)
    draw = spark.createDataFrame([(1, sigma, theta)], "k int, sigma double, theta double")
    s, t = F.col("sigma"), F.col("theta")
    got = staged_total(draw, ["k"], {
        "visits": binomial_term(one_row(visit_statistics(sizes, "total", "size")), F.lit(p)),
        "blocks": multinomial_term(one_row(block_statistics(frame, ["v"], "y", 2, 3)), s, t, cutoff, 2, 3),
        "effects": effect_term(one_row(effect_statistics(frame, "y")), F.lit(2.0)),
    }).first()
    normal = sum(-0.5 * math.log(2 * math.pi) - math.log(2) - y * y / 8 for *_, y in cells)
    assert got.visits == pytest.approx(binomial) and got.blocks == pytest.approx(blocks) and got.effects == pytest.approx(normal)
    assert got.total == pytest.approx(binomial + blocks + normal)


def test_totals_are_summed_within_draws(spark):
    draws = spark.createDataFrame(
        [(0, 1, "N[1, 5]", 2.0), (0, 1, "N[2, 5]", 3.0), (0, 2, "N[1, 5]", 7.0), (1, 1, "N[1, 6]", 1.0), (0, 1, "sigma", 9.0)],
        "chain int, iter int, parameter string, value double")
    got = {(r.chain, r.iter, r.year): r.total for r in derived_totals(draws, "parameter", "N", "value", ["chain", "iter"]).collect()}
    assert got == {(0, 1, 5): 5.0, (0, 2, 5): 7.0, (1, 1, 6): 1.0}


def test_posterior(spark):
    rng = random.Random(3)
    data = [(c, i, p, rng.gauss(c, 1.0)) for c in (1, 2, 3) for i in range(1, 201) for p in ("a", "b")]
    draws = spark.createDataFrame(data, "chain int, iter int, p string, v double")
    kept = kept_draws(draws, "iter", 100, 10, "p", ["a"])
    assert {r.iter for r in kept.collect()} == set(range(110, 201, 10)) and kept.count() == 30
    s = {r.p: r for r in summarise(draws, ["p"], "v").collect()}
    a = sorted(v for _, _, p, v in data if p == "a")
    assert s["a"].n_draws == 600 and s["a"].median == pytest.approx((a[299] + a[300]) / 2)
    assert s["a"].low == pytest.approx(a[14] + 0.975 * (a[15] - a[14]))
    chains = {c: [v for k, _, p, v in data if p == "a" and k == c] for c in (1, 2, 3)}
    means = {c: sum(v) / 200 for c, v in chains.items()}
    within = sum(sum((x - means[c]) ** 2 for x in v) / 199 for c, v in chains.items()) / 3
    grand = sum(means.values()) / 3
    between = sum((m - grand) ** 2 for m in means.values()) / 2
    r = {r.p: r for r in potential_scale(draws, "p", "chain", "v").collect()}["a"]
    assert r.rhat == pytest.approx(math.sqrt((within * 199 / 200 + between) / within)) and r.rhat > 1.1
    s2 = {c: sum((x - means[c]) ** 2 for x in v) / 199 for c, v in chains.items()}

    def cov(a, b):
        ma, mb = sum(a.values()) / 3, sum(b.values()) / 3
        return sum((a[c] - ma) * (b[c] - mb) for c in a) / 2

    b = 200 * between
    big_v = 199 / 200 * within + (1 + 1 / 3) * b / 200
    cov_wb = 200 / 3 * (cov(s2, {c: m * m for c, m in means.items()}) - 2 * grand * cov(s2, means))
    var_v = (199**2 * cov(s2, s2) / 3 + (4 / 3) ** 2 * 2 * b * b / 2 + 2 * 199 * (4 / 3) * cov_wb) / 200**2
    df = 2 * big_v**2 / var_v
    assert r.psrf == pytest.approx(math.sqrt((df + 3) / (df + 1) * big_v / within))
    by_chain = summarise(draws, ["p", "chain"], "v")
    assert by_chain.count() == 6


def test_f_quantiles_of_the_tables(spark):
    # upper 2.5 % points as printed tables have them
    table = [(1, 1, 647.789), (1, 10, 6.9367), (2, 10, 5.4564), (3, 7, 5.8898), (5, 20, 3.2891), (10, 30, 2.5112), (4, 120, 2.8943), (2, 4000.0, 3.6922)]
    df = spark.createDataFrame([(float(a), float(b), v) for a, b, v in table], "a double, b double, v double")
    got = df.select("v", density.f_quantile(0.975, F.col("a"), F.col("b")).alias("f"), density.beta_share(F.lit(0.3), F.col("a"), F.col("b")).alias("i")).collect()
    for r in got:
        assert r.f == pytest.approx(r.v, rel=3e-5)
    logs = spark.createDataFrame([(x,) for x in (0.1, 0.5, 1.0, 2.5, 30.0, 1e5)], "x double").select("x", density.log_gamma(F.col("x")).alias("g"))
    for r in logs.collect():
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12)


def test_kernel_density(spark):
    rng = random.Random(5)
    groups = {"a": [rng.gauss(3, 2) for _ in range(400)], "b": [1.0, 1.0, 1.0, 9.0], "c": [4.0]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("a", None), ("none", None)]
    got = kernel_density(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], points=256).collect()
    assert len(got) == 3 * 256
    for g, values in groups.items():
        own = sorted((r for r in got if r.g == g), key=lambda r: r.i)
        bw = own[0].bandwidth
        step = own[1].at - own[0].at
        assert own[0].at == pytest.approx(min(values) - 3 * bw) and own[-1].at == pytest.approx(max(values) + 3 * bw)
        assert sum(r.density for r in own) * step == pytest.approx(1, abs=0.01)
        for r in own[::25]:  # the shared masses stay close to the kernels of the values themselves
            exact = sum(math.exp(-0.5 * ((r.at - v) / bw) ** 2) for v in values) / (len(values) * bw * math.sqrt(2 * math.pi))
            assert r.density == pytest.approx(exact, abs=2e-3 / bw)


def test_gather_names_the_missing_key(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    effects = spark.createDataFrame([("a", 0.5)], "k string, e double")
    assert gather(rows.where("k = 'a'"), effects, "k", "e", "eff").first().eff == 0.5
    with pytest.raises(Exception, match="no e for k b"):
        gather(rows, effects, "k", "e", "eff").collect()
