"""Missing values, order and id rules on hand-made frames."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.functions.bins import bin_columns, bin_index, bin_label, spaced
from tallyfield.functions.columns import (
    clean_names,
    col_range,
    count_true,
    drop_positions,
    distinct_with_null,
    row_sum,
    share_missing,
    snake_name,
    strict_sum,
)
from tallyfield.functions.text import drop_brackets, index_of, padded_code, word
from tallyfield.operators.aggregates import frequency_profile, start_abundance, start_occupancy
from tallyfield.operators.checklists import collapse_groups, counted, roll_up_taxa, thin_zero_sites, zero_fill
from tallyfield.operators.joins import (
    drop_known,
    keep_common,
    keep_known,
    natural_join,
    rows_matching_one,
    suffixed_join,
    with_every,
)
from tallyfield.operators.pivots import distance_period_block, fold_stops, wide_counts
from tallyfield.operators.ranks import (
    exact_quantiles,
    factor_ids,
    first_per_key,
    flag_first,
    group_size,
    id_by_first_seen,
    id_by_value,
    numbered,
    one_at_random,
    running_weight,
    with_factor_ids,
)
from tallyfield.functions.geo import Grid
from tallyfield.operators.spatial import grid_cells
from tallyfield.plans.route_counts import of_codes, on_grid, route_points, widen_stops
from tallyfield.plans.distance_blocks import cell_blocks, clean_survey
from tallyfield.plans.checklist_points import zero_filled_points


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_natural_join_matches_missing_keys(spark):
    left = spark.createDataFrame([("a", None, 1), (None, "x", 2), ("b", "y", 3)], "p string, q string, l int")
    right = spark.createDataFrame([("a", None, 10), (None, "x", 20), ("c", "z", 30)], "p string, q string, r int")
    assert rows(natural_join(left, right)) == sorted([("a", None, 1, 10), (None, "x", 2, 20), ("b", "y", 3, None)], key=str)
    assert rows(natural_join(left, right, "inner"), "l", "r") == [(1, 10), (2, 20)]
    full = rows(natural_join(left, right, "full"))
    assert full == sorted([("a", None, 1, 10), (None, "x", 2, 20), ("b", "y", 3, None), ("c", "z", None, 30)], key=str)


def test_full_join_keeps_duplicates_on_both_sides(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (3, "z")], "k int, r string")
    got = rows(natural_join(left, right, "full"))
    want = [tuple(r) for r in left.join(right, "k", "full").collect()]
    assert got == sorted(want, key=str)


def test_membership_counts_missing_as_a_value(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "k int")
    other = spark.createDataFrame([(None,), (2,), (2,)], "k int")
    assert rows(keep_known(df, other, ["k"])) == [(2,), (None,)]
    assert rows(drop_known(df, other, ["k"])) == [(1,)]
    a, b = keep_common(df, other, ["k"])
    assert a.count() == 2 and b.count() == 3


def test_suffixed_join(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "c"), (1, "d")], "k int, v string")
    out = suffixed_join(left, right, ["k"])
    assert out.columns == ["k", "v_x", "v_y"] and out.count() == 4


def test_with_every_is_whole_and_not_a_cross_join(spark):
    out = with_every(spark.range(100), spark.range(7).withColumnRenamed("id", "j"), ["id"], parts=4)
    assert out.distinct().count() == 700 and out.count() == 700
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_rows_matching_one(spark):
    items = spark.createDataFrame([("ab",), ("bc",), ("zz",), ("a",)], "code string")
    codes = spark.createDataFrame([("xab",), ("abc",), ("abc",), (None,)], "c string")
    assert rows(rows_matching_one(items, "code", codes, "c")) == [("bc",)]


def test_aggregate_null_rules(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 2)], "g string, v int")
    out = df.groupBy("g").agg(
        strict_sum("v").alias("s"), distinct_with_null("v").alias("d"), share_missing("v").alias("m"),
        count_true(F.col("v") > 1).alias("c"),
    )
    assert rows(out) == [("a", None, 2, 0.5, 0), ("b", 4, 1, 0.0, 2)]


def test_names_and_ranges(spark):
    assert [snake_name(n) for n in ("StateNum", "spp.num", "Point Latitude", "BBS", "1st")] == [
        "state_num", "spp_num", "point_latitude", "bbs", "x1st"]
    df = spark.createDataFrame([(1, 2, 3)], "A int, `a ` int, bC int")
    assert clean_names(df).columns == ["a", "a_2", "b_c"]
    assert col_range(df, "a ", "bC") == ["a ", "bC"]
    assert drop_positions(df, 1, -1).columns == ["a "]


def test_row_sums_propagate_missing(spark):
    df = spark.createDataFrame([(1, 2, 3, 4), (1, None, 3, 4)], "s1 int, s2 int, s3 int, s4 int")
    assert rows(df.select(row_sum(df.columns))) == [(10,), (None,)]
    folded = fold_stops(df, df.columns, size=2)
    assert rows(folded) == [(3, 7, 10), (None, 7, None)]


def test_text(spark):
    df = spark.createDataFrame([("Aquila chrysaetos (Golden) x (y) z", "123"), ("Solo", "123456")], "n string, c string")
    out = rows(df.select(word("n", 2), drop_brackets("n"), padded_code("c")))
    assert out == [("", "Solo", "123456"), ("chrysaetos", "Aquila chrysaetos  z", "00123")]
    named = spark.createDataFrame([("N[12, 3]",), ("s[4]",)], "p string")
    assert rows(named.select(index_of("p", 1), index_of("p", 2))) == [(12, 3), (None, None)]


def test_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 49.9, 50.0, 199.0, 250.0, 250.1, -1.0)], "d double")
    got = [tuple(r) for r in df.select("d", bin_index(F.col("d"), 50, 5), bin_label(F.col("d"), 50, 5)).collect()]
    assert [g[1] for g in got] == [0, 0, 1, 3, 4, None, None]
    assert got[4][2] == "200_250"
    assert bin_columns(50, 5, 6)[:6] == ["count_0_50_1", "count_50_100_1", "count_100_150_1", "count_150_200_1", "count_200_250_1", "count_0_50_2"]
    assert spaced(-2, 2, 5) == [-2, -1, 0, 1, 2]


def test_block_keeps_the_total_and_absent_columns(spark):
    df = spark.createDataFrame([(1, 10.0, 1, 2), (1, 10.0, 1, 3), (2, 240.0, 6, 4)], "v int, d double, p int, n int")
    out = distance_period_block(df, ["v"], "d", "p", "n")
    assert len(out.columns) == 31
    assert out.select(F.sum(row_sum(out.columns[1:]))).first()[0] == 9


def test_wide_counts_tell_missing_from_absent(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 1, None), (1, 70, 3), (2, 2, None), (2, 70, 1)], "k int, l int, n int")
    names = {i: f"c{i}" for i in range(1, 71)}
    out = {r.k: r for r in wide_counts(df, ["k"], "l", "n", names).collect()}
    assert (out[1].c1, out[1].c2, out[1].c70) == (None, 0, 3)
    assert (out[2].c1, out[2].c2, out[2].c70) == (0, None, 1)
    skipped = {r.k: r for r in wide_counts(df, ["k"], "l", "n", names, skip_missing=True).collect()}
    assert (skipped[1].c1, skipped[2].c2) == (2, 0)


def _hot(spark, n=20000):
    """A third of all rows on one key, a third with no key."""
    return spark.range(n).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('k', id % 50) END AS k", "id * 7919 % 20011 AS v", "id"
    )


def test_numbered_equals_a_window(spark):
    df = _hot(spark)
    got = numbered(df, ["v", "id"], ["k"], "n", "size")
    w = Window.partitionBy("k")
    want = df.withColumn("n", F.row_number().over(w.orderBy("v", "id")).cast("long")).withColumn("size", F.count("*").over(w))
    assert got.count() == df.count()
    assert got.select("k", "v", "id", "n", "size").exceptAll(want).isEmpty()


def test_numbered_all_rows(spark):
    df = _hot(spark, 5000)
    out = numbered(df, ["k", "v", "id"], name="n", size_name="size")
    assert out.agg(F.min("n"), F.max("n"), F.count_distinct("n"), F.max("size")).first() == (1, 5000, 5000, 5000)
    last = out.orderBy("n").collect()
    assert [r.k for r in last][-1] is None and last[0].k == "hot"


def test_running_weight_and_quantiles(spark):
    df = _hot(spark, 6000).withColumn("x", F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.sin("id")))
    got = exact_quantiles(df, ["k"], "x", {"med": 0.5, "low": 0.025, "high": 0.975})
    want = df.groupBy("k").agg(F.percentile("x", 0.5).alias("med"), F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))
    a, b = ({r.k: r[1:] for r in d.collect()} for d in (got, want))
    assert a.keys() == b.keys()
    for k in a:
        assert all(abs(p - q) < 1e-12 for p, q in zip(a[k], b[k]))
    total = running_weight(df, ["id"], [], "v", "upto", "total").agg(F.max("upto"), F.max("total")).first()
    assert total[0] == total[1] == df.agg(F.sum("v")).first()[0]


def test_ids(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 0), (None, 5)], "o string, t int")
    assert rows(id_by_value(df, "o", "i"), "o", "i") == sorted([("b", 2), ("a", 1), ("b", 2), ("c", 3), (None, None)], key=str)
    assert rows(id_by_first_seen(df, "o", ["t"], "i"), "o", "i") == sorted([("b", 2), ("a", 3), ("b", 2), ("c", 1), (None, None)], key=str)


def test_firsts(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 3, 2), ("a", 2, 3), (None, 1, 4), (None, 1, 5)], "k string, t int, id int")
    assert rows(first_per_key(df, ["k"], ["t", "id"])) == sorted([("a", 2, 3), (None, 1, 4)], key=str)
    assert rows(flag_first(df, ["k"], ["t", "id"], "new"), "id", "new") == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 0)]
    assert rows(group_size(df, ["k"], "n"), "id", "n") == [(1, 3), (2, 3), (3, 3), (4, 2), (5, 2)]
    once, again = (rows(one_at_random(df, ["k"], "id", "s")) for _ in range(2))
    assert once == again and len(once) == 2


def test_frequency_profile_with_missing_ids(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,), (None,)], "i string")
    r = frequency_profile(df, ["i"]).first()
    assert (r.n_i, r.n_rep_i, r.mean_rep_i, r.med_rep_i, r.max_rep_i) == (3, 3, 2.0, 2.0, 3)


def test_zero_fill_is_lists_times_species(spark):
    lists = spark.createDataFrame([("l1",), ("l2",), ("l3",)], "l string")
    seen = spark.createDataFrame([("l1", "s1", 2), ("l1", "s1", 1), ("l2", "s2", 0), ("l9", "s1", 5)], "l string, s string, n int")
    species = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s1",)], "s string")
    out = zero_fill(lists, seen, species, "l", "s", "n")
    assert out.count() == 9
    assert rows(out.where("n > 0 or observed"), "l", "s", "n", "observed") == [("l1", "s1", 3, True), ("l2", "s2", 0, True)]


def test_groups_taxa_and_counts(spark):
    df = spark.createDataFrame([(1, "G", "s"), (2, "G", "s"), (2, "G", "t"), (3, None, "s")], "e int, g string, s string")
    assert rows(collapse_groups(df, "e", "g", ["s"], "c"), "c", "s", "e") == [("G", "s", 1), ("G", "t", 2), ("S3", "s", 3)]
    obs = spark.createDataFrame([("l", "a1", "2"), ("l", "a2", "X"), ("m", "a1", "2"), ("m", "a2", "3")], "l string, t string, n string")
    tax = spark.createDataFrame([("a1", "a"), ("a2", "a")], "t string, s string")
    assert rows(roll_up_taxa(obs, tax, "l", "t", "s", "n")) == [("l", "a", "X"), ("m", "a", "5")]
    text = spark.createDataFrame([("X",), ("7",), ("oops",)], "n string")
    assert rows(counted(text, "n", "c")) == [("7", 7), ("oops", None)]


def test_thinning_against_plain_python(spark):
    rng = random.Random(4)
    data = [(rng.randrange(30), rng.randrange(2000, 2006), rng.choice([0, 0, 0, None, 1]) if s % 2 else 0, i) for i, s in enumerate(range(400))]
    df = spark.createDataFrame(data, "site int, yr int, n int, id int")
    out = rows(thin_zero_sites(df, "site", "yr", "n", "id", min_years=4, seed="x"))
    positive = [d for d in data if d[2]]
    with_pos = {d[0] for d in positive}
    years: dict[int, set] = {}
    for site, yr, n, _ in data:
        if n == 0 and site not in with_pos:
            years.setdefault(site, set()).add(yr)
    keep = with_pos | {s for s, y in years.items() if len(y) >= 4}
    zeros = [r for r in out if r[2] == 0]
    assert sorted(r for r in out if r[2]) == sorted(positive)
    assert {(r[0], r[1]) for r in zeros} == {(d[0], d[1]) for d in data if d[2] == 0 and d[0] in keep}
    assert len(zeros) == len({(r[0], r[1]) for r in zeros}) and set(zeros) <= set(data)


def test_start_values(spark):
    frame = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "s int, t int")
    top = spark.createDataFrame([(1, 1, 4.0), (1, 2, 20.0)], "s int, t int, m double")
    starts = start_abundance(frame, top, ["s", "t"], "m")
    assert rows(starts, "s", "t", "n_start") == [(1, 1, 30.0), (1, 2, 60.0), (2, 1, 10.0), (2, 2, 10.0)]
    assert rows(start_occupancy(starts, "s", "n_start"), "s", "z_start") == [(1, 1), (2, 0)]


def test_zero_fill_keeps_uncounted_records(spark):
    lists = spark.createDataFrame([("l1",), ("l2",)], "l string")
    seen = spark.createDataFrame([("l1", "s1", None), ("l2", "s1", 4), ("l2", None, 1)], "l string, s string, n int")
    out = zero_fill(lists, seen, seen.select("s"), "l", "s", "n")
    assert rows(out, "l", "s", "n", "observed") == [("l1", "s1", None, True), ("l2", "s1", 4, True)]


def test_cell_blocks_keep_species_apart(spark):
    data = [(2012, 1, 1, 20.0, 1, 3, "A")] * 30 + [(2012, 1, 1, 20.0, 1, 5, "B")] * 30 + [(2012, 1, 1, 20.0, 1, 7, "rare")]
    clean = clean_survey(spark.createDataFrame(data, "yr int, transect int, point int, distance double, time_period int, cnt int, species string"))
    located = spark.createDataFrame([(1, 0)], "transect int, cell_id int")
    out = cell_blocks(clean, located, spark.createDataFrame([(0,), (1,)], "cell_id int"))
    assert rows(out, "alpha", "cell_id", "count_0_50_1") == [("a", 0, 90), ("a", 1, 0), ("b", 0, 150), ("b", 1, 0)]


def test_factors_of_all_feeds_at_once(spark):
    a = spark.createDataFrame([(10, "y"), (2, "x"), (2, None), (None, "y")], "n int, t string")
    b = spark.createDataFrame([(7.5,), (7.5,), (-1.0,)], "n double")
    factors = {"a": {"n_no": "n", "t_no": "t"}, "b": {"n_no": "n"}}
    ids = factor_ids({"a": a, "b": b}, factors)
    got = with_factor_ids(a, "a", ids, factors["a"]).collect()
    assert sorted(((r.n, r.t, r.n_no, r.t_no) for r in got), key=str) == sorted([(10, "y", 2, 2), (2, "x", 1, 1), (2, None, 1, None), (None, "y", None, 2)], key=str)
    assert sorted((r.n, r.n_no) for r in with_factor_ids(b, "b", ids, factors["b"]).collect()) == [(-1.0, 1), (7.5, 2), (7.5, 2)]


def test_species_have_their_own_steps_and_observers(spark):
    stops = [(a, r, y, o, s, 1) for a in (1, 2) for r, y, o in ((1, 2000, 9), (1, 2001, 8), (2, 2000, 8)) for s in (1, 6) if not (a == 2 and y == 2000 and r == 1)]
    taxa = spark.createDataFrame([("0001", "AAAA"), ("2", "BBBB"), ("x3", "CCCC")], "aou text, alpha string".replace("text", "string"))
    counted = spark.createDataFrame([*stops, (5, 1, 2000, 9, 1, 1)], "code int, route int, yr int, obs_n int, stop int, cnt int")
    named = of_codes(counted, taxa, "code", "aou", ["alpha"])
    assert {r.alpha for r in named.collect()} == {"AAAA", "BBBB"}
    grid = Grid(0.0, 0.0, 1.0, 3, 1)
    routes = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.6, 0.5)], "route int, x double, y double")
    points = route_points(widen_stops(named, ["alpha", "route", "yr", "obs_n"], "stop", "cnt"), routes, grid, by=["alpha"])
    full = on_grid(points, grid_cells(spark, grid), by=["alpha"], at_least=2).collect()
    steps = {(r.alpha, r.route, r.yr): (r.time_step, r.new, r.obs_id, r.nyears_site) for r in full if r.route is not None}
    assert steps == {
        ("AAAA", 1, 2000): (1, 1, 1, 3), ("AAAA", 1, 2001): (2, 1, 2, 3), ("AAAA", 2, 2000): (3, 1, 2, 3),
        ("BBBB", 1, 2001): (1, 1, 1, 2), ("BBBB", 2, 2000): (2, 1, 1, 2),
    }
    assert sorted((r.alpha, r.cell_id) for r in full if r.route is None) == [(a, c) for a in ("AAAA", "BBBB") for c in (1, 2)]
    assert on_grid(points, grid_cells(spark, grid), by=["alpha"], at_least=3).where("alpha = 'BBBB'").isEmpty()


def test_whole_checklist_feed(spark):
    lists = [  # event, group, observer, date, duration, complete, protocol
        (1, "G1", 7, 20, True), (2, "G1", 8, 30, True), (2, "G1", 8, 30, True),  # event 2 stands there twice
        (3, None, 9, 10, True), (4, None, 9, 10, False), (5, None, 9, 10, True),  # 4 is not complete, 5 saw nothing
    ]
    checklists = spark.createDataFrame(
        [(e, g, o, "Stationary", datetime.date(2001, 5, e), d, c, -100.0, 40.0) for e, g, o, d, c in lists],
        "event_id int, group_id string, observer int, protocol string, obs_date date, duration int, complete boolean, lon double, lat double")
    observations = spark.createDataFrame(
        [(1, "wren", "2"), (2, "wren", "9"), (2, "lark", "4"), (3, "lark", "X"), (4, "wren", "5"), (3, "tern", "0")],
        "event_id int, species string, count_text string")
    out = zero_filled_points(checklists, observations, at_least=1)
    got = sorted((r.checklist_id, r.event_id, r.species, r["count"], r.observed, r.day) for r in out.collect())
    # one checklist for the group, lark there from event 2; no row for a lark without a count; tern was never positive
    assert got == [("G1", 1, "lark", 4, True, 1), ("G1", 1, "wren", 2, True, 1), ("S3", 3, "wren", 0, False, 3)]
