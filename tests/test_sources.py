"""Readers, writers and the pending list on fresh folders."""

from __future__ import annotations

import pytest

from tallyfield.sources.readers import load_bundle, lookup, read_csv, read_table, read_tsv, stack_csv, stack_folder, text_layouts
from tallyfield.sources.writers import write_by_key, write_csv, write_table, write_tsv
from tallyfield.streaming.pending import pending_keys, without, written_keys


def test_text_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"', 1.5), (2, None, 0.1)], "k int, s string, v double")
    write_csv(df, f"{tmp_path}/c")
    assert read_csv(spark, f"{tmp_path}/c", "k int, s string, v double").exceptAll(df).isEmpty()
    write_tsv(df, f"{tmp_path}/t")
    assert sorted(map(tuple, read_tsv(spark, f"{tmp_path}/t", "k int, s string, v double").collect())) == [(1, 'a "b"', 1.5), (2, None, 0.1)]


def test_stacked_layouts(spark, tmp_path):
    write_csv(spark.createDataFrame([(1, "x")], "state_num int, s string"), f"{tmp_path}/a")
    write_csv(spark.createDataFrame([(2.0,)], "state_num double"), f"{tmp_path}/b")
    out = stack_csv(spark, [(f"{tmp_path}/a", "state_num int, s string"), (f"{tmp_path}/b", "state_num double")], {"state_num": "double"})
    assert sorted(map(tuple, out.collect())) == [(1.0, "x"), (2.0, None)]


def test_write_by_key_leaves_other_keys(spark, tmp_path):
    path = f"{tmp_path}/by"
    write_by_key(spark.createDataFrame([("a", 1), ("b", 2)], "sp string, n int"), path, "sp")
    write_by_key(spark.createDataFrame([("b", 3), ("c", 4)], "sp string, n int"), path, "sp")
    assert sorted((r.sp, r.n) for r in read_table(spark, path).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    wanted = spark.createDataFrame([("a",), ("d",), ("d",)], "sp string")
    done = written_keys(spark, path, "sp")
    assert [r.sp for r in pending_keys(wanted, "sp", [done]).collect()] == ["d"]
    none = spark.createDataFrame([], "sp string")
    assert sorted(r.sp for r in pending_keys(wanted, "sp", [done, none]).collect()) == ["a", "d"]


def test_bundle_lookup_and_exclusion(spark, tmp_path):
    write_table(spark.range(3), f"{tmp_path}/bird.parquet")
    write_table(spark.range(2), f"{tmp_path}/route.parquet")
    bundle = load_bundle(spark, str(tmp_path), ["bird", "route"])
    assert (bundle["bird"].count(), bundle["route"].count()) == (3, 2)
    table = lookup(spark, [("x", 1), ("y", 2)], "code string, n int")
    assert without(table, "code", ["x"]).count() == 1
    assert without(table, "code", []).count() == 2


def test_tsv_columns_by_name(spark, tmp_path):
    write_tsv(spark.createDataFrame([(1, "b1", 2.5), (2, None, 0.5)], "a int, b string, c double"), f"{tmp_path}/t")
    got = read_tsv(spark, f"{tmp_path}/t", "c double, a int")
    assert got.columns == ["c", "a"] and sorted(map(tuple, got.collect())) == [(0.5, 2), (2.5, 1)]
    with pytest.raises(ValueError, match="no column d"):
        read_tsv(spark, f"{tmp_path}/t", "a int, d string")


def test_pending_first_run_and_padded_codes(spark, tmp_path):
    wanted = spark.createDataFrame([("00123",), ("9",)], "sp string")
    none = written_keys(spark, f"{tmp_path}/nothing", "sp")
    assert sorted(r.sp for r in pending_keys(wanted, "sp", [none]).collect()) == ["00123", "9"]
    write_by_key(wanted.where("sp = '00123'").selectExpr("sp", "1 AS n"), f"{tmp_path}/done", "sp")
    assert [r.sp for r in pending_keys(wanted, "sp", [written_keys(spark, f"{tmp_path}/done", "sp")]).collect()] == ["9"]


def test_folder_of_layouts(spark, tmp_path):
    folder = tmp_path / "states"
    folder.mkdir()
    (folder / "a.csv").write_text("StateNum,count\n1,2\n")
    (folder / "b.csv").write_text("StateNum,count\n3,\n")
    (folder / "c.csv").write_text('count,"the, name",StateNum\n5,"x, y",4.5\n')
    (folder / "d.csv").write_text("other\nz\n")
    (folder / "empty.csv").write_text("")
    (folder / "_note.csv").write_text("no table")
    (folder / "e.txt").write_text("no table")
    assert sorted(map(len, text_layouts(spark, str(folder)).values())) == [1, 1, 2]
    got = stack_folder(spark, str(folder), {"StateNum": "double", "count": "int"})
    assert sorted(map(tuple, got.select("StateNum", "count", "the, name", "other").collect()), key=str) == [
        (1.0, 2, None, None), (3.0, None, None, None), (4.5, 5, "x, y", None), (None, None, None, "z"),
    ]
    (folder / "f.csv").write_text("count\nmany\n")
    with pytest.raises(Exception, match="many"):
        stack_folder(spark, str(folder), {"count": "int"}).collect()
    with pytest.raises(ValueError, match="no .csv file"):
        stack_folder(spark, str(tmp_path), {})
