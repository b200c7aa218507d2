"""Taxon names, codes and species lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.columns import as_double, rounded, share_missing
from tallyfield.functions.text import drop_brackets, each_code, padded_code, two_word_name, word
from tallyfield.operators.joins import natural_join, rows_matching_one, suffixed_join
from tallyfield.operators.ranks import first_per_key
from tallyfield.queries.registry import Tables, query


def taxon_key(taxa: DataFrame) -> DataFrame:
    """Living taxa, one row per four-letter code and two-word name."""
    living = taxa.where(F.col("extinct_year").isNull())
    coded = living.select(
        "taxon", each_code("alpha").alias("alpha"), word("binomial", 1).alias("genus"), word("binomial", 2).alias("species"),
        two_word_name("binomial").alias("binomial"), drop_brackets("binomial").alias("en_common_name"),
    ).where((F.char_length("alpha") == 4) & F.col("alpha").isNotNull())
    return first_per_key(coded.withColumn("alpha", F.lower("alpha")), ["alpha", "binomial"], ["taxon"])


@query("taxonomy_clean", r"""
WITH e AS (SELECT taxon, unnest(string_split(alpha, ',')) AS alpha, binomial FROM v_taxa WHERE extinct_year IS NULL),
c AS (SELECT taxon, lower(alpha) AS alpha, split_part(binomial, ' ', 1) AS genus, split_part(binomial, ' ', 2) AS species,
  split_part(binomial, ' ', 1) || ' ' || split_part(binomial, ' ', 2) AS binomial,
  regexp_replace(binomial, '\(.*\)', '') AS en_common_name FROM e WHERE length(alpha) = 4)
SELECT taxon, alpha, genus, species, binomial, en_common_name FROM c
QUALIFY row_number() OVER (PARTITION BY alpha, binomial ORDER BY taxon) = 1""")
def taxonomy_clean(t: Tables) -> DataFrame:
    return taxon_key(t.v_taxa)


@query("explode_codes", "SELECT taxon, unnest(string_split(alpha, ',')) AS alpha FROM v_taxa")
def explode_codes(t: Tables) -> DataFrame:
    return t.v_taxa.select("taxon", each_code("alpha").alias("alpha"))


@query("zero_pad_code", """
SELECT taxon, CASE WHEN length(aou) >= 5 THEN aou ELSE lpad(aou, 5, '0') END AS aou FROM v_taxa""")
def zero_pad_code(t: Tables) -> DataFrame:
    return t.v_taxa.select("taxon", padded_code("aou").alias("aou"))


@query("code_match_once", """
WITH items AS (SELECT taxon, aou FROM v_taxa), codes AS (SELECT DISTINCT lower(concat(p_brand, p_size)) AS code FROM part),
m AS (SELECT i.aou FROM (SELECT DISTINCT aou FROM items) i JOIN codes c ON contains(c.code, i.aou) GROUP BY 1 HAVING count(*) = 1)
SELECT taxon, aou FROM items WHERE aou IN (SELECT aou FROM m)""")
def code_match_once(t: Tables) -> DataFrame:
    """Taxa whose code occurs inside exactly one code of the other list."""
    codes = t.part.select(F.lower(F.concat("p_brand", F.col("p_size").cast("string"))).alias("code"))
    return rows_matching_one(t.v_taxa.select("taxon", "aou"), "aou", codes, "code")


@query("taxon_record_counts", """
SELECT aou, alpha, binomial, split_part(binomial, ' ', 1) AS genus, split_part(binomial, ' ', 2) AS species,
  CAST(extinct_year AS DOUBLE) AS extinct_year, count(*) AS n_records
FROM lineitem LEFT JOIN v_taxa ON l_partkey = taxon
WHERE split_part(binomial, ' ', 2) IS NOT NULL GROUP BY ALL""")
def taxon_record_counts(t: Tables) -> DataFrame:
    """Records per taxon key; records are counted by number before the join."""
    records = t.lineitem.groupBy(F.col("l_partkey").alias("taxon")).agg(F.count("*").alias("n"))
    named = natural_join(records, t.v_taxa).withColumns({"genus": word("binomial", 1), "species": word("binomial", 2)})
    by_key = named.groupBy("aou", "alpha", "binomial", "genus", "species", "extinct_year")
    counts = by_key.agg(F.sum("n").alias("n_records")).where(F.col("species").isNotNull())
    return as_double(counts, ["extinct_year"])


@query("null_share", """
WITH living AS (SELECT taxon, alpha AS code FROM v_taxa WHERE extinct_year IS NULL)
SELECT count(*) AS n_rows, round(avg(CASE WHEN extinct_year IS NULL THEN 1.0 ELSE 0.0 END), 8) + 0.0 AS extinct_missing,
  round(avg(CASE WHEN code IS NULL THEN 1.0 ELSE 0.0 END), 8) + 0.0 AS code_missing
FROM lineitem JOIN v_taxa ON v_taxa.taxon = l_partkey LEFT JOIN living ON living.taxon = l_partkey""")
def null_share(t: Tables) -> DataFrame:
    """Share of records without an extinction year or a code after the key joins.

    Records are counted per taxon first and weigh the shares.
    """
    living = t.v_taxa.where(F.col("extinct_year").isNull()).select("taxon", F.col("alpha").alias("code"))
    keyed = natural_join(t.v_taxa.select("taxon", "extinct_year"), living, "left", ["taxon"], nulls_match=False)
    records = t.lineitem.groupBy(F.col("l_partkey").alias("taxon")).agg(F.count("*").alias("n")).join(keyed, "taxon")
    return records.agg(
        F.sum("n").alias("n_rows"),
        rounded(share_missing("extinct_year", "n"), 8).alias("extinct_missing"),
        rounded(share_missing("code", "n"), 8).alias("code_missing"),
    )


@query("masterlist_overlap", """
WITH routes AS (SELECT taxon, alpha, binomial, true AS on_routes FROM v_taxa WHERE extinct_year IS NULL),
survey AS (SELECT l_partkey AS taxon, count(*) AS n_survey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
lists AS (SELECT taxon, unnest(string_split(alpha, ',')) AS alpha, binomial, true AS on_checklists FROM v_taxa),
full_list AS (SELECT coalesce(r.taxon, s.taxon) AS taxon, r.alpha, r.binomial, on_routes, n_survey FROM routes r FULL JOIN survey s ON r.taxon = s.taxon)
SELECT DISTINCT f.taxon, f.alpha AS alpha_x, f.binomial AS binomial_x, on_routes, n_survey, on_checklists
FROM full_list f LEFT JOIN lists l ON l.taxon = f.taxon WHERE on_routes AND on_checklists AND n_survey > 0""")
def masterlist_overlap(t: Tables) -> DataFrame:
    """Species on all three lists; the lists are joined fully, then many-to-many on the taxon."""
    routes = t.v_taxa.where(F.col("extinct_year").isNull()).select("taxon", "alpha", "binomial", F.lit(True).alias("on_routes"))
    survey = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("taxon")).agg(F.count("*").alias("n_survey"))
    lists = t.v_taxa.select("taxon", each_code("alpha").alias("alpha"), "binomial", F.lit(True).alias("on_checklists"))
    joined = suffixed_join(natural_join(routes, survey, "full", nulls_match=False), lists, ["taxon"]).drop("alpha_y", "binomial_y")
    on_all = joined.where(F.col("on_routes") & F.col("on_checklists") & (F.col("n_survey") > 0)).distinct()
    return on_all.orderBy("on_checklists", F.col("n_survey").desc_nulls_last(), "on_routes")
