"""Quality rules: a few fixed rules, then likeness to trusted texts by hashed n-grams.

Words and word pairs are hashed into ``buckets``. Two multinomials over the
buckets are counted, one over all documents and one over trusted documents
(labelled good and not toxic), and each document gets the mean log ratio of
the two over its n-grams, so length does not decide. The threshold lies a
margin below what nearly all trusted documents reach; every document is judged
against the same number.

Only built-in functions are used. Every document so labelled is trusted: both
counts and the threshold cover all of them. Every text is scored once and
written; the threshold is the exact quantile of the written scores. Up to
``BROADCAST_IDS`` trusted ids are sent to every task; beyond that the texts are
shuffled to them once.

Null and empty texts have no words and fail the rules. Repeated rows get equal
verdicts. Without trusted documents the fixed rules alone decide. A label
table with several rows of one document must agree that it is good.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.tables import col
from tallyfield.operators.ranks import exact_quantiles
from tallyfield.session import cut_lineage

BUCKETS = 1 << 14
#: trusted ids sent to every task at most
BROADCAST_IDS = 1 << 20
#: share of trusted documents allowed below the threshold before the margin
QUANTILE = 0.005
MARGIN = 0.06

# fixed values: the rules
SPACE = " \t\n\u000b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
SYMBOL_CLASS = r"[#*$%&|<>]"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent


def word_array(text: Column) -> Column:
    """Words of a text, null as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def _with_rules(docs: DataFrame) -> DataFrame:
    """Adds to ``(row, text, words)`` the counts that the fixed rules use."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    n = F.size("words")
    windows = F.expr(
        f"transform(slice(words, 1, greatest(size(words) - {WINDOW - 1}, 0)), (w, i) -> xxhash64(w, "
        + ", ".join(f"words[i + {j}]" for j in range(1, WINDOW)) + "))"
    )
    counted = docs.withColumns({
        "n_words": n.cast("bigint"),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(SPACE_CLASS))).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL_CLASS)).cast("bigint"),
        "lines": lines,
        "windows": windows,
    })
    counted = counted.withColumns({
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        # only texts that repeat a window are sorted
        "placed": F.expr(
            "CASE WHEN size(array_distinct(windows)) < size(windows) "
            "THEN sort_array(transform(windows, (h, i) -> struct(h, i))) END"
        ),
    }).drop("lines", "windows")
    places = F.expr(
        "sort_array(transform(filter(placed, (x, k) -> "
        "coalesce(get(placed, k - 1).h = x.h, false) OR coalesce(get(placed, k + 1).h = x.h, false)), x -> x.i))"
    )
    covered = F.expr(
        f"coalesce(aggregate(places, struct(0L AS n, 0L AS upto), (a, i) -> "
        f"struct(a.n + i + {WINDOW} - greatest(a.upto, i) AS n, CAST(i + {WINDOW} AS BIGINT) AS upto)).n, 0L)"
    )
    counted = counted.withColumn("places", places).withColumn("n_repeat_words", covered).drop("placed", "places")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _features(buckets: int) -> Column:
    return F.expr(
        f"concat(transform(words, w -> pmod(xxhash64(w), {buckets})), "
        f"transform(words, (w, i) -> pmod(xxhash64(w, get(words, i + 1)), {buckets})))"
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All documents labelled good and not toxic, written, so that Spark knows their size when they are joined."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return cut_lineage(good.where("q = 1 AND t = 0 AND doc_id IS NOT NULL").select("doc_id"))


def bucket_weights(docs: DataFrame, trusted: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """One row: ``weights``, the log ratio of trusted to all n-grams per bucket, add-one smoothed."""
    good = trusted.withColumn("good", F.lit(1))
    good = F.broadcast(good) if trusted.count() <= BROADCAST_IDS else good
    marked = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")).join(good, "doc_id", "left")
    marked = marked.select(F.coalesce("good", F.lit(0)).alias("good"), word_array(F.col("text")).alias("words"))
    grams = marked.select("good", F.explode(_features(buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    spark = docs.sparkSession
    every = spark.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").na.fill(0)
    packed = every.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("counts"),  # ``buckets`` entries
        F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"),
    )
    weight = (
        f"CASE WHEN all_target = 0 THEN 0D ELSE ln((x.target + 1) / (all_target + {buckets})) "
        f"- ln((x.raw + 1) / (all_raw + {buckets})) END"
    )
    return packed.select(F.expr(f"transform(counts, x -> {weight})").alias("weights"))


def _scored(docs: DataFrame, weights: Column, buckets: int) -> DataFrame:
    """Adds ``score`` to ``(words, ...)``: the mean weight of a document's n-grams; null without words."""
    df = docs.withColumn("features", _features(buckets)).withColumn("weights", weights)
    total = F.expr("aggregate(features, 0D, (a, f) -> a + weights[CAST(f AS INT)])")
    return df.withColumn("score", F.when(F.size("words") > 0, total / F.size("features"))).drop("features", "weights")


def judged(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    buckets: int = BUCKETS, quantile: float = QUANTILE, margin: float = MARGIN,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Every document with the rules' counts, ``base_failed``, ``score``, ``threshold`` and ``kept``, as a written table.

    ``row`` holds the columns ``carry`` of the document, all of them if none
    are named. Verdicts are written because a filter on an unwritten one would be pushed
    down to the texts with every count it depends on.
    """
    trusted = trusted_ids(labels)
    weights = bucket_weights(docs, trusted, doc_id, text, buckets).scalar()
    carried = docs.columns if carry is None else carry
    base = docs.select(F.struct(*[col(c) for c in carried]).alias("row"), col(doc_id).alias("doc_id"), col(text).alias("text"))
    base = base.withColumn("words", word_array(F.col("text")))
    out = cut_lineage(_scored(_with_rules(base), weights, buckets).drop("words", "text"))
    reached = out.select("doc_id", "score").join(trusted, "doc_id", "left_semi")
    lowest = cut_lineage(exact_quantiles(reached, [], "score", {"t": quantile}).select(F.col("t") - margin)).scalar()
    out = out.withColumn("threshold", lowest)
    verdict = F.col("threshold").isNull() | (F.col("score") >= F.col("threshold"))
    return out.withColumn("kept", ~F.col("base_failed") & verdict)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, columns as they came."""
    return judged(docs, labels, **options).where("kept").select("row.*")
