"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

A source's target is its weight's share of all words, but at most ``MOST``
times its own words; what that leaves over is shared again by weight. The mix
is cut into blocks of ``BLOCK`` words, and blocks go to sources by highest
quotients target / (s + 1/2). A source's documents lie, in seeded order, in
shards of about ``SHARD`` words; its blocks go to its shards the same way. A
shard takes whole passes over its words first and then seeded blocks of one
more pass, the last block cut to measure; a document's share is what of it
lies in taken blocks.

Only built-in functions are used. No step holds a whole source: windows run
over shards, and quotients are ranked by range. Only the water level is
computed in the driver, from sums.

Null texts have no words and are taken 0 times. A null source is a source of
its own, the last one. Repeated rows are separate documents; rows that share
an id, or have none, are drawn by their text too, so only rows equal in both
stand in one shard. An empty table gives an empty mix. Equal quotients go to the smaller source or shard number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.tables import col
from tallyfield.operators.ranks import numbered
from tallyfield.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 128
SHARD = 1 << 15
SEED = 17


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``number``, ``weight`` and ``target`` to ``(source, source_size)``."""
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = numbered(sources, ["source"], name="number")
    place = ((F.col("number") - 1) % len(weights)).cast("int")
    ranked = cut_lineage(ranked.withColumn("weight", F.get(listed, place)).withColumn("most", most * F.col("source_size")))
    level, capped = 0.0, -1
    while True:  # each round caps more sources; the driver sees three sums
        at = F.col("most") <= level * F.col("weight") if capped >= 0 else F.lit(False)
        rest, weight, now = ranked.agg(
            (F.sum("source_size") - F.sum(F.when(at, F.col("most")).otherwise(0))).cast("double"),
            F.sum(F.when(at, 0.0).otherwise(F.col("weight"))), F.count_if(at),
        ).first()
        if not weight or now == capped:
            break
        capped, level = now, rest / weight
    return ranked.withColumn("target", F.least(F.col("most").cast("double"), level * F.col("weight"))).drop("most")


def apportion(units: DataFrame, keys: list[str], unit: str, weight: str, seats: str, name: str) -> DataFrame:
    """Adds integer ``name``: ``seats`` of each group given to its units by highest quotients.

    A divisor that gives too few seats fixes the ones nobody contests; only
    the quotients between it and one that gives too many are ranked, about two
    per unit.
    """
    totals = units.groupBy(*keys).agg(F.sum(weight).alias("_w"), F.count("*").alias("_k"), F.first(seats).alias("_seats"))
    wide = units.join(totals, keys) if keys else units.withColumns({
        c: totals.select(c).scalar() for c in ("_w", "_k", "_seats")
    })
    share = F.col(weight) / F.col("_w")
    low = F.floor(share * F.greatest(F.col("_seats") - F.col("_k") / 2, F.lit(0.0)) + 0.5 - 1e-9)
    high = F.floor(share * (F.col("_seats") + F.col("_k") / 2) + 0.5 + 1e-9)
    low = F.when(F.col("_seats") > F.col("_k") / 2, F.greatest(low, F.lit(0))).otherwise(0)
    wide = wide.withColumn("_low", F.when(F.col(weight) > 0, low).otherwise(0).cast("bigint"))
    wide = cut_lineage(wide.withColumn("_high", F.when(F.col(weight) > 0, high).otherwise(0).cast("bigint")))
    base = wide.groupBy(*keys).agg(F.sum("_low").alias("_given"))
    contested = wide.where("_high > _low").select(
        *keys, unit, weight, "_seats", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_s")
    ).withColumn("_q", -F.col(weight) / (F.col("_s") + 0.5))
    ranked = numbered(contested, ["_q", unit], keys, name="_place")
    ranked = ranked.join(base, keys) if keys else ranked.withColumn("_given", base.scalar())
    won = ranked.where(F.col("_place") <= F.col("_seats") - F.col("_given")).groupBy(*keys, unit).agg(F.count("*").alias("_won"))
    out = wide.join(won, [*keys, unit], "left").withColumn(name, F.col("_low") + F.coalesce("_won", F.lit(0)))
    return out.select(*units.columns, name)


def _takes(block: int, seed: int) -> str:
    """SQL for the words taken of each block of a shard in the pass that is not whole, in block order.

    The place of the shard's last, shorter block in seeded order is a variable
    of the outer lambda, so that it is found once per shard and not per block.
    """
    last = f"(shard_size - (n_blocks - 1) * {block})"
    drawn = lambda j: f"named_struct('h', xxhash64({seed}, source_number, shard, {j}), 'j', {j})"
    last_place = f"size(filter(sequence(0, n_blocks - 1), j -> {drawn('j')} < {drawn('(n_blocks - 1)')})) + 1"
    order = f"transform(sort_array(transform(sequence(0, n_blocks - 1), j -> {drawn('j')})), x -> x.j)"
    words = (
        f"least(CASE WHEN j = n_blocks - 1 THEN {last} ELSE {block} END, "
        f"rest - r * {block} + CASE WHEN r >= last_place THEN {block} - {last} ELSE 0 END)"
    )
    return (
        f"CASE WHEN rest > 0 THEN get(transform(array({last_place}), last_place -> transform(sort_array("
        f"transform({order}, (j, r) -> struct(j, greatest(0L, {words})))), x -> x.col2)), 0) END"
    )


def mix(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", whole_rows: bool = False,
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED,
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every document; with ``whole_rows`` also ``row``, all its columns."""
    kept = [F.struct("*").alias("row")] if whole_rows else []
    # rows that share an id, or have none, are told apart by a hash of their text
    sized = docs.select(
        col(doc_id).alias("doc_id"), col(source).alias("source"), n_words(col(text)).alias("size"),
        F.xxhash64(F.lit(seed), col(text), col(doc_id), col(doc_id).isNull()).alias("draw"), *kept,
    )
    narrow = cut_lineage(sized.select("doc_id", "source", "size", "draw"))
    sources = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    blocks = narrow.agg(F.ceil(F.coalesce(F.sum("size"), F.lit(0)) / block).cast("bigint")).scalar()
    sources = apportion(sources.withColumn("seats", blocks), [], "number", "target", "seats", "quota")
    sources = cut_lineage(sources.select(
        F.col("source").alias("_source"), F.col("number").alias("source_number"), "source_size", "target", "quota",
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("bigint").alias("n_shards"),
    ))

    def placed(rows: DataFrame) -> DataFrame:
        with_source = rows.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
        return with_source.withColumn("shard", F.expr("pmod(shiftright(draw, 8), n_shards)"))

    shards = placed(narrow.where("size > 0")).groupBy("source_number", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("quota").alias("seats")
    )
    shards = apportion(shards, ["source_number"], "shard", "shard_size", "seats", "shard_quota")
    words = F.least(F.col("shard_quota") * block, most * F.col("shard_size"))
    shards = shards.withColumns({
        "passes": F.floor(words / F.col("shard_size")).cast("bigint"), "n_blocks": F.ceil(F.col("shard_size") / block).cast("bigint"),
    }).withColumn("rest", words - F.col("passes") * F.col("shard_size"))
    shards = shards.withColumn("takes", F.expr(_takes(block, seed)))
    shards = cut_lineage(shards.select("source_number", "shard", "passes", "takes"))

    in_order = Window.partitionBy("source_number", "shard").orderBy("draw", "doc_id", "size")
    laid = placed(sized).withColumn(
        "at", F.coalesce(F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    part = (
        f"CASE WHEN size > 0 AND takes IS NOT NULL THEN aggregate(sequence(at div {block}, (at + size - 1) div {block}), 0L, (a, j) -> "
        f"a + greatest(0L, least(at + size, j * {block} + takes[CAST(j AS INT)]) - greatest(at, j * {block}))) ELSE 0L END"
    )
    taken = F.coalesce(F.col("passes"), F.lit(0)) * F.col("size") + F.expr(part)
    return laid.join(shards, ["source_number", "shard"], "left").select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), *(["row"] if whole_rows else [])
    )


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents the mix takes words of, with ``size``, ``target`` and ``taken`` in place of columns of these names."""
    out = mix(docs, whole_rows=True, **options).where("taken > 0")
    added = ("size", "target", "taken")
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in added]
    return out.select(*own, *added)
