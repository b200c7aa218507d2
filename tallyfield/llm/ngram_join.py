"""Exact Jaccard join of documents on word n-grams, as a blocked sparse matrix product.

The document by n-gram incidence matrix is multiplied with its transpose, but
only where a product can reach the threshold:

1. Documents with equal n-gram sets become one row of the matrix.
2. The columns are ordered from rare to frequent by a frequency sketch. Two
   rows can only reach the threshold if they meet in their rarest columns, as
   many as the size bound leaves; columns that hold one row are left out.
3. First product: in every column and range of sizes, the row of the smallest
   id times the others. That is one product per entry, and connects most copies.
4. Second product: all other entries of a column, in blocks of ``BLOCK_ROWS``
   rows; a task gets the two blocks of one place of the product. Rows that are
   connected already are never multiplied: of a column's largest component no
   block meets another. The products are summed per pair, and pairs whose sum
   is below what the sizes demand of their rarest columns are discarded.
5. The pairs that a product leaves get their overlaps accumulated over all
   columns, again in blocks: a long row is cut by ranges of columns, a row's
   block is sent once to some hundred partners, and partial counts are summed.

Pairs whose sizes or parity bits rule the threshold out are discarded before
they are counted; long parities grow with the row, so long rows are told apart as well. No link between different texts is lost: a skipped pair is
either below a bound or inside one component already. Nothing is sampled or
capped, and hot columns come last in the order, so they are met only by rows
made of little else.

Null and empty texts have no n-grams and link with nothing, as do rows without
an id, whose component is null. Rows with the same id are one document that
has all their links. N-grams count as equal when their 64-bit hashes are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.tables import batches_of, col, components, list_array, map_arrow, per_batch
from tallyfield.llm.words import NONSPACE, find_words, mix, ranges, running, slices, spans_hash, text_bytes
from tallyfield.session import cut_lineage

WIDTH = 4
PERCENT = 85
#: text worked on at once; what a worker needs for it stays with the worker while it waits
CHUNK_BYTES = 1 << 19
SKETCH_BITS = 20
#: columns of more n-grams than two to this power, by the sketch, meet their leaders in a join
HOT_LEVEL = 11
BLOCK_ROWS = 1024
#: rows of 2^12 n-grams and more are cut into ranges of columns
PART_BITS = 12
#: a long parity has a bit per n-gram at least, and two to this power at least
PARITY_BITS = 10
PARTNERS = 256
#: ids sent to every task at most; beyond it the texts are shuffled to the ids
BROADCAST_IDS = 1 << 20

_BASE = 0x2545F4914F6CDD1D


def shingles(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every text, ascending per text, and where each text's begin."""
    data, bounds = text_bytes(part.column("text"))
    _, _, words, at = find_words(data, bounds, NONSPACE)
    sizes = np.diff(at)
    starts, owner = ranges(at[:-1], np.where(sizes > 0, np.maximum(sizes - width + 1, 1), 0))
    ends = np.minimum(starts + width, at[owner + 1])
    hashes = mix(spans_hash(running(words, _BASE), starts, ends, _BASE))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(part.num_rows + 1))


def _sketcher(schema: pa.Schema, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES) if batch.num_rows else ():
                hashes, _ = shingles(part, width)
                np.add.at(counts, (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        # only what stands out from the even spread of rare n-grams
        at = np.flatnonzero(counts > 4 + 4 * counts.mean())
        yield batches_of(schema, [pa.array(at), pa.array(counts[at])])

    return run


def frequency_levels(docs: DataFrame, width: int) -> np.ndarray:
    """A level per sketch bucket, 0 for rare; the order of columns is by level, then hash."""
    found = map_arrow(docs.select("text"), lambda fields: _sketcher(fields, width), "bucket bigint, n bigint")
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():  # at most one row per bucket
        levels[bucket] = int(n).bit_length()
    return levels


def _profiler(levels, schema: pa.Schema, width: int, percent: int):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text", CHUNK_BYTES):
            hashes, at = shingles(part, width)
            sizes = np.diff(at)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            level = levels.value[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
            column = (level << np.uint64(56)) | (hashes >> np.uint64(8))
            column = column[np.lexsort((column, owner))]
            # an overlap is at least the threshold's share of the larger set
            reach = np.where(sizes > 0, sizes - -(-percent * sizes // 100) + 1, 0)
            taken, _ = ranges(at[:-1], reach)
            filled = np.flatnonzero(sizes)
            sums = []
            for seed in range(2):
                salted = mix(hashes ^ np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
                made = np.zeros(len(sizes), np.uint64)
                if len(filled):
                    made[filled] = np.add.reduceat(salted, at[filled])
                sums.append(made)
            # each n-gram flips one of 128 bits: sets differ in at least as many n-grams as bits
            bit = np.uint64(1) << (hashes & np.uint64(63))
            for half in range(2):
                flips, made = np.where((hashes >> np.uint64(6)) & np.uint64(1) == half, bit, np.uint64(0)), np.zeros(len(sizes), np.uint64)
                if len(filled):
                    made[filled] = np.bitwise_xor.reduceat(flips, at[filled])
                sums.append(made)
            # and one of as many bits as n-grams or more, for the pairs that the short ones leave
            width_of = np.int64(1) << np.maximum(np.frexp(np.maximum(sizes - 1, 0).astype(float))[1], PARITY_BITS).astype(np.int64)
            begin = np.append(0, np.cumsum(width_of))
            at_bit = begin[owner] + ((hashes >> np.uint64(7)).astype(np.int64) & (width_of[owner] - 1))
            parity = np.packbits((np.bincount(at_bit, minlength=begin[-1]) & 1).astype(np.uint8)).tobytes()
            begin //= 8
            yield batches_of(schema, [
                part.column("doc_id"), pa.array(sizes), *[pa.array(s.view(np.int64)) for s in sums],
                pa.array([parity[low:high] for low, high in zip(begin, begin[1:])], pa.binary()),
                list_array(np.repeat(np.arange(len(sizes)), reach), len(sizes), pa.array(column[taken].view(np.int64))),
            ])

    return per_batch(work)


def _leader(schema: pa.Schema, percent: int):
    """Rows of columns that hold several, with the first row of their column and range of sizes.

    Rows arrive by column, range and id, so no more than one row waits for the next batch.
    """
    names = ("column", "span", "doc", "size", "b1", "b2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lone, lead = None, None  # a row that is the first of its column; the last row's leader
        for batch in batches:
            rows = [batch.column(name).to_numpy() for name in names]
            if not len(rows[0]):
                continue
            if lone is not None:
                rows = [np.append(one, many) for one, many in zip(lone, rows)]
            given = lone is None and lead is not None and lead[0] == rows[0][0]
            if given:
                rows = [np.append(one, many) for one, many in zip(lead, rows)]
            new = np.append(True, rows[0][1:] != rows[0][:-1])
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(new)))
            several = np.repeat(size > 1, size)
            several[0] &= not given  # this leader was given out with an earlier batch
            new |= np.append(True, rows[1][1:] != rows[1][:-1])
            at = np.flatnonzero(new)[np.cumsum(new) - 1]
            lead = [x[at[-1]] for x in rows]
            lone = [x[-1] for x in rows] if size[-1] == 1 else None
            keep = np.flatnonzero(several)
            top = at[keep]
            yield batches_of(schema, [pa.array(rows[k][keep]) for k in (0, 2, 3, 4, 5)] + [pa.array(rows[k][top]) for k in (2, 3, 4, 5)])

    return run


_MET = "column bigint, doc bigint, size bigint, b1 bigint, b2 bigint, lead bigint, lead_size bigint, l1 bigint, l2 bigint"


def columns_with_leaders(classes: DataFrame, percent: int) -> DataFrame:
    """The entries of all columns that hold several rows, each with a leader of about its size."""
    span = F.floor(F.ln("size") / math.log(100 / percent)) if percent < 100 else F.col("size")
    rows = classes.select(F.explode("prefix").alias("column"), span.cast("bigint").alias("span"), "doc", "size", "b1", "b2")
    level = F.shiftrightunsigned("column", 56)
    rare = rows.where(level <= HOT_LEVEL).repartition("column").sortWithinPartitions("column", "span", "doc")
    rare = map_arrow(rare, lambda fields: _leader(fields, percent), _MET)
    hot = rows.where(level > HOT_LEVEL)
    leaders = cut_lineage(hot.groupBy("column", "span").agg(F.count("*").alias("n"), F.min(F.struct("doc", "size", "b1", "b2")).alias("top")))
    several = leaders.groupBy("column").agg(F.sum("n").alias("n")).where("n > 1").select("column")
    hot = hot.join(leaders.join(several, "column", "left_semi"), ["column", "span"])
    hot = hot.select("column", "doc", "size", "b1", "b2", "top.doc", "top.size", "top.b1", "top.b2")
    return cut_lineage(rare.union(hot))


def _sets(schema: pa.Schema, width: int, percent: int, part_bits: int):
    """Blocks of a row: for every cut that a partner's size can ask for, its ranges of columns."""

    def bits(sizes):
        return np.maximum(np.frexp(sizes.astype(float))[1] - part_bits, 0)  # exponent: length in binary

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text", CHUNK_BYTES):
            hashes, at = shingles(part, width)
            sizes = np.diff(at)
            sums = np.zeros(len(sizes), np.uint64)
            filled = np.flatnonzero(sizes)
            if len(filled):
                sums[filled] = np.add.reduceat(mix(hashes), at[filled])
            least, most = bits(sizes), bits(sizes * 100 // percent)
            for cut in range(int(most.max()) + 1):
                rows = np.flatnonzero((least <= cut) & (cut <= most) & (sizes > 0))
                taken, owner = ranges(at[:-1][rows], sizes[rows])
                found = hashes[taken]
                slot = (owner << cut) + ((found >> np.uint64(64 - cut)).astype(np.int64) if cut else 0)
                slots, begin = np.unique(slot, return_index=True)  # hashes ascend, so slots do
                row = rows[slots >> cut]
                yield batches_of(schema, [
                    part.column("doc_id").take(pa.array(row)), pa.array(sums[row].view(np.int64)), pa.array(sizes[row]),
                    pa.array(np.full(len(row), cut)), pa.array(slots & ((1 << cut) - 1)),
                    pa.ListArray.from_arrays(pa.array(np.append(begin, len(found)), pa.int32()), pa.array(found.view(np.int64))),
                ])

    return per_batch(work)


def _counter(schema: pa.Schema):
    """Overlaps of one row's block with its partners' blocks; the row itself comes before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, centres = None, []
        for batch in batches:
            keys = np.stack([batch.column(name).to_numpy() for name in ("a", "bits", "part", "salt")], 1)
            if not len(keys):
                continue
            partner = batch.column("b").is_valid().to_numpy(zero_copy_only=False)
            lists = batch.column("grams")
            at = lists.offsets.to_numpy()
            values = lists.values.to_numpy().view(np.uint64)
            version, size = batch.column("version").to_numpy(), batch.column("size").to_numpy()
            begin = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1)
            out = []
            for low, high in zip(begin, np.append(begin[1:], len(keys))):
                if held is None or (held != keys[low]).any():
                    held, centres = keys[low].copy(), []
                split = low + int(np.searchsorted(partner[low:high], True))
                centres += [(version[k], size[k], values[at[k] : at[k + 1]].copy()) for k in range(low, split)]
                if split == high:
                    continue
                met = values[at[split] : at[high]]
                for own, many, grams in centres:
                    hit = grams[np.minimum(np.searchsorted(grams, met), len(grams) - 1)] == met
                    shared = np.add.reduceat(hit, at[split:high] - at[split], dtype=np.int64)
                    rows = split + np.flatnonzero(shared)
                    out.append((rows, np.full(len(rows), own), np.full(len(rows), many), shared[rows - split]))
            if out:
                rows, own, many, shared = (np.concatenate(x) for x in zip(*out))
                yield batches_of(schema, [
                    pa.array(keys[rows, 0]), pa.array(own), pa.array(many), batch.column("b").take(pa.array(rows)),
                    pa.array(version[rows]), pa.array(size[rows]), pa.array(shared),
                ])

    return run


def links_of(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs (a, b, na, nb)`` whose sets reach the threshold, overlaps counted over all columns."""
    bits = F.expr(f"cast(greatest(0, length(bin(greatest(na, nb))) - {PART_BITS}) AS bigint)")
    degree = pairs.groupBy("a").agg(F.count("*").alias("n"))
    asked = pairs.join(degree, "a").select(
        "a", "b", bits.alias("bits"), F.expr(f"pmod(xxhash64(b), n div {PARTNERS} + 1)").alias("salt")
    )
    own = asked.select(F.col("a").alias("doc"), "a", F.lit(None).cast("bigint").alias("b"), "bits", "salt")
    asked = cut_lineage(own.union(asked.select(F.col("b").alias("doc"), "a", "b", "bits", "salt")).distinct())
    ids = cut_lineage(asked.select(F.col("doc").alias("doc_id")).distinct())
    few = asked.count() <= BROADCAST_IDS
    found = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = map_arrow(
        found.select("doc_id", "text"), lambda fields: _sets(fields, width, percent, PART_BITS),
        "doc bigint, version bigint, size bigint, bits bigint, part bigint, grams array<bigint>",
    )
    if found.count() > ids.count():  # rows that share an id
        sets = cut_lineage(sets.dropDuplicates(["doc", "version", "bits", "part"]))
    blocks = sets.join(F.broadcast(asked) if few else asked, ["doc", "bits"]).drop("doc")
    place = ["a", "bits", "part", "salt"]
    blocks = blocks.repartition(*place).sortWithinPartitions(*place, F.asc_nulls_first("b"))
    met = map_arrow(blocks, lambda fields: _counter(fields), "a bigint, va bigint, na bigint, b bigint, vb bigint, nb bigint, shared bigint")
    whole = met.groupBy("a", "va", "na", "b", "vb", "nb").agg(F.sum("shared").alias("shared"))
    return cut_lineage(whole.where((100 + percent) * F.col("shared") >= percent * (F.col("na") + F.col("nb"))).select("a", "b").distinct())


def _multiplier(schema: pa.Schema, percent: int):
    """A row for each pair of rows that meet in a place of the product; rows arrive by place, then size."""
    names = ("column", "lo", "hi", "block", "doc", "size", "label", "b1", "b2")

    def pairs(column, lo, hi, block, doc, size, label, b1, b2):
        out = []
        new = np.append(True, (column[1:] != column[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
        place = np.cumsum(new)
        rows, step = np.arange(len(column)), 1
        while len(rows):
            rows = rows[rows + step < len(column)]
            to = rows + step
            near = (place[rows] == place[to]) & (100 * size[rows] >= percent * size[to])
            rows, to = rows[near], to[near]
            flips = np.bitwise_count(b1[rows] ^ b1[to]).astype(np.int64) + np.bitwise_count(b2[rows] ^ b2[to])
            most = (100 - percent) * (size[rows] + size[to]) // (100 + percent)  # n-grams a link may differ in
            hit = (label[rows] != label[to]) & (flips <= most) & ((lo[rows] == hi[rows]) | (block[rows] != block[to]))
            x, y = rows[hit], to[hit]
            x, y = np.where(doc[x] < doc[y], x, y), np.where(doc[x] < doc[y], y, x)
            out.append((doc[x], doc[y], size[x], size[y]))
            step += 1
        return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [batch.column(name).to_numpy().view(np.uint64 if name in ("b1", "b2") else np.int64) for name in names]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            # the last place may go on in the next batch
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
            cut = int(np.argmax(last))
            held = [x[cut:] for x in rows]
            if cut:
                yield batches_of(schema, map(pa.array, pairs(*[x[:cut] for x in rows])))
        if held is not None and len(held[0]):
            yield batches_of(schema, map(pa.array, pairs(*held)))

    return run


def _differing(schema: pa.Schema):
    def folded(parity: bytes, size: int) -> np.ndarray:
        # bits are places modulo a power of two, so halves laid over each other are the shorter parity
        return np.bitwise_xor.reduce(np.frombuffer(parity, np.uint64).reshape(-1, size // 8), axis=0)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        both = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())
        sizes = ((x, y, min(len(x), len(y))) for x, y in both)
        flips = [int(np.bitwise_count(folded(x, n) ^ folded(y, n)).sum(dtype=np.int64)) for x, y, n in sizes]
        yield batches_of(schema, [*(batch.column(name) for name in ("a", "b", "na", "nb")), pa.array(flips, pa.int64())])

    return per_batch(work)


def not_ruled_out(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``pairs (a, b, na, nb)`` whose long parities differ in no more bits than linked rows may in n-grams."""
    left = classes.select(F.col("doc").alias("a"), F.col("size").alias("na"), F.col("parity").alias("x"))
    right = classes.select(F.col("doc").alias("b"), F.col("size").alias("nb"), F.col("parity").alias("y"))
    both = pairs.join(left, ["a", "na"]).join(right, ["b", "nb"]).select("a", "b", "na", "nb", "x", "y")
    told = map_arrow(both, _differing, "a bigint, b bigint, na bigint, nb bigint, flips bigint")
    told = told.where(f"flips <= {100 - percent} * (na + nb) div {100 + percent}").select("a", "b", "na", "nb")
    return cut_lineage(told.distinct())


def product_blocks(entries: DataFrame) -> DataFrame:
    """``entries (column, doc, size, b1, b2, label)`` dealt to the places ``(column, lo, hi)`` of the product.

    The largest component of a column makes the first blocks, which never meet
    each other; columns of one component are left out.
    """
    count = entries.groupBy("column", "label").agg(F.count("*").alias("n"))
    columns = count.groupBy("column").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main"))
    columns = cut_lineage(columns.where("n > main.n").selectExpr(
        "column", "main.label AS main", f"n <= {BLOCK_ROWS} AS small",
        f"(main.n - 1) div {BLOCK_ROWS} + 1 AS heavy", f"(n - main.n - 1) div {BLOCK_ROWS} + 1 AS light",
    ))
    dealt = entries.join(columns, "column").selectExpr(
        "*",
        """CASE WHEN small THEN 0L WHEN label = main THEN pmod(xxhash64(doc), heavy)
        ELSE heavy + pmod(xxhash64(doc), light) END AS block""",
    )
    dealt = dealt.selectExpr("*", """explode(CASE WHEN small THEN array(0L)
        WHEN label = main THEN sequence(heavy, heavy + light - 1) ELSE sequence(0L, heavy + light - 1) END) AS other""")
    return dealt.selectExpr("column", "least(block, other) AS lo", "greatest(block, other) AS hi", "block", "doc", "size", "label", "b1", "b2")


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document; links need ``percent`` / 100 similarity."""
    spark = docs.sparkSession
    docs = docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text"))
    levels = spark.sparkContext.broadcast(frequency_levels(docs, width))
    profiles = cut_lineage(map_arrow(
        docs, lambda fields: _profiler(levels, fields, width, percent),
        "doc_id bigint, size bigint, s1 bigint, s2 bigint, b1 bigint, b2 bigint, parity binary, prefix array<bigint>",
    ))
    same = ["size", "s1", "s2"]
    real = profiles.where("size > 0 AND doc_id IS NOT NULL")
    classes = cut_lineage(real.groupBy(*same).agg(
        F.min("doc_id").alias("doc"), F.any_value("b1").alias("b1"), F.any_value("b2").alias("b2"),
        F.any_value("parity").alias("parity"), F.any_value("prefix").alias("prefix")
    ))

    entries = columns_with_leaders(classes, percent)
    first = entries.where(
        (F.col("doc") != F.col("lead"))
        & (100 * F.least("size", "lead_size") >= percent * F.greatest("size", "lead_size"))
        & F.expr(f"bit_count(b1 ^ l1) + bit_count(b2 ^ l2) <= {100 - percent} * (size + lead_size) div {100 + percent}")
    )
    first = first.select(F.col("lead").alias("a"), F.col("doc").alias("b"), F.col("lead_size").alias("na"), F.col("size").alias("nb"))
    near = links_of(docs, not_ruled_out(first.distinct(), classes, percent), width, percent)
    labels = components(near)

    named = entries.select("column", "doc", "size", "b1", "b2").join(labels, F.col("doc") == F.col("node"), "left")
    places = product_blocks(named.withColumn("label", F.coalesce("root", "doc")).drop("node", "root"))
    places = places.repartition("column", "lo", "hi").sortWithinPartitions("column", "lo", "hi", "size", "doc")
    met = map_arrow(places, lambda fields: _multiplier(fields, percent), "a bigint, b bigint, na bigint, nb bigint")
    # all but the last ceil(t * larger) - 1 columns of a row were multiplied; the rest cannot add more than that
    least = F.expr(f"ceil({percent} * (na + nb) / {100 + percent}) - ceil({percent} * greatest(na, nb) / 100) + 1")
    met = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    far = links_of(docs, not_ruled_out(met.select("a", "b", "na", "nb"), classes, percent), width, percent)
    reached = components(near.union(far))

    named = profiles.select("doc_id", *same).join(classes.select(*same, "doc"), same, "left")
    named = named.join(reached, F.col("doc") == F.col("node"), "left")
    return named.select(
        "doc_id", F.col("size").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc", "doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with only the smallest id of every component; of rows with one id, one stays.

    Rows without an id stay. Columns are those of ``docs``.
    """
    found = jaccard_components(docs, doc_id, text, width, percent)
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    whole = docs.select(F.struct("*").alias("row"), col(doc_id).cast("bigint").alias("_id"))
    without = whole.where("_id IS NULL").select("row.*")
    one = whole.join(stay, "_id").groupBy("_id").agg(F.first("row").alias("row"))
    return one.select("row.*").union(without)
