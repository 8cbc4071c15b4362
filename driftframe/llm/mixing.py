"""Mixing sources to target weights by a low-discrepancy schedule over shuffled equal-token blocks.

Slot i of the mix takes the van der Corput point of i (its bits mirrored behind the point) through the cumulative shares of
the sources; the slots of a source are ranked, and its j-th slot takes its j-th block. A source's documents, shuffled by hash,
lie end to end on a line of words, run through again from the start when the target exceeds one pass; the line up to the
target is cut into as many blocks of equal words as the source has slots. A document's taken words are the overlaps of its
places on the line with the blocks. Points, ranks, offsets and blocks are all made in parallel: ranks and offsets are running
totals over hash buckets, so that a source with most of the rows is spread over tasks.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, last; repeated rows are documents of
their own; a null doc_id is hashed like a value; rows are ordered by hashes of what they hold, so reruns agree on any partitions; a
source with words but without a slot gets one; a mix without any word takes 0 everywhere; an empty table gives an empty result; other
columns are ignored by mix() and pass through apply(), whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.llm.common import keyed, n_words, plain, sized, stored
from driftframe.llm.ranks import hash_order, running

#: Weights of sources in order of code points, the share of all sizes that the mix takes, the most passes over a source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
#: Words of a block, about.
BLOCK_WORDS = 4096
CHUNK = 1 << 14


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> list[float]:
    """Words of each source: share of the total by weight, none above PASSES times its size, the excess dealt again by weight."""
    size = np.array(sizes, float)
    weight = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    out, free, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), share * size.sum()
    while free.any():
        offer = left * weight / weight[free].sum()
        full = free & (offer >= PASSES * size)
        if not full.any():
            out[free] = offer[free]
            break
        out[full] = PASSES * size[full]
        left -= out[full].sum()
        free &= ~full
    return [float(x) for x in out]


def van_der_corput(i: Column) -> Column:
    """The 52 low bits of i mirrored behind the point."""
    mirrored = F.conv(F.rpad(F.reverse(F.conv(i, 10, 2)), 52, "0"), 2, 10)
    return mirrored.cast("double") / F.lit(float(1 << 52))


def schedule(spark, wanted: list[float], block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source, rank, of): the source of each slot of the mix, the slot's rank in it and the source's number of slots.

    Points find their source by an equi-join on cells of the unit interval, in each of which few sources begin or end.
    """
    total = sum(wanted)
    n = max(int(-(-total // block_words)), sum(w > 0 for w in wanted)) if total else 0
    cells = 1
    while cells < 4 * len(wanted):
        cells *= 2
    ends = np.cumsum(np.array(wanted) / total) if total else np.zeros(len(wanted))
    ends[-1:] = 1.0
    begins = np.concatenate([[0.0], ends[:-1]]) if len(ends) else ends
    spans = [(i, float(w), float(b), float(e)) for i, (w, b, e) in enumerate(zip(wanted, begins, ends, strict=True)) if e > b and w > 0]
    spans = spark.createDataFrame(spans, "source int, target double, begin double, end double")
    last = F.least(F.floor(F.col("end") * cells), F.lit(cells - 1))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("begin") * cells), last)))
    slots = spark.range(0, n).withColumn("u", van_der_corput(F.col("id"))).withColumn("cell", F.floor(F.col("u") * cells))
    slots = slots.join(sized(spans), "cell").where("u >= begin and u < end").select(F.col("id").alias("slot"), "source")
    chunk = F.floor(F.col("slot") / CHUNK)
    counts = slots.groupBy(chunk.alias("chunk"), "source").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("chunk", "source", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("chunk", "source").orderBy("slot")) - 1
    ranked = slots.withColumn("chunk", chunk).withColumn("nth", nth).join(offsets, ["chunk", "source"])
    ranked = ranked.select("slot", "source", (F.col("before") + F.col("nth")).alias("rank"))
    # sources too small for any slot
    used = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("of"))
    wanted_rows = spark.createDataFrame([(i, float(w)) for i, w in enumerate(wanted) if w > 0], "source int, target double")
    used = wanted_rows.join(used, "source", "left").select("source", "target", F.coalesce("of", F.lit(1)).alias("of"), F.col("of").isNull().alias("late"))
    late = used.where("late").select((F.lit(n) + F.col("source")).cast("long").alias("slot"), "source", F.lit(0).cast("long").alias("rank"))
    return ranked.unionByName(late).join(used.select("source", "target", "of"), "source")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return _mix(keyed(rows, ["doc_id", "text"]), weights, share).select("doc_id", "size", "source_size", "target", "taken")


def apply(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """docs as the mix takes them: each row as often as its taken words make up its size (rounded, a half up), with docs' columns.

    Documents are shuffled once, to meet the plan of their key, a hash of all columns; rows that agree in every column share a plan.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    at = {n: c for n, c in reversed(list(zip(docs.columns, columns, strict=True)))}
    rows = keyed(plain(docs), columns)
    named = rows.select(F.col(at["doc_id"]).cast("long").alias("doc_id"), F.col(at["source"]).cast("string").alias("source"), F.col(at["text"]).cast("string").alias("text"), "k1", "k2")
    copies = F.when(F.col("size") > 0, F.floor(F.try_divide(F.col("taken"), F.col("size")) + 0.5)).otherwise(0).cast("int")
    plan = _mix(named, weights, share).groupBy("k1", "k2").agg(F.sum(copies).alias("times"), F.count(F.lit(1)).alias("rows")).where("times > 0")
    plan = stored(plan, "mix-plan", docs.count())
    met = rows.join(sized(plan.where("rows = 1").select("k1", "k2", "times")), ["k1", "k2"]).select(F.col("times").alias("times_"), *columns)
    several = plan.where("rows > 1").select("k1", "k2", "times")
    if not several.isEmpty():
        one = rows.join(sized(several), ["k1", "k2"]).groupBy("k1", "k2", "times").agg(F.first(F.struct(*columns)).alias("row"))
        met = met.unionByName(one.select(F.col("times").alias("times_"), "row.*"))
    return met.withColumn("times_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times_")))).select(*columns).toDF(*docs.columns)


def _mix(docs: DataFrame, weights: tuple[int, ...], share: float) -> DataFrame:
    """mix() of docs(doc_id, source, text, k1, k2), with k1 and k2, which tell rows apart but for repeated ones."""
    spark = docs.sparkSession
    rows = stored(docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64("text").alias("t1"), "k1", "k2"), "mix-rows", mapped=True)
    # sources are the mix's dimension, with a weight each
    found = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([r["words"] for r in found], weights, share)
    dimension = spark.createDataFrame(
        [(r["source"], i, r["words"], w) for i, (r, w) in enumerate(zip(found, wanted, strict=True))], "source string, s int, source_size long, target double"
    )
    at = rows.join(sized(dimension.withColumnRenamed("source", "name")), rows["source"].eqNullSafe(F.col("name"))).drop("name")
    order = [hash_order("doc_id", "size", "t1", seed="mix"), *(F.col(c) for c in ("doc_id", "size", "t1", "k1", "k2"))]
    at = running(at, ["s"], order, F.col("size"), max((r["rows"] for r in found), default=0), "offset")
    at = at.withColumn("row", F.monotonically_increasing_id())
    at = stored(at, "mix-lines", sum(r["rows"] for r in found))

    # the line of a source: its words from 0, again from source_size; block j covers [floor(j t / n), floor((j + 1) t / n))
    slots = stored(schedule(spark, wanted), "mix-slots", int(sum(wanted) // BLOCK_WORDS) + len(wanted))
    n_slots = sized(slots.groupBy(F.col("source").alias("s")).agg(F.first("of").alias("of")))
    end = F.floor(F.col("target"))
    edge = lambda j: F.floor(j * F.floor(F.col("target")) / F.col("of"))
    lines = at.where("size > 0 and target >= 1").drop("t1", "k1", "k2").join(n_slots, "s").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))))
    lines = lines.withColumn("from", F.col("offset") + F.col("pass") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), end)).where("from < to")
    first = F.greatest(F.floor(F.col("from") * F.col("of") / end) - 1, F.lit(0)).cast("long")
    last = F.least(F.floor(F.col("to") * F.col("of") / end) + 1, F.col("of") - 1).cast("long")
    pieces = lines.withColumn("rank", F.explode(F.sequence(first, last)))
    pieces = pieces.withColumn("words", F.least("to", edge(F.col("rank") + 1)) - F.greatest("from", edge(F.col("rank")))).where("words > 0")
    taken = pieces.select(F.col("s").alias("source"), "rank", "row", "words").join(slots.select("source", "rank"), ["source", "rank"])
    taken = taken.groupBy("row").agg(F.sum("words").alias("taken"))
    out = at.join(taken, "row", "left")
    return out.select("doc_id", "k1", "k2", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
