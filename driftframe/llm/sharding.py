"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

A group's share is the largest of its shares of bytes, tokens and rows. Documents with equal texts form a group that stays together
unless it is larger than a shard in any of the three; such a group is cut into parts by
hash of doc_id. Groups of at least a HEAVY-th of a shard are items of their own; all others are gathered by hash into bundles
of about that size, whose vectors are sums. A single row larger than a shard can't be cut: it gets a shard, and the others
share what is left. So the number of items depends on the number of shards alone and the packing
runs on the driver over at most a few hundred small vectors a shard, however many documents there are. Items are placed from the
largest to the smallest, each where it fits in bytes, tokens and rows and the dot product of its vector with the shard's residual
capacity is highest; then items are moved and swapped between shards while that evens out what is left in all three. The law `bytes`
holds: shard sizes come out near equal.

Defined cases: a null text has 0 bytes and 0 tokens, counts as empty and is in one group with empty texts; repeated rows are
rows like others; a null doc_id is hashed like a value; fewer rows than shards leave shards empty; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.llm.common import n_words, sized, stored
from driftframe.llm.ranks import hash_order, running

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: A group larger than a shard is cut into parts of about this share of one; a group of at least 1/HEAVY of a shard is an item;
#: bundles for each shard, fewer where there are so many shards that all bundles would be more than ALL_BUNDLES.
PART = 1 / 16
HEAVY = 64
BUNDLES = 256
LEAST_BUNDLES = 16
ALL_BUNDLES = 1 << 17
LAW = "bytes"
#: What is balanced, jointly: a size, each as a share of its total.
DIMENSIONS = ("bytes", "tokens", "rows")
#: Weight of each dimension's imbalance when items are exchanged: the law is about bytes.
WEIGHTS = (4.0, 1.0, 1.0)
#: Exchanges tried at most for each shard, and partners looked at in each.
EXCHANGES = 40
PARTNERS = 6


def capacity_left(share: np.ndarray, shards: int) -> np.ndarray:
    """What a shard may hold: an item of more than a shard, in any dimension, has one, and the others share what is left."""
    left, free = share.sum(0), shards
    for v in share[np.argsort(-share.max(1), kind="stable")]:
        if free <= 1 or (v <= left / free).all():
            break
        left, free = left - v, free - 1
    return left / free


def place(share: np.ndarray, capacity: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of shares), the largest first: of the shards where it fits in every dimension, that where the dot product of
    its vector with the residual capacity is highest; if it fits in none, that whose least residual is then highest."""
    residual = np.tile(capacity, (shards, 1))
    placed = np.zeros(len(share), np.int64)
    for item in np.lexsort((np.arange(len(share)), -share.sum(1))):
        v = share[item]
        fits = (residual >= v).all(1)
        best = int(np.argmax(np.where(fits, residual @ v, -np.inf))) if fits.any() else int(np.argmax((residual - v).min(1)))
        placed[item] = best
        residual[best] -= v
    return placed


def exchange(share: np.ndarray, placed: np.ndarray, capacity: np.ndarray, shards: int) -> np.ndarray:
    """placed with items moved or swapped between pairs of shards while that lessens the weighted squares of their residuals."""
    weight = np.sqrt(np.array(WEIGHTS)[: share.shape[1]])
    x, room = share * weight / capacity, np.tile(weight, (shards, 1))
    np.subtract.at(room, placed, x)
    placed, stuck = placed.copy(), np.zeros(shards, bool)
    for _ in range(EXCHANGES * shards):
        cost = np.where(stuck, -1.0, (room**2).sum(1))
        s = int(cost.argmax())
        if cost[s] < 1e-8:
            break
        mine = np.flatnonzero(placed == s)
        others = np.argsort(room @ room[s], kind="stable")[:PARTNERS]
        theirs = np.flatnonzero(np.isin(placed, others[others != s]))
        gives = np.concatenate([x[mine], np.zeros((1, x.shape[1]))])  # the last stands for no item
        # a move or swap takes d from s to t: the change of both shards' squares
        takes = np.concatenate([x[theirs], np.zeros((len(others), x.shape[1]))])
        to = np.concatenate([placed[theirs], others])
        d = gives[:, None, :] - takes[None, :, :]
        change = (2 * d * (room[s] - room[to])[None, :, :] + 2 * d * d).sum(2)
        change[:, to == s] = 0.0
        i, j = np.unravel_index(int(change.argmin()), change.shape)
        if change[i, j] > -1e-9:
            stuck[s] = True
            continue
        t = int(to[j])
        if i < len(mine):
            placed[mine[i]] = t
        if j < len(theirs):
            placed[theirs[j]] = s
        room[s] += d[i, j]
        room[t] -= d[i, j]
        stuck[[s, t]] = False
    return placed


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of bytes, tokens, rows), placed by dot product with residual capacity, then evened out by exchanges."""
    share = vectors / np.maximum(vectors.sum(0), 1)
    capacity = np.maximum(capacity_left(share, shards), 1e-12)
    return exchange(share, place(share, capacity, shards), capacity, shards)


def fair_share(total: float, shards: int, rows: list[tuple[float, int]]) -> float:
    """Size of a shard when single rows larger than that have one each; rows: (size, how many) of the largest rows."""
    left, free = total, shards
    for size, count in sorted(rows, reverse=True):
        for _ in range(min(count, free)):
            if free <= 1 or size <= left / free:
                return max(left / max(free, 1), 1.0)
            left, free = left - size, free - 1
    return max(left / max(free, 1), 1.0)


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in its shard), grown_shard (null: law `bytes`)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        n_words().alias("tokens"), F.md5(text.cast("binary")).alias("group_"),
    )
    rows = stored(rows, "shard-rows", mapped=True)
    groups = rows.groupBy("group_").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    groups = stored(groups, "shard-groups", rows.count())
    total = groups.agg(*(F.sum(d).alias(d) for d in DIMENSIONS)).first()
    if not total["rows"]:
        return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
    capacity = {d: max(total[d] / shards, 1.0) for d in DIMENSIONS}
    # for each dimension at most HEAVY groups a shard are that heavy, and they split into at most 1 / PART parts a shard more
    heavy = groups.where(F.greatest(*(F.col(d) / capacity[d] for d in DIMENSIONS)) >= 1 / HEAVY).collect()
    capacity = {d: fair_share(total[d], shards, [(r[d] / r["rows"], r["rows"]) for r in heavy]) for d in DIMENSIONS}
    shares = {r["group_"]: max(r[d] / capacity[d] for d in DIMENSIONS) for r in heavy}
    parts = {r["group_"]: 1 if shares[r["group_"]] <= 1 else min(int(-(-shares[r["group_"]] // PART)), r["rows"]) for r in heavy}
    light = groups.join(sized(spark.createDataFrame([(g,) for g in parts], "group_ string")), "group_", "left_anti")
    n_bundles = shards * max(LEAST_BUNDLES, min(BUNDLES, ALL_BUNDLES // shards))
    bundle = F.pmod(F.xxhash64("group_", F.lit("bundle")), F.lit(n_bundles)).cast("int")
    bundles = light.groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")).collect()

    split = {g: p for g, p in parts.items() if p > 1}
    marks = spark.createDataFrame([(g, p) for g, p in parts.items()], "group_ string, parts int")
    part = F.pmod(F.xxhash64("doc_id", "size", F.lit("part")), F.col("parts")).cast("int")
    marked = rows.join(sized(marks), "group_", "left").withColumn("part", F.when(F.col("parts").isNotNull(), part))
    sums = []
    if split:
        sums = marked.where(F.col("parts") > 1).groupBy("group_", "part").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).collect()
    items = [((r["group_"], r["part"], None), r) for r in sums] + [((r["group_"], 0, None), r) for r in heavy if r["group_"] not in split] + [((None, None, r["bundle"]), r) for r in bundles]
    items.sort(key=lambda x: tuple((v is not None, v) for v in x[0]))  # rows come from the cluster in any order
    placed = pack(np.array([[r["bytes"], r["tokens"], r["rows"]] for _, r in items], float), shards)
    where = spark.createDataFrame([(*k, int(s)) for (k, _), s in zip(items, placed, strict=True)], "g string, p int, b int, shard int")

    at = marked.withColumn("bundle", F.when(F.col("parts").isNull(), bundle))
    by_bundle = sized(where.where("b is not null").select("b", F.col("shard").alias("s_bundle")))
    by_part = sized(where.where("g is not null").select("g", "p", F.col("shard").alias("s_part")))
    at = at.join(by_bundle, at["bundle"] == F.col("b"), "left")
    at = at.join(by_part, (at["group_"] == F.col("g")) & (at["part"] == F.col("p")), "left")
    at = at.select("doc_id", "size", "text_crc32", F.coalesce("s_part", "s_bundle").alias("shard"), F.xxhash64("group_").alias("tie_"))
    order = [hash_order("doc_id", "text_crc32", seed="slot"), F.col("doc_id"), F.col("tie_"), F.col("size")]
    out = running(at, ["shard"], order, F.lit(1).cast("long"), 2 * total["rows"] // shards, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
