"""Shards and mixes: their laws, against brute force where there is one."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftframe.llm import mixing, sharding
from driftframe.llm.ranks import hash_order, running


def table(spark, n=3000, hot=True):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)) + str(i), f"s{i % 7}") for i in range(n)]
    if hot:
        rows += [(10_000 + i, "the very same text in a great many copies", "hot") for i in range(n // 2)]
    rows += [(20_000, None, None), (20_001, "", None), (20_002, "long " * 20_000, "s1"), (None, "no id", "s1"), (0, rows[0][1], "s0"), (0, rows[0][1], "s0"), (20_003, "gap", "empty source?")]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")


def test_shards_are_near_equal_and_gapless(spark):
    rows, d = table(spark)
    got = sharding.shard(d, 40).collect()
    assert len(got) == len(rows)
    size = {}
    slots = {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    big = max(len((t or "").encode()) + 16 for _, t, _ in rows)
    rest = [v for v in size.values() if v < big]
    assert max(rest) - min(rest) <= 0.02 * np.mean(rest)
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want


def test_equal_texts_stay_together(spark):
    rows = [(i, f"text {i % 300} " + "x" * (i % 300)) for i in range(1500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    at = {}
    for r in got:
        at.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in at.values())


def test_reruns_agree_and_edges(spark):
    _, d = table(spark, 200)
    one, two = (sorted(map(tuple, sharding.shard(x, 7).select("doc_id", "shard", "slot").fillna(-1).collect())) for x in (d, d.repartition(5)))
    assert one == two
    assert sharding.shard(d.limit(0), 40).count() == 0
    assert sharding.shard(d.limit(1), 40).collect()[0]["slot"] == 0


def test_many_rows_of_few_bytes_are_spread(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.col("id").cast("string"), F.repeat(F.lit(" some words"), 20))).alias("text"))
    got = sharding.shard(d, 8).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
    rows, sizes = [r["n"] for r in got], [r["size"] for r in got]
    assert len(got) == 8 and sum(rows) == 6000 and max(rows) < 1.05 * 750 and max(sizes) < 1.02 * sum(sizes) / 8


def plain_place(share, capacity, shards):
    """The rule of place(), item by item and shard by shard."""
    left = [list(capacity) for _ in range(shards)]
    out = [0] * len(share)
    for i in sorted(range(len(share)), key=lambda i: (-sum(share[i]), i)):
        v = share[i]
        fitting = [s for s in range(shards) if all(a >= b for a, b in zip(left[s], v, strict=True))]
        if fitting:
            best = max(fitting, key=lambda s: (sum(a * b for a, b in zip(left[s], v, strict=True)), -s))
        else:
            best = max(range(shards), key=lambda s: (min(a - b for a, b in zip(left[s], v, strict=True)), -s))
        out[i] = best
        left[best] = [a - b for a, b in zip(left[best], v, strict=True)]
    return out


def test_placing_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    for n, shards in ((60, 5), (200, 7), (3, 4)):
        v = rng.integers(1, 64, (n, 3)) / 1024.0
        capacity = np.maximum(sharding.capacity_left(v, shards), 1e-9)
        assert sharding.place(v, capacity, shards).tolist() == plain_place(v.tolist(), capacity.tolist(), shards)


def test_packing_balances_all_three():
    rng = np.random.default_rng(0)
    v = rng.lognormal(size=(2000, 3)) * [1000, 200, 1]
    placed = sharding.pack(v, 16)
    totals = np.array([v[placed == s].sum(0) for s in range(16)])
    assert ((np.ptp(totals, axis=0) / totals.mean(0)) < [0.01, 0.02, 0.02]).all()
    assert sharding.pack(np.array([[1.0, 1, 1]]), 3).tolist() == [0]
    giant = sharding.pack(np.array([[500.0, 5, 1], *[[1.0, 1, 1]] * 90]), 4)
    assert sorted(np.bincount(giant[1:], minlength=4).tolist()) == [0, 30, 30, 30] and giant[0] not in giant[1:]


def test_shards_balance_bytes_tokens_and_rows(spark):
    rng = random.Random(5)
    d = spark.createDataFrame([(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 120)))) for i in range(2400)], "doc_id long, text string")
    at = sharding.shard(d, 12).join(d.select("doc_id", F.size(F.split("text", " ")).alias("tokens")), "doc_id")
    got = np.array([tuple(r) for r in at.groupBy("shard").agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).drop("shard").collect()], float)
    assert len(got) == 12 and ((np.ptp(got, axis=0) / got.mean(0)) < [0.005, 0.02, 0.02]).all()


def plain_targets(sizes):
    weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    full, out = set(), [0.0] * len(sizes)
    while True:
        left = 1.5 * sum(sizes) - sum(2 * sizes[i] for i in full)
        free = [i for i in range(len(sizes)) if i not in full]
        for i in free:
            out[i] = left * weight[i] / sum(weight[j] for j in free)
        over = [i for i in free if out[i] > 2 * sizes[i]]
        if not over:
            return [2 * sizes[i] if i in full else out[i] for i in range(len(sizes))]
        full |= set(over)


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 50, 3], [10], [0, 5, 5], [5, 5, 1000, 2, 1, 400]])
def test_targets_share_out_the_excess(sizes):
    assert mixing.targets(sizes) == pytest.approx(plain_targets(sizes))


def test_points_are_the_mirrored_bits(spark):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(9).select(mixing.van_der_corput(F.col("id"))).collect()]
    assert got == [0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875, 0.0625]


def test_schedule_follows_the_shares_everywhere(spark):
    s = mixing.schedule(spark, [6000.0, 3000.0, 1000.0], block_words=1).orderBy("slot").toPandas()
    for n in (50, 500, 5000):
        share = s.head(n)["source"].value_counts(normalize=True)
        assert abs(share[0] - 0.6) < 12 / n and abs(share[2] - 0.1) < 12 / n
    assert (s.sort_values("slot").groupby("source")["rank"].apply(list).apply(lambda x: x == list(range(len(x))))).all()


def test_mix_meets_its_targets(spark):
    rows, d = table(spark)
    got = mixing.mix(d).collect()
    words = lambda t: len((t or "").replace("\n", " ").split())
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), words(t)) for i, t, _ in rows)
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(words(t) for _, t, s in rows if s == n) for n in names]
    want = plain_targets(sizes)
    for n, size, target in zip(names, sizes, want, strict=True):
        of = [r for r in got if r["source_size"] == size and r["target"] == pytest.approx(target)]
        assert of and abs(sum(r["taken"] for r in of) - target) <= 1 + 0.001 * target
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted((str(r["doc_id"]), r["taken"]) for r in got) == sorted((str(r["doc_id"]), r["taken"]) for r in mixing.mix(d.repartition(7)).collect())


def test_mix_applies_and_edges(spark):
    _, d = table(spark, 300)
    plan = {}
    for r in mixing.mix(d).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + (int(r["taken"] / r["size"] + 0.5) if r["size"] else 0)
    out = mixing.apply(d)
    n = {}
    for r in out.select("doc_id").collect():
        n[r[0]] = n.get(r[0], 0) + 1
    assert out.columns == d.columns and n == {k: v for k, v in plan.items() if v}
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.apply(d.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(empty).collect()] == [0, 0]


def test_running_totals_over_buckets(spark, monkeypatch):
    from pyspark.sql import functions as F

    from driftframe.llm import ranks

    monkeypatch.setattr(ranks, "BUCKET_ROWS", 3)
    d = spark.createDataFrame([(i, "a" if i % 3 else None, i % 5) for i in range(200)], "i long, g string, v long")
    got = running(d, ["g"], [hash_order("i"), F.col("i")], F.col("v"), 200, "before").withColumn("o", hash_order("i")).toPandas()
    for _, part in got.groupby("g", dropna=False):
        part = part.sort_values(["o", "i"])
        assert (part["before"] == part["v"].cumsum() - part["v"]).all()


def test_mix_is_the_same_whatever_the_partitions_and_names(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2, 3, 4]), " ".join(["w"] * rng.choice([0, 1, 3, 9, 40])) or None, rng.choice(["a", "b", None]), rng.randint(0, 2), "x") for _ in range(200)]
    ddl = "doc_id long, text string, source string, k1 int, times_ string"
    plan, out = [], []
    for parts in (1, 3, 7):
        d = spark.createDataFrame(rng.sample(rows, len(rows)), ddl).repartition(parts)
        plan.append(sorted(str(tuple(r)) for r in mixing.mix(d).collect()))
        got = mixing.apply(d)
        assert got.columns == d.columns
        out.append(sorted(str(tuple(r)) for r in got.collect()))
    assert plan[0] == plan[1] == plan[2] and out[0] == out[1] == out[2]
    assert set(out[0]) <= {str(r) for r in rows}


def plain_taken(rows, targets, size, slots_of, order):
    """Words taken of each row of one source, by walking its line block by block."""
    line = [i for i in order for _ in range(rows[i])]
    end = int(targets)
    taken = [0] * len(rows)
    for j in range(slots_of):
        for w in range(j * end // slots_of, (j + 1) * end // slots_of):
            taken[line[w % size]] += 1
    return taken


def test_taken_words_equal_a_walk_along_the_line(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "c"])) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(d).collect()}
    keys = {r["doc_id"]: tuple(r)[1:] for r in d.withColumn("size", mixing.n_words()).withColumn("t1", F.xxhash64("text")).select("doc_id", hash_order("doc_id", "size", "t1", seed="mix").alias("o")).collect()}
    for name in "abc":
        of = [i for i, _, s in rows if s == name]
        sizes = [len(rows[i][1].split()) for i in of]
        order = sorted(range(len(of)), key=lambda k: (keys[of[k]][0], of[k]))
        target = got[of[0]]["target"]
        want = plain_taken(sizes, target, sum(sizes), 1, order)
        assert [got[i]["taken"] for i in of] == want
