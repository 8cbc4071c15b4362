"""Fingerprints, keys and components against brute force."""

import random

import numpy as np
import xxhash

from driftframe.llm import simhash
from driftframe.llm.components import components
from driftframe.llm.golay import decode, near_indices


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_equal_brute_force():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 4, 50]:
        text = " ".join(rng.choice(["Ab", "É", "cD\t", "x\n", "zz"]) for _ in range(n))
        assert simhash.fingerprint(text) == brute_print(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n\t") == 0


def test_every_word_is_within_three_of_one_codeword():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 23, 5000)
    near = near_indices(x)
    assert ((near == decode(x)[:, None]).any(1)).all() and near.shape == (5000, 6)
    flipped = x ^ (1 << rng.integers(0, 23, 5000))
    assert (near_indices(x) == decode(flipped)[:, None]).any(1).all()
    sizes = np.bincount([len(set(r)) for r in near.tolist()], minlength=7)
    assert sizes[1] + sizes[6] == 5000


def test_pigeonhole_never_misses():
    rng = np.random.default_rng(3)
    a = rng.integers(-(2**63), 2**63 - 1, 4000, dtype=np.int64)
    b = a.copy().view(np.uint64)
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(1, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    met = np.zeros(len(a), bool)
    left, right = [set() for _ in a], [set() for _ in a]
    for out, fp, near in ((left, a, True), (right, b.view(np.int64), False)):
        for r, k in zip(*simhash.keys(fp, near), strict=True):
            out[r].add(k)
    met = [bool(x & y) for x, y in zip(left, right, strict=True)]
    assert all(met)


def test_links_of_dense_groups_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    found = set()
    for b in rng.integers(-(2**63), 2**63 - 1, 40, dtype=np.int64).tolist():
        found.add(b)
        for _ in range(20):
            u = b & (2**64 - 1)
            for k in rng.choice(64, rng.integers(1, 5), replace=False):
                u ^= 1 << int(k)
            found.add(u - 2**64 if u >> 63 else u)
    fp = sorted(found)
    want = {(a, b) for i, a in enumerate(fp) for b in fp[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = simhash.links(spark.createDataFrame([(x,) for x in fp], "fp long")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_components_of_paths_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(-5, 500), (500, -5), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(30)}, -5: -5, 500: -5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def documents(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(10, " ".join(base)), (11, " ".join(base)), (12, " ".join([*base[:399], "other"])), (13, " ".join(base).upper()), (9, " ".join([*base[1:], "x"]))]
    rows += [(20 + i, " ".join(f"w{rng.randrange(5000)}" for _ in range(200))) for i in range(60)]
    rows += [(1, None), (2, ""), (3, " \n"), (None, " ".join(base)), (10, " ".join(base)), (90, "one"), (91, "one"), (None, "only me here")]
    return rows, spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component_id string")


def test_groups_equal_brute_force(spark):
    rows, d = documents(spark)
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), p, str(least.get(r))) for (i, _), p, r in zip(rows, prints, root, strict=True))
    got = sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), str(r["component_id"])) for r in simhash.groups(d).collect())
    assert got == want
    assert simhash.groups(d.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    _, d = documents(spark)
    kept = simhash.deduplicate(d)
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    named = {r["component_id"] for r in simhash.groups(d).collect() if r["component_id"] is not None}
    assert kept.columns == d.columns and ids == sorted(named) and 1 in ids and 2 not in ids and 11 not in ids


def test_keys_are_long_and_a_pair_is_taken_once(spark):
    from pyspark.sql import functions as F

    assert len(simhash.KINDS) < 64
    assert min(mask.bit_count() + (12 if decoded else 0) for mask, decoded in simhash.KINDS) >= 40
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(4000):
        d = 0
        for k in rng.choice(64, rng.integers(1, 4), replace=False):
            d |= 1 << int(k)
        rows.append((d - 2**64 if d >> 63 else d,))
    rows += [(d - 2**64 if d >> 63 else d,) for d in (1 << i for i in range(64))]
    for r in spark.createDataFrame(rows, "d long").select("d", simhash._kind_of(F.col("d")).alias("kind")).collect():
        mask, decoded = simhash.KINDS[r["kind"]]
        d = r["d"] & (2**64 - 1)
        assert d & mask == 0 and (decoded is None or (d & {"A": simhash.A, "B": simhash.B}[decoded]).bit_count() <= 1)


def test_every_group_keeps_one_row_where_ids_repeat(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(80)) for k in "abc"}
    rows = [(1, text["a"]), (5, text["a"]), (5, text["b"]), (7, text["b"]), (8, text["c"]), (8, text["c"] + " " + text["a"]), (9, text["c"])]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        kept = simhash.deduplicate(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert sorted(map(tuple, kept)) == sorted([rows[0], rows[2], rows[4], rows[5]])


def brute_kept(rows, columns):
    """Groups by brute force; of each the row with the least doc_id, nulls last, if only one has it."""
    prints = [brute_print(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    out = {}
    for r, g in zip(rows, root, strict=True):
        out.setdefault(g, []).append(r)
    return [[r for r in g if (r[0] is None, r[0] or 0) == min((x[0] is None, x[0] or 0) for x in g)] for g in out.values()]


def test_one_row_stays_on_any_number_of_partitions(spark):
    rng = random.Random(8)
    text = [" ".join(f"{k}w{i}" for i in range(60)) for k in range(8)]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([*text, "", None, " "]), rng.choice("xy"), rng.choice([{"a": 1}, None])) for _ in range(60)]
    rows += [(3, text[1], "x", None), (5, text[0], "x", None), (5, text[1], "x", None), (7, text[0], "x", None), *rows[:9], (9, "word " * 120_000, "k1", None)]
    ddl = "doc_id long, text string, k1 string, nth_ map<string,int>"
    got = []
    for parts in (1, 4, 7):
        d = spark.createDataFrame(rng.sample(rows, len(rows)), ddl).repartition(parts)
        out = simhash.deduplicate(d)
        assert out.columns == d.columns
        got.append(sorted(map(str, map(tuple, out.collect()))))
    assert got[0] == got[1] == got[2]
    groups = brute_kept(rows, 4)
    assert len(got[0]) == len(groups) and all(sum(str(tuple(r)) in got[0] for r in {str(r): r for r in g}.values()) == 1 for g in groups)
    assert simhash.deduplicate(spark.createDataFrame([], ddl)).count() == 0
