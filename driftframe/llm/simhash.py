"""SimHash near-duplicates, linked by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into A (23 bits), B (23 bits) and C (18 bits); A, B and C are cut further into thirds, B into quarters.
A codeword index of the perfect Golay code stands for a whole neighbourhood, so a segment with one flipped bit still meets a
partner's index. Two fingerprints with at most 3 differing bits (a in A, b in B, c in C) meet, by pigeonhole, under a key of

    a = b = 0                  (A, B)
    a = c = 0                  (A, C)
    b = c = 0                  (B, C)
    a = 0, b = 1, c <= 2       (A, near(B), a third of C)
    a = 0, b = 2, c = 1        (A, a third of B, two thirds of C)
    b = 0, a = 1, c <= 2       (B, near(A), a third of C)
    b = 0, a = 2, c = 1        (B, a third of A, two thirds of C)
    c = 0, a = 1, b <= 2       (C, two thirds of A, a third of B)
    c = 0, a = 2, b = 1        (C, two thirds of B, a third of A)
    a = b = c = 1              (near(A), three quarters of B, two thirds of C)

with the parts that the differing bits leave whole. near(S) is the up to six indices on the one side, decode(S) the single index on
the other. Every key has 40 bits or more, so that chance meetings stay few as documents grow. Only distinct fingerprints are
joined, and the join's own condition verifies the distance and that a pair is taken under the first of its keys alone: copies never
multiply, a pair is given out once and no partner is left out. Components come from star contraction over verified links.

Defined cases: a null, empty or blank text has no shingle and fingerprint zero, linked like any other; repeated rows share
their fingerprint and group; a row with null doc_id belongs to its group but never names it (component_id null if nobody
else does); an empty table gives an empty result; other columns are ignored by groups() and pass through deduplicate().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftframe.llm.common import arrow_map, keyed, plain, sized, stored
from driftframe.llm.components import components
from driftframe.llm.golay import decode, near_indices

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
#: Fingerprints of a task that makes keys.
KEYED_ROWS = 25_000


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of a whole text: a bit is set if it is set in over half the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size).tolist()
    last = end[SHINGLE - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(start, last, strict=False)])
    votes = np.zeros(64, np.int64)
    hashes = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    for k in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[k : k + 65536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every whole text, and the long columns in more."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp), *(batch.column(c) for c in more)], ["doc_id", "fp", *more])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)
    return arrow_map(rows, f, "doc_id long, fp long" + "".join(f", {c} long" for c in more))


def _mask(shift: int, bits: int) -> int:
    return ((1 << bits) - 1) << shift


A, B, C = _mask(41, 23), _mask(18, 23), _mask(0, 18)
A3, B3, C3 = (_mask(41, 8), _mask(49, 8), _mask(57, 7)), (_mask(18, 8), _mask(26, 8), _mask(34, 7)), (_mask(0, 6), _mask(6, 6), _mask(12, 6))
B4 = (_mask(18, 6), _mask(24, 6), _mask(30, 6), _mask(36, 5))

#: (bits that agree, segment that is decoded, if any) of each kind of key, in the docstring's order.
KINDS: list[tuple[int, str | None]] = [
    (A | B, None), (A | C, None), (B | C, None),
    *((A | c, "B") for c in C3), *((A | b | C & ~c, None) for b in B3 for c in C3),
    *((B | c, "A") for c in C3), *((B | a | C & ~c, None) for a in A3 for c in C3),
    *((C | A & ~a | b, None) for a in A3 for b in B3), *((C | B & ~b | a, None) for b in B3 for a in A3),
    *((B & ~b | C & ~c, "A") for b in B4 for c in C3),
]
#: Bits of a key that hold its kind.
_KIND_BITS = 6


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _hash(x: np.ndarray, index: np.ndarray | int) -> np.ndarray:
    """64 bits of x and a codeword index, one-to-one in x."""
    h = (x ^ (np.uint64(0x9E3779B97F4A7C15) * (np.asarray(index).astype(np.uint64) + np.uint64(1)))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def keys(fp: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs for KINDS; near: the side that emits near(S), else the side that emits decode(S).

    A key holds its kind in the low bits, so kinds never meet.
    """
    u = fp.view(np.uint64)
    segment = {s: (u >> np.uint64(shift) & np.uint64((1 << 23) - 1)).astype(np.int64) for s, shift in (("A", 41), ("B", 18))}
    index = {s: near_indices(x) if near else decode(x)[:, None] for s, x in segment.items()}
    every = np.arange(len(u))
    rows, out = [], []
    for kind, (mask, decoded) in enumerate(KINDS):
        whole = u & np.uint64(mask)
        for j in range(index[decoded].shape[1] if decoded else 1):
            column = index[decoded][:, j] if decoded else 0
            # near_indices() is padded with its first index
            fresh = every if not decoded or j == 0 else np.flatnonzero(column != index[decoded][:, 0])
            at = _hash(whole[fresh], column[fresh] if decoded else 0)
            rows.append(fresh)
            out.append((at >> np.uint64(_KIND_BITS) << np.uint64(_KIND_BITS) | np.uint64(kind)).view(np.int64))
    return np.concatenate(rows), np.concatenate(out)


def _keyed(distinct: DataFrame, near: bool) -> DataFrame:
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        row, key = keys(fp, near)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])

    return arrow_map(distinct.select("fp"), f, "key long, fp long")


def _kind_of(differ: Column) -> Column:
    """The kind under which a pair that differs in these bits is taken; it is among the keys that both have."""
    clean = lambda mask: differ.bitwiseAND(F.lit(_signed(mask))) == 0
    count = lambda mask: F.bit_count(differ.bitwiseAND(F.lit(_signed(mask))))

    def first(parts: tuple[int, ...], is_clean: bool) -> Column:
        """Number of the first of the parts that the bits leave whole, or that they touch."""
        out = F.lit(len(parts) - 1)
        for i in range(len(parts) - 2, -1, -1):
            out = F.when(clean(parts[i]) if is_clean else ~clean(parts[i]), i).otherwise(out)
        return out

    a, b, c = count(A), count(B), count(C)
    whole, touched = lambda parts: first(parts, True), lambda parts: first(parts, False)
    kind = F.when((a == 0) & (b == 0), 0).when((a == 0) & (c == 0), 1).when((b == 0) & (c == 0), 2)
    kind = kind.when((a == 0) & (b == 1), 3 + whole(C3)).when(a == 0, 6 + 3 * whole(B3) + touched(C3))
    kind = kind.when((b == 0) & (a == 1), 15 + whole(C3)).when(b == 0, 18 + 3 * whole(A3) + touched(C3))
    kind = kind.when((c == 0) & (a == 1), 27 + 3 * touched(A3) + whole(B3)).when(c == 0, 36 + 3 * touched(B3) + whole(A3))
    return kind.otherwise(45 + 3 * touched(B4) + touched(C3))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: the fingerprints of distinct(fp) that differ in 1 to MAX_DISTANCE bits, each pair once.

    Every kind finds its pairs from either side, so one order suffices.
    """
    left, right = _keyed(distinct, True).alias("l"), _keyed(distinct, False).alias("r")
    differ = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    kind = F.col("l.key").bitwiseAND(F.lit((1 << _KIND_BITS) - 1))
    on = (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp")) & (F.bit_count(differ) <= MAX_DISTANCE) & (kind == _kind_of(differ))
    return left.join(right.hint("shuffle_merge"), on).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def _rooted(prints: DataFrame) -> DataFrame:
    """(fp, first, root) of the distinct fingerprints of prints: first is the least doc_id that has it, root tells components apart."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints", prints.count(), file_rows=KEYED_ROWS)
    roots = components(links(distinct), distinct.count())
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fp (signed), component_id (the least doc_id that links reach)."""
    prints = stored(fingerprints(docs), "fingerprints", mapped=True)
    rooted = _rooted(prints)
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = stored(rooted.join(names, "root").select("fp", "component_id"), "components", prints.count())
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with exactly one row of each group: the first by doc_id (null last), then by a hash of all its columns.

    Groups are settled on narrow rows; only the keys of the rows that go meet the documents (broadcast if they are few). Of rows that
    agree in every column one stays. The outcome depends on the rows alone, not on their order or partitions.
    """
    rows = plain(docs)
    at = {n: f"c{i}" for i, n in reversed(list(enumerate(docs.columns)))}
    rows = keyed(rows, rows.columns)
    prints = stored(fingerprints(rows.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"), "k1", "k2"), ("k1", "k2")), "fingerprints", mapped=True)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2").alias("order")
    least = prints.groupBy("fp").agg(F.min(order).alias("least"))
    rooted = _rooted(prints).select("fp", "root").join(least, "fp")
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    best = stored(rooted.join(best, "root").select("fp", F.col("best.k1").alias("b1"), F.col("best.k2").alias("b2")), "kept-rows", prints.count())
    judged = prints.join(best, "fp").select("k1", "k2", ((F.col("k1") != F.col("b1")) | (F.col("k2") != F.col("b2"))).alias("goes"))
    counted = judged.groupBy("k1", "k2").agg(F.min("goes").alias("goes"), F.count(F.lit(1)).alias("rows")).where("goes or rows > 1")
    marked = stored(counted.select("k1", "k2", "goes"), "marked-rows", prints.count())
    columns = [f"c{i}" for i in range(len(docs.columns))]
    kept = rows.join(sized(marked.select("k1", "k2")), ["k1", "k2"], "left_anti").select(*columns)
    again = marked.where("not goes").select("k1", "k2")
    if not again.isEmpty():
        one = rows.join(sized(again), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first(F.struct(*columns)).alias("row"))
        kept = kept.unionByName(one.select("row.*"))
    return kept.toDF(*docs.columns)
