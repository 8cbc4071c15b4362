"""Leaks: exact passages always, edited ones with high recall, nothing else; brute-force verification."""

import random

import numpy as np
import pyarrow.parquet as pq

from driftframe.llm import cgk, decontaminate
from driftframe.llm.cgk import edit_distances
from driftframe.llm.decontaminate import MAX_EDIT, Index, normalised

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choices("abcdefghij", k=RNG.randint(2, 6))) for _ in range(3000)]


def words(n, rng=RNG):
    return [VOCABULARY[int(len(VOCABULARY) * rng.random() ** 2)] for _ in range(n)]


ITEMS = [(i, " ".join(words(RNG.randint(15, 60)))) for i in range(120)]


def plain_distance(a, b):
    """Least edit distance of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_distance_equals_the_plain_one():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = rng.integers(1, 5, rng.integers(1, 10)), rng.integers(1, 5, (3, rng.integers(1, 15)))
        assert edit_distances(a, b).tolist() == [plain_distance(a.tolist(), x.tolist()) for x in b]


def edited(text, share, rng):
    w = text.split()
    for _ in range(int(share * len(w))):
        p, how = rng.randrange(len(w)), rng.random()
        if how < 0.5:
            w[p] = rng.choice(VOCABULARY)
        elif how < 0.75 and len(w) > 1:
            del w[p]
        else:
            w.insert(p, rng.choice(VOCABULARY))
    return " ".join(w)


def test_recall_and_precision():
    rng = random.Random(6)
    index = Index(ITEMS)
    for share, least in ((0.0, 1.0), (0.1, 0.99), (0.19, 0.95)):
        texts, want = [], []
        for i, t in ITEMS * 3:
            before, after = words(rng.randint(0, 200), rng), words(rng.randint(0, 200), rng)
            texts.append(" ".join([*before, edited(t, share, rng), *after]))
            want.append(i)
        got = index.find(texts)
        assert sum(w in g for w, g in zip(want, got, strict=True)) >= least * len(want)
    clean = [" ".join(words(300, rng)) for _ in range(200)]
    assert index.find(clean) == [[]] * 200


def real_passages():
    """Runs of words of the test documents, and a source of other words."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    pool = [w for t in table if len(w := [x.decode() for x in normalised(t)]) > 60]
    return pool, sorted({x for w in pool[:300] for x in w})


def test_recall_by_length_and_kind_of_edit():
    """The target recall is 0.9 at the most edits allowed, on passages of real documents."""
    rng = random.Random(8)
    pool, vocabulary = real_passages()

    def passage(n):
        out = []
        while len(out) < n:
            out += pool[rng.randrange(len(pool))]
        at = rng.randrange(len(out) - n + 1)
        return out[at : at + n]

    for n in (5, 6, 8, 10, 12, 15, 16, 18, 20, 24, 25, 32, 48, 64, 65, 150, 500):
        items = [(i, " ".join(passage(n))) for i in range(120 if n < 100 else 30)]
        index, edits = Index(items), int(MAX_EDIT * n + 1e-9)
        for how in ("even", "spread", "mixed"):
            texts = []
            for _, t in items:
                w = t.split()
                if how == "mixed":
                    w = edited(t, MAX_EDIT + 1e-9, rng).split()
                else:
                    for p in [int((j + 0.5) * n / edits) for j in range(edits)] if how == "even" else rng.sample(range(n), edits):
                        w[p] = rng.choice(vocabulary)
                texts.append(" ".join([*passage(40), *w, *passage(40)]))
            assert sum(i in g for (i, _), g in zip(items, index.find(texts), strict=True)) >= 0.97 * len(items), (n, how)


def plain_walk(words, bits, steps):
    """Symbols that a CGK walk over words writes at the sampled steps."""
    out, i = [], 0
    for j in range(max(steps) + 1):
        if j in steps:
            out.append(words[i] if i < len(words) else 0)
        if i < len(words):
            i += int(bits[words[i]]) >> (j % 62) & 1
    return tuple(out)


class Moves:
    """The walk's bits of an item's words, asked by place from 1."""

    def __init__(self, bits, item):
        self.bits, self.item = bits, item

    def __getitem__(self, place):
        return self.bits[self.item[place - 1]]


def test_candidates_equal_plain_walks():
    rng = np.random.default_rng(3)
    items = [rng.integers(1, 9, n) for n in (1, 2, 3, 5, 9, 14, 20, 30, 70)]
    words = np.concatenate([*(x for i in items for x in (rng.integers(0, 9, 30), i)), rng.integers(0, 9, 30), np.zeros(1, np.int64)])
    for number in range(cgk.REPEATS):
        r = cgk.Repetition(items, 8, number, 5 + number)
        position, anchor = r.candidates(words, np.arange(len(words)))
        got = set(zip(position.tolist(), r.owner[anchor].tolist(), r.offset[anchor].tolist(), strict=True))
        want = set()
        for k, item in enumerate(items):
            for o in cgk.anchors(len(item)).tolist():
                size = max(c for c in cgk.WINDOWS if c <= len(item) - o)
                steps = cgk.sampled(number, size)
                places = plain_walk(list(range(1, len(item) - o + 1)), Moves(r.bits, item[o:]), steps) if steps else ()
                if len(set(places)) >= cgk.least_places(size):
                    key = plain_walk(item[o:].tolist(), r.bits, steps)
                    want |= {(p, k, o) for p in range(len(words)) if plain_walk(words[p:].tolist(), r.bits, steps) == key}
        assert want <= got and len(got - want) <= 0.02 * len(want) + 2  # symbols past a text's end only differ


def test_found_items_equal_brute_force():
    rng = random.Random(7)
    items = ITEMS[:15]
    texts = [" ".join([*words(60, rng), edited(items[rng.randrange(15)][1], rng.choice([0.1, 0.2, 0.35]), rng), *words(60, rng)]) for _ in range(60)]
    got = Index(items).find(texts)
    want = [[i for i, t in items if plain_distance(normalised(t), normalised(x)) <= int(0.2 * len(normalised(t)))] for x in texts]
    missed = sum(len(set(w) - set(g)) for w, g in zip(want, got, strict=True))
    assert all(set(g) <= set(w) for w, g in zip(want, got, strict=True)) and missed <= 0.05 * sum(map(len, want))


def test_case_punctuation_and_document_bounds():
    item = ITEMS[0][1]
    index = Index([(9, item)])
    half = len(item.split()) // 2
    loud = "«" + item.upper().replace(" ", ", ") + "!"
    assert index.find([loud, " ".join(item.split()[:half]), " ".join(item.split()[half:]), None, ""]) == [[9], [], [], [], []]


def test_short_and_empty_items():
    index = Index([(1, "zeta"), (2, ""), (3, None), (4, "alpha beta gamma delta epsilon")])
    assert index.find(["so zeta it is", "alpha beta gamma dolta epsilon", "alpha beta nothing"]) == [[1], [4], []]
    assert Index([]).find(["x"]) == [[]]


def test_tables_blocks_and_edges(spark, monkeypatch):
    bench = spark.createDataFrame([*ITEMS, (500, ITEMS[3][1]), (501, None), (None, ITEMS[3][1]), (None, ITEMS[7][1]), (-1, ITEMS[9][1]), (3, ITEMS[3][1])], "item_id long, text string")
    rows = [(1, f"x {ITEMS[3][1]} y", 1), (2, " ".join(words(100)), 1), (3, None, 1), (None, ITEMS[110][1], 1), (1, f"x {ITEMS[3][1]} y", 1), (4, " ".join(words(50_000)) + " " + ITEMS[7][1], 1), (5, ITEMS[9][1] + " " + ITEMS[8][1], 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, items_ int")
    want = [(0, [110], True, 1), (1, [None, 3, 500], True, 3), (1, [None, 3, 500], True, 3), (2, [], False, 0), (3, [], False, 0), (4, [None, 7], True, 2), (5, [-1, 8, 9], True, 3)]
    for size in (decontaminate.BLOCK_ITEMS, 50):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", size)
        got = [(r["doc_id"] or 0, r["item_ids"], r["contaminated"], r["n_items"]) for r in decontaminate.find(d, bench).collect()]
        assert sorted(got, key=lambda r: r[0]) == want
        kept = decontaminate.clean(d, bench)
        assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
        assert decontaminate.find(d.limit(0), bench).count() == 0 and decontaminate.clean(d.limit(0), bench).count() == 0
    assert decontaminate.find(d, bench.limit(0)).where("contaminated").count() == 0
