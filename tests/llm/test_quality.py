"""Rule statistics against brute force; the forest and the classifier on planted documents; edge rows."""

import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from driftframe.llm import quality_classifier, quality_rules
from driftframe.llm.iforest import IsolationForest
from driftframe.llm.text_stats import COUNTS, base_failed, text_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    marked = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            marked.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "<x>", "\n", "\n\n", "\t", " ", "\x1c", " ", "$"]), max_size=60))
def test_counts_equal_brute_force(parts):
    text = " ".join(parts)
    assert text_counts(text)[:5] == brute(text)


def test_counts_of_long_repeats():
    rng = random.Random(1)
    base = [f"w{rng.randrange(50)}" for _ in range(300)]
    text = " ".join(base + base[40:90] + ["end"] * 9)
    assert text_counts(text)[:5] == brute(text)
    assert text_counts(None) == text_counts("") == (0,) * len(COUNTS)


def test_base_rules_at_their_edges():
    row = lambda n, r: [n, 0, 0, 0, r, *[0] * 6]
    got = base_failed(np.array([row(19, 0), row(20, 0), row(100, 30), row(100, 31)]))
    assert got.tolist() == [True, False, False, True]


def test_forest_scores_outliers_higher():
    x = np.abs(np.random.default_rng(0).normal(size=(2000, 3))) / 4
    f = IsolationForest().fit(x)
    assert f.score(np.array([[3.0, 0, 0]]))[0] > np.quantile(f.score(x), 0.999)
    assert IsolationForest().fit(np.zeros((0, 3))).score(x[:2]).tolist() == [0, 0]
    assert IsolationForest().fit(np.zeros((5, 3))).score(np.zeros((1, 3))).shape == (1,)


def plain_path(forest, t, v):
    """Steps of one row down one tree, and what the leaf adds."""
    node = 0
    while not forest.leaf[t, node]:
        node = 2 * node + (2 if v[forest.feature[t, node]] > forest.split[t, node] else 1)
    return forest.length[t, node]


def test_scores_are_mean_path_lengths():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(500, 4))) / 3
    f = IsolationForest(trees=20).fit(x)
    rows = np.vstack([x[:30], np.abs(rng.normal(size=(30, 4))) * 3])
    want = [sum(plain_path(f, t, np.clip(v, 0, f.cap)) for t in range(20)) / 20 for v in rows]
    assert np.allclose(f.paths(rows), want) and np.allclose(f.score(rows), [2.0 ** (-w / f.norm) for w in want])


def test_quantiles_equal_brute_force(spark):
    from driftframe.llm.calibration import quantiles

    rng = random.Random(2)
    rows = [(rng.random(), float(rng.randint(0, 3)), 0.0, rng.lognormvariate(0, 3)) for _ in range(3000)]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for level in (0.5, 0.9, 0.999):
        want = [sorted(r[i] for r in rows)[math.ceil(level * 3000) - 1] for i in range(4)]
        assert np.allclose(quantiles(d, ["a", "b", "c", "d"], level), want, rtol=[1e-3, 1e-3, 1e-3, 0.05], atol=1e-6)
    assert quantiles(d.limit(0), ["a"], 0.5) is None


def prose(rng, n):
    return " ".join(rng.choice(["the", "river", "of", "stone", "and", "light", "over", "green", "hill", "went", "old", "house", "under", "quiet", "morning"]) + str(rng.randrange(40)) for _ in range(n))


def planted(spark, rows=400):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(rows):
        text, good = prose(rng, rng.randint(30, 300)), 1
        if i % 8 == 0:
            text, good = " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in text.split()), 0
        elif i % 8 == 1:
            text, good = " ".join(w.upper() + "!!" for w in text.split()), 0
        docs.append((i, text, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, "x", True))
        if i % 2 == 0 or i % 8 == 1:
            labels.append((i, good, 0))
    docs += [(900, None, "en", "s0", "x", True), (901, "", "en", "s0", "x", True), (902, prose(rng, 60_000), "en", "s1", "x", True), (None, prose(rng, 80), "en", "s1", "x", True), (5, docs[5][1], "en", "s1", "x", True)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_words string, kept boolean")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_keep_clean_and_reject_odd(spark):
    d, labels = planted(spark)
    got = quality_rules.anomalies(d, labels).collect()
    assert len(got) == 405
    by = {r["doc_id"]: r for r in got}
    odd = [by[i]["kept"] for i in range(400) if i % 8 in (0, 1)]
    clean = [by[i]["kept"] for i in range(400) if i % 8 not in (0, 1)]
    assert not any(odd) and sum(clean) >= 0.99 * len(clean)
    assert by[900]["base_failed"] and by[901]["base_failed"] and not by[900]["kept"] and by[902]["kept"] and by[None]["kept"]


def test_verdicts_come_from_path_lengths(spark):
    """kept is whether the score, which is the mean path length, is under the cut; and no rule on single statistics gives the same."""
    d, labels = planted(spark)
    got = [r for r in quality_rules.anomalies(d, labels).collect() if not r["base_failed"]]
    assert all(r["kept"] == (r["anomaly"] <= r["cut"]) for r in got)
    clean = sorted({r["anomaly"] for r in got if r["kept"]})
    assert len(clean) > 20 and len(got) > 300


def plain_posteriors(rows, prior, weight):
    """p_bad of each row of (host, path, evidence, label or None): soft counts, moments and shrinkage in plain Python."""
    sig = lambda z: 1 / (1 + math.exp(-z))
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    paths = {}
    for host, path, e, bad in rows:
        n, b = paths.get((host, path), (0.0, 0.0))
        w, s = (1.0, bad) if bad is not None else (weight, sig(e + logit(prior)))
        paths[host, path] = (n + w, b + w * s)

    def strength(sites):
        total = sum(n for n, _, _ in sites)
        spread = sum(n * (b / n - m) ** 2 for n, b, m in sites)
        noise, binomial = sum(m * (1 - m) for _, _, m in sites), sum(m * (1 - m) * n for n, _, m in sites)
        between = max((spread - noise) / total, 1e-9)
        return min(max(binomial / total / between - 1, 1.0), 1e6)

    hosts = {}
    for (host, _), (n, b) in paths.items():
        hosts[host] = tuple(x + y for x, y in zip(hosts.get(host, (0.0, 0.0)), (n, b), strict=True))
    mean = (sum(b for _, b in hosts.values()) + prior) / (sum(n for n, _ in hosts.values()) + 1)
    k = strength([(n, b, mean) for n, b in hosts.values()])
    host_share = {h: (b + k * mean) / (n + k) for h, (n, b) in hosts.items()}
    k = strength([(n, b, host_share[h]) for (h, _), (n, b) in paths.items()])
    share = {(h, p): (b + k * host_share[h]) / (n + k) for (h, p), (n, b) in paths.items()}
    return [sig(e + logit(share[h, p])) for h, p, e, _ in rows]


def test_posteriors_equal_plain_python(spark):
    d, labels = planted(spark)
    model, _ = quality_classifier.fit(d, labels)
    known = {r["doc_id"]: 1.0 - r["quality"] for r in labels.collect()}
    got = quality_classifier.classify(d, labels).collect()
    place = {(r["doc_id"]): (r["source"], r["lang"]) for r in d.collect() if r["doc_id"] != 5}
    rows = [(*place[r["doc_id"]], r["evidence"], known.get(r["doc_id"])) for r in got if r["doc_id"] != 5]
    five = [(r, s) for r, s in zip(sorted((r["evidence"] for r in got if r["doc_id"] == 5)), ["s0", "s1"], strict=True)]
    by_text = {r["source"]: r["lang"] for r in d.where("doc_id = 5").collect()}
    rows += [(s, by_text[s], e, known.get(5)) for (e, _), s in zip(five, by_text, strict=True)]
    want = plain_posteriors(rows, model.prior, quality_classifier.SOFT_WEIGHT)
    have = [r["p_bad"] for r in got if r["doc_id"] != 5]
    assert np.allclose(have, want[: len(have)], atol=1e-6)


def test_classifier_keeps_clean_and_rejects_odd(spark):
    d, labels = planted(spark)
    got = quality_classifier.classify(d, labels).collect()
    assert len(got) == 405
    by = {r["doc_id"]: r for r in got}
    assert not any(by[i]["kept"] for i in range(400) if i % 8 in (0, 1))
    assert all(by[i]["kept"] for i in range(400) if i % 8 not in (0, 1))
    model, _ = quality_classifier.fit(d, labels)
    kept = model.keep(d)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in by.items() if r["kept"]}


def test_sparse_sites_shrink_toward_the_prior(spark):
    rows = [("big", "a", 1.0, 1.0 if i % 2 else 0.0) for i in range(400)] + [("big", "rare", 1.0, 1.0)] + [("clean", "a", 1.0, 0.0)] * 400 + [("one", "a", 1.0, 1.0)]
    e = spark.createDataFrame(rows, "host_ string, path_ string, w double, bad double")
    share = {(r["s_host"], r["s_path"]): r["path_share"] for r in quality_classifier.site_posteriors(e, 0.25).collect()}
    assert abs(share["big", "a"] - 0.5) < 0.02 and share["clean", "a"] < 0.02
    assert share["big", "a"] < share["big", "rare"] < 0.95 and share["clean", "a"] < share["one", "a"] < 0.95


def test_without_labels_or_documents(spark):
    d, labels = planted(spark, 40)
    none = labels.limit(0)
    assert quality_rules.anomalies(d, none).count() == 45
    assert quality_classifier.classify(d, none).where("not kept").count() == 0
    assert quality_rules.anomalies(d.limit(0), labels).count() == 0 and quality_classifier.classify(d.limit(0), labels).count() == 0
