"""Reply trees against brute force; reversible templates."""

import hashlib
import os
import random
import re

from pyspark.sql import functions as F

from driftframe import runtime
from driftframe.llm import chat, common

DDL = "tree long, node long, parent long, role string, text string, score double"


def plain_escape(text):
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def read(text):
    """(role, text) of each message, by a plain reader of the template."""
    out = []
    for piece in text.split(chat.START)[1:]:
        head, _, body = piece.partition("\n")
        plain = lambda x: re.sub(r"<\\(\\*)\|", r"<\1|", x)
        out.append((re.sub(r"\\([bn])", lambda m: {"b": "\\", "n": "\n"}[m[1]], plain(head)), plain(body.removesuffix(chat.END + "\n"))))
    return out


def test_escapes_are_reversible(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("<|\\im_endst>a\nbn", k=rng.randint(0, 14))) for _ in range(3000)] + ["<|im_end|>", "<\\|", "\\n", "\\b\n"]
    d = spark.createDataFrame([(t,) for t in texts], "x string")
    got = d.select("x", chat.escape(F.col("x")).alias("e"), chat.unescape(chat.escape(F.col("x"))).alias("u"), chat.escape_role(F.col("x")).alias("r"), chat.unescape_role(chat.escape_role(F.col("x"))).alias("v")).collect()
    for x in got:
        assert x["e"] == plain_escape(x["x"]) and x["u"] == x["v"] == x["x"] and "<|" not in x["e"] and "<|" not in x["r"] and "\n" not in x["r"]


def test_formatted_turns_parse_back(spark):
    rng = random.Random(4)
    word = lambda letters, n: "".join(rng.choices(letters, k=rng.randint(0, n)))
    rows = [(c, n, n - 1 if n else None, word(["<|", "\\", "a", "\n", "é", "n", "b"], 4), word(["<|im_start|>", "<|im_end|>", "\n", "\\", "é", "x"], 6), 0.0) for c in range(60) for n in range(c % 5 + 1)]
    out = chat.format_chats(spark.createDataFrame(rows, DDL)).select("tree", "formatted", chat.parse(F.col("formatted")).alias("said")).collect()
    for r in out:
        want = [(x[3], x[4]) for x in rows if x[0] == r["tree"]]
        assert [tuple(m) for m in r["said"]] == read(r["formatted"]) == want


def brute_paths(rows):
    by = {(r[0], r[1]): r for r in rows}
    inner = {(r[0], r[2]) for r in rows if (r[0], r[2]) in by}
    out = set()
    for r in rows:
        if (r[0], r[1]) not in inner:
            up, at = 0, (r[0], r[1])
            while at in by and up < 1000:
                out.add((r[0], r[1], at[1], up))
                at, up = (r[0], by[at][2]), up + 1
    return out


def test_paths_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for tree in range(6):
        for n in range(60):
            rows.append((tree, n, rng.randrange(max(n - 4, 0), n) if n else None, rng.choice(["user", "assistant"]), f"t{n}", rng.random()))
    rows += [(7, n, n - 1 if n else None, "user", "deep", 1.0) for n in range(300)] + [(None, 0, None, "user", "x", 0.0), (None, 1, 0, "assistant", "y", 0.0), (8, 0, 99, "user", "orphan", 0.0)]
    m = spark.createDataFrame(rows, DDL)
    assert {tuple(r) for r in chat.paths(m).collect()} == brute_paths(rows)


def test_best_branches_come_first(spark):
    rows = [(1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "bad", 0.1), (1, 2, 0, "assistant", "good", 0.9), (1, 3, 0, "assistant", "tie", 0.9)]
    out = chat.format_chats(spark.createDataFrame(rows, DDL), best=2).orderBy("rank").collect()
    assert [(r["leaf"], read(r["formatted"])) for r in out] == [(2, [("user", "q"), ("assistant", "good")]), (3, [("user", "q"), ("assistant", "tie")])]
    assert [x["at"] for x in out[0]["loss"]] == [0, out[0]["formatted"].index(chat.START, 1)] and out[0]["loss"][0]["length"] == 0
    s = out[0]["loss"][1]
    assert out[0]["formatted"][s["start"] : s["start"] + s["length"]] == "good"


def test_cycles_and_empty_tables(spark):
    m = spark.createDataFrame([(1, 0, 1, "user", "a", 0.0), (1, 1, 0, "user", "b", 0.0), (2, 0, None, "user", "c", 0.0), (3, 0, 1, "user", "loop", 0.0), (3, 1, 0, "user", "loop", 0.0), (3, 2, 0, "user", "hangs off it", 0.0), (4, 0, 0, "user", "itself", 0.0)], DDL)
    assert [r["tree"] for r in chat.format_chats(m).collect()] == [2] == [r["tree"] for r in chat.paths(m).collect()]
    assert chat.format_chats(m.limit(0)).count() == 0


def test_digests_of_conversations(spark):
    probe = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", "b<|", "x"), (1, 0, "user", None, "x"), (1, 1, "assistant", "b<|", "x"), (2, None, None, "t", "x"), (None, 0, "assistant", "n", "x"), (-1, 0, "user", probe, "x"), (-1, 1, "assistant", probe, "x"), (3, 0, "user", "z" * 200_000, "x")]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")))).collect()}
    want = {1: [("user", ""), ("assistant", "b<|"), ("assistant", "b<|")], 2: [("", "t")], None: [("assistant", "n")], -1: [("user", probe), ("assistant", probe)], 3: [("user", "z" * 200_000)]}
    assert set(got) == set(want)
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[k]
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def test_long_conversations_are_put_together_in_order(spark):
    rows = [(c, n % 700, "assistant" if n % 3 else "user", f"{n}<|é") for c, top in ((1, 1500), (2, 257)) for n in range(top)] + [(2, None, "user", "first")]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    for c in (1, 2):
        said = sorted((x[1:] for x in rows if x[0] == c), key=lambda x: (x[0] is not None, x[0], x[1], x[2]))
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in said).encode()).hexdigest()
        loss = "".join(b for _, a, b in said if a == "assistant")
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(a) + len(plain_escape(b)) + 24 for _, a, b in said)


def test_a_round_of_paths_adds_a_folder_and_no_scan(spark, monkeypatch):
    kinds, plans = [], []
    new, put = runtime.new_folder, runtime.put
    for module in (chat, common):
        monkeypatch.setattr(module, "new_folder", lambda s, kind: kinds.append(kind) or new(s, kind), raising=False)
        monkeypatch.setattr(module, "put", lambda df, path: plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation")) or put(df, path), raising=False)
    for top in (3, 400):
        kinds.clear()
        plans.clear()
        rows = [(1, n, n - 1 if n else None, "user", f"{n}", 0.0) for n in range(top)]
        assert sorted(r["up"] for r in chat.paths(spark.createDataFrame(rows, DDL)).collect()) == list(range(top))
        assert sorted(kinds) == ["messages", "reply-paths"] and max(plans[2:]) == 2


def test_intermediate_tables_have_no_mark(spark):
    for made in (common.stored(spark.range(3), "marks"), runtime.settled(spark.range(3), "marks")):
        folder = os.path.dirname(made.inputFiles()[0]).removeprefix("file://")
        assert sorted(r["id"] for r in made.collect()) == [0, 1, 2] and not [x for x in os.listdir(folder) if "SUCCESS" in x]
