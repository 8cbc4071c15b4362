"""Chat formatting over reply trees.

messages(tree, node, parent, role, text, score) form trees. Iterated self-joins enumerate every root-to-leaf path: a round joins what
is known of paths, and the jumps from node to ancestor, with the jumps, which doubles the length of both; a path of n messages takes
log2(n) rounds, all of ids alone, each one join and one folder of a table in the shared folder. Branches are ranked by score, the best ones of each tree are
chosen, and each chosen path is formatted as one conversation with the spans of its loss mask.

Template: <|im_start|>role LF text <|im_end|> LF, for each message. Inside a text each "<" followed by backslashes and "|" gets
one more backslash, so a control string can't occur there and the text can be restored exactly; a role is escaped likewise, with its
backslashes written as \\b and its line feeds as \\n first.

Texts meet their path once, at the end, in the JVM. A path is put together in stretches of STRETCH messages, so that a long conversation is
joined, sorted and escaped by many tasks; only its finished stretches meet in one, as a conversation is one row of the output.

Defined cases: null roles and texts are empty; messages whose parent is null or not in their tree are roots; a parent cycle has
no root, and messages in it or above which it stands are in no conversation; repeated node ids of a tree are an error of the caller
(linear() numbers messages itself, so repeated turns are all kept, ordered by turn, role, text); null trees form one tree; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from driftframe.llm.common import dealt, put, stored
from driftframe.runtime import new_folder

#: Control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
#: Messages of a path that are joined and formatted together, and turns that are numbered together.
STRETCH = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def linear(conversations: DataFrame) -> DataFrame:
    """messages of conversations(conv_id, turn, role, text): each turn replies to the one before it.

    Turns are numbered within stretches of turn numbers, and stretches by running totals of their rows.
    """
    stretch = F.struct(F.col("conv_id").alias("c"), F.floor(F.col("turn") / STRETCH).alias("b")).alias("k")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    totals = rows.select(stretch).groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("k.c").orderBy("k.b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("k", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("k").orderBy("turn", "role", "text"))
    rows = rows.select("*", stretch).withColumn("own", own).join(totals, "k").withColumn("node", (F.col("before") + F.col("own")).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _placed(messages: DataFrame) -> DataFrame:
    """messages, stored; t holds the tree, so that null trees join."""
    return stored(messages.select(F.struct("tree").alias("t"), F.col("node").cast("long"), F.col("parent").cast("long"), "role", "text", "score"), "messages")


def _steps(rows: DataFrame) -> DataFrame:
    """(t, start, at, up, path, round) of rows(t, node, parent), as _paths() has them after round 0: every leaf at itself, and every reply's jump to its parent."""
    known = rows.select("t", F.col("node").alias("parent"), F.lit(True).alias("known"))
    answered = rows.where("parent is not null").select("t", F.col("parent").alias("node"), F.lit(True).alias("answered")).distinct()
    ids = rows.select("t", "node", "parent").join(known, ["t", "parent"], "left").join(answered, ["t", "node"], "left")
    step = lambda at, up, path: F.struct(F.col(at).alias("at"), F.lit(up).cast("long").alias("up"), F.lit(path).alias("path"))
    own = F.array(F.when(F.col("answered").isNull(), step("node", 0, True)), F.when(F.col("known"), step("parent", 1, False)))
    return ids.select("t", F.col("node").alias("start"), F.inline(F.filter(own, lambda x: x.isNotNull())))


def _paths(rows: DataFrame) -> DataFrame:
    """(t, start, at, up, path, round) of rows(t, node, parent): where path holds, at stands up messages above the leaf start, in one row for every
    message of every path; paths above which a cycle stands are cut somewhere in it.

    Other rows are jumps, of 2 ** round messages. A round joins the paths so far and its jumps with its jumps, which gives more of each
    path and jumps twice as long. Rounds are folders of one table, so that a plan reads one table however many rounds there were.
    """
    folder, n = new_folder(rows.sparkSession, "reply-paths"), rows.count()
    further, number, going = _steps(rows), 0, n
    kind = StructType([*further.schema, StructField("round", IntegerType())])
    while True:
        put(dealt(further, n + going), f"{folder}/round={number}")
        seen = rows.sparkSession.read.schema(kind).parquet(folder)
        jump = seen.where((F.col("round") == number) & ~F.col("path"))
        before, going = going, jump.count()
        if not going or going == before:  # none, or only cycles and what hangs off them, are left
            return seen
        onward = jump.select("t", F.col("start").alias("at"), F.col("at").alias("next"))
        further = seen.where(F.col("path") | (F.col("round") == number)).join(onward, ["t", "at"])
        further = further.select("t", "start", F.col("next").alias("at"), (F.col("up") + 2**number).alias("up"), "path")
        number += 1


def _replies(seen: DataFrame) -> DataFrame:
    """(t, node) of every message that is no root."""
    return seen.where("round = 0 and not path").select("t", F.col("start").alias("node"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every message of every root-to-leaf path; up counts steps from the leaf."""
    seen = _paths(_placed(messages))
    every = seen.where("path").select("t", F.col("start").alias("leaf"), F.col("at").alias("node"), "up")
    whole = every.join(_replies(seen), ["t", "node"], "left_anti").select("t", "leaf")
    return every.join(whole, ["t", "leaf"], "left_semi").select("t.tree", "leaf", "node", "up")


def turns(messages: DataFrame, best: int = 1) -> DataFrame:
    """(t, leaf, rank, stretch, up, role, text): the best paths of each tree by mean score (ties: lower leaf). A path is read by falling up;
    stretch is up by STRETCH."""
    rows = _placed(messages)
    seen = _paths(rows)
    every = seen.where("path").select("t", F.col("start").alias("leaf"), F.col("at").alias("node"), "up")
    stretch = F.floor(F.col("up") / STRETCH).alias("stretch")
    replies = _replies(seen).withColumn("reply", F.lit(True))
    nodes = rows.select("t", "node", F.coalesce("score", F.lit(0.0)).alias("score")).join(replies, ["t", "node"], "left").withColumn("root", F.col("reply").isNull())
    ranked = every.join(nodes, ["t", "node"]).groupBy("t", "leaf").agg(F.avg("score").alias("mean"), F.max("up").alias("top"), F.max("root").alias("whole")).where("whole")
    order = Window.partitionBy("t").orderBy(F.desc("mean"), "leaf")
    chosen = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    chosen = chosen.select("t", "leaf", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / STRETCH))).alias("stretch"))
    at = every.select("t", "leaf", "node", "up", stretch).join(chosen, ["t", "leaf", "stretch"])
    said = rows.select("t", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return at.join(said, ["t", "node"]).select("t", "leaf", "rank", "stretch", "up", "role", "text")


def format_chats(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): one text a chosen path. loss has an entry for each message, in order: at is where the message
    begins in the text, start and length (0 where nothing is learned) the span under the mask, all in code points, escapes as they stand."""
    path, learned = ["t", "leaf", "rank"], F.col("role") == LEARNED
    rows = turns(messages, best).select(
        *path, "stretch", "up", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), learned.alias("learned")
    )
    rows = rows.select(
        *path, "stretch", F.length("head").cast("long").alias("lead"), F.when(F.col("learned"), F.length("body")).otherwise(0).cast("long").alias("length"),
        (-F.col("up")).alias("nth"), F.concat("head", "body", F.lit(END + "\n")).alias("piece"),
    ).withColumn("chars", F.length("piece").cast("long"))
    at = F.coalesce(F.sum("chars").over(Window.partitionBy(*path, "stretch").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    piece = F.struct("nth", "piece", "at", (F.col("at") + F.col("lead")).alias("start"), "length")
    parts = rows.withColumn("at", at).groupBy(*path, "stretch").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.sum("chars").alias("chars"))
    parts = parts.select(
        *path, (-F.col("stretch")).alias("nth"), "chars", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("part"),
        F.transform("pieces", lambda x: F.struct(x["at"].alias("at"), x["start"].alias("start"), x["length"].alias("length"))).alias("spans"),
    )
    before = F.coalesce(F.sum("chars").over(Window.partitionBy(*path).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before)
    spans = F.transform("spans", lambda x: F.struct((x["at"] + F.col("before")).alias("at"), (x["start"] + F.col("before")).alias("start"), x["length"].alias("length")))
    whole = parts.withColumn("spans", spans).groupBy(*path).agg(F.sort_array(F.collect_list(F.struct("nth", "part", "spans"))).alias("parts"))
    return whole.select("t.tree", "leaf", "rank", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("formatted"), F.flatten(F.transform("parts", lambda x: x["spans"])).alias("loss"))


def pieces(formatted: Column) -> Column:
    """The messages of a formatted conversation, without what begins each: an array of strings."""
    return F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x, i: i > 0)


def _head(piece: Column) -> Column:
    return F.substring_index(piece, "\n", 1)


def parse(formatted: Column) -> Column:
    """An array of (role, text) of a formatted conversation's messages, unescaped."""
    body = lambda p: F.substr(p, F.length(_head(p)) + 2, F.length(p) - F.length(_head(p)) - (2 + len(END)))
    return F.transform(pieces(formatted), lambda p: F.struct(unescape_role(_head(p)).alias("role"), unescape(body(p)).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """Per formatted conversation what can be read back from it: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    text = F.col("formatted")
    said = F.array_join(F.transform(parse(text), lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    masked = F.zip_with(pieces(text), F.col("loss"), lambda p, s: F.substr(p, (s["start"] - s["at"] - len(START) + 1).cast("int"), s["length"].cast("int")))
    learned = F.array_join(F.transform(masked, unescape), "")
    return formatted.select(
        F.col("tree").alias("conv_id"), F.size(pieces(text)).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.length(text).cast("long").alias("formatted_chars"),
    )
