"""Benchmark decontamination: CGK embedding and repeated bit-sampling LSH, then exact edit verification.

Texts and benchmark items are sequences of normalised words (lower case, punctuation cut). Every position of every whole text
starts a window; CGK walks turn edit distance into Hamming distance, and repeated bit samples find the windows that share a
key with an anchor of an item (see cgk.py). A candidate window of the item's size, widened by the allowed distance on both
sides, is then verified exactly: an item is found if its word edit distance to some part of the window is at most
MAX_EDIT of its words, that is a similarity of 0.8 or more. Unedited passages are always found, as their keys are equal;
tests measure recall for edited ones.

The items are the query set: distinct texts with the ids that have them, a table in the shared folder, taken in blocks of about
BLOCK_ITEMS texts by hash. Only one block at a time is on the driver and sent to the tasks. One block is one map over the texts; of
more blocks each makes one pass that writes what it finds, and these findings, which are few, meet the documents at the end. Texts are
never shuffled.

Defined cases: a null text or item has no words; an item without words is never found; items with equal words are all found;
repeated rows get a row each; a null doc_id stays null; a null item_id stays null, first in the list of found items, and an id of
several found items is listed once; without items nothing is found; an empty table gives an empty result; other columns are ignored
by find() and pass through clean().
"""

from __future__ import annotations

import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.llm.cgk import REPEATS, Repetition, anchors, edit_distances
from driftframe.llm.common import arrow_map, keyed, plain, sized, stored

#: Share of an item's words that may be edited.
MAX_EDIT = 0.2
#: Distinct item texts of one block, about, and so of one broadcast.
BLOCK_ITEMS = 20_000
SEED = 11

_CUT = bytes(32 if (b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def normalised(text: str | None) -> list[bytes]:
    """Words of a text in lower case, with ASCII punctuation taken as white space."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_CUT).split()


class Index:
    """Keys of a block of items under all repetitions."""

    def __init__(self, items: list[tuple]):
        """items: (id, text) pairs; an id may be anything."""
        worded = [(i, w) for i, t in items if (w := normalised(t))]
        self.ids = [i for i, _ in worded]
        self.vocabulary: dict[bytes, int] = {}
        self.items = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64) for _, w in worded]
        self.slack = np.array([int(MAX_EDIT * len(w) + 1e-9) for w in self.items], np.int64)
        #: Symbols at which some item has an anchor: every repetition's first sampled step.
        self.anchor = np.zeros(len(self.vocabulary) + 1, bool)
        for item in self.items:
            self.anchor[item[anchors(len(item))]] = True
        self.repetitions = [Repetition(self.items, len(self.vocabulary), r, SEED + r) for r in range(REPEATS)] if worded else []

    def find(self, texts: list[str | None]) -> list[list]:
        """For each text the numbers, in order, of the items found in it, as ids stand for them."""
        found: list[set[int]] = [set() for _ in texts]
        if not self.items or not texts:
            return [[] for _ in texts]
        get = self.vocabulary.get
        parts, starts, at = [], [], 0
        for t in texts:
            w = normalised(t)
            parts.append(np.fromiter(map(get, w, repeat(0)), np.int64, len(w)))
            starts.append(at)
            at += len(w) + 1
        gap = np.zeros(1, np.int64)
        words = np.concatenate([x for p in parts for x in (p, gap)])
        begin = np.array(starts, np.int64)
        end = begin + np.array([len(p) for p in parts], np.int64)
        pairs, anchored = [], np.flatnonzero(self.anchor[words])
        for rep in self.repetitions:
            position, anchor = rep.candidates(words, anchored)
            if len(position):
                owner = rep.owner[anchor]
                # windows that start in the same cell, as wide as the slack allows, share one verification
                cell = (position - rep.offset[anchor] + len(words)) // (self.slack[owner] + 1)
                doc = np.searchsorted(begin, position, "right") - 1
                pairs.append(np.unique((owner * len(texts) + doc) * (2 * len(words) + 1) + cell))
        if not pairs:
            return [[] for _ in texts]
        owned, cells = np.divmod(np.unique(np.concatenate(pairs)), 2 * len(words) + 1)
        owners, docs = np.divmod(owned, len(texts))
        for part in np.split(np.arange(len(owners)), np.flatnonzero(np.diff(owners)) + 1):
            k = int(owners[part[0]])
            item, slack = self.items[k], int(self.slack[k])
            for some in np.split(part, range(4096, len(part), 4096)):
                low = cells[some] * (slack + 1) - len(words) - slack
                columns = low[:, None] + np.arange(len(item) + 3 * slack + 1)
                inside = (columns >= begin[docs[some], None]) & (columns < end[docs[some], None])
                windows = np.where(inside, words[np.clip(columns, 0, len(words) - 1)], -1)
                windows[windows == 0] = -1
                for d in docs[some][edit_distances(item, windows) <= slack]:
                    found[d].add(k)
        return [[self.ids[k] for k in sorted(x)] for x in found]


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The stored table (block, text, ids) of distinct item texts, and the number of blocks."""
    named = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    ids = F.sort_array(F.collect_set(F.struct("id")))
    texts = named.groupBy("text").agg(F.transform(ids, lambda x: x["id"]).alias("ids"))
    texts = stored(texts, "benchmark-items")
    blocks = -(-texts.count() // BLOCK_ITEMS)
    return texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(max(blocks, 1)))), blocks


def _found(ids: list[list]) -> list:
    """The ids of found items, each once, in order, null first."""
    return sorted({i for some in ids for i in some}, key=lambda i: (i is not None, i))


def _pass(df: DataFrame, text: str, items: DataFrame, block: int) -> DataFrame:
    """df with items_: the ids of the block's items found in its text."""
    one = [(r["ids"], r["text"]) for r in items.where(F.col("block") == block).orderBy("text").toLocalIterator()]
    sent = df.sparkSession.sparkContext.broadcast(one)
    names, t = df.columns, df.columns.index(text)
    schema = ", ".join(f"`{n}` {kind}" for n, kind in df.dtypes) + ", items_ array<bigint>"

    def f(batch: pa.RecordBatch, index: Index) -> pa.RecordBatch:
        more = [_found(x) for x in index.find(batch.column(t).to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(more, pa.list_(pa.int64()))], [*names, "items_"])

    named = uuid.uuid4().hex
    return arrow_map(df, f, schema, lambda: _index(named, sent))


#: The index that a worker process made last, for its next tasks.
_made: dict[str, Index] = {}


def _index(named: str, sent) -> Index:
    if named not in _made:
        _made.clear()
        _made[named] = Index(sent.value)
    return _made[named]


def _with_items(df: DataFrame, text: str, benchmark: DataFrame) -> DataFrame:
    """df, whose columns are named c0, c1, ..., with the array column items_ of the ids of items found in its text."""
    items, blocks = _items(benchmark)
    if blocks <= 1:
        return _pass(df, text, items, 0)
    rows = keyed(df, [text])
    parts = [stored(_pass(rows.select(text, "k1", "k2"), text, items, b).where(F.size("items_") > 0).select("k1", "k2", "items_"), "found-items") for b in range(blocks)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_list("items_"))), lambda i: F.struct(i.isNotNull().alias("some"), i.alias("id"))))
    every = stored(every.groupBy("k1", "k2").agg(F.transform(ids, lambda x: x["id"]).alias("items_")), "found-items")
    out = rows.join(sized(every), ["k1", "k2"], "left")
    return out.select(*df.columns, F.coalesce("items_", F.array().cast("array<bigint>")).alias("items_"))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, item_ids (sorted list of the items found in its text)."""
    found = _with_items(docs.select(F.col("doc_id").cast("long").alias("c0"), F.col("text").cast("string").alias("c1")), "c1", benchmark)
    return found.select(F.col("c0").alias("doc_id"), (F.size("items_") > 0).alias("contaminated"), F.size("items_").cast("long").alias("n_items"), F.col("items_").alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents in which an item is found, columns as they were."""
    kept = _with_items(plain(docs), f"c{docs.columns.index('text')}", benchmark).where(F.size("items_") == 0).drop("items_")
    return kept.toDF(*docs.columns)
