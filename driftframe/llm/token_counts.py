"""Token counts: two tiers of pre-token lengths looked up where the texts are read.

Tier 1 is a compact table of the corpus's most frequent pre-tokens and the number of tokens of each, broadcast to every
task. It is drawn from all documents without shuffling pre-tokens: every task keeps a bounded summary of its most frequent
ones, and only these summaries are added up. Tier 2 is a cache in each Python worker; a pre-token that neither tier knows is
encoded by the tokenizer itself, once per worker as long as the cache holds it. The tables only save work: a count is always
the sum of the tokenizer's own counts over pre-tokens.

A text is cut into pre-tokens here only if all its characters belong to SAFE, for which the pattern and the library's cutter
agree, and if it holds no special string; any other text is encoded whole by the library.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows get a row each; a null doc_id stays null; an
empty table gives an empty result; other columns are ignored; a very long text is handled whole, its pre-tokens streamed.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.llm.common import BATCH_ROWS, arrow_map

#: Entries of the broadcast table, and of a task's summary.
TABLE_SIZE = 32_768
SUMMARY_SIZE = 16_384
#: Entries of a worker's cache; the cache is emptied when it is full.
CACHE_SIZE = 1_000_000
LIMIT = 1024

#: The byte-level pre-token pattern of the vocabulary, and the characters on which Python's and the library's
#: character classes are known to agree (printable ASCII, tab, line feed, carriage return, Latin letters with marks).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNSAFE = r"[^\t\n\r\x20-\x7E\xC0-\xD6\xD8-\xF6\xF8-ſ]"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 up."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class TokenCounter:
    """Counts tokens of texts by one tokenizer, with a given table of pre-token lengths and a cache for the rest."""

    def __init__(self, path: str, table: dict[str, int] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, int] = {}
        self.find = regex.compile(PATTERN).findall
        self.unsafe = regex.compile(UNSAFE).search
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.use(table or {})

    def use(self, table: dict[str, int]) -> None:
        """Take a table of frequent pre-tokens; the cache starts over from it whenever it is full."""
        self.table = table
        self.known.update(table)

    def plain(self, text: str) -> bool:
        """Whether the text may be cut by PATTERN."""
        return self.unsafe(text) is None and not any(s in text for s in self.special)

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def learn(self, missing: set[str], make_room: bool = True) -> None:
        """Encode pre-tokens by the tokenizer's model and keep their lengths."""
        if make_room and len(self.known) + len(missing) > CACHE_SIZE:
            self.known = dict(self.table)
        encode, letters, known = self.model.tokenize, self.letters, self.known
        for piece in missing:
            known[piece] = len(encode(piece.encode().decode("latin-1").translate(letters)))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.plain(text):
            return self.whole(text)
        pieces = self.find(text)
        lengths = list(map(self.known.get, pieces))
        if None in lengths:
            self.learn({p for p, n in zip(pieces, lengths, strict=True) if n is None})
            lengths = list(map(self.known.get, pieces))
            if None in lengths:  # the cache was emptied in between
                self.learn({p for p, n in zip(pieces, lengths, strict=True) if n is None}, make_room=False)
                lengths = [self.known[p] for p in pieces]
        return sum(lengths)


@lru_cache(maxsize=2)
def _worker(path: str) -> TokenCounter:
    return TokenCounter(path)


def frequent(docs: DataFrame, path: str, size: int = TABLE_SIZE) -> dict[str, int]:
    """The size most frequent pre-tokens of all documents and their token counts, from bounded summaries of every task.

    A task's summary holds its SUMMARY_SIZE most frequent pre-tokens; when it has seen four times as many it keeps the most
    frequent half. What is dropped is rare there and costs a cached encoding later, never a wrong count.
    """

    def summarise(batches):
        worker, seen = _worker(path), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text and worker.plain(text):
                    seen.update(worker.find(text))
                    if len(seen) > 4 * SUMMARY_SIZE:
                        seen = Counter(dict(seen.most_common(2 * SUMMARY_SIZE)))
        top = seen.most_common(SUMMARY_SIZE)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    parts = docs.select(F.col("text").cast("string")).mapInArrow(summarise, "piece string, n long")
    rows = parts.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size).collect()
    worker = TokenCounter(path)
    worker.learn({r["piece"] for r in rows})
    return worker.known


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        worker = _worker(path)
        if worker.table is not table.value:
            worker.use(table.value)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        n = [worker.count(t) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), f, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
