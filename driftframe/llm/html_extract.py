"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host, then applied to each page.

Every task aligns the pages it reads into one partial wrapper a host; partial wrappers of a host are aligned further in two
levels, so that a host with a third of all pages is merged from bounded parts. A wrapper says where the article stands: its core is
the element whose repeated groups hold most text that varies from page to page outside links. An article or main element around the
core bounds the article; up to there, and else up to the whole page, text beside the core is kept unless it is the template's, a
block of links, or in a container of other names with a label of the template's or strings much shorter than the core's. A string
that nearly all distinct pages of a host show at one place is the template's and goes wherever it equals, by place and string; that
is counted over all pages, in the JVM, a page's copies once. Names
that tell what is no article (whole words, see wrappers.py) leave an element out; names that tell an article only break ties.
Pages are then read once more, each with its host's decision (broadcast if the hosts are few, joined otherwise); a page that the
decision doesn't fit, or that has no other page of its host, is read by the wrapper of itself alone, by the same rules.

The text: blocks of the article in page order, without menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments; character references decoded, white space in a block made one space, blocks joined by an empty line.

Defined cases: a null or empty html, or one without any text, gives an empty text; a null or odd url makes its own host ''; a
repeated page gets a row each time, and counts once for its host's template; an empty table gives an empty result; other columns are
ignored; cut pages and unclosed tags are read to their end; a very long page is read whole.
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.llm.common import BATCH_ROWS, arrow_map, sized, stored
from driftframe.llm.html_tree import INLINE, Node, parse, squeeze
from driftframe.llm.wrappers import NEARLY_ALL, ROOT, Counts, Decision, Element, blocks_below, constant, counted, digest, dropped, inline_text, key_of, merge, own_text, page, says

#: Hosts whose decisions are broadcast; with more, pages and decisions are joined by host.
BROADCAST_HOSTS = 20_000
#: Hosts that a task keeps open; beyond, it hands out their partial wrappers and starts over.
OPEN_HOSTS = 2_000

_HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


_NUMBERS = pa.list_(pa.int64())
_PARTS = pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("page", pa.int64()), ("paths", _NUMBERS), ("strings", _NUMBERS), ("held", _NUMBERS)])


def _partial(batches):
    """Rows of two kinds: a host's partial wrapper, and what a page shows, as counted() gives it."""
    open_hosts: dict[str, Element] = {}

    def flush():
        rows = [{"host": h, "wrapper": json.dumps(e.pack())} for h, e in open_hosts.items()]
        open_hosts.clear()
        return pa.RecordBatch.from_pylist(rows, schema=_PARTS)

    for batch in batches:
        rows = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if html:
                digest, one, shown = counted(html, parse(html))
                open_hosts[host] = merge([([], open_hosts[host]), ([], one)])[1] if host in open_hosts else one
                rows.append((host, None, digest, *zip(*shown, strict=True)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PARTS, strict=True)], schema=_PARTS)
        if len(open_hosts) > OPEN_HOSTS:
            yield flush()
    yield flush()


def _merge_rows(rows: pd.DataFrame) -> Element:
    return merge([([], Element.unpack(json.loads(w))) for w in rows["wrapper"].sort_values()])[1]


def _counts(shown: DataFrame) -> DataFrame:
    """(host, pages, places, template) as in Counts, over shown(host, page, paths, strings, held); every distinct page counts once.

    Strings go on by (host, path, string), and those of one page alone go no further, so that a host with most pages makes no large task.
    """
    each = shown.dropDuplicates(["host", "page"]).select("host", F.inline(F.arrays_zip("paths", "strings", "held")).alias("path", "string", "held"))
    n = each.groupBy("host", "path", "string").agg(F.count(F.lit(1)).alias("n"), F.sum("held").alias("held"))
    n = stored(n.where("string IS NULL OR n > 1"), "page-strings")
    hosts = n.where((F.col("path") == ROOT) & F.col("string").isNull()).select("host", F.col("n").alias("pages"))
    n = n.join(sized(hosts, BROADCAST_HOSTS), "host").where(F.col("string").isNull() | (F.col("n") >= F.col("pages") * NEARLY_ALL))
    at = F.col("string").isNull()
    return n.groupBy("host").agg(
        F.first("pages").alias("pages"), F.collect_list(F.when(at, F.array("path", "n", "held"))).alias("places"), F.collect_list(F.when(~at, F.array("path", "string", "n"))).alias("template")
    )


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages, places, template) inferred from all pages(host, html); the last three as in Counts."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    read = pages.mapInArrow(_partial, "host string, wrapper string, page long, paths array<long>, strings array<long>, held array<long>").withColumn("part", F.spark_partition_id())
    read = stored(read, "partial-wrappers")
    parts = read.where("wrapper IS NOT NULL").select("host", "wrapper", "part")
    top = parts.agg(F.max("part")).first()[0] or 0
    level = max(1, int(top**0.5))

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[key[0], json.dumps(_merge_rows(rows).pack())]], columns=["host", "wrapper"])

    schema = "host string, wrapper string"
    once = parts.groupBy("host", F.pmod("part", F.lit(level)).alias("part")).applyInPandas(joined, schema)
    made = once.groupBy("host").applyInPandas(joined, schema)
    return made.join(_counts(read.where("wrapper IS NULL").drop("wrapper", "part")), "host")


def decisions(found: DataFrame) -> DataFrame:
    """(host, main, top, whole, beside, fixed) of wrappers; see Decision."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [Decision([], Element.unpack(json.loads(x["wrapper"])), Counts(x["pages"], x["places"], x["template"])) for x in batch.to_pylist()]
        kind = pa.list_(pa.string())
        columns = [pa.array([o.main for o in out], kind), pa.array([o.top for o in out], pa.int32()), pa.array([o.whole for o in out], pa.bool_()), pa.array([o.beside for o in out], kind), pa.array([o.fixed for o in out], kind)]
        return pa.RecordBatch.from_arrays([batch.column("host"), *columns], ["host", "main", "top", "whole", "beside", "fixed"])

    return arrow_map(found, f, "host string, main array<string>, top int, whole boolean, beside array<string>, fixed array<string>")


class Reader:
    """A decision in the form that pages are read by."""

    def __init__(self, main: list[str], top: int, whole: bool, beside: list[str], fixed: list[str]):
        self.main, self.top, self.whole, self.beside, self.fixed = main, top, whole, frozenset(beside), frozenset(fixed)
        self.places = frozenset(x.partition("\n")[0] for x in fixed)

    def is_fixed(self, path: str, node: Node) -> bool:
        return path in self.places and constant(path, digest(own_text(node))) in self.fixed


def reader(d: Decision) -> Reader:
    return Reader(d.main, d.top, d.whole, d.beside, d.fixed)


def _find(root: Node, path: list[str]) -> list[Node]:
    """Elements of a page at a path of keys."""
    level = [root]
    for key in path:
        level = [c for x in level for c in x.children if not isinstance(c, str) and key_of(c) == key]
    return level


#: Elements that a reader doesn't see and that end no block.
UNSEEN = frozenset(["script", "style", "template", "noscript", "link", "meta"])


def _blocks(node: Node, path: str, by: Reader, out: list[str], core: list[str] | None = None, inside: bool = True) -> None:
    """Blocks of an element. core: keys that lead on to the article's core if node stands above it; inside: False beside that core,
    where text without a word outside links is a menu, and headers of no section are the site's."""
    parts: list[str] = []
    beside = bool(core) or not inside
    unsaid = by.is_fixed(path, node) or (beside and not says(node))

    def flush() -> None:
        text = squeeze("".join(parts))
        parts.clear()
        if text and not unsaid:
            out.append(text)

    for c in node.children:
        if isinstance(c, str):
            parts.append(c)
        elif c.tag in INLINE and not blocks_below(c):
            if not dropped(key_of(c), True):
                parts.append(inline_text(c)[0])
        elif c.tag not in UNSEEN:
            flush()
            key = key_of(c)
            to = f"{path}/{key}"
            if core and key == core[0]:
                _blocks(c, to, by, out, core[1:])
            elif to not in by.beside and not dropped(key, not beside or node.tag == "section"):
                _blocks(c, to, by, out, None, not beside)
    flush()


def _read(root: Node, by: Reader) -> list[str]:
    """Blocks of a page by a decision that fits it."""
    out: list[str] = []
    if by.whole or _find(root, by.main):
        for node in _find(root, by.main[: by.top]):
            _blocks(node, "", by, out, None if by.whole else by.main[by.top :])
    return out


def main_text(html: str | None, by: Reader | None = None) -> str:
    """The article of a page, by its host's decision or, where that finds nothing, by the page's own wrapper."""
    if not html:
        return ""
    root = parse(html)
    out = _read(root, by) if by else []
    if not out:
        out = _read(root, reader(Decision(*page(html, root))))
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), _HOST, 1), F.lit(""))).alias("host"))
    made = stored(decisions(wrappers(rows.select("host", "html"))), "wrapper-decisions")
    by = ["main", "top", "whole", "beside", "fixed"]
    rows = rows.join(sized(made, BROADCAST_HOSTS), "host", "left").select("page_id", "url", "html", "host", *by)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, where = batch.column("host").to_pylist(), {}
        for i, h in enumerate(hosts):
            where.setdefault(h, i)
        known = {h: Reader(*(batch.column(c)[i].as_py() for c in by)) for h, i in where.items() if batch.column("main")[i].is_valid}
        texts = [main_text(x, known.get(h)) for h, x in zip(hosts, batch.column("html").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return arrow_map(rows, f, "page_id long, url string, text string, n_chars long")
