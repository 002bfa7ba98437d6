"""Main text of web pages: markup first, repeated runs of the host's pages for the rest.

1. A tolerant scan of the markup gives the page's blocks. Scripts, styles, menus,
   headers, footers, sidebars, forms, adverts, notices and reader comments are
   told by element, role or class name and left out; a name never leaves out an
   article or main element, or what holds one, but comments stay out.
2. The token streams of what is left are concatenated by host; a suffix array (prefix
   doubling, then neighbours in order) finds the runs of ``MIN_RUN`` tokens that distinct
   pages share. Tokens that repeated runs cover are boilerplate and go, the others stay.
   Pages with equal streams count as one page, so a copied page keeps its text.
3. Inside an article or main element a run is boilerplate if it stands on ``COMMON_SHARE``
   of the host's distinct pages, at least on ``COMMON_PAGES``: a notice or menu without a
   telling name. Passages that some articles share are theirs and stay. Pages without
   such an element leave their blocks open: there a second page is enough.

A large host is dealt to chunks of bounded size. Each chunk's suffix array gives its
distinct runs with their first and last page, and these are merged by run: no task
holds a host, and the result is the same as from one array. A run that is common on a host
is as common in one of its chunks at least, so chunks name candidates, of which all count their pages.

Repetition alone cannot give the text that is asked for: menus, adverts and
footers of a page may be unlike all others, while articles share passages. So the
markup decides first.

Null or empty html gives empty text. Repeated rows each get their text. Broken
markup (unclosed tags, cut references) never fails. Only the named columns are read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepset.llm.arrow import runs, texts
from keepset.llm.store import stored, table
from keepset.llm.urls import host

MIN_RUN = 8
CHUNK_TOKENS = 2_000_000
CHUNK_CHARS = 8_000_000  # html of a chunk of pages with an article or main element
COMMON_SHARE, COMMON_PAGES = 0.9, 10
# Elements and names of HTML and of common page layouts.
_RAW = {"script", "style", "template", "noscript", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_MAIN = {"article", "main"}
_LEFT_OUT = {"nav", "header", "footer", "aside", "form", "button", "select", "head", "menu", "dialog", "svg", "object", "canvas"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
           "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
           "wbr", "br", "input", "embed"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar"}
_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies",
          "consent", "gdpr", "notice", "notices", "notification", "alert", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb",
          "breadcrumbs", "comment", "comments", "disqus", "reply", "replies", "respond", "share", "sharing", "social", "related", "newsletter",
          "subscribe", "subscription", "popup", "modal", "footer", "masthead", "widget", "toolbar", "pagination", "pager"}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[^a-z]+")
_COMMENTS = {"comment", "comments", "disqus", "reply", "replies", "respond"}
_SECTIONS = {"area", "list", "section", "thread", "wrapper", "respond", "form"}
_STATES = {"has", "no", "with", "without", "is", "not", "hide", "show"}  # such a token tells of a page, not of the element
_NAMED_OUT, _OUT = 1, 2  # by name, which an article inside undoes; for good


def _is_name(token: str, names: set[str]) -> bool:
    """Whether the first or the last part of a class token or id is a name."""
    parts = [p for p in _PARTS.split(token) if p]
    return bool(parts) and parts[0] not in _STATES and (parts[0] in names or parts[-1] in names)


def _is_comments(token: str) -> bool:
    """Whether a class token or id names a comment section (comments-area), not a page's state (comments-open)."""
    parts = [p for p in _PARTS.split(token) if p]
    return bool(parts) and parts[0] not in _STATES and (parts[-1] in _COMMENTS or parts[0] in _COMMENTS and parts[-1] in _SECTIONS)


def _left_out(name: str, attributes: str) -> int:
    """0, ``_NAMED_OUT`` or ``_OUT``."""
    if name in _LEFT_OUT:
        return _OUT
    if "=" not in attributes or name in ("body", "html"):
        return 0
    found = 0
    for kind, *values in _NAMED.findall(attributes):
        tokens = next((v for v in values if v), "").lower().split()
        if kind.lower() == "role":
            if " ".join(tokens) in _ROLES:
                return _OUT
        elif any(token in _COMMENTS or name not in _MAIN and _is_comments(token) for token in tokens):
            return _OUT
        elif any(_is_name(token, _NAMES) for token in tokens):
            found = _NAMED_OUT
    return found


def blocks(page: str) -> tuple[list[str], bool]:
    """The page's blocks in order, and whether they come from an article or main element.

    White space within a block is one space; character references are decoded.
    """
    main, rest, held = [], [], []
    stack: list[tuple[str, int, bool, bool]] = []  # element; from here: left out, inside main, inside an article
    skip, inside, article = 0, False, False

    def close_block() -> None:
        if held:
            text = " ".join(references.unescape("".join(held)).split())
            held.clear()
            if text:
                rest.append(text)
                if inside:
                    main.append(text)

    at, n = 0, len(page)
    while at < n:
        tag = _TAG.search(page, at)
        start = tag.start() if tag else n
        if start > at and not skip:
            held.append(page[at:start])
        if not tag:
            break
        at, name = tag.end(), (tag[2] or "").lower()
        if not name:
            continue
        if name == "br" and not skip:
            held.append(" ")
        if name not in _INLINE:
            close_block()
        if tag[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                if name in _INLINE and any(s[0] not in _INLINE for s in stack[k + 1:]):
                    continue  # a misplaced inline end tag closes no block
                state = stack[k - 1][1:] if k else (0, False, False)
                if state != (skip, inside, article):
                    close_block()
                skip, inside, article = state
                del stack[k:]
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in _VOID or tag[3].endswith("/") and name in ("svg", "path"):
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack:
            # such an element ends an open one of its kind, back to the nearest container
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    skip, inside, article = stack[k - 1][1:] if k else (0, False, False)
                    del stack[k:]
                    break
                if stack[k][0] not in _INLINE:
                    break
        out = _left_out(name, tag[3])
        if out and not skip:
            close_block()
        if name in _MAIN and not article and max(skip, out) == _NAMED_OUT:
            skip = out = 0
        skip, inside, article = max(skip, out), inside or name in _MAIN, article or name == "article"
        stack.append((name, skip, inside, article))
    close_block()
    return (main, True) if main else (rest, False)


def _stream(parts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for b in parts for w in b.split()], dtype=np.uint64)


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` tokens, and for each place in text its rank by them.

    Equal ranks mean equal first ``depth`` tokens. Prefix doubling: ranks by one
    token, then by 2, 4, ... until ``depth`` is covered.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < depth:
        step = min(length, depth - length)
        behind = np.full(n, -1, dtype=np.int64)
        behind[:n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + behind + 1, return_inverse=True)[1].astype(np.int64)
        length += step
    return np.argsort(rank, kind="stable"), rank


def run_hashes(tokens: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """The hash of the ``least`` tokens from each place on."""
    hashes = np.zeros(len(at), dtype=np.uint64)
    for k in range(least):
        hashes = (hashes ^ tokens[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    return hashes


def shared_runs(streams: list[np.ndarray], pages: list[int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every distinct run of ``least`` tokens of the concatenated streams.

    Returns per run its hash, first and last page; and per place of the
    concatenation the number of its run (-1 if it would leave the page) and its page's row.
    """
    sizes = np.array([len(s) for s in streams])
    gaps = np.arange(len(streams), dtype=np.uint64)  # a mark no other stream has ends each page
    tokens = np.concatenate([np.append(s, g) for s, g in zip(streams, gaps)])
    row = np.repeat(np.arange(len(streams)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    whole = np.arange(len(tokens)) + least <= ends[row]
    order, rank = suffix_array(tokens, least)
    order = order[whole[order]]
    run = np.full(len(tokens), -1, dtype=np.int64)
    if not len(order):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), run, row
    new = np.append(True, rank[order][1:] != rank[order][:-1])  # neighbours in suffix order with a shorter common prefix
    run[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    page = np.array(pages, dtype=np.int64)[row[order]]
    hashes = run_hashes(tokens, order[first], least)
    return hashes, np.minimum.reduceat(page, first), np.maximum.reduceat(page, first), run, row


def without_repeats(parts: list[str], covered: np.ndarray) -> str:
    """The blocks without their covered tokens."""
    out, at = [], 0
    for block in parts:
        tokens = block.split()
        kept = [t for t, gone in zip(tokens, covered[at:at + len(tokens)]) if not gone]
        at += len(tokens)
        if kept:
            out.append(" ".join(kept))
    return "\n".join(out)


def _covered(repeated: np.ndarray, run: np.ndarray, least: int) -> np.ndarray:
    """Places that lie in a repeated run."""
    starts = (run >= 0) & repeated[np.maximum(run, 0)] if len(repeated) else np.zeros(len(run), dtype=bool)
    reach = np.cumsum(starts) - np.append(np.zeros(least, dtype=np.int64), np.cumsum(starts))[:len(run)]
    return reach > 0


def open_pages_cleaned(open_pages: DataFrame, least: int = MIN_RUN, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``row, text`` of pages (``host, stream, row, parts, n``) without the runs that distinct pages of a host share."""
    sizes = open_pages.groupBy("host").agg(F.sum("n").alias("total"))
    chunks = F.ceil(F.col("total") / chunk_tokens).cast("int")
    placed = (open_pages.join(sizes, "host").withColumn("chunks", chunks)
              .withColumn("chunk", F.pmod(F.col("stream"), F.greatest("chunks", F.lit(1)))))
    placed = placed.repartition("host", "chunk").sortWithinPartitions("host", "chunk")

    def groups(batches):
        for group in runs(batches, ["host", "chunk"]):
            parts = group.column("parts").to_pylist()
            yield group, parts, shared_runs([_stream(p) for p in parts], group.column("stream").to_pylist(), least)

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _, (hashes, first, last, _, _) in groups(batches):
            if group.column("chunks")[0].as_py() > 1:
                yield pa.RecordBatch.from_arrays([pa.array([group.column("host")[0].as_py()] * len(hashes), pa.string()),
                                                  pa.array(hashes.view(np.int64)), pa.array(first), pa.array(last)], ["host", "run", "first", "last"])

    merged = (placed.mapInArrow(listed, "host string, run long, first long, last long").groupBy("host", "run")
              .agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first <> last").select("host", "run"))
    merged = stored(merged, "host-runs")

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, parts, (hashes, first, last, run, row) in groups(batches):
            if group.column("chunks")[0].as_py() > 1:
                continue
            covered = _covered(first != last, run, least)
            ends = np.searchsorted(row, np.arange(len(parts) + 1))
            found = [without_repeats(p, covered[a:b]) for p, a, b in zip(parts, ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([group.column("row").combine_chunks(), pa.array(found, pa.string())], ["row", "text"])

    def exploded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, parts, (hashes, _, _, run, row) in groups(batches):
            if group.column("chunks")[0].as_py() > 1:
                at = np.flatnonzero(run >= 0)
                begin = np.searchsorted(row, np.arange(len(parts)))
                rows = group.column("row").combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array([group.column("host")[0].as_py()] * len(at), pa.string()),
                                                  pa.array(hashes[run[at]].view(np.int64)), rows.take(pa.array(row[at])),
                                                  pa.array((at - begin[row[at]]).astype(np.int32))], ["host", "run", "row", "place"])

    marks = (placed.mapInArrow(exploded, "host string, run long, row long, place int").join(merged, ["host", "run"], "left_semi")
             .groupBy("row").agg(F.collect_list("place").alias("places")))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for parts, places in zip(batch.column("parts").to_pylist(), batch.column("places").to_pylist(), strict=True):
                covered = np.zeros(sum(len(p.split()) for p in parts), dtype=bool)
                for place in places or []:
                    covered[place:place + least] = True
                found.append(without_repeats(parts, covered))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string())], ["row", "text"])

    large = placed.where("chunks > 1").select("row", "parts").join(marks, "row", "left")
    return placed.mapInArrow(local, "row long, text string").union(large.mapInArrow(cut, "row long, text string"))


def common_runs(streams: DataFrame, sizes: DataFrame, least: int = MIN_RUN, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``host, runs``: hashes of the runs that are common on a host's pages (``host, stream, parts``); ``sizes``:
    ``host, chars``, by which hosts are dealt to chunks. Equal streams are one page.

    A host has no more such runs than a page has tokens, divided by ``COMMON_SHARE``.
    """
    large = sizes.where(F.col("chars") > chunk_chars).select("host", F.ceil(F.col("chars") / chunk_chars).cast("int").alias("chunks"))
    placed = (streams.join(F.broadcast(large), "host", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
              .withColumn("chunk", F.pmod("stream", "chunks")))
    placed = placed.repartition("host", "chunk").sortWithinPartitions("host", "chunk", "stream")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, np.ndarray, np.ndarray]]:
        """A chunk of distinct pages, their number, its runs and on how many pages each stands."""
        for group in runs(batches, ["host", "chunk"]):
            stream = group.column("stream").to_numpy()
            group = group.take(pa.array(np.flatnonzero(np.append(True, stream[1:] != stream[:-1]))))
            found = [_stream(p) for p in group.column("parts").to_pylist()]
            hashes, _, _, run, row = shared_runs(found, list(range(len(found))), least)
            both = np.unique(run[run >= 0] * len(found) + row[run >= 0])
            yield group, len(found), hashes, np.bincount(both // len(found), minlength=len(hashes))

    def common(pages, n):
        return (pages >= COMMON_SHARE * n) & (pages >= COMMON_PAGES)

    def lists_of(named: list[tuple[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if named:
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in named], pa.string()),
                                              pa.array([r.view(np.int64) for _, r in named], pa.list_(pa.int64()))], ["host", "runs"])

    def named(whole: bool):
        def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group, n, hashes, pages in counted(batches):
                kept = hashes[common(pages, n) if whole else pages >= COMMON_SHARE * n]
                yield from lists_of([(group.column("host")[0].as_py(), kept)] if len(kept) else [])
        return task

    def recounted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, n, hashes, pages in counted(batches):
            asked = np.unique(np.array(group.column("runs")[0].as_py() or [], dtype=np.int64)).view(np.uint64)
            held = np.isin(hashes, asked)
            run, pages = np.append(hashes[held].view(np.int64), 0), np.append(pages[held], n)  # the last row: all pages
            yield pa.RecordBatch.from_arrays([pa.array([group.column("host")[0].as_py()] * len(run), pa.string()), pa.array(run),
                                              pa.array(np.arange(len(run)) == len(run) - 1), pa.array(pages.astype(np.int64))],
                                             ["host", "run", "every", "pages"])

    whole = placed.where("chunks = 1").mapInArrow(named(True), "host string, runs array<long>")
    split = placed.where("chunks > 1")
    asked = stored(split.mapInArrow(named(False), "host string, runs array<long>").select("host", F.explode("runs").alias("run"))
                   .groupBy("host").agg(F.collect_set("run").alias("runs")), "asked-runs")
    pages = split.join(asked, "host").repartition("host", "chunk").sortWithinPartitions("host", "chunk", "stream").mapInArrow(
        recounted, "host string, run long, every boolean, pages long").groupBy("host", "run", "every").agg(F.sum("pages").alias("pages"))
    pages = stored(pages, "run-pages")
    every = pages.where("every").select("host", F.col("pages").alias("n"))
    found = (pages.where("NOT every").join(every, "host").where(common(F.col("pages"), F.col("n")))
             .groupBy("host").agg(F.collect_list("run").alias("runs")))
    return stored(whole.union(found), "common-runs")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, least: int = MIN_RUN,
              chunk_tokens: int = CHUNK_TOKENS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``id, url, text`` for each page."""
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def streams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # a copy counts once anyway
        for batch in batches:
            rows, parts, numbers = [], [], []
            for i, page in enumerate(texts(batch.column("html"))):
                found, is_main = blocks(page)
                number = xxhash.xxh3_64_intdigest(" ".join(found)) >> 1
                if is_main and (batch.column("host")[i].as_py(), number) not in seen:
                    seen.add((batch.column("host")[i].as_py(), number))
                    rows.append(i), parts.append(found), numbers.append(number)
            yield pa.RecordBatch.from_arrays([batch.column("host").take(pa.array(rows, pa.int32())), pa.array(numbers, pa.int64()),
                                              pa.array(parts, pa.list_(pa.string()))], ["host", "stream", "parts"])

    def settled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for page, common in zip(texts(batch.column("html")), batch.column("runs"), strict=True):
                parts, is_main = blocks(page)
                if is_main and common.is_valid:
                    tokens = _stream(parts)
                    run = run_hashes(tokens, np.arange(max(len(tokens) - least + 1, 0)), least).view(np.int64)
                    held = np.append(np.isin(run, common.values.to_numpy()), np.zeros(len(tokens) - len(run), dtype=bool))
                    found.append(without_repeats(parts, _covered(np.ones(1, dtype=bool), np.where(held, 0, -1), least)))
                else:
                    found.append("\n".join(parts) if is_main or not parts else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(found, pa.string())], ["id", "url", "text"])

    def left_open(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, streams, sizes = [], [], [], []
            for i, page in enumerate(texts(batch.column("html"))):
                found, is_main = blocks(page)
                if found and not is_main:
                    rows.append(i), parts.append(found), sizes.append(sum(len(p.split()) for p in found))
                    streams.append(xxhash.xxh3_64_intdigest(" ".join(found)) >> 1)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("id", "url", "host")] + [
                pa.array(streams, pa.int64()), pa.array(parts, pa.list_(pa.string())), pa.array(sizes, pa.int64())],
                ["id", "url", "host", "stream", "parts", "n"])

    kinds = dict(source.dtypes)
    hosted = source.withColumn("host", host(F.col("url")))
    sizes = hosted.groupBy("host").agg(F.sum(F.length("html")).alias("chars"))
    common = common_runs(hosted.mapInArrow(streams, "host string, stream long, parts array<string>"), sizes, least, chunk_chars)
    done = hosted.join(common, "host", "left").select("id", "url", "html", "runs").mapInArrow(
        settled, f"id {kinds['id']}, url string, text string")
    waiting = stored(hosted.mapInArrow(
        left_open, f"id {kinds['id']}, url string, host string, stream long, parts array<string>, n long"), "open-pages")
    waiting = stored(waiting.withColumn("row", F.monotonically_increasing_id()), "open-rows")
    folded = waiting.groupBy("host", "stream").agg(F.min("row").alias("row"))
    alone = waiting.join(folded.select("row"), "row", "left_semi")
    cleaned = open_pages_cleaned(alone.select("host", "stream", "row", "parts", "n"), least, chunk_tokens)
    texts_of = folded.join(cleaned, "row").select("host", "stream", "text")
    copied = waiting.join(texts_of, ["host", "stream"]).select("id", "url", "text")
    return (done.where("text IS NOT NULL").union(copied).withColumnsRenamed({"id": id_col, "url": url_col}))


def page_texts(spark, sf_dir: str) -> DataFrame:
    """``op4_html_text``: the main text of every page."""
    found = main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
