"""Main text of HTML pages: markup first, a host's suffix array for what markup leaves open.

A page is cut into blocks. Menus, headers, footers, sidebars, notices, adverts, comments, scripts and styles named by
element, role, class or id go, and forms that hold no article; regions named as related links, sharing bars and the like
go where most of their text is links. If the page has an article or main element, its blocks are the text; of several,
those of all. Otherwise its remaining blocks are undecided, those of forms only where there are no others: substrings of
``DEPTH`` tokens or more that stand in at least ``MIN_PAGES`` distinct pages of the host are repeats, tokens they cover are
removed and the unique runs stay. Pages of equal blocks count as one, so copies of a page aren't each other's boilerplate;
a page that consists of repeats alone stays whole.

Pages are handled in chunks of about ``SHARD`` characters. A chunk's pages are concatenated as token streams, and a
suffix array gives each distinct substring with the pages of the chunk that hold it. The array is sorted to ``DEPTH``
tokens: a longer repeat is a chain of such substrings, each in as many pages at least, so what all repeats together cover
is the same as with whole suffixes in order. The counts are summed over all chunks by host and substring, both in a
96-bit hash, so that a chunk bounds memory and not the counting; substrings with enough pages go back to the chunks they
came from.

Suffix sorting alone can't tell an article printed on several pages from a menu, nor a one-off advert from text; that
is why it decides only where markup doesn't.

Defined results: null html reads as empty and gives an empty text; a null or odd url is a host of its own kind ("");
repeated rows are pages of their own and count as distinct; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.llm._io import materialize, text_column
from folium.session import ship

DEPTH = 6
MIN_PAGES = 3
SHARD = 2_000_000

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<!\[CDATA\[.*?\]\]>"
    r"|<[!?][^>]*+>"
    r"|<(?P<raw>script|style|textarea|iframe|noframes|xmp|noembed)(?=[\s/>])(?P<rawattrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<start2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody tfoot thead title tr ul caption".split()
)
# fixed values: elements, roles and names that pages use for what isn't their text
_DROP = frozenset("nav footer aside head script style noscript template select button dialog menu svg canvas object audio video applet map datalist label input".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices newsletter popup modal alert paywall nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars sidenav footer masthead topbar toolbar comment comments commentlist disqus replies respond outbrain taboola".split()
)
_LINK_WORDS = frozenset("header tags related recommended recommendations share sharing social widget widgets search login signin signup subscribe subscription overlay disclaimer reply feedback skiplink".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


_KEEP, _LINKS, _GONE = range(3)


def _fate(name: str, attrs: str, in_article: bool) -> int:
    """Whether an element's text is kept, kept unless it is mostly links, or gone."""
    if name in _DROP or name == "header" and not in_article:
        return _GONE
    if "=" not in attrs and "hidden" not in attrs:
        return _KEEP
    found = {k.lower(): _html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "").lower()):
        return _GONE
    if name in ("html", "body", "main"):
        return _KEEP
    if found.get("role", "").lower() in _DROP_ROLES:
        return _GONE
    if name in ("article", "h1", "h2", "form"):
        return _KEEP
    words = set(_WORDS.findall(_CAMEL.sub(" ", f"{found.get('class', '')} {found.get('id', '')}").lower()))
    return _GONE if words & _DROP_WORDS else _LINKS if words & _LINK_WORDS else _KEEP


class _State(NamedTuple):
    """Where in a page: gone, 2 in an article, 1 in main, else 0, in a region that goes if it is links, in a form, in a link."""

    gone: bool = False
    level: int = 0
    soft: bool = False
    form: bool = False
    link: bool = False


def blocks_of(page: str) -> tuple[bool, list[str]]:
    """Whether markup names the main text, and its blocks or else all blocks not ruled out."""
    stack: list[tuple[str, _State]] = []
    now = _State()
    blocks: list[tuple[int, bool, str]] = []
    part: list[str] = []
    region: list[tuple[int, bool, str]] = []  # blocks of the region that goes if it is links
    shown = linked = 0

    def say(text: str) -> None:
        nonlocal shown, linked
        part.append(text)
        if now.soft:
            n = len(text.strip())
            shown, linked = shown + n, linked + n * now.link

    def flush() -> None:
        if part:
            text = " ".join("".join(part).split())
            part.clear()
            if text:
                (region if now.soft else blocks).append((now.level, now.form, text))

    def to(new: _State) -> None:
        """Enters a state; a region is settled when it ends."""
        nonlocal now, shown, linked
        if now.soft and not new.soft:
            if 2 * linked <= shown:
                blocks.extend(region)
            region.clear()
            shown = linked = 0
        now = new

    def pop_to(i: int) -> None:
        new = stack[i - 1][1] if i else _State()
        if now[1:4] != new[1:4] or any(n in _BLOCK for n, _ in stack[i:]):
            flush()
        del stack[i:]
        to(new)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not now.gone:
            say(_html.unescape(page[at : m.start()]))
        at = m.end()
        if end := m["end"]:
            end = end.lower()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == end:
                    pop_to(i)
                    break
            if end in ("td", "th") and not now.gone:
                say(" ")
            continue
        if m["raw"]:
            continue
        start = m["start"] or m["start2"]
        if not start:
            if page.startswith("<![CDATA[", m.start()) and not now.gone:
                say(page[m.start() + 9 : m.end() - 3])
            continue
        start, attrs = start.lower(), m["attrs"] or m["attrs2"] or ""
        if start == "br" or start in ("td", "th"):
            if not now.gone:
                say(" ")
            if start == "br":
                continue
        if start in _BLOCK:
            if not now.gone:
                flush()
            for i in range(len(stack) - 1, -1, -1):  # a paragraph ends where a block begins
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in _BLOCK:
                    break
        if start in _CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _CLOSES[start]:
                    pop_to(i)
                    break
                if stack[i][0] in ("ul", "ol", "table", "dl", "select", "div"):
                    break
        if start == "body":  # an open head ends here
            for i in range(len(stack)):
                if stack[i][0] == "head":
                    pop_to(i)
                    break
        if start in _VOID or attrs.endswith("/") and start not in _BLOCK:
            continue
        fate = _GONE if now.gone else _fate(start, attrs, now.level > 0)
        level, form = now.level, now.form or start == "form"
        if fate != _GONE and (start == "article" or "articlebody" in attrs.lower()):
            level, form = 2, False
        elif fate != _GONE and level < 1 and (start == "main" or 'role="main"' in attrs.lower()):
            level, form = 1, False
        new = _State(fate == _GONE, level, now.soft or fate == _LINKS and start in _BLOCK, form, now.link or start == "a")
        if new[1:4] != now[1:4]:
            flush()
        stack.append((start, new))
        to(new)
    if at < len(page) and not now.gone:
        say(_html.unescape(page[at:]))
    flush()
    to(_State())
    for level in (2, 1):
        if own := [t for n, form, t in blocks if n >= level and not form]:
            return True, own
    return False, [t for _, form, t in blocks if not form] or [t for *_, t in blocks]


def _classes(streams: list[np.ndarray], depth: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For every place of the streams, each followed by a mark of its own, the class of its next ``depth`` tokens; for every class its distinct pages, of those that ``counts`` marks.

    The suffix array of all streams is sorted by prefix doubling, as deep as ``depth`` tokens: suffixes that are then
    equal share a substring of that length, and a longer repeated one is a chain of such.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    total = int(sizes.sum() + len(streams))
    ids, page = np.empty(total, np.int64), np.repeat(np.arange(len(streams)), sizes + 1)
    at = 0
    for i, s in enumerate(streams):
        ids[at : at + len(s)] = s
        ids[at + len(s)] = -1 - i  # every page ends with a mark of its own
        at += len(s) + 1
    rank = np.unique(ids, return_inverse=True)[1]
    reach = 1
    while reach < depth:
        step = min(reach, depth - reach)
        ahead = np.full(total, -1, np.int64)
        ahead[: total - step] = rank[step:]
        order = np.lexsort((ahead, rank))
        r, a = rank[order], ahead[order]
        new = np.concatenate([[0], np.cumsum((r[1:] != r[:-1]) | (a[1:] != a[:-1]))])
        rank = np.empty(total, np.int64)
        rank[order] = new
        reach += step
    own = slice(None) if counts is None else counts[page]
    pairs = np.unique((rank * len(streams) + page)[own])
    return rank, np.bincount(pairs // len(streams), minlength=int(rank.max()) + 1)


def _covers(starts: np.ndarray, depth: int) -> np.ndarray:
    """The places that substrings of ``depth`` tokens cover, from a mask of where they start."""
    mark = np.zeros(len(starts) + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(mark, at, 1)
    np.add.at(mark, np.minimum(at + depth, len(starts)), -1)
    return np.cumsum(mark[:-1]) > 0


def covered(streams: list[np.ndarray], depth: int = DEPTH, min_pages: int = MIN_PAGES) -> list[np.ndarray]:
    """For each page's token ids a mask of the tokens in substrings of ``depth`` or more that at least ``min_pages`` pages hold."""
    sizes = np.array([len(s) for s in streams], np.int64)
    if not sizes.any():
        return [np.zeros(len(s), bool) for s in streams]
    rank, pages = _classes(streams, depth)
    mask = _covers((pages >= min_pages)[rank], depth)
    ends = np.cumsum(sizes + 1)
    return [mask[e - n - 1 : e - 1] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _streams(hosts: list[str], pages: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Token ids of each page, apart for each host, and for every id a 128-bit hash of host and word."""
    from xxhash import xxh64_intdigest, xxh128_digest

    known: dict[tuple[str, str], int] = {}
    streams = [np.array([known.setdefault((host, w), len(known)) for b in blocks for w in b.split(" ")], np.int64) for host, blocks in zip(hosts, pages, strict=True)]
    seed = {host: xxh64_intdigest(host.encode("utf-8", "surrogatepass")) for host in set(hosts)}
    data = b"".join(xxh128_digest(w.encode("utf-8", "surrogatepass"), seed[host]) for host, w in known)
    return streams, np.frombuffer(data, np.uint64).reshape(-1, 2)


def _keys(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash in 64 and 32 bits of every ``depth`` token hashes in a row."""
    n = len(tokens) - depth + 1
    h = np.zeros((max(n, 0), 2), np.uint64)
    for j in range(depth if n > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[j : j + n]
    return h[:, 0].copy().view(np.int64), (h[:, 1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


_COUNTED = pa.schema([("chunk", pa.int64()), ("a", pa.int64()), ("b", pa.int32()), ("pages", pa.int64())])


def _counted(batches):
    """Distinct substrings of a chunk's pages, as hashes, each with the number of pages that hold it and count. A chunk may come in parts."""
    for batch in batches:
        for chunk, rows in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: r[0]):
            _, hosts, pages, counts = zip(*rows, strict=True)
            streams, tokens = _streams(hosts, pages)
            if max(map(len, streams)) < DEPTH:
                continue
            rank, holders = _classes(streams, DEPTH, np.array(counts))
            sizes = np.array([len(s) for s in streams], np.int64)
            left = np.repeat(np.cumsum(sizes + 1) - 1, sizes + 1) - np.arange(len(rank))
            first = np.unique(rank, return_index=True)[1]
            first = first[left[first] >= DEPTH]
            flat = np.concatenate([np.append(s, 0) for s in streams])  # marks count as any word: no whole substring has one
            a, b = _keys(tokens[flat], DEPTH)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), chunk)), pa.array(a[first]), pa.array(b[first]), pa.array(holders[rank[first]])], schema=_COUNTED)


def _among(a: np.ndarray, b: np.ndarray, known_a: np.ndarray, known_b: np.ndarray) -> np.ndarray:
    """Which pairs of ``a`` and ``b`` are known; ``known_a`` rises."""
    lo, hi = np.searchsorted(known_a, a), np.searchsorted(known_a, a, side="right")
    hit = np.zeros(len(a), bool)
    for k in range(int((hi - lo).max(initial=0))):
        hit |= (lo + k < hi) & (known_b[np.minimum(lo + k, len(known_b) - 1)] == b)
    return hit


def _unique_runs(blocks: list[str], mask: np.ndarray) -> list[str]:
    """A page's blocks without the tokens that repeated substrings cover; empty blocks go. A page of repeats alone stays whole."""
    at, kept = 0, []
    for block in blocks:
        b = block.split(" ")
        own = mask[at : at + len(b)]
        at += len(b)
        if text := " ".join(w for w, gone in zip(b, own.tolist(), strict=True) if not gone):
            kept.append(text)
    return kept or blocks


_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("text", pa.string()), ("blocks", pa.list_(pa.string())), ("chunk", pa.int64()), ("row", pa.int64()), ("content", pa.binary())])


def _extracted(shard: int):
    def run(batches):
        from xxhash import xxh128_digest

        chunk, size = None, 0
        for b in batches:
            rows = []
            for row, page_id, url, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                host = re.match(r"[a-zA-Z][\w+.-]*://([^/?#]*)", url or "")
                host = host[1].lower() if host else ""
                named, blocks = blocks_of(page)
                content = None if named else xxh128_digest("\0".join([host, *blocks]).encode("utf-8", "surrogatepass"))
                if not named:
                    n = 1 + sum(map(len, blocks))
                    if chunk is None or size + n > shard:
                        chunk, size = row, 0
                    size += n
                rows.append((page_id, url, host, "\n\n".join(blocks) if named else None, None if named else blocks, None if named else chunk, row, content))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PAGE.types, strict=True)], schema=_PAGE)

    return run


def _cleaned(t: pa.Table, repeated: pa.Table) -> pa.Table:
    pages = t.column("blocks").to_pylist()
    streams, tokens = _streams(t.column("host").to_pylist(), pages)
    known_a, known_b = repeated.column("a").to_numpy(), repeated.column("b").to_numpy()
    order = np.argsort(known_a)
    known_a, known_b = known_a[order], known_b[order]
    texts = []
    for blocks, s in zip(pages, streams, strict=True):
        starts = np.zeros(len(s), bool)
        if len(s) >= DEPTH and len(known_a):
            starts[: len(s) - DEPTH + 1] = _among(*_keys(tokens[s], DEPTH), known_a, known_b)
        texts.append("\n\n".join(_unique_runs(blocks, _covers(starts, DEPTH))))
    return pa.table({"page_id": t.column("page_id"), "url": t.column("url"), "text": pa.array(texts, pa.string())})


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``."""
    ship(pages.sparkSession)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"), F.col("url").cast("string"), text_column("html").alias("html"))
    parsed = materialize(rows.mapInArrow(_extracted(SHARD), "page_id long, url string, host string, text string, blocks array<string>, chunk long, row long, content binary"), "parsed")
    done = parsed.where("text is not null").select("page_id", "url", "text")
    open_ = parsed.where("text is null").select("chunk", "host", "blocks", "page_id", "url")
    # of pages with one content one counts; found by partial minima
    single = parsed.where("text is null").groupBy("content").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("counts"))
    marked = parsed.where("text is null").join(single, "row", "left").select("chunk", "host", "blocks", F.coalesce("counts", F.lit(False)).alias("counts"))
    counted = marked.sortWithinPartitions("chunk").mapInArrow(_counted, "chunk long, a long, b int, pages long")
    repeated = counted.withColumn("n", F.sum("pages").over(Window.partitionBy("a", "b"))).where(F.col("n") >= MIN_PAGES).select("chunk", "a", "b")
    cleaned = open_.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(_cleaned, "page_id long, url string, text string")
    return done.unionByName(cleaned).withColumn("n_chars", F.length("text").cast("long"))
