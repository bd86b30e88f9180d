"""Main text of web pages: token runs repeated over a host's pages, found by a suffix array, and the page's own structure."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcomm.llm.common import pack_sorted, unpack_sorted
from sparkcomm.llm.scoring import mix, pair_hash
from sparkcomm.session import materialize

#: Runs of so many tokens that stand on so many distinct pages of a host are boilerplate.
RUN, PAGES = 5, 3
#: Pages of a host that share one suffix array; hosts with more are dealt over several, and their runs are counted by hash.
SHARD, SHARD_CHARS = 2000, 8 << 20
#: Characters of a host's pages for each block of the hash range in which its windows are counted.
BLOCK_CHARS = 16 << 20
#: Bits of a window's hash in its block. A block holds some millions of windows, so two of them rarely agree (1 in 30,000 windows).
BITS, LOW = np.uint64(36), np.uint64((1 << 36) - 1)
#: Bits of a window's cell in its block. Cells of the windows are counted first; one window alone in its cell goes no further.
CELL = 25
#: Share of a block's tokens that repeated runs must cover.
COVERED = 0.5

# Elements of HTML by the part they play on a page.
HIDDEN = "head script style noscript template iframe object svg math canvas audio video select datalist button textarea".split()
APART = "nav header footer aside form menu dialog fieldset".split()
MAIN = "article main".split()
TEXT = "p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split()
BREAKS = "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
# Words in class, id and role that name parts beside the article.
BESIDE = set(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice
    notices alert nav navbar navigation menu breadcrumb breadcrumbs sidebar aside complementary widget footer contentinfo header masthead
    topbar toolbar share sharing social related recommended comment comments disqus reply replies respond newsletter subscribe
    subscription signup login search popup modal overlay dialog pagination pager form skip""".split()
)
_HIDDEN, _APART, _MAIN, _TEXT, _BREAKS, _VOID = map(set, (HIDDEN, APART, MAIN, TEXT, BREAKS, VOID))
_RAW = "|".join(("script", "style", "noscript", "template", "textarea", "iframe", "svg"))
_PART = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*?(?<!/)>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|([^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDE = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TIMES = [f"from_{i + 1}" for i in range(PAGES)]


@dataclass
class Block:
    """Text of one block: beside the article by its markup, inside an article or main element, in an element meant for text."""

    text: str
    beside: bool
    inside: bool
    prose: bool
    tokens: list[str] = field(default_factory=list)


def _beside(tag: str, attributes: str) -> bool:
    if tag in _APART:
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    if _HIDE.search(attributes):
        return True
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
    return bool(names) and not BESIDE.isdisjoint(w.lower() for w in _WORDS.findall(names))


def blocks(page: str) -> list[Block]:
    """Blocks of visible text in page order. Unclosed elements end with what holds them."""
    out: list[Block] = []
    held: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each is beside
    hidden = beside = inside = prose = 0

    def close() -> None:
        if held:
            if text := " ".join(entities.unescape("".join(held)).split()):
                out.append(Block(text, beside > 0, inside > 0, prose > 0, text.split(" ")))
            held.clear()

    def count(entry: tuple[str, bool], by: int) -> None:
        nonlocal hidden, beside, inside, prose
        tag = entry[0]
        hidden += by * (tag in _HIDDEN)
        beside += by * entry[1]
        inside += by * (tag in _MAIN)
        prose += by * (tag in _TEXT)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            count(stack.pop(), -1)

    def innermost(tags: set[str], until: set[str]) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in until:
                return -1
        return -1

    holders = _BREAKS - _TEXT - {"dl", "ul", "ol"}
    for m in _PART.finditer(page):
        if m[5] is not None:
            if not hidden:
                held.append(m[5])
            continue
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag == "br":
            held.append(" ")
        if tag in _BREAKS:
            close()
        if tag == "body" and not m[2]:
            pop_to(0)
        if tag in _VOID:
            continue
        if m[2]:
            at = innermost({tag}, set() if tag in holders or tag in ("html", "body", "ul", "ol", "dl", "head") else holders)
            if at >= 0:
                pop_to(at)
        else:
            if tag in _BREAKS:
                same = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}}.get(tag)
                at = innermost({"p", "h1", "h2", "h3", "h4", "h5", "h6"}, holders | {"li", "blockquote", "td", "th", "dd"})
                if at >= 0:
                    pop_to(at)
                if same and (at := innermost(same, {"ul", "ol", "dl", "table"})) >= 0:
                    pop_to(at)
            if not m[4].endswith("/") or tag in _BREAKS:
                entry = (tag, _beside(tag, m[4]))
                stack.append(entry)
                count(entry, 1)
    close()
    return out


def suffix_array(tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first tokens (``length`` of them at least), and how many tokens each shares with the one before.

    Ranks double the number of tokens they stand for; the shared lengths come from the ranks kept.
    """
    n = len(tokens)
    rank = tokens - tokens.min() + 1 if n else tokens
    kept, h, most = [rank], 1, int(rank.max(initial=0)) + 2
    while h < length:
        second = np.zeros(n, np.int64)
        second[: max(n - h, 0)] = rank[h:]
        rank = np.unique(rank * most + second, return_inverse=True)[1].astype(np.int64) + 1
        most = n + 2
        kept.append(rank)
        h *= 2
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for ranks, step in zip(reversed(kept), [1 << i for i in reversed(range(len(kept)))], strict=True):
        fits = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[fits] = ranks[a[fits]] == ranks[b[fits]]
        a[same] += step
        b[same] += step
        shared[1:][same] += step
    return order, shared


def repeated(streams: list[list[str]], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For each page's tokens, which are covered by runs of ``run`` tokens or more found on ``pages`` pages or more.

    Pages with equal tokens count as one page.
    """
    return covered_by_runs(*numbered(streams)[:2], run, pages)


def covered_by_runs(number: np.ndarray, sizes: np.ndarray, run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """``repeated`` for tokens given as numbers."""
    streams = np.split(number, np.cumsum(sizes)[:-1]) if len(sizes) else []
    keys = [s.tobytes() for s in streams]
    distinct = {key: i for i, key in enumerate(dict.fromkeys(keys))}
    first = dict(zip(reversed(keys), reversed(streams), strict=True))
    parts, owner = [], []
    for key, i in distinct.items():  # after each page a token of its own
        parts += [first[key], np.array([-1 - i])]
        owner += [np.full(len(first[key]) + 1, i)]
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    covered = np.zeros(len(tokens) + 1, np.int64)
    if len(tokens) > 1:
        page = np.concatenate(owner)
        order, shared = suffix_array(tokens, run)
        interval = np.cumsum(shared < run)
        seen = np.sort(interval * (len(distinct) + 1) + page[order])
        seen = seen[np.append(True, seen[1:] != seen[:-1])]
        often = np.bincount(seen // (len(distinct) + 1), minlength=interval[-1] + 1) >= pages
        starts = order[often[interval]]
        covered += np.bincount(starts, minlength=len(covered)) - np.bincount(np.minimum(starts + run, len(tokens)), minlength=len(covered))
    covered = np.cumsum(covered)[:-1] > 0
    at, found = 0, []
    for key in distinct:
        found.append(covered[at : at + len(first[key])])
        at += len(first[key]) + 1
    return [found[distinct[key]] for key in keys]


class _Numbers(dict):
    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        return n


def numbered(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The streams' tokens as numbers in a row, the streams' sizes, and the tokens by number."""
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    ids = _Numbers()
    return np.fromiter(map(ids.__getitem__, chain.from_iterable(streams)), np.int64, sizes.sum()), sizes, list(ids)


def codes(streams: list[list[str]], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of RUN tokens within the streams, as numbers, and where they start when the streams stand in a row.

    A number is one of ``blocks`` blocks by the upper bits of the window's hash, and the hash's lower BITS bits.
    """
    return window_codes(*numbered(streams), blocks)


def window_codes(number: np.ndarray, sizes: np.ndarray, ids: list[str], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """``codes`` for tokens given as numbers."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in ids), np.uint64, len(ids))[number]
    ends = np.repeat(np.cumsum(sizes), sizes)
    starts = np.flatnonzero(np.arange(len(h)) + RUN <= ends)
    out = h[starts]
    for i in range(1, RUN):
        out = pair_hash(out, h[starts + i])
    h = mix(out)
    return ((h >> np.uint64(40)) * np.uint64(blocks)) >> np.uint64(24) << BITS | h & LOW, starts


def main_texts(pages: list[str]) -> list[str]:
    """Main texts of pages of one host (see ``chosen``)."""
    return chosen([blocks(p) for p in pages])


def chosen(parsed: list[list[Block]], often: np.ndarray | None = None, n_blocks: int = 1) -> list[str]:
    """Main texts of the parsed pages of a host. ``often``: windows as numbers (see ``codes``) found to repeat on other pages too.

    A block is dropped if repeated runs cover at least COVERED of it. The page's markup then corrects this both ways: paragraphs,
    headings, list items and the like of an article or main element come back (articles may quote each other), and
    blocks that menus, headers, footers, forms and so on hold go even where they are unique, as does what stands
    outside the article if the page has one.
    """
    streams = [[t for b in page for t in b.tokens] for page in parsed]
    number, sizes, ids = numbered(streams)
    found = covered_by_runs(number, sizes)
    if often is not None and len(often):
        code, start = window_codes(number, sizes, ids, n_blocks)
        start = start[_held(code, np.sort(often))]
        n = sum(map(len, streams)) + 1
        edge = np.bincount(start, minlength=n) - np.bincount(start + RUN, minlength=n)
        also = np.split(np.cumsum(edge)[:-1] > 0, np.cumsum([len(x) for x in streams])[:-1])
        found = [a | b for a, b in zip(found, also, strict=True)]
    out = []
    for page, covered in zip(parsed, found, strict=True):
        framed = any(b.inside and not b.beside for b in page)
        at, keep = 0, []
        for b in page:
            share = covered[at : at + len(b.tokens)].mean()
            at += len(b.tokens)
            if not b.beside and (b.inside or not framed) and (share < COVERED or (b.inside and b.prose)):
                keep.append(b.text)
        out.append("\n\n".join(keep))
    return out


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty for a null URL or one without a host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def pack(page: list[Block]) -> bytes:
    """Blocks as compressed lines: a digit of the three marks, then the text (which holds no line feed)."""
    lines = (f"{b.beside + 2 * b.inside + 4 * b.prose}{b.text}" for b in page)
    return zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"))


def _lines(packed: bytes) -> list[str]:
    page = zlib.decompress(packed).decode("utf-8", "surrogatepass")
    return page.split("\n") if page else []


def unpack(packed: bytes) -> list[Block]:
    return [Block(x[1:], x[0] in "1357", x[0] in "2367", x[0] in "4567", x[1:].split(" ")) for x in _lines(packed)]


def _new(ordered: np.ndarray) -> np.ndarray:
    """Where another value begins."""
    return np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]


def _held(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values stand among others that are in order."""
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values if len(among) else np.zeros(len(values), bool)


def _windows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Windows of the distinct pages of a shard as numbers, their pages, and the pages' hashes; none for a host of one shard."""
    held: dict[int, list[str]] = {}
    for page in pdf["page"] if len(pdf) and pdf["shards"].iloc[0] > 1 else ():
        line = " ".join(x[1:] for x in _lines(page))
        stream = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
        if stream not in held:
            held[stream] = line.split(" ") if line else []
    code, start = codes(list(held.values()), pdf["blocks"].iloc[0] if held else 1)
    return code, np.searchsorted(np.cumsum([len(x) for x in held.values()]), start, side="right"), list(held)


def _cells(pdf: pd.DataFrame) -> pd.DataFrame:
    """host, block, shard, and the cells that windows of at least one, two, ... PAGES distinct pages of the shard fall into."""
    code, page, held = _windows(pdf)
    cell = (code >> (BITS - np.uint64(CELL))).astype(np.int64)
    both = np.sort(cell * max(len(held), 1) + page)
    cell = both[_new(both)] // max(len(held), 1)  # each page once in a cell
    at = np.flatnonzero(_new(cell))
    cell, n = cell[at], np.diff(np.append(at, len(cell)))
    block = cell >> CELL
    first = np.flatnonzero(_new(block))
    rows = [
        (pdf["host"].iloc[0], block[at], pdf["shard"].iloc[0], *[pack_sorted(own[times > i], CELL) for i in range(PAGES)])
        for at, own, times in zip(first, np.split(cell & (1 << CELL) - 1, first[1:]), np.split(n, first[1:]), strict=False)
    ]
    return pd.DataFrame(rows, columns=["host", "block", "shard", *_TIMES], dtype=object)


def _crowded(pdf: pd.DataFrame) -> pd.DataFrame:
    """host, shard, block, cells: for every shard, its cells in which the windows of PAGES pages or more of the host meet."""
    own = [unpack_sorted(x, CELL) for x in pdf[_TIMES[0]]]
    total = np.sort(np.concatenate([*own, *[unpack_sorted(x, CELL) for c in _TIMES[1:] for x in pdf[c]]]))
    at = np.flatnonzero(_new(total))
    often = total[at[np.diff(np.append(at, len(total))) >= PAGES]]
    kept = [(h, s, b, x[_held(x, often)]) for h, s, b, x in zip(pdf["host"], pdf["shard"], pdf["block"], own, strict=True)]
    return pd.DataFrame([(h, s, b, pack_sorted(x, CELL)) for h, s, b, x in kept if len(x)], columns=["host", "shard", "block", "cells"], dtype=object)


def _cut(pdf: pd.DataFrame, crowded: pd.DataFrame | None = None) -> pd.DataFrame:
    """host, block, shard, entries, pages: windows of the distinct pages of a shard in crowded cells, each PAGES times at most.

    Windows are sorted, the lower 36 bits as steps; ``pages`` are hashes of the pages that ``entries`` count. Without
    ``crowded`` all windows.
    """
    if crowded is not None and not len(crowded):
        pdf = pdf.iloc[:0]
    code, page, held = _windows(pdf)
    if crowded is not None and len(crowded):
        wanted = np.concatenate([unpack_sorted(x, CELL) | int(b) << CELL for b, x in zip(crowded["block"], crowded["cells"], strict=True)])
        inside = _held((code >> (BITS - np.uint64(CELL))).astype(np.int64), np.sort(wanted))
        code, page = code[inside], page[inside]
    order = np.lexsort((page, code))
    code, page = code[order], page[order]
    own = np.append(True, (code[1:] != code[:-1]) | (page[1:] != page[:-1]))[: len(code)]
    code, page = code[own], page[own]
    few = np.ones(len(code), bool)
    few[PAGES:] = code[PAGES:] != code[:-PAGES]
    code, page = code[few], page[few]
    block = (code >> BITS).astype(np.int64)
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(block)])
    streams = np.array(held, np.uint64).astype("<u4")
    entries, pages = [], []
    for own, of in zip(np.split(code & LOW, first[1:]), np.split(page, first[1:]), strict=True) if len(first) else ():
        named, number = np.unique(of, return_inverse=True)
        step = np.diff(own, prepend=np.uint64(0))
        parts = ((step & np.uint64(0xFFFF)).astype("<u2"), (step >> np.uint64(16)).astype("<u2"), (step >> np.uint64(32)).astype("u1"), number.astype("<u2" if len(named) < 1 << 16 else "<u4"))
        entries.append(zlib.compress(b"".join(x.tobytes() for x in parts), 1))
        pages.append(streams[named].tobytes())
    host, shard = ([pdf[c].iloc[0]] * len(first) if len(first) else [] for c in ("host", "shard"))
    return pd.DataFrame({"host": host, "block": block[first], "shard": shard, "entries": entries, "pages": pages}, dtype=object)


def _entries(packed: bytes, pages: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lower bits of the windows and the hashes of their pages, as ``_cut`` packed them."""
    streams, raw = np.frombuffer(pages, "<u4"), zlib.decompress(packed)
    number = np.dtype("<u2" if len(streams) < 1 << 16 else "<u4")
    n = len(raw) // (5 + number.itemsize)
    low, middle, high = np.frombuffer(raw, "<u2", n), np.frombuffer(raw, "<u2", n, 2 * n), np.frombuffer(raw, "u1", n, 4 * n)
    step = low.astype(np.int64) | middle.astype(np.int64) << 16 | high.astype(np.int64) << 32
    return np.cumsum(step), streams[np.frombuffer(raw, number, n, 5 * n)]


def _repeated_codes(pdf: pd.DataFrame) -> pd.DataFrame:
    """host, shard, block, codes: windows of a block found on PAGES distinct pages of the host, for every shard that has them."""
    parts = [_entries(*x) for x in zip(pdf["entries"], pdf["pages"], strict=True)]
    shard = np.repeat(pdf["shard"].to_numpy(), [len(low) for low, _ in parts])
    low, stream = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((stream, low))
    a, s, shard = low[order], stream[order], shard[order]
    new = np.append(True, a[1:] != a[:-1])
    page = np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1]))
    often = (np.add.reduceat(page.astype(np.int64), np.flatnonzero(new)) >= PAGES)[np.cumsum(new) - 1]
    a, shard = a[often], shard[often]
    host, block = pdf["host"].iloc[0], pdf["block"].iloc[0]
    return pd.DataFrame([(host, x, block, pack_sorted(np.unique(a[shard == x]), int(BITS))) for x in np.unique(shard)], columns=["host", "shard", "block", "codes"], dtype=object)


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Key, url and the main text of every page (see ``main_texts``): blocks joined by an empty line, empty if there are none.

    Null html counts as empty. Pages without a host count as one host. A host with more than SHARD pages or SHARD_CHARS
    characters is dealt over several suffix arrays by a hash of the page, so no task holds a whole large host; the runs its
    pages share across these are found by hashes of windows of RUN tokens, counted over the distinct pages of the host.
    First every shard sends the cells that its windows fall into to blocks of the host's hash range, one to two bytes each,
    and gets back those where PAGES pages or more meet. Then windows in such cells go there with their pages, packed, at
    most PAGES of a window for a shard; only windows that repeat come back. Pages are parsed once and go to their shard as
    compressed blocks.
    """
    named = pages.select(F.col(key), F.col(url), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    chars = F.sum(F.coalesce(F.length("html"), F.lit(0)))
    shards = F.greatest(F.ceil(F.col("n") / SHARD), F.ceil(F.col("chars") / SHARD_CHARS), F.lit(1)).cast("int")
    blocks_ = F.least(F.ceil(F.col("chars") / BLOCK_CHARS) + 1, F.lit(1 << 24)).cast("int")
    sizes = named.groupBy("host").agg(F.count("*").alias("n"), chars.alias("chars")).select("host", shards.alias("shards"), blocks_.alias("blocks"))
    sizes = materialize(sizes.where(F.col("shards") > 1))  # large hosts only
    one = F.lit(1)
    dealt = named.join(sizes, "host", "left").withColumns({c: F.coalesce(F.col(c), one) for c in ("shards", "blocks")})
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(key, url, F.length("html")), F.col("shards")))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([pack(blocks(h.as_py() or "")) for h in batch.column("html")], pa.binary())
            kept = batch.drop_columns(["html"])
            yield pa.RecordBatch.from_arrays([*kept.columns, packed], [*kept.schema.names, "page"])

    kind = {f.name: f.dataType.simpleString() for f in pages.select(key, url).schema}
    dealt = dealt.select(key, url, "host", "shards", "blocks", "shard", "html")
    shipped = dealt.mapInArrow(parse, f"`{key}` {kind[key]}, `{url}` {kind[url]}, host string, shards int, blocks int, shard long, page binary")
    dealt_pages = shipped.groupBy("host", "shard")
    cells = dealt_pages.applyInPandas(_cells, ", ".join(["host string, block long, shard long", *[f"{c} binary" for c in _TIMES]]))
    crowded = cells.groupBy("host", "block").applyInPandas(_crowded, "host string, shard long, block long, cells binary")
    cut = dealt_pages.cogroup(crowded.groupBy("host", "shard")).applyInPandas(lambda pdf, near: _cut(pdf, near), "host string, block long, shard long, entries binary, pages binary")
    often = cut.groupBy("host", "block").applyInPandas(_repeated_codes, "host string, shard long, block long, codes binary")

    def run(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        own = [(unpack_sorted(x, int(BITS)) | int(b) << int(BITS)).view(np.uint64) for b, x in zip(found["block"], found["codes"], strict=True)]
        own = np.concatenate(own) if own else None
        texts = chosen([unpack(p) for p in pdf["page"]], own, pdf["blocks"].iloc[0] if len(pdf) else 1)
        return pd.DataFrame({key: pdf[key], url: pdf[url], "text": texts})

    return dealt_pages.cogroup(often.groupBy("host", "shard")).applyInPandas(run, f"`{key}` {kind[key]}, `{url}` {kind[url]}, text string")
