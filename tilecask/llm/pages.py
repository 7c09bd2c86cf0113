"""Main text of web pages by differencing each page from its neighbours by URL.

A page is cut into its blocks of visible text.  Blocks within navigation, headers, footers,
asides, forms, notices, adverts and comments go, told by element, role or name; where a page
has an ``article`` or ``main`` element, only its blocks stay.  What is left is the page's body.
Pages of one host with equal bodies are copies and one case, placed at the least of their URLs.

The bodies of a host are ordered by path, which puts those with the longest common
beginnings side by side.  A body's blocks are aligned with those of its ``WITNESSES`` nearest neighbours
by longest common subsequence and shared ones are deleted: those that it shares with the nearest one, or, within
an ``article`` or ``main`` element, those that it shares with every one of them, since a line that only some
neighbours have may be a quotation there.  A body with fewer neighbours loses nothing within such an element.

Every place in the order is counted over the whole table, so the result does not depend on how rows
are dealt to tasks.  Blocks are compared by 64-bit digests within a pair of pages.

A null html is empty and gives an empty text.  Unclosed elements end with the page.  Broken
or missing URLs share an empty host.  Repeated pages are judged each; further columns are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import heavy_keys, modest_batches, pieces_of, settle, spread_join

#: Elements without text of the page.
RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "svg", "object", "select", "xmp"}
#: Elements of the frame of a page.
FRAME = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head"}
#: Roles of the frame of a page.
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: Words in a class or id that name a part of the frame.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination popup promo promoted promotion recommended related replies share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that make a name tell of a part of the frame instead of being one.
MODIFIERS = {"no", "not", "has", "with", "without", "hide", "hidden", "show", "enabled", "disabled", "closed", "open", "allow"}
#: Elements that start and end a block.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without content.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What an element that was left open ends at, beside the end of its parent.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_MARKUP = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NOT_LETTERS = re.compile(r"[^a-z]+")
#: Neighbours that must agree on a line within an article, and how many are looked at on each side.
WITNESSES = 4
#: Bodies whose neighbours a task looks at together.
CELL = 4096


@dataclass
class Line:
    text: str
    framed: bool
    main: bool


@dataclass
class Open:
    name: str
    framed: bool
    main: bool


@dataclass
class Page:
    lines: list[Line] = field(default_factory=list)

    @property
    def has_main(self) -> bool:
        return any(x.main for x in self.lines)


def _framed(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element starts a part of the frame."""
    if name in FRAME or name == "header" and not inside:
        return True
    if not attributes.strip():
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "role" and value in ROLES or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id") and name not in ("html", "body", "main"):
            for token in value.split():
                parts = set(_NOT_LETTERS.split(token)) - ({"header"} if inside else set())
                if not NAMES.isdisjoint(parts) and MODIFIERS.isdisjoint(parts):
                    return True
    return False


def parse(source: str) -> Page:
    """Every block of visible text in page order."""
    page, stack, words = Page(), [Open("", False, False)], []
    lower = source.lower() if len(source.lower()) == len(source) else "".join(c.lower() if len(c.lower()) == 1 else c for c in source)

    def flush() -> None:
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                page.lines.append(Line(text, stack[-1].framed, stack[-1].main))
            words.clear()

    def close(at: int) -> None:
        flush()
        del stack[at:]

    at = 0
    while True:
        m = _MARKUP.search(source, at)
        if m is None:
            words.append(source[at:])
            break
        if m.start() > at:
            words.append(source[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCKS or name in FRAME:
                flush()
            found = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if found:
                close(found)
            continue
        if name in BLOCKS:
            flush()
        if name in RAW:
            end = lower.find(f"</{name}", at)
            if end < 0:
                break
            at = lower.find(">", end) + 1 or len(source)
            continue
        if name == "br":
            words.append(" ")
        if name in VOID:
            continue
        if name in CLOSES:
            i = len(stack) - 1
            while i > 0 and stack[i].name not in ("ul", "ol", "menu", "dl", "table", "select", "nav"):
                if stack[i].name in CLOSES[name]:
                    close(i)
                    break
                i -= 1
        top = stack[-1]
        if name in BLOCKS and name != "p" or name in FRAME or m[3].strip():
            starts = name in ("article", "main") or "main" in m[3] and re.search(r"""\brole\s*=\s*["']?main\b""", m[3]) is not None
            framed = top.framed or _framed(name, m[3], top.main)
            if framed != top.framed and name not in BLOCKS:
                flush()
            stack.append(Open(name, framed, top.main or starts))
        elif name == "p" and any(o.name == "p" for o in stack[-2:]):
            close(len(stack) - 1)
    flush()
    return page


def _prefix_lengths(a: list, b: list) -> np.ndarray:
    """The length of a longest common subsequence of ``a`` and the first j of ``b``, for each j from 0 on; a bit for each place of ``b``."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & masks.get(x, 0)
        row = (row + hit | row - hit) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, by halving ``a`` where both halves together are longest."""
    there, here = set(b), set(a)
    at = [i for i, x in enumerate(a) if x in there]
    x, y = [a[i] for i in at], [v for v in b if v in here]
    out: set[int] = set()
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and x[a0] == y[b0]:
            out.add(at[a0])
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and x[a1 - 1] == y[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.add(at[a1])
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if x[a0] in y[b0:b1]:
                out.add(at[a0])
            continue
        mid = (a0 + a1) // 2
        cut = b0 + int((_prefix_lengths(x[a0:mid], y[b0:b1]) + _prefix_lengths(x[mid:a1][::-1], y[b0:b1][::-1])[::-1]).argmax())
        todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return out


def body(page: Page) -> list[Line]:
    """The blocks that structure does not tell to be part of the frame."""
    within = page.has_main
    return [x for x in page.lines if not x.framed and (x.main or not within)]


def shared_lines(own: list, within: bool, others: list[list]) -> set[int]:
    """Places of the body's lines that ``others``, nearest first, tell to be part of the frame."""
    if within and len(others) < WITNESSES:
        return set()
    found: set[int] | None = None
    for other in others if within else others[:1]:
        places = common(own, other)
        found = places if found is None else found & places
        if not found:
            break
    return found or set()


def nearness(a: str, b: str) -> int:
    """Characters that two paths have in common from the beginning."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def nearest(path: str, before: list[tuple[str, list]], after: list[tuple[str, list]]) -> list[list]:
    """Bodies of the ``WITNESSES`` nearest of some neighbours ``(path, body)``, each side in the order of distance."""
    near = [(-nearness(path, p), k, side, own) for side, some in enumerate((before, after)) for k, (p, own) in enumerate(some)]
    return [x[3] for x in sorted(near, key=lambda x: x[:3])[:WITNESSES]]


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _key(hashes: list[int], within: bool) -> bytes:
    return hashlib.blake2b(b"".join(h.to_bytes(8, "little", signed=True) for h in hashes), digest_size=16, salt=bytes([within])).digest()


def _bodies(rows: DataFrame) -> DataFrame:
    """``(id, host, path, body, within, hashes)`` of every ``(id, host, path, html)``, without any text."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "html"):
            pages = [parse(t or "") for t in batch.column("html").to_pylist()]
            hashes = [[_digest(x.text) for x in body(p)] for p in pages]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "host", "path")), pa.array([_key(h, p.has_main) for h, p in zip(hashes, pages, strict=True)], pa.binary()), pa.array([p.has_main for p in pages]), pa.array(hashes, pa.list_(pa.int64()))],
                ["id", "host", "path", "body", "within", "hashes"],
            )

    return rows.mapInArrow(run, f"id {kind}, host string, path string, body binary, within boolean, hashes array<bigint>")


def _numbered(cases: DataFrame) -> DataFrame:
    """Adds ``rank``, the place in the order by host, path and body, from 0 on."""
    order = ["host", "path", "body"]
    cases = settle(cases.repartitionByRange(*order).sortWithinPartitions(*order))  # the place in its partition is fixed from here on
    local = cases.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = local.groupBy("_part").count()  # a row for each partition
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return local.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def _frame_lines(cases: DataFrame) -> DataFrame:
    """``(host, body, gone)`` of bodies ``(rank, host, path, body, within, hashes)`` that lose lines.

    Bodies go in cells of ``CELL`` neighbours by rank; the few at both ends of a cell go to the next one too.
    """

    def solve(now: tuple, before: list[tuple], after: list[tuple]) -> list[int]:
        _, host, path, _, within, own = now
        some = [[(x[2], x[5]) for x in side if x[1] == host] for side in (before[::-1], after)]
        return sorted(shared_lines(own, within, nearest(path, *some)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque[tuple] = deque()
        at, cell = 0, None
        out: list[list] = [[], [], []]

        def judge(upto: int) -> None:
            nonlocal at
            rows = list(held)
            while at < upto:
                now = rows[at]
                if now[0] // CELL == cell and now[5]:
                    gone = solve(now, rows[max(0, at - WITNESSES) : at], rows[at + 1 : at + 1 + WITNESSES])
                    if gone:
                        for column, value in zip(out, (now[1], now[3], gone), strict=True):
                            column.append(value)
                at += 1

        def ready() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int32()))], ["host", "body", "gone"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cell", "rank", "host", "path", "body", "within", "hashes")]
            for own, *row in zip(*columns, strict=True):
                if own != cell:
                    judge(len(held))
                    held.clear()
                    at, cell = 0, own
                held.append(tuple(row))
                if len(held) > 4 * WITNESSES:
                    judge(len(held) - WITNESSES)
                    while at > WITNESSES:
                        held.popleft()
                        at -= 1
            yield ready()
        judge(len(held))
        yield ready()

    cells = F.array_distinct(F.transform(F.array(*(F.lit(d) for d in (-WITNESSES, 0, WITNESSES))), lambda d: F.floor((F.col("rank") + d) / CELL)))
    rows = cases.withColumn("cell", F.explode(cells)).repartition("cell").sortWithinPartitions("cell", "rank")
    return rows.select("cell", "rank", "host", "path", "body", "within", "hashes").mapInArrow(run, "host string, body binary, gone array<int>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` of every page."""
    modest_batches(pages.sparkSession)
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"), path.alias("path"))
    found = settle(_bodies(rows))
    cases = found.groupBy("host", "body").agg(F.min("path").alias("path"), F.first("within").alias("within"), F.first("hashes").alias("hashes"))
    gone = settle(_frame_lines(_numbered(cases)))
    # from here on by row: copies of one body are spread by their ids
    sizes = found.groupBy("host", "body").agg(F.count("*").alias("n"))
    own = spread_join(found.select("id", "host", "body"), gone, ["host", "body"], heavy_keys(sizes, ["host", "body"], "n"), ["id"])
    name = F.struct("id", "host", "body").alias("row")
    own = own.select(name, "gone").dropDuplicates(["row"])
    kind = pages.schema[id_col].dataType.simpleString()

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "html"):
            pages = [parse(t or "") for t in batch.column("html").to_pylist()]
            lines = [[x.text for x in body(p)] for p in pages]
            keys = [_key([_digest(x) for x in own], p.has_main) for own, p in zip(lines, pages, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "url", "host")), pa.array(keys, pa.binary()), pa.array(lines, pa.list_(pa.string()))], ["id", "url", "host", "body", "lines"])

    cut = rows.select("id", "url", "host", "html").mapInArrow(texts, f"id {kind}, url string, host string, body binary, lines array<string>")
    joined = cut.withColumn("row", name).join(own, "row", "left")
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    text = F.array_join(left, "\n")
    return joined.select(F.col("id").alias(id_col), "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
