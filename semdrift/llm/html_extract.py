"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text they hold outside links. A container is named by its generalised
path of tags and classes, so that pages of one template share it. Each page votes for its best path with that
path's share of its text; votes are summed per host and path in Spark. Then every page is read again, and the
text of its host's path with the most votes that it has is taken, so that pages of several templates agree each
among themselves. A page that has none of its host's paths uses its own best container.

Null and empty html gives an empty text. Pages with a null url, or one without a host, form one host of their own.
Every row is extracted, repeated ids included. Whole pages are read; broken markup is taken as it comes: an
unclosed element ends with its parent, an unopened end tag is ignored. Ties go to the smaller path. Extra
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Elements and names that hold no article text.
DROP_TAGS = frozenset("nav header footer aside form script style noscript template iframe svg math object select button textarea dialog menu title head".split())
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer "
    "footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup "
    "promo promoted promotion related recommended respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
# What says that a page has such a part, not that an element is one: "has-sidebar", "no-comments".
NOT_NAMES = frozenset("has no with without not is hide hides show shows".split())
# Inline elements go by these names only: "comment" may be one in source code.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising promo promoted promotion sponsor sponsored".split())
RAW_TAGS = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_TAGS = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
# Blocks of text; they are no containers and do not count in a path.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote figcaption tr td th thead tbody tfoot caption hr html body".split())
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME_PART = re.compile(r"[a-z]+")
# Between the labels of a path; no label holds it, as attributes are split at white space.
_STEP = "\n"
_SPACE = re.compile(r"\s+")
# What a container counts of the text of one a level below.
DECAY = 0.7
# Paths with at least this part of the votes of the host's first one are used as well.
SECOND = 0.05
MAX_PATHS = 8

Block = tuple[tuple[str, ...], str, int]


def _names(value: str) -> set[str]:
    """Words of the names in a class, id or role, but for names that speak of another element."""
    parts = [_NAME_PART.findall(name) for name in value.split()]
    return {word for words in parts if NOT_NAMES.isdisjoint(words[:-1]) for word in words}


def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """Generalised name of an element, and whether it is to be dropped."""
    drop, classes = tag in DROP_TAGS, ""
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            # Words count, not parts of words: "ad-box" is an advert, "shadow" is not.
            if tag not in ("html", "body", "article", "main") and not DROP_NAMES.isdisjoint(_names(value)):
                drop = True
            if name.lower() == "class":
                classes = ".".join(sorted(set(re.sub(r"\d+", "#", c) for c in value.split())))
    return f"{tag}.{classes}" if classes else tag, drop


def _is_advert(attributes: str) -> bool:
    return any(not ADVERTS.isdisjoint(_names("".join(values).lower())) for _, *values in _ATTRIBUTE.findall(attributes))


def blocks(page: str) -> list[Block]:
    """(container path, text, characters within links) of each block of text outside dropped elements."""
    out: list[Block] = []
    stack: list[tuple[str, str | None, bool]] = []  # tag, label of a container, dropped
    path: tuple[str, ...] = ()
    dropped, links, linked = 0, 0, 0
    parts: list[str] = []
    advert: list[str] = []  # an inline advert and elements of its kind within; it ends with its block

    def flush() -> None:
        nonlocal linked, dropped
        if advert:
            dropped -= 1
            advert.clear()
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((path, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def leave() -> None:
        nonlocal path, dropped
        _, label, drop = stack.pop()
        dropped -= drop
        if label is not None:
            path = path[:-1]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not dropped:
            parts.append(page[at:stop])
            linked += (stop - at) * (links > 0)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in INLINE_TAGS:
                links = max(0, links - 1) if tag == "a" else links
                if advert and advert[-1] == tag:
                    advert.pop()
                    dropped -= not advert
                continue
            flush()
            if any(s[0] == tag for s in stack):
                links = 0
                while stack:
                    last = stack[-1][0]
                    leave()
                    if last == tag:
                        break
            continue
        if tag in INLINE_TAGS:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links += 1
            if advert:
                advert.extend([tag] if tag == advert[0] else [])
            elif m[3] and tag not in VOID_TAGS and _is_advert(m[3]):
                advert.append(tag)
                dropped += 1
            continue
        flush()
        links = 0
        if tag in RAW_TAGS:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in VOID_TAGS:
            continue
        closing = CLOSES_ITSELF.get(tag, {"p"})
        while stack and stack[-1][0] in closing:
            leave()
        label, drop = _label(tag, m[3])
        name = None if tag in TEXT_TAGS else label
        stack.append((tag, name, drop))
        dropped += drop
        if name is not None:
            path = (*path, name)
    flush()
    return out


def scores(found: list[Block]) -> dict[str, float]:
    """Share of the page's text that each container path holds; text further down counts less."""
    total: dict[tuple[str, ...], float] = defaultdict(float)
    for path, text, linked in found:
        worth = float(len(text) - linked)
        for up in range(len(path) + 1):
            total[path[: len(path) - up]] += worth * DECAY**up
    all_ = sum(len(t) - n for _, t, n in found)
    return {_STEP.join(p): s / all_ for p, s in total.items()} if all_ else {}


def extract(page: str | None, votes: dict[str, float]) -> str:
    """Text of the page's part of the winning path; blocks are joined by empty lines."""
    found = blocks(page) if page else []
    own = scores(found)
    agreed = {p: votes[p] for p in own if p in votes} or own
    if not agreed:
        return ""
    best = min(agreed, key=lambda p: (-agreed[p], p))
    lead = tuple(best.split(_STEP)) if best else ()
    return "\n\n".join(t for path, t, _ in found if path[: len(lead)] == lead)


def _with_host(pages: DataFrame, id_col: str, url: str, body: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(body).alias("html"), host.alias("host"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the winning paths of each host with their votes. ``pages`` has host and html."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], float] = defaultdict(float)
        for batch in batches:
            for host, page in zip(batch["host"].to_pylist(), batch["html"], strict=True):
                page = page.as_py()
                own = scores(blocks(page) if page else [])
                if own:
                    path = min(own, key=lambda p: (-own[p], p))
                    total[host, path] += own[path]
            if len(total) > 100_000:
                yield _votes(total)
                total.clear()
        yield _votes(total)

    cast = pages.select("host", "html").mapInArrow(vote, "host string, path string, score double")
    # Rounded, so that the order of addition does not matter.
    summed = cast.groupBy("host", "path").agg(F.round(F.sum("score"), 6).alias("votes"))
    first = summed.groupBy("host").agg(F.max("votes").alias("most"))
    near = summed.join(first, "host").where(F.col("votes") >= SECOND * F.col("most"))
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))).where(F.col("r") <= MAX_PATHS)
    return ranked.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "votes"))).alias("paths"))


def _votes(total: dict[tuple[str, str], float]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([h for h, _ in total], pa.string()), pa.array([p for _, p in total], pa.string()), pa.array(list(total.values()), pa.float64())], names=["host", "path", "score"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row."""
    hosted = _with_host(pages, id_col, url, body)
    joined = hosted.join(host_paths(hosted), "host", "left").select("page_id", "url", "html", "paths")
    schema = hosted.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [extract(h.as_py(), dict(p.as_py() or ())) for h, p in zip(batch["html"], batch["paths"], strict=True)]
                yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return joined.mapInArrow(read, schema)
