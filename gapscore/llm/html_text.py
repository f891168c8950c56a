"""Main text of web pages: the lines that a page does not share with its neighbours by URL."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from html import unescape
from itertools import groupby, islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by their meaning, and words of class, id and role that mark what is not the article.
_RAW = "script style noscript template iframe svg object canvas math audio video select textarea title".split()
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meta q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr link".split()
)
_ASIDE = frozenset("head nav footer aside form button dialog menu fieldset".split())
_MAIN = {"main": 1, "article": 2}
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification pagination pager popup promo promoted related replies reply search share sharing sidebar signup social "
    "sponsor sponsored subscribe teaser toolbar widget contentinfo complementary dialog alert".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    rf"|<(?P<raw>{'|'.join(_RAW)})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:_-]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_WORD = re.compile(r"[a-z]+")


#: A line is prose if it has so many words and ends a sentence.
PROSE_WORDS = 8


class Line(NamedTuple):
    text: str
    mark: int  # 2 in an article, 1 in a main element, 0 elsewhere

    @property
    def is_prose(self) -> bool:
        return self.text[-1] in ".!?\"'”’»…" and self.text.count(" ") >= PROSE_WORDS - 1


def _is_aside(name: str, attributes: str, in_article: bool) -> bool:
    if name in _ASIDE or (name == "header" and not in_article):
        return True
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    if _HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
        return True
    words = {w for groups in _MARK.findall(attributes) for w in _WORD.findall("".join(groups).lower())}
    return name not in ("html", "body") and bool(words & (_MARKS - {"header"} if in_article else _MARKS))


def lines_of(html: str) -> list[Line]:
    """The text blocks of a page outside of asides, in page order, white space reduced; empty ones are left out."""
    out: list[Line] = []
    held: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # name, is aside or inside one, the mark

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(Line(text, stack[-1][2] if stack else 0))

    at = 0
    for tag in _TOKEN.finditer(html):
        if not (stack and stack[-1][1]):
            held.append(html[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if name in _INLINE:
            if name == "br":
                held.append(" ")
            elif name not in _VOID and not tag["end"] and _is_aside(name, tag["attributes"], bool(stack and stack[-1][2])):
                stack.append((name, True, stack[-1][2] if stack else 0))
            elif tag["end"] and stack and stack[-1][0] == name:
                stack.pop()
            continue
        flush()
        held.clear()
        if tag["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
        elif name not in _VOID and not tag["attributes"].endswith("/"):
            if name in ("body", "main", "article") and not _is_aside(name, tag["attributes"], False):
                while stack and stack[-1][1] and not any(s[2] for s in stack):
                    stack.pop()  # an aside that was never closed ends where the article begins
            aside, mark = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                stack.pop()  # these end where the next begins
                aside, mark = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            stack.append((name, aside or _is_aside(name, tag["attributes"], bool(mark)), max(mark, _MAIN.get(name, 0))))
    if not (stack and stack[-1][1]):
        held.append(html[at:])
    flush()
    return out


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Indexes in ``a`` of a longest common subsequence with ``b``.

    Row by row with one bit for each line of ``b``: bit j is 0 where the length grows at line j.
    """
    both = set(a) & set(b)
    left = [i for i, x in enumerate(a) if x in both]
    right = [x for x in b if x in both]
    if not left:
        return []
    places: dict[str, int] = {}
    for j, x in enumerate(right):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(right)) - 1
    rows = [full]
    for i in left:
        hit = rows[-1] & places[a[i]]
        rows.append(((rows[-1] + hit) | (rows[-1] - hit)) & full)
    found, i, j = [], len(left), len(right)
    while i and j:
        bit = 1 << (j - 1)
        if rows[i] & bit:
            j -= 1
        elif rows[i - 1] & bit:
            found.append(left[i - 1])
            i, j = i - 1, j - 1
        else:
            i -= 1
    return found[::-1]


def _is_copy(page: list[Line], shared: list[int]) -> bool:
    """Whether a neighbour that shares these lines has the same article, and so tells nothing about the template.

    It shares over half of the marked article, or of the prose where nothing is marked. Where there is no prose
    either, a copy and a template cannot be told apart, and only a page without a line of its own is a copy.
    """
    kinds = [line.mark == 2 for line in page]
    if not any(kinds):
        kinds = [line.is_prose for line in page]
    if not any(kinds):
        return len(shared) == len(page)
    total = sum(len(line.text) for line, kind in zip(page, kinds) if kind)
    return 2 * sum(len(page[i].text) for i in shared if kinds[i]) > total


def main_text(page: list[Line], neighbours: list[list[Line]]) -> str:
    """The page without the lines that it shares with its neighbours, by longest common subsequences of all lines.

    Neighbours that are copies of the page's article are set aside. A line goes if two of the others share it, or the
    only other one does. A line of a marked article goes only if they have it outside of theirs, so headings that all
    articles of a site have stay. Of what is left the article is the text, or else the main element, unless over twice as
    much is left outside of it: then the mark is on a teaser.
    """
    own = [line.text for line in page]
    shares, real = [0] * len(own), 0
    for other in neighbours:
        shared = common_lines(own, [line.text for line in other])
        if _is_copy(page, shared):
            continue
        real += 1
        outside = {line.text for line in other if line.mark < 2}
        for i in shared:
            shares[i] += page[i].mark < 2 or own[i] in outside
    left = [line for line, n in zip(page, shares) if n < max(1, min(real, 2))]
    for mark in (2, 1):
        inside = [line.text for line in left if line.mark >= mark]
        outside = sum(len(line.text) for line in left if line.mark < mark)
        if inside and outside <= 2 * sum(map(len, inside)):
            return "\n".join(inside)
    return "\n".join(line.text for line in left)


def _with_neighbours(pages: Iterator[tuple]) -> Iterator[tuple[tuple, list]]:
    """Each page with the two before and the two after it, if they are of its host. A page: (place, lines, ...), where
    place has the range and the host first. Pages of one place are the same page, and no neighbours of each other."""
    held: deque[list[tuple]] = deque([[], []])
    groups = (list(group) for _, group in groupby(pages, key=lambda p: p[0]))
    held.extend(islice(groups, 3))
    while len(held) > 2:
        now = held[2]
        around = [held[i][0] for i in (1, 0, 3, 4) if i < len(held) and held[i]]
        near = [p[1] for p in around if now[0][0][1] and p[0][:2] == now[0][0][:2]]
        for page in now:
            yield page, near
        held.popleft()
        if (after := next(groups, None)) is not None:
            held.append(after)


def extracted(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, url, text and n_chars for each page.

    Pages are dealt to ranges and sorted by host, path and id, so a page lies next to those with the nearest
    URL path on its host, and a large host is spread over many tasks. A task reads its pages in order and
    holds five at a time. A range also gets the two pages before and after it, so the result does not depend on
    where ranges end.

    Defined cases: a null or empty page has an empty text; a page without a host has no neighbours; rows that
    repeat an id are extracted one by one; an unclosed element ends with its parent, or where the article
    begins; other columns are ignored; an empty table gives no rows.
    """
    place = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)"
    own = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), place, 1)).alias("host"),
        F.regexp_extract(F.coalesce(F.col(url), F.lit("")), place, 2).alias("path"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
    )
    key_type = pages.schema[page_id].dataType
    arrow_key = pa.string() if key_type.simpleString() == "string" else pa.int64()
    kind = "string" if arrow_key == pa.string() else "long"
    own = own.withColumn("page_id", F.col("page_id").cast(kind))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            before, lines = None, []
            for batch in batches:
                for key, link, host, path, body, mark, part, here in zip(*batch.columns):
                    place = part.as_py(), host.as_py(), path.as_py(), key.as_py(), mark.as_py()
                    if place != before:  # a page that is repeated many times is held once
                        before, lines = place, lines_of(body.as_py())
                    yield place, lines, key.as_py(), link.as_py(), here.as_py()

        rows, size = [], 0
        for (_, lines, key, link, here), others in _with_neighbours(read()):
            if not here:
                continue
            text = main_text(lines, others)
            rows.append((key, link, text, len(text)))
            size += len(text)
            if size > 1 << 23:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (arrow_key, pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "url", "text", "n_chars"]
        )

    return (
        _in_ranges(own)
        .repartition("part")
        .sortWithinPartitions("part", *_PLACE)
        .mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
    )


#: The order of pages; the last tells pages of one address and id apart.
_PLACE = ["host", "path", "page_id", "mark"]
#: Ranges for each shuffle partition at least, bytes of a range at most, and places that are looked at for each range.
_RANGES, _RANGE_BYTES, _SAMPLED = 4, 64 << 20, 16


def _in_ranges(pages: DataFrame) -> DataFrame:
    """The pages with ``mark``, ``part`` (the range) and ``here``; and once more, not here, the two before and after each range.

    The driver gets a bounded number of places for each range, never a page.
    """
    spark = pages.sparkSession
    placed = pages.withColumn("mark", F.xxhash64("html"))
    size = pages.agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes")).first()
    ranges = max(_RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")), (size["bytes"] or 0) // _RANGE_BYTES + 1)
    # Distinct places, so that repeated rows are looked at once; a hash takes about as many as wanted, never twice so many.
    every = max(1, size["n"] // (ranges * _SAMPLED))
    some = pages.where(F.pmod(F.xxhash64("host", "path", "page_id"), F.lit(every)) == 0).select("host", "path", "page_id").distinct()
    sample = sorted(map(tuple, some.limit(4 * ranges * _SAMPLED).collect()), key=lambda at: (*at[:2], at[2] is not None, at[2] if at[2] is not None else 0))
    bounds = list(dict.fromkeys(sample[len(sample) * k // ranges] for k in range(1, ranges))) if sample else []
    place = "host string, path string, page_id " + placed.schema["page_id"].dataType.simpleString()
    fields = place.replace(", ", ",").replace(" ", ":")
    listed = F.from_json(F.lit(json.dumps([dict(zip(("host", "path", "page_id"), at)) for at in bounds])), f"array<struct<{fields}>>")
    key = F.struct("host", "path", "page_id")
    dealt = placed.withColumn("part", F.size(F.filter(listed, lambda b: b <= key)))
    ends = dealt.select("part", F.struct(*_PLACE).alias("at"))
    outer = ends.groupBy("part").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    inner = (
        ends.join(F.broadcast(outer), "part")
        .where("at > first AND at < last")
        .groupBy("part")
        .agg(F.min("at").alias("second"), F.max("at").alias("last_but_one"))
    )
    found = {r["part"]: [r["first"], r["last"]] for r in outer.collect()}
    for r in inner.collect():
        found[r["part"]] += [r["second"], r["last_but_one"]]
    order = lambda at: (*at[:2], (at[2] is not None, at[2]) if at[2] is not None else (False,), at[3])  # noqa: E731  null first
    edges = {part: sorted({tuple(at) for at in places}, key=order) for part, places in found.items()}
    moved, parts = [], sorted(edges)
    for i, part in enumerate(parts):
        before = [at for p in parts[max(0, i - 2) : i] for at in edges[p]][-2:]
        after = [at for p in parts[i + 1 : i + 3] for at in edges[p]][:2]
        moved += [(*at, part) for at in before + after]
    copies = spark.createDataFrame(moved, f"{place}, mark long, to int")
    same = F.lit(True)
    for c in _PLACE:
        same = same & dealt[c].eqNullSafe(copies[c])
    beside = dealt.join(F.broadcast(copies), same).select(*(dealt[c] for c in pages.columns), dealt["mark"], F.col("to").alias("part"))
    return dealt.withColumn("here", F.lit(True)).unionByName(beside.withColumn("here", F.lit(False)))
