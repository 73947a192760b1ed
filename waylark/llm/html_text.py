"""Main text of web pages: page differencing with the nearest URL, led by landmarks.

A page is cut into lines, one per block element. Pages are ordered by host and URL path;
each is aligned with the neighbour on its host whose path is nearest, by the longest
common subsequence of their lines, and shared lines are taken for the site's furniture.
Pages with the same lines are copies and no neighbours of each other.

Differencing alone can't give right results: menus and adverts that change from page to
page are not shared, and passages that articles repeat are. So what the markup says goes
first. Lines in menus, headers, footers, sidebars, forms, comments and the like are
never text, whether shared or not; lines of an article stay, whether shared or not. What
only wraps an article (html, body, a form or a division with such a name around it) does
not make it furniture. Inside an article a division with a compound name of such a word
goes as well; one named for its place in a layout only if it holds less than half of the
article, else it is its wrapper. A teaser next to a longer text is no article.
Differencing decides about the lines for which the markup says nothing, on pages
without an article or main element.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylark.llm.common import batched, rows_of, short_batches
from waylark.llm.neighbours import in_ranges

# Fixed names of HTML: elements that break lines, that have no end, whose content is
# raw, and that are never part of the text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody "
    "td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset(
    "aside audio button canvas dialog footer form head iframe input menu nav noscript object script select style svg "
    "template textarea title video".split())
ARTICLE, MAIN = 1, 2
LANDMARKS = {"article": ARTICLE, "main": MAIN}
# Words in class, id or role that mark furniture.
FURNITURE = frozenset(
    "ad ads advert advertisement advertising adverts alert alertdialog announcement banner breadcrumb breadcrumbs comment "
    "commentlist comments complementary consent contentinfo cookie cookies disqus footer form header login masthead menu "
    "menubar modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted related "
    "replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
# An open paragraph ends before these; list items and cells end before their like.
_ENDS_P = BLOCKS - {"html", "head", "body", "title", "option", "legend", "caption"}
_ENDS_LIKE = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"},
              "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"},
           "option": {"select"}}
_PART = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|([^<]+|<)""", re.S)
_MARKS = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true""", re.I)
_NAME = re.compile(r"[a-z0-9]+")


# How sure it is that an element is furniture. A loose one, a form or a name with such a word
# in it, may be a wrapper of the page. A named one has a name of such words alone.
LOOSE, NAMED, SURE = 1, 2, 3
# Words that name a place in a layout, so a division around the text may have them too.
_PLACES = frozenset("footer form header nav navbar sidebar toolbar widget".split())
# Elements whose class, if it has a word of furniture in it, names what they hold.
_CONTAINERS = frozenset("div dl ol section span table ul".split())
_STATES = frozenset("has hide no show with without".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _furniture(tag: str, attributes: str, in_article: bool) -> int:
    """0 or how sure it is that an element is furniture, by itself."""
    if tag == "form":
        return LOOSE
    if tag in NEVER or (tag == "header" and not in_article):
        return SURE
    if not attributes.strip() or tag in ("html", "body"):
        return 0
    if _HIDDEN.search(attributes):
        return SURE
    if tag == "main":
        return 0
    # The heading of an article may well be called its header.
    known = FURNITURE - {"header", "banner"} if in_article else FURNITURE
    found = 0
    for m in _MARKS.finditer(attributes):
        if in_article and tag in _HEADINGS and m[1].lower() == "id":
            continue  # made from what it says
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = _NAME.findall(name)
            if words and known.issuperset(words):
                return NAMED
            if not words or words[0] in _STATES or known.isdisjoint(words):
                continue
            if not in_article:
                found = LOOSE
            elif tag in _CONTAINERS and m[1].lower() != "id":
                if not (known - _PLACES).isdisjoint(words):
                    return NAMED
                if tag in BLOCKS:
                    found = LOOSE
    return found


class _Open:
    """An open element; a silent one is furniture within a line, which it doesn't break.
    wraps: loose furniture around the outermost article, or around the element if in none."""

    __slots__ = ("tag", "furniture", "landmark", "silent", "wraps")

    def __init__(self, tag: str, furniture: int, landmark: int, silent: bool = False, wraps: int = 0):
        self.tag, self.furniture, self.landmark, self.silent, self.wraps = tag, furniture, landmark, silent, wraps


def _judged(found: list[tuple[str, int, int, int]]) -> list[tuple[str, bool, bool]]:
    """The lines with loose furniture decided by the whole page.

    Of the articles those in the fewest wrappers count, so teasers below an article are
    none. If there is more text outside of them all, they are teasers too: more than twice as much, if
    they are in no wrapper; a main element is never one. Without an article, and without a line outside
    of wrappers, the wrappers don't count. Loose furniture inside an article counts if it is less than half of it.
    """
    least = min((wraps for _, _, landmark, wraps in found if landmark), default=None)
    keep_inner = False
    if least is not None:
        own = [(len(text), furniture) for text, furniture, landmark, wraps in found if landmark and wraps == least]
        inside, inner = sum(n for n, _ in own), sum(n for n, furniture in own if furniture)
        keep_inner = 2 * inner > inside
        outside = sum(len(text) for text, furniture, landmark, _ in found if not furniture and not landmark)
        if outside > inside * (1 if least else 2) and not any(landmark == MAIN for _, _, landmark, _ in found):
            least = -1
    bound = LOOSE if least is None and all(furniture for _, furniture, _, _ in found) else 0
    out = []
    for text, furniture, landmark, wraps in found:
        if landmark:
            counts = wraps == least and (keep_inner or not furniture)
            out.append((text, not counts, counts))
        else:
            out.append((text, furniture > bound, False))
    return out


def lines(html: str | None) -> list[tuple[str, bool, bool]]:
    """(text, is furniture, is in an article or main element) of each block in page order.

    Character references are decoded, white space runs are one space, blocks without
    text are left out. Broken markup is read as browsers do, roughly: unknown ends are
    skipped, open elements end with those around them, or with the page.
    """
    stack: list[_Open] = []
    found: list[tuple[str, int, int, int]] = []
    words: list[str] = []
    html, at = html or "", 0

    def close_line() -> None:
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                top = stack[-1] if stack else None
                found.append((text, top.furniture, top.landmark, top.wraps) if top else (text, 0, 0, 0))

    def close_to(k: int) -> None:
        while len(stack) > k:
            if stack[-1].tag in BLOCKS:
                close_line()
            stack.pop()

    while at < len(html):
        part = _PART.match(html, at)
        at = part.end()
        text = part[7]
        if text is not None:
            if not (stack and stack[-1].silent):
                words.append(unescape(text))
            continue
        tag = (part[2] or part[5] or "").lower()
        if not tag:
            continue  # a comment or declaration
        if part[1] or part[4]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    close_to(k)
                    break
            continue
        attributes = part[3] or part[6] or ""
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p":
                    close_to(k)
                    break
                if stack[k].tag in BLOCKS:
                    break
        if tag in _ENDS_LIKE:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in _ENDS_LIKE[tag]:
                    close_to(k)
                    break
                if stack[k].tag in _SCOPES[tag]:
                    break
        top = stack[-1] if stack else _Open("", 0, 0)
        landmark = max(top.landmark, LANDMARKS.get(tag, 0))
        own = _furniture(tag, attributes, landmark > 0)
        # An article resets what only wraps it, and main what has such a name, too.
        resets = {"article": LOOSE, "main": NAMED}.get(tag, 0)
        furniture = max(top.furniture if top.furniture > resets else 0, own)
        wraps = 0 if tag == "main" and not top.landmark else top.wraps + (own == LOOSE and not top.landmark)
        if tag in BLOCKS:
            close_line()
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCKS:
            if tag == "br":
                words.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>|\Z", re.I).search(html, at)
            at = end.end()
            continue
        silent = furniture and tag not in BLOCKS and (top.silent or not top.furniture)
        # What is loose inside an article is still in it.
        inside = landmark if not furniture or furniture == LOOSE and top.landmark else 0
        stack.append(_Open(tag, furniture, inside, silent, wraps))
    close_to(0)
    close_line()
    return _judged(found)


def _texts(found: list[tuple[str, bool, bool]]) -> list[str]:
    return [text for text, _, _ in found]


def shared(one: list[str], other: list[str]) -> set[int]:
    """Positions of the lines of `one` in a longest common subsequence with `other`.

    Equal beginnings and ends first; between them the pairs of equal lines, of which the
    longest increasing run is found by bisection.
    """
    start, n, m = 0, len(one), len(other)
    while start < min(n, m) and one[start] == other[start]:
        start += 1
    while n > start and m > start and one[n - 1] == other[m - 1]:
        n, m = n - 1, m - 1
    places: dict[str, list[int]] = {}
    for j in range(m - 1, start - 1, -1):
        places.setdefault(other[j], []).append(j)
    tails: list[int] = []
    ends: list[tuple[int, tuple | None]] = []
    for i in range(start, n):
        for j in places.get(one[i], ()):
            k = bisect_left(tails, j)
            link = (i, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(link)
            else:
                tails[k], ends[k] = j, link
    result = {*range(start), *range(n, len(one))}
    link = ends[-1] if ends else None
    while link:
        result.add(link[0])
        link = link[1]
    return result


def main_text(own: list[tuple[str, bool, bool]], nearest: list[tuple[str, bool, bool]] | None) -> tuple[str, int]:
    """The text of a page, given the lines of it and of the nearest page, and how many
    lines differencing has deleted."""
    if any(landmark for _, _, landmark in own):
        kept = [text for text, furniture, landmark in own if landmark and not furniture]
        return "\n".join(kept), 0
    common = shared(_texts(own), _texts(nearest)) if nearest else set()
    open_lines = [(k, text) for k, (text, furniture, _) in enumerate(own) if not furniture]
    kept = [text for k, text in open_lines if k not in common]
    return "\n".join(kept), len(open_lines) - len(kept)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Lower-cased host without port, and path; empty for null and unreadable URLs."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.hostname or ""), parts.path
    except ValueError:
        return "", ""


def _common_prefix(a: str, b: str) -> int:
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, deleted for every row of pages (page_id, url, html).

    deleted: lines that differencing has cut. Pages are in the order of host and path,
    then of url, page_id and html; nearest is the page before or after on the same host
    with the longer common path, the one after if equal, where pages with the same lines
    are passed over. A page without another on its host has none. A null html has an
    empty text; copies of a page, and pages with equal URLs, are rows of their own. Each
    html is shuffled once; a task holds three pages at a time, and of a run of copies the
    ids and URLs.
    """
    spark = pages.sparkSession
    short_batches(spark)

    @F.arrow_udf("struct<host: string, path: string>")
    def parts(urls: pa.Array) -> pa.Array:
        found = [host_and_path(u) for u in urls.to_pylist()]
        return pa.array([{"host": h, "path": p} for h, p in found], pa.struct([("host", pa.string()), ("path", pa.string())]))

    slim = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").withColumn("parts", parts("url")).select(
        "page_id", "url", "html", F.col("parts.host").alias("host"), F.col("parts.path").alias("path"))
    slim = slim.withColumn("mark", F.xxhash64("html"))

    @F.arrow_udf("bigint")
    def content(htmls: pa.Array) -> pa.Array:
        marks = [blake2b("\n".join(_texts(lines(h))).encode("utf-8", "surrogatepass"), digest_size=8).digest() for h in htmls.to_pylist()]
        return pa.array([int.from_bytes(m, "big", signed=True) for m in marks], pa.int64())

    ordered, place, role = in_ranges(slim, ["host", "path", "url", "page_id", "mark"], ["html"], content("html"))
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()),
                     ("deleted", pa.int64())])

    def results(before, run, after) -> Iterator[tuple]:
        """The rows of a run of copies on a host; before and after: (path, lines) or none."""
        texts: dict[bool, tuple[list, tuple[str, int]]] = {}
        for page_id, url, path, found, how in run:
            if how != 0:
                continue
            near = [n for n in (before, after) if n is not None]
            near.sort(key=lambda n: (-_common_prefix(path, n[0]), n is before))
            side = bool(near) and near[0] is before
            if side not in texts or texts[side][0] is not found:
                texts[side] = found, main_text(found, near[0][1] if near else None)
            text, deleted = texts[side][1]
            yield page_id, url, text, len(text), deleted

    def extract(batches):
        def rows() -> Iterator[tuple]:
            before, run, at = None, [], None
            for page_id, url, host, path, html, k, how in rows_of(batches, "page_id", "url", "host", "path", "html", place, role):
                if how == 2:
                    continue
                found = lines(html)
                if run and at == (k, host) and _texts(found) == _texts(run[0][3]):
                    run.append((page_id, url, path, run[-1][3] if found == run[-1][3] else found, how))
                    continue
                same = at == (k, host)
                yield from results(before, run, (path, found) if same else None)
                before = (run[-1][2], run[-1][3]) if same else None
                run, at = [(page_id, url, path, found, how)], (k, host)
            yield from results(before, run, None)

        yield from batched(out, rows())

    return ordered.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint, deleted bigint")
