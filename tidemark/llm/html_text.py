"""Main text of web pages by consensus of their host's pages.

Each page scores its containers: text outside links counts fully for the element that holds its block and half for
the one above. Containers are named by a generalised path of tags and classes (numbers in classes do not count), and
every page votes for its best ones. Votes are summed by host and path in Spark; a host's winning paths are those with
a fair share of its votes, or the first where none has one. Every page is then read again: what stands under its winning paths, under the article or main
element around the first of them, and directly in an element around it is taken in page order; outside the first path
and its article blocks that are mostly links are not. A page that has none of the paths is taken by its own best containers.

Menus, page headers and footers, sidebars, notices, adverts, forms and reader comments are left out by tag, role and
class wherever they stand; scripts, styles, buttons and other markup are no text. A class like has-sidebar or ad-free says nothing
about the element itself, nor does the header of an article, and a noise word is passed over on an element that holds most of the page's text and its article, main
or h1, or most of it where nothing else is left. Odd input: null or empty html gives empty
text; a null or odd url is a host of its own name; unclosed and stray tags are closed or passed over; equal votes go
to the smaller path; rows that repeat a page are each answered. Only (host, path, votes) are shuffled.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialise

DEPTH = 256  #: levels of elements that are told apart; what is nested deeper counts as standing at the last, as in browsers
FAIR_SHARE = 0.2  #: of a host's votes that makes a path a winning one; of which there are at most five
VOTES = 3  #: containers that a page votes for

# fixed values: kinds of HTML elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
MATH = frozenset("math maction menclose merror mfenced mfrac mi mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
RAW = frozenset("script style noscript template svg annotation annotation-xml iframe object canvas audio video textarea select button title".split())
NOISE_TAGS = frozenset("nav footer aside form dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo recommended related replies reply "
    "respond rss share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"['\"<>]")
ANGLE = re.compile(r"[<>]")
RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
DIGITS = re.compile(r"\d+")
SPLIT = re.compile(r"[\s_-]+")
MODIFIER = re.compile(r"(?<![^\s])(?:(?:has|have|no|not|with|without|hide|show)[_-]\S*|\S+[_-]free(?:[_-]\S*)?(?![^\s]))")
TOLD_BY = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
HEADS = frozenset(("article", "main", "h1"))
MARKED, NEVER = 1, 2  #: noise by a word of a class or id; by tag, role or hidden


def noisy(tag: str, value: str, in_article: bool) -> bool:
    """Whether a class or id tells of noise. On text itself, as a paragraph or heading, every part of a name must say so."""
    for name in MODIFIER.sub(" ", value).split():
        parts = {x for x in SPLIT.split(name) if x}
        said = parts & NOISE_WORDS - ({"header"} if in_article else set())  # an article's own header is part of it
        if said and (tag not in CONTENT or said == parts):
            return True
    return False


def describe(tag: str, attributes: str, in_article: bool) -> tuple[str, int]:
    """The generalised name of an element, and 0, MARKED or NEVER: whether it is no part of an article."""
    noise = NEVER if tag in NOISE_TAGS or (tag == "header" and not in_article) else 0
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag, noise
    names = ""
    for m in ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key not in TOLD_BY:
            continue
        value = (m[2] or m[3] or m[4] or "").lower()
        if key == "class":
            names = "." + ".".join(sorted({DIGITS.sub("#", x) for x in value.split()})) if value.split() else ""
        if key in ("class", "id") and tag not in ("body", "html", "main") and noisy(tag, value, in_article):
            noise = max(noise, MARKED)
        elif (key == "role" and value in NOISE_ROLES) or key == "hidden" or (key == "aria-hidden" and value == "true"):
            noise = NEVER
    return tag + names, noise


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, tag, "/" if it closes, attributes) of the page's markup in order; comments and raw elements have no tag.

    A tag ends at the first > outside quoted values of any length, or, if its quoting is odd, at the first > before
    any <. What follows a quote is the same for every tag that comes to it, so it is kept, and a page is read once.
    """
    last = page.rfind(">")
    ends: dict[int, int] = {}  # by the place of an opening quote
    none = {'"': len(page), "'": len(page)}  # no such quote stands behind this place

    def tag_end(at: int) -> int:
        quotes = []
        while True:
            m = STOP.search(page, at)
            if not m or m[0] == "<":
                end = -1
                break
            if m[0] == ">":
                end = m.start()
                break
            at = m.start()
            if at in ends:
                end = ends[at]
                break
            quotes.append(at)
            close = page.find(m[0], at + 1) if at < none[m[0]] else -1
            if close < 0:
                none[m[0]] = min(none[m[0]], at)
                end = -1
                break
            at = close + 1
        ends.update(dict.fromkeys(quotes, end))
        return end

    at = page.find("<")
    while 0 <= at < last:
        end, tag, slash, attributes = -1, "", "", ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
            end = end if end > 2 else len(page)
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at + 2) + 1
        elif m := NAME.match(page, at):
            slash, tag = m[1], m[2].lower()
            end = tag_end(m.end())
            if end < 0 and (odd := ANGLE.search(page, m.end())) and odd[0] == ">":
                end = odd.start()
            if end >= 0:
                attributes = page[m.end() : end]
                end += 1
                if tag in RAW and not slash:
                    close = RAW_END[tag].search(page, end)
                    end, tag, attributes = close.end() if close else len(page), "", ""
        if end > 0:
            yield at, end, tag, slash, attributes
        at = page.find("<", end if end > 0 else at + 1)
    if at >= 0 and (at := page.find("<!--", at)) >= 0:
        yield at, len(page), "", "", ""


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """The page's blocks of text in order, noise left out: (path of the elements around it, text, characters in links)."""
    out: list[tuple[tuple[str, ...], str, int, tuple[int, ...]]] = []
    heads: list[tuple[int, ...]] = []
    tags: list[str] = []
    path: list[str] = []
    noise: list[int] = []  # 0, NEVER, or -n for the n-th element that is marked
    marked = 0
    parts: list[str] = []
    paths: dict[tuple[str, ...], tuple[str, ...]] = {}  # one copy of each
    linked, in_link, end = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and NEVER not in noise:
                here = tuple(path)
                out.append((paths.setdefault(here, here), text, min(linked, len(text)), tuple(filter(None, noise))))
            parts.clear()
        linked = 0

    def close(to: int) -> None:
        flush()
        del tags[to:], path[to:], noise[to:]

    for start, after, tag, slash, attributes in tokens(page):
        if start > end:
            text = page[end:start]
            parts.append(text)
            linked += len(text) * (in_link > 0)
        end = after
        if not tag:  # raw element, comment, declaration
            continue
        if tag in INLINE or tag in MATH:
            if tag == "a":
                in_link = 0 if slash else 1
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
            continue
        if slash:
            in_link = 0
            if tag in tags:
                close(len(tags) - 1 - tags[::-1].index(tag))
            else:
                flush()
            continue
        flush()
        in_link = 0
        if tags and tags[-1] == "p":  # a paragraph ends where any block begins
            close(len(tags) - 1)
        if tags and tags[-1] in CLOSED_BY.get(tag, ()):
            close(len(tags) - 1)
        if len(tags) >= DEPTH:
            close(DEPTH - 1)
        name, is_noise = describe(tag, attributes, "article" in tags or "main" in tags)
        tags.append(tag)
        path.append(name)
        if is_noise == MARKED:
            marked += 1
            is_noise = -marked
        elif not is_noise and tag in HEADS and any(noise) and NEVER not in noise:
            heads.append(tuple(x for x in noise if x))
        noise.append(is_noise)
    if end < len(page):
        parts.append(page[end:])
    flush()
    return unmarked(out, heads) if marked else [x[:3] for x in out]


def unmarked(found: list[tuple[tuple[str, ...], str, int, tuple[int, ...]]], heads: list[tuple[int, ...]]) -> list[tuple[tuple[str, ...], str, int]]:
    """The blocks that stand in no marked element, those that hold most of the text passed over, the innermost first."""
    lifted: set[int] = set()
    total = sum(len(text) - linked for _, text, linked, _ in found)
    while True:
        inside = [tuple(x for x in marks if x not in lifted) for *_, marks in found]
        holds: dict[int, int] = defaultdict(int)
        for (_, text, linked, _), marks in zip(found, inside, strict=True):
            if marks:
                holds[marks[-1]] += len(text) - linked
        most = max(holds, key=lambda x: (holds[x], x), default=0)
        with_head = any([x for x in h if x not in lifted][-1:] == [most] for h in heads)
        if not most or 2 * holds[most] <= total or (not with_head and not all(inside)):
            return [x[:3] for x, marks in zip(found, inside, strict=True) if not marks]
        lifted.add(most)


CONTENT = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "table", "tbody", "thead", "tr", "td", "th", "details", "summary", "hgroup")
OUTER = ("html", "head")


def container(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path without the elements that hold one block of running text."""
    n = len(path)
    while n and path[n - 1].split(".")[0] in CONTENT:
        n -= 1
    return tuple(x for x in path[:n] if x not in OUTER)


def scored(found: list[tuple[tuple[str, ...], str, int]]) -> list[tuple[str, float]]:
    """Containers of a page by falling score; the scores of a page sum to one at most."""
    held: dict[tuple[str, ...], int] = defaultdict(int)
    for path, text, linked in found:
        held[path] += len(text) - linked
    score: dict[tuple[str, ...], float] = defaultdict(float)
    for path, value in held.items():
        at = container(path)
        score[at] += value
        if at:
            score[at[:-1]] += value / 2
    total = sum(score.values())
    best = sorted(((s / total, "/".join(p)) for p, s in score.items() if s > 0), key=lambda x: (-x[0], x[1]))[:VOTES]
    return [(p, s) for s, p in best]


def taken(found: list[tuple[tuple[str, ...], str, int]], winners: list[str]) -> list[str]:
    """Blocks under the first of the paths that the page has, and those that belong to it, in page order."""
    bare = {path: tuple(x for x in path if x not in OUTER) for path in {path for path, _, _ in found}}
    wanted = [tuple(x.split("/")) if x else () for x in winners]
    first = next((w for w in wanted if any(path[: len(w)] == w for path in bare.values())), None)
    if first is None:
        return []
    around = [first[: i + 1] for i, x in enumerate(first) if x.split(".")[0] in ("article", "main")]
    article = next((x for x in around if x[-1].split(".")[0] == "article"), around[0] if around else None)
    wide = [w for w in wanted if w not in ((), ("body",))] + [article] * (article is not None)

    def place(path: tuple[str, ...]) -> tuple[bool, bool]:
        """Whether blocks of this path belong to the text, and whether they do unless they are mostly links."""
        own = container(path)
        # a list of sources in the article; links that stand bare in a box are a menu
        listed = own != path and article is not None and article[-1].split(".")[0] == "article" and path[: len(article)] == article
        return path[: len(first)] == first or listed, own == first[: len(own)] or any(path[: len(w)] == w for w in wide)

    places = {path: place(x) for path, x in bare.items()}
    return [text for path, text, linked in found if places[path][0] or (places[path][1] and 2 * linked < len(text))]


def main_text(page: str | None, winners: list[str] | None) -> str:
    found = blocks(page) if page else []
    own = scored(found)
    if text := taken(found, winners or []) or taken(found, [p for i, (p, s) in enumerate(own) if not i or s >= FAIR_SHARE]):
        return " ".join(text)
    return " ".join(text for _, text, _ in found)


def host(url: str | Column) -> Column:
    """The url's host in lower case; an odd url stands for itself."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    found = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(found == "", url).otherwise(found)


def winning_paths(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """(host, paths): the winning paths of each host, those with most votes first."""

    @F.arrow_udf("array<struct<path: string, vote: double>>")
    def vote(found: pa.Array) -> pa.Array:
        votes = [[{"path": p, "vote": s} for p, s in scored(blocks(x))] if x else [] for x in found.to_pylist()]
        return pa.array(votes, pa.list_(pa.struct([("path", pa.string()), ("vote", pa.float64())])))

    votes = pages.select(host(url).alias("host"), F.explode(vote(page)).alias("v"))
    sums = votes.groupBy("host", "v.path").agg(F.sum(F.col("v.vote").cast("decimal(28,9)")).alias("votes"))
    hosts = sums.groupBy("host").agg(F.sum("votes").alias("all"), F.min(F.struct((-F.col("votes")).alias("less"), "path")).alias("top"))
    fair = sums.join(hosts.select("host", "all"), "host").where(F.col("votes") >= FAIR_SHARE * F.col("all"))  # at most 1 / FAIR_SHARE of a host
    listed = fair.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path"))).alias("fair"))
    paths = F.coalesce(F.transform("fair", lambda x: x["path"]), F.array("top.path"))
    return hosts.join(listed, "host", "left").select("host", paths.alias("paths"))


def extract(pages: DataFrame, page: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and the main text of every page."""
    winners = materialise(winning_paths(pages, page, url), "paths")

    @F.arrow_udf("string")
    def text(found: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([main_text(x, p) for x, p in zip(found.to_pylist(), paths.to_pylist(), strict=True)], pa.string())

    rows = pages.select(*keep, F.col(page).alias("page"), host(url).alias("host")).join(winners, "host", "left")
    return rows.select(*keep, text("page", "paths").alias("text"))
