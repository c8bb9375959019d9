"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text they hold; the page votes for the generalised tag-class path of
its best container, and votes are summed per host in Spark. Every page is then re-extracted with the path of its
host's consensus that most pages voted for among those it has; a page that has none uses its own best container.

Pages are read in time linear in their length, whatever their markup: tags are found by index, elements are kept
in arrays, and a path is a digest of its parent's path and its own step.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mapped, stored

#: A path is a host's consensus if at least this share of its voting pages chose it: at most 1 / SHARE paths a host.
SHARE = 0.01
DECAY = 0.7  # of a text's worth for each container further out

# The vocabulary of page structure.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body center dd div figure html main section table tbody td".split())
DROPPED = frozenset("aside audio button canvas dialog embed footer form head input map menu nav object option script select style svg textarea title video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
OPTIONAL_END = frozenset("p li dt dd tr td th option optgroup tbody thead tfoot colgroup caption head body html".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot"}, "tfoot": {"tbody", "thead"}, "option": {"option"}}
LISTS = frozenset("ul ol dl menu dir table".split())
SCOPES = frozenset("td th caption table".split())
TABLE_PARTS = frozenset("td th tr tbody thead tfoot caption table".split())
#: Blocks at which an unwanted element that is never closed is taken to have ended.
FREES = frozenset("article blockquote figure h1 h2 h3 h4 h5 h6 main p pre section table".split())
GOOD = frozenset("article articlebody body-text bodytext content entry entry-content main maincontent main-content post post-body post-content story story-body text prose".split())
BAD = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners billboard sponsor sponsored promo promos promoted promotion outbrain taboola"
    " comment comments commentlist disqus respond reply replies discussion feedback"
    " cookie cookies consent gdpr notice notices notification notifications alert announcement disclaimer paywall popup modal overlay lightbox"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination toolbar topbar skip"
    " sidebar sidenav aside rail widget widgets related recommended recommendations trending popular tags tagcloud"
    " footer footnav copyright header masthead share sharing social subscribe subscription newsletter signup login search searchbox form hidden".split()
)
#: A name of several parts is unwanted if all its parts are here or in BAD, and one is in BAD_PART: "ad-slot", not "social-history".
BAD_PART = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner comment comments cookie cookies consent notice popup modal newsletter subscribe sidebar side nav navbar navigation menu breadcrumb breadcrumbs footer header masthead share sharing social related disqus gdpr skip tag".split())
NEUTRAL = frozenset("a and area bar block bottom box btn button buttons by cloud col column container desktop first fixed floating for global group holder icons inner item items js last left level like link links list media mobile more of outer page panel pane placeholder primary right row second secondary section site slot sticky sub the thread to top under unit us wrap wrapper zone".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu".split())
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
DIGITS = re.compile(r"\d+")
SPACE = re.compile(r"\s+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(next((x for x in m.groups()[1:] if x is not None), "")) for m in ATTRIBUTE.finditer(text)} if "=" in text or "hidden" in text else {}


def _unwanted_name(name: str) -> bool:
    if name in BAD:
        return True
    parts = [x for x in re.split(r"[-_]+", name) if x and not x.isdigit()]
    return len(parts) > 1 and any(x in BAD_PART for x in parts) and all(x in BAD or x in BAD_PART or x in NEUTRAL for x in parts)


def _unwanted(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether the element and all in it is no main text; inside: it stands in an article, whose own header counts."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    names = attributes.get("class", "").lower().split()
    if tag in ("body", "html", "article", "main"):
        return tag == "article" and any(n.split("-")[0].split("_")[0] in ("comment", "comments", "reply") for n in names)
    for n in names + attributes.get("id", "").lower().split():
        if _unwanted_name(n) and not (inside and n in ("header", "tags", "discussion", "related")):
            return True
    return False


def _step(tag: str, attributes: dict[str, str]) -> str:
    names = sorted({DIGITS.sub("#", n) for n in attributes.get("class", "").lower().split()})
    return ".".join([tag, *names])


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it is an end tag, attributes) of each tag; comments and declarations have no name.

    A tag ends at the first > outside quotes. Where quotes never close, tags end at the first >; without any > what
    is left is text.
    """
    at, size, quoted = 0, len(page), True
    endless: set[str] = set()
    while (i := page.find("<", at)) >= 0:
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = size if end < 0 else end + 3
            yield i, at, "", False, ""
            continue
        if page[i + 1 : i + 2] in ("!", "?"):
            end = page.find(">", i)
            if end < 0:
                return
            at = end + 1
            yield i, at, "", False, ""
            continue
        closing = page.startswith("/", i + 1)
        name = NAME.match(page, i + 1 + closing)
        if not name:
            at = i + 1
            continue
        k = name.end()
        while quoted:
            k = PLAIN.match(page, k).end()
            if k >= size:
                quoted = False
            elif page[k] == ">":
                break
            else:
                k = page.find(page[k], k + 1) + 1
                if not k:
                    quoted = False
        if not quoted:
            k = page.find(">", name.end())
            if k < 0:
                return
        at = k + 1
        tag = name[0].lower()
        if tag in RAW and not closing:  # its content is no markup
            end = None if tag in endless else RAW_END[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = size
            else:
                endless.add(tag)
                tag = ""
            yield i, at, tag, False, ""
            continue
        yield i, at, tag, closing, page[name.end() : k]


@dataclass
class Elements:
    """The elements of a page as arrays; element 0 is the page."""

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    attributes: list[dict] = field(default_factory=lambda: [{}])
    inside: list[bool] = field(default_factory=lambda: [False])
    broken: list[bool] = field(default_factory=lambda: [False])
    holds_main: set[int] = field(default_factory=set)
    events: list[tuple[int, str | None]] = field(default_factory=list)  # (element, text) or (element, None) where it starts or what follows is its parent's


def elements(page: str) -> Elements:
    """Reads tags into elements: omitted end tags are filled in, end tags without an open element are passed over."""
    e = Elements()
    stack = [0]
    places: dict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by tag
    blocks: list[int] = [0]

    def close(to: int, own_end: bool) -> None:
        ends_block = blocks[-1] >= to
        while len(stack) > to:
            k = stack.pop()
            places[e.tag[k]].pop()
            if blocks[-1] == len(stack):
                blocks.pop()
            e.broken[k] = not (own_end and len(stack) == to) and e.tag[k] not in OPTIONAL_END
        if ends_block:
            e.events.append((stack[-1], None))

    def text(start: int, end: int) -> None:
        if end > start:
            e.events.append((stack[-1], html.unescape(page[start:end])))

    def nearest(names: frozenset[str] | set[str]) -> int:
        return max((places[n][-1] for n in names if places[n]), default=-1)

    at = 0
    for start, end, tag, closing, rest in tags(page):
        text(at, start)
        at = end
        if not tag:
            continue
        if closing:
            k = places[tag][-1] if places[tag] else -1
            if k < 0:
                if tag == "p":
                    e.events.append((stack[-1], None))
                continue
            if tag not in BLOCKS:
                over = blocks[-1] > k
            elif tag == "table":
                over = False
            elif tag in TABLE_PARTS:
                over = nearest({"table"}) > k
            else:
                over = nearest(SCOPES) > k or (tag == "li" and nearest({"ul", "ol"}) > k)
            if not over:
                close(k, True)
            continue
        if tag in BLOCKS:
            if places["p"] and places["p"][-1] > nearest(SCOPES) and tag not in ("html", "body"):
                close(places["p"][-1], False)
            for shut in CLOSED_BY.get(tag, ()):
                k = places[shut][-1] if places[shut] else -1
                if k > nearest(LISTS if tag in ("li", "dt", "dd") else {"table"}):
                    close(k, False)
        elif tag == "a" and places["a"] and places["a"][-1] > blocks[-1]:
            close(places["a"][-1], False)
        if tag == "body" and places["head"]:
            close(places["head"][-1], False)
        number = len(e.tag)
        e.tag.append(tag)
        e.parent.append(stack[-1])
        e.attributes.append(_attributes(rest))
        e.inside.append(e.inside[stack[-1]] or tag in ("article", "main"))
        e.broken.append(False)
        if tag in ("article", "main"):
            e.holds_main.update(stack[k] for k in places["form"])
        e.events.append((number, None))
        if tag in VOID or tag in RAW or rest.endswith("/") and tag not in BLOCKS:
            e.events.append((stack[-1], " " if tag == "br" else None if tag in BLOCKS else ""))
            continue
        places[tag].append(len(stack))
        if tag in BLOCKS:
            blocks.append(len(stack))
        stack.append(number)
    text(at, len(page))
    close(1, False)
    return e


@dataclass
class Page:
    """Blocks of wanted text, and the containers that hold them, each after the one around it."""

    text: list[str] = field(default_factory=list)
    worth: list[float] = field(default_factory=list)
    container: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    path: list[str] = field(default_factory=list)
    bonus: list[float] = field(default_factory=list)


def parse(source: str) -> Page:
    e, page = elements(source), Page()
    n = len(e.tag)
    hidden, linked, within, block = [False] * n, [False] * n, [-1] * n, [0] * n
    pieces: list[str] = []
    in_links = last = 0

    def flush(holder: int) -> None:
        nonlocal in_links
        joined = SPACE.sub(" ", "".join(pieces)).strip()
        if joined:
            page.text.append(joined)
            page.worth.append(len(joined) * max(0.0, 1 - in_links / len(joined)))
            page.container.append(within[holder])
        pieces.clear()
        in_links = 0

    started = 0
    for k, content in e.events:
        if k > started:  # the element starts here
            started = k
            tag, above, attributes = e.tag[k], e.parent[k], e.attributes[k]
            if hidden[above] and tag in FREES:
                up = above
                while hidden[up] and e.broken[up] and (tag in ("article", "main") or e.tag[up] not in ("aside", "footer")):
                    hidden[up] = False
                    up = e.parent[up]
            unwanted = tag not in VOID and (tag in RAW or _unwanted(tag, attributes, e.inside[above])) and not (tag == "form" and k in e.holds_main)
            hidden[k] = hidden[above] or unwanted
            linked[k] = linked[above] or tag == "a"
            block[k] = k if tag in BLOCKS else block[above]
            within[k] = within[above]
            if tag in CONTAINERS and not hidden[k]:
                names = set((attributes.get("class", "") + " " + attributes.get("id", "") + " " + attributes.get("itemprop", "")).lower().split())
                within[k] = len(page.path)
                page.parent.append(within[above])
                page.path.append(hashlib.blake2b(((page.path[within[above]] if within[above] >= 0 else "") + "/" + _step(tag, attributes)).encode("utf-8", "replace"), digest_size=8).hexdigest())
                page.bonus.append(3.0 if tag in ("article", "main") or attributes.get("role") in ("main", "article") else 0.25 if tag in ("body", "html") else 2.0 if names & GOOD else 1.0)
        if block[k] != last or (content is None and block[k] == k):
            flush(last)
            last = block[k]
        if content and not hidden[k]:
            pieces.append(content)
            if linked[k]:
                in_links += len(content)
    flush(last)
    return page


def path_scores(page: Page) -> dict[str, float]:
    """Worth of each path: text outside links, less for each container further out, times the container's bonus."""
    held = [0.0] * len(page.path)
    for worth, k in zip(page.worth, page.container):
        if k >= 0:
            held[k] += worth
    scores: dict[str, float] = defaultdict(float)
    for k in range(len(held) - 1, -1, -1):
        if held[k]:
            scores[page.path[k]] += held[k] * page.bonus[k]
            if page.parent[k] >= 0:
                held[page.parent[k]] += held[k] * DECAY
    return scores


def best_path(page: Page) -> str | None:
    scores = path_scores(page)
    return min(scores.items(), key=lambda x: (-x[1], x[0]))[0] if scores else None


#: A container beside the chosen one may be part of the same article if it has this share of its worth and a sentence, and
#: is if so many of the host's pages that vote for the one have the other beside it.
LIKE, AGREED = 0.1, 0.5
SENTENCE = re.compile(r"\w\W+\w+\W.*[.!?\u2026][\"'\u201d\u00bb)]*$", re.DOTALL)


def like_beside(page: Page, path: str) -> set[str]:
    """Paths of containers beside those of a path that have like worth and a sentence: an article may be split over
    neighbours, a lead and the rest. Article and main elements are whole by declaration and have none."""
    worth, prose = [0.0] * len(page.path), [False] * len(page.path)
    for value, text, k in zip(page.worth, page.text, page.container):
        if k >= 0:
            worth[k] += value
            prose[k] = prose[k] or bool(SENTENCE.search(text[-400:]))
    for k in reversed(range(len(worth))):
        if page.parent[k] >= 0:
            worth[page.parent[k]] += worth[k]
            prose[page.parent[k]] = prose[page.parent[k]] or prose[k]
    least: dict[int, float] = defaultdict(float)
    for k, mine in enumerate(page.path):
        if mine == path and page.bonus[k] < 3:
            least[page.parent[k]] += LIKE * worth[k]
    return {page.path[k] for k, beside in enumerate(page.parent) if page.path[k] != path and prose[k] and least.get(beside, 0.0) > 0 and worth[k] >= least[beside]}


def blocks_under(page: Page, path: str, beside: set[str] = frozenset()) -> list[str]:
    """The blocks under the containers of a path, and under those of paths that go with it beside them."""
    parents = {page.parent[k] for k, mine in enumerate(page.path) if mine == path}
    under = [False] * len(page.path)
    for k, mine in enumerate(page.path):
        under[k] = mine == path or (mine in beside and page.parent[k] in parents) or (page.parent[k] >= 0 and under[page.parent[k]])
    return [text for text, k in zip(page.text, page.container) if k >= 0 and under[k]]


def extract(page: Page, paths: list[str], beside: list[list[str]] | None = None) -> str:
    """The blocks under the first path under which the page has text, with what goes with it, else under its own best container, else all."""
    there = set(page.path)
    for path, more in zip(paths, beside or [[]] * len(paths)):
        if path in there and (held := blocks_under(page, path, set(more))):
            return "\n".join(held)
    own = best_path(page)
    return "\n".join(blocks_under(page, own, like_beside(page, own)) if own else page.text)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def consensus(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, paths, beside): the paths that at least SHARE of a host's pages vote for, first the one with most votes, and what goes with each.

    Votes are summed within each task before they are shuffled, so a host with most pages sends few rows.
    """
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes: dict[tuple[str, str, str], int] = defaultdict(int)
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if page and (best := best_path(read := parse(page))):
                    for beside in ("", *like_beside(read, best)):
                        votes[host, best, beside] += 1
            if len(votes) > 100_000:
                yield flushed(votes)
        yield flushed(votes)

    def flushed(votes: dict) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([*[pa.array([v[i] for v in votes], pa.string()) for i in range(3)], pa.array(list(votes.values()), pa.int64())], ["host", "path", "beside", "votes"])
        votes.clear()
        return batch

    cast = mapped(pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")), vote, "host string, path string, beside string, votes long")
    summed = cast.groupBy("host", "path", "beside").agg(F.sum("votes").alias("votes"))
    summed = stored(summed, "host-votes")
    own = summed.where("beside = ''")
    total = own.groupBy(F.col("host").alias("whole_host")).agg(F.sum("votes").alias("whole"))
    top = own.join(total, F.col("host") == F.col("whole_host")).where(F.col("votes") >= SHARE * F.col("whole")).drop("beside", "whole_host")
    more = summed.where("beside <> ''").select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "beside", F.col("votes").alias("together"))
    both = top.join(more, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left")
    goes = F.array_sort(F.array_compact(F.collect_list(F.when(F.col("together") >= AGREED * F.col("votes"), F.col("beside")))))
    each = both.groupBy("host", "path", "votes").agg(goes.alias("beside"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path", "beside")))
    return each.groupBy("host").agg(ranked.alias("ranked")).select(F.col("host").alias("voted_host"), F.col("ranked.path").alias("paths"), F.col("ranked.beside").alias("beside"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text.

    Null and empty html give an empty text; pages without a host vote together; ties go to the lesser path; long or
    broken pages are read whole; rows are answered one by one, repeats alike; an empty table gives an empty result;
    other columns are ignored.
    """
    voted = stored(consensus(pages, url_col, html_col), "host-paths")
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(parse(page), paths or [], beside) if page else "" for page, paths, beside in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = rows.join(voted, F.col("host") == F.col("voted_host"), "left").select("id", "url", "html", "paths", "beside")
    return mapped(joined, run, f"id {kind}, url string, text string").withColumnsRenamed({"id": id_col, "url": url_col})
