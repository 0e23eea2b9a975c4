"""Main text of HTML pages by tag-path ratios.

A page is read into text nodes, each with its path of tags from the root.  For every path the lengths and the punctuation of its nodes
are added up and divided by the number of nodes; along the page the two ratios are smoothed over neighbouring nodes and multiplied; paths
whose mean product reaches ``THRESHOLD`` times the length-weighted mean of the page are content paths.  The smallest element that
holds ``MASS`` of the content paths' text points at the article: the outermost ``article`` around it, else the next ``main``, else
the outermost element below the body that holds more text of content paths or headings than those within it.  All blocks in it
count, so that short paragraphs, headings and what stands beside one dominating block stay.  Where that is only the body
itself, all from the first to the last content path or heading counts, the elements these stand in, and lists, tables and the like
that are not mainly links.

Menus, footers, sidebars, adverts, forms, reader comments and the like are set aside beforehand by element, role, or a class or id that says
so plainly (``HINTS``), and take no part in the ratios.  Words that may as well describe a topic (``DOUBTS``: "social history", "search results") only
make an element suspect.  A suspect's paths hold those words too, and it stays if they reach ``THRESHOLD`` times the mean ratio product of the
other paths (of all, where most text is suspect) and most of its text is not links; it points at the article only where suspects hold most of the content.  White space in
a block becomes one blank, blocks are joined in page order by one blank, character references are decoded.

Defined cases: null and empty pages, and pages without text, give an empty text; unclosed and misnested elements are closed
by the next block or the end of their parent; an unclosed comment or script reaches to the end; very long pages are read whole; repeated
rows give one result each; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD, MASS, REACH = 0.25, 0.9, 2

# Element names of HTML and the words that name boilerplate in classes, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset("head script style noscript template svg math canvas iframe object audio video nav footer aside form button "
                    "select option textarea title dialog menu noembed noframes datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored nav navbar breadcrumb breadcrumbs footer sidebar "
                  "cookie cookies consent gdpr newsletter comments comment commentlist disqus respond replies reply pagination pager paywall".split())
DOUBTS = frozenset("promo promotion banner navigation menu menubar header masthead aside widget notice notices popup modal overlay subscribe "
                   "subscription signup signin login share sharing social related recommended recommendations copyright toolbar search skip".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CONTENT = frozenset("content main article post entry story body page wrapper container layout".split())
#: Never an article by themselves.
PARTIAL = INLINE | HEADINGS | frozenset("p li td th tr tbody thead tfoot table ul ol dl dt dd blockquote pre figure figcaption section".split())
LISTED = frozenset("ul ol dl table blockquote pre".split())
BODIES = ("", "html", "body")
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
                  "option": ("select",)}
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", re.DOTALL)
NAMED = re.compile(r"\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
PARTS = re.compile(r"[a-z]+")


def hinted(tag: str, attributes: str, in_article: bool) -> tuple[bool, str]:
    """Whether an element's attributes name it boilerplate, and the words that make it suspect."""
    suspect = set()
    for name, *values in NAMED.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden":
            return True, ""
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return True, ""
        elif name == "role":
            if value in ROLES:
                return True, ""
        elif tag not in ("html", "body", "main"):
            for one in value.split():
                words = set(PARTS.findall(one))
                if words & CONTENT:
                    continue
                if tag == "article":
                    if words & {"comment", "comments", "reply", "ad", "advert", "sponsored"}:
                        return True, ""
                    suspect |= words & {"promo", "related"}
                elif words & HINTS:
                    return True, ""
                elif words & DOUBTS and not (in_article and words & DOUBTS == {"header"}):
                    suspect |= words & DOUBTS
    return False, " ".join(sorted(suspect))


class Element:
    __slots__ = ("tag", "path", "dropped", "number", "article")

    def __init__(self, tag, path, dropped, number, article):
        self.tag, self.path, self.dropped, self.number, self.article = tag, path, dropped, number, article


def text_nodes(page: str) -> tuple[list[tuple[str, int, int, bool]], list[int], list[str], list[bool]]:
    """Text nodes (text, path, element, whether a block begins before it), each element's parent, its tag, and whether it is suspect."""
    paths: dict[tuple[int, str, str], int] = {}
    parents, tags, suspects = [-1], [""], [False]
    stack = [Element("", 0, False, 0, False)]
    nodes: list[tuple[str, int, int, bool]] = []
    begin, at, token = True, 0, TOKEN.search

    def close(n: int) -> None:
        nonlocal begin
        begin = begin or any(e.tag not in INLINE for e in stack[n:])
        del stack[n:]

    while at < len(page):
        found = token(page, at)
        stop = found.start() if found else len(page)
        top = stack[-1]
        if stop > at and not top.dropped:
            nodes.append((html.unescape(page[at:stop]), top.path, top.number, begin))
            begin = False
        if not found:
            break
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == tag:
                    close(n)
                    break
                if tag in INLINE and stack[n].tag not in INLINE:
                    break
            continue
        if tag in VOID:
            begin = begin or tag not in INLINE
            continue
        if tag not in INLINE:
            begin = True
            limit = CLOSED_BY_SAME.get(tag)
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == "p" and tag != "option" or limit and stack[n].tag == tag:
                    close(n)
                    break
                if stack[n].tag not in INLINE and (not limit or stack[n].tag in limit):
                    break
        top = stack[-1]
        dropped, suspect = hinted(tag, found[3], top.article)
        dropped = dropped or top.dropped or tag in DROPPED or tag == "header" and not top.article
        number = top.number
        if not dropped:
            number = len(parents)
            parents.append(top.number)
            tags.append(tag)
            suspects.append(bool(suspect))
        if found[3].endswith("/") and tag in ("svg", "math", "path"):
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append(Element(tag, paths.setdefault((top.path, tag, suspect), len(paths) + 1), dropped, number, top.article or tag in ("article", "main")))
    return nodes, parents, tags, suspects


def smooth(values: np.ndarray) -> np.ndarray:
    """A Gaussian mean over ``REACH`` nodes to either side."""
    weights = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / (REACH / 2)) ** 2)
    full = np.convolve(values, weights, "same") if len(values) > 2 * REACH else \
        np.convolve(np.r_[np.zeros(REACH), values, np.zeros(REACH)], weights, "valid")
    ones = np.ones(len(values))
    norm = np.convolve(ones, weights, "same") if len(values) > 2 * REACH else \
        np.convolve(np.r_[np.zeros(REACH), ones, np.zeros(REACH)], weights, "valid")
    return full / norm


def path_ratios(lengths: np.ndarray, marks: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each node's path, and every path's text ratio and punctuation ratio."""
    _, which = np.unique(paths, return_inverse=True)
    count = np.bincount(which)
    return which, np.bincount(which, lengths) / count, np.bincount(which, marks) / count


def content_paths(lengths: np.ndarray, marks: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """Whether each node's path is a content path."""
    which, text_ratio, mark_ratio = path_ratios(lengths, marks, paths)
    fused = smooth(text_ratio[which]) * smooth(1.0 + mark_ratio[which])
    by_path = np.bincount(which, fused) / np.bincount(which)
    return (by_path >= THRESHOLD * np.average(by_path[which], weights=lengths))[which]


def summed(parents: list[int], owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For every element the sum over the nodes in it."""
    held = np.zeros(len(parents))
    np.add.at(held, owner, values)
    for n in range(len(parents) - 1, 0, -1):
        held[parents[n]] += held[n]
    return held


def within(parents: list[int], tags: list[str], names) -> np.ndarray:
    """For every element the outermost one of these names around it or itself, or -1."""
    out = [-1]
    for n in range(1, len(parents)):
        around = out[parents[n]]
        out.append(around if around >= 0 else n if tags[n] in names else -1)
    return np.array(out)


def doubted(parents: list[int], suspects: list[bool]) -> np.ndarray:
    """Whether each element is suspect or in one that is."""
    out = np.array(suspects)
    for n in range(1, len(parents)):
        out[n] |= out[parents[n]]
    return out


def boilerplate(parents: list[int], suspects: list[bool], owner: np.ndarray, lengths: np.ndarray, marks: np.ndarray, paths: np.ndarray,
                linked: np.ndarray) -> list[bool]:
    """The suspect elements whose paths do not read like content.  Not smoothed: a notice between two paragraphs would borrow their ratios.
    Where most text is suspect, the mean of all that is no link is the measure."""
    which, text_ratio, mark_ratio = path_ratios(lengths, marks, paths)
    fused = (text_ratio * (1.0 + mark_ratio))[which]
    others = ~doubted(parents, suspects)[owner]
    if 2 * lengths[others].sum() < lengths[~linked].sum():
        others = ~linked
    usual = np.average(fused[others], weights=lengths[others]) if others.any() else 0.0
    every, links = summed(parents, owner, lengths), summed(parents, owner, np.where(linked, lengths, 0.0))
    rated = summed(parents, owner, lengths * fused)
    return [s and (rated[n] < THRESHOLD * usual * every[n] or 2 * links[n] > every[n]) for n, s in enumerate(suspects)]


def article_of(root: int, parents: list[int], tags: list[str], telling: np.ndarray) -> int:
    """The article around the element that holds most of the text; ``telling`` is each element's text of content paths and headings."""
    around = [root]
    while around[-1]:
        around.append(parents[around[-1]])
    for n in reversed(around):
        if tags[n] == "article":
            return n
    for n in around:
        if tags[n] == "main":
            return n
    for n in around:
        if tags[root] in PARTIAL or telling[n] > telling[root]:
            root = n
    return root


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes, parents, tags, suspects = text_nodes(page)
    solid = [i for i, node in enumerate(nodes) if node[0].strip()]
    if not solid:
        return ""
    lengths = np.array([len(nodes[i][0].strip()) for i in solid], float)
    marks = np.array([len(PUNCTUATION.findall(nodes[i][0])) for i in solid], float)
    paths, owner = np.array([nodes[i][1] for i in solid]), np.array([nodes[i][2] for i in solid])
    linked = within(parents, tags, ("a",))
    if any(suspects):
        left = ~doubted(parents, boilerplate(parents, suspects, owner, lengths, marks, paths, linked[owner] >= 0))
        nodes = [node if left[node[2]] else ("", *node[1:]) for node in nodes]
        stays = left[owner]
        solid, lengths, marks, paths, owner = [i for i, s in zip(solid, stays) if s], lengths[stays], marks[stays], paths[stays], owner[stays]
        if not solid:
            return ""
    content = content_paths(lengths, marks, paths)
    plain = content & ~doubted(parents, suspects)[owner]
    if 2 * lengths[plain].sum() < lengths[content].sum():
        plain = content
    held = summed(parents, owner, np.where(plain, lengths, 0.0))
    root = int(np.flatnonzero(held >= MASS * held[0])[-1])
    heading = within(parents, tags, HEADINGS)[owner] >= 0
    root = article_of(root, parents, tags, summed(parents, owner, np.where(plain | heading, lengths, 0.0)))
    if tags[root] not in BODIES:
        inside = np.zeros(len(parents), bool)
        inside[root] = True
        for n in range(root + 1, len(parents)):
            inside[n] = inside[parents[n]]
        chosen = {i for i in range(len(nodes)) if inside[nodes[i][2]]}
    else:
        telling = content | heading
        top = np.arange(len(parents))
        for n in range(1, len(parents)):
            if tags[parents[n]] not in BODIES:
                top[n] = top[parents[n]]
        listed = within(parents, tags, LISTED)
        whole = {top[o] for o in owner[telling] if tags[top[o]] not in BODIES}
        links = summed(parents, owner, np.where(linked[owner] >= 0, lengths, 0.0))
        every = summed(parents, owner, lengths)
        first, last = np.array(solid)[telling][[0, -1]]
        chosen = set(range(first, last + 1))
        for i, (_, _, o, _) in enumerate(nodes):
            if top[o] in whole or listed[o] >= 0 and 2 * links[listed[o]] <= every[listed[o]]:
                chosen.add(i)
    pieces = []
    for i, (text, _, _, begin) in enumerate(nodes):
        if begin:
            pieces.append(" ")
        if i in chosen:
            pieces.append(text)
    return " ".join("".join(pieces).split())


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars); one pass without a shuffle."""
    return pages.select(F.col("page_id").cast("long"), "url", "html") \
        .mapInArrow(extract_batches, "page_id bigint, url string, text string, n_chars bigint")
