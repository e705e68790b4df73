"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with the path of tags (and their classes) from the root. Text length,
punctuation and link text are aggregated for each path; the ratios to the path's number of blocks are smoothed over the
order in which the paths appear, fused with the path's share of the text into one score and thresholded. What an element
says of itself only lowers the scores of the paths under it: kinds (nav, header, footer, aside) and names (classes, id or
role such as ad or comments) by SUSPECT, names that are common in articles too (search, social, notice) by DOUBT, and in an
article or main these only if such a path is mostly links. A name on an element around all text of the page says nothing.

The selected paths name the content: the lowest element around all their blocks, or the article or main around that. Its
blocks stay but for those of lowered paths that aren't selected; before the first and behind the last selected block of an
element that is no article or main, texts stay unless mostly links, and at the level of the body only where their path
reaches a part (weak) of the best score. The same holds for texts beside the content element; headings stay before it. A
page of which all text is lowered has no main text. Only what is no text to read (head, scripts, styles, forms, controls,
hidden elements) never takes part.

Defined results: null html, empty html and pages without text give an empty text; unclosed, unopened and crossed tags,
cut-off pages, stray < and unknown character references are text or ignored as browsers do; rows are independent of
each other, so repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>|<[!?/][^>]*+>""", re.S)
_ATTR = re.compile(r"""([^\s"'=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PUNCT = re.compile(r"[.,;:!?…。，、！？؟۔।]")
_NAME = re.compile(r"[a-z0-9]+")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
          "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that are no text to read.
DROP = {"head", "form", "noscript", "template", "button", "select", "option", "datalist", "svg", "math", "canvas",
        "object", "audio", "video", "map", "menu", "dialog", "input"} | RAW
#: Elements that are boilerplate by kind.
KINDS = {"nav", "header", "footer", "aside"}
#: Words in a class, id or role that name boilerplate.
DROP_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion",
              "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "header", "masthead", "footer", "sidebar", "aside",
              "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "toolbar",
              "comment", "comments", "reply", "replies", "disqus", "respond", "share", "sharing", "social", "related", "recommended", "recommendations",
              "newsletter", "subscribe", "subscription", "signup", "login", "search", "copyright", "skip", "hidden", "contentinfo", "complementary"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Parts of a text, never the whole of it.
PARTS = HEADINGS | {"p", "li", "ul", "ol", "blockquote", "td", "tr", "tbody", "table", "pre", "dl", "dd", "dt", "figure"}
#: Of these, words that are common in articles too: they count for less, and inside an article only where the texts of such a path are mostly links.
DOUBTFUL = {"header", "masthead", "footer", "banner", "notice", "notices", "notification", "alert", "promotion", "search", "social", "copyright", "aside",
            "complementary", "contentinfo", "reply", "replies", "respond", "share", "sharing", "related", "skip", "consent", "navigation", "menu", "signup", "login"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
            "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: A start tag ends an open element of these kinds, unless an element of the second set lies between.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
        "body": ({"head"}, set())} | {t: ({"p"}, {"button", "td", "th", "table", "li", "div", "section", "article", "body"}) for t in CLOSES_P}


#: Above this share of link text, texts are mostly links.
MAX_LINKED = 0.6
#: Factors on the score of a path, for each element on it that is boilerplate by kind or name, or by a doubtful name.
SUSPECT, DOUBT = 0.001, 0.05


class Element:
    __slots__ = ("tag", "up", "depth", "path", "drop", "link", "at", "article", "doubt", "prior", "kind")

    def __init__(self, tag, up, path, drop=False, link=False, at=0, article=False, doubt=None, prior=1.0, kind=False):
        self.tag, self.up, self.path, self.drop, self.link, self.at, self.article, self.doubt = tag, up, path, drop, link, at, article, doubt
        self.prior, self.kind = prior, kind
        self.depth = up.depth + 1 if up else 0


class Block:
    """``prior``: the product of the factors on its path."""

    __slots__ = ("text", "linked", "element", "prior")

    def __init__(self, text, linked, element):
        self.text, self.linked, self.element, self.prior = text, linked, element, element.prior


def _boilerplate_names(value: str) -> set[str]:
    """Whole words only: "ad-slot" is an advert, "reading" isn't, and "has-sidebar" says something about the rest."""
    words = _NAME.findall(value)
    return {w for k, w in enumerate(words) if w in DROP_NAMES and (not k or words[k - 1] not in ("has", "no", "with", "without"))}


def _evidence(tag: str, attrs: str, article: bool = False) -> tuple[str, bool, float, bool]:
    """(classes, whether the element is no text to read, the factor on its path's score, whether the links of its path
    decide on that); ``article``: it is in one."""
    if tag in DROP:
        return "", True, 1.0, False
    factor = SUSPECT if tag in KINDS else 1.0
    if not attrs or tag in ("html", "body", "article", "main"):
        return "", False, factor, False
    classes, drop, names = "", False, set()
    for k, v in _ATTR.findall(attrs):
        k, v = k.lower(), v.strip("\"'").lower()
        if k in ("class", "id", "role"):
            if k == "class":
                classes = v
            # Ids of headings and of an article's sections are made from the heading's text.
            if not (k == "id" and (tag in HEADINGS or article and tag == "section")):
                names |= _boilerplate_names(v)
        elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and "display:none" in v.replace(" ", ""):
            drop = True
    if names - DOUBTFUL:
        factor = SUSPECT
    elif names and not article:
        factor = min(factor, DOUBT)
    return classes, drop, factor, article and bool(names) and factor == 1.0


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, without those in elements that are no text to read."""
    paths: dict[tuple, int] = {}
    top = Element("", None, 0)
    open_tags: dict[str, int] = {}
    out: list[Block] = []
    texts: list[str] = []
    linked = at = n = 0
    last = page.rfind(">") + 1 if "<!--" not in page else len(page)  # no tag ends behind it

    def text(a: int, b: int) -> None:
        nonlocal linked
        if a < b and not top.drop:
            t = page[a:b]
            t = html.unescape(t) if "&" in t else t
            texts.append(t)
            if top.link:
                linked += len(t)

    def end_block() -> None:
        nonlocal linked
        if texts:
            t = " ".join("".join(texts).split())
            if t:
                e = top
                while e.tag in INLINE and e.up:
                    e = e.up
                out.append(Block(t, min(linked, len(t)), e))
            texts.clear()
        linked = 0

    def pop() -> None:
        nonlocal top
        open_tags[top.tag] -= 1
        top = top.up

    while True:
        m = _TAG.search(page, at, last)
        if m is None:
            text(at, len(page))
            break
        text(at, m.start())
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                texts.append(" ")
            if tag == "p" and not open_tags.get("p"):
                end_block()
            if open_tags.get(tag):
                if tag not in INLINE:
                    end_block()
                elif _blocked(top, tag):
                    continue
                while top.tag != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            elif tag == "br":
                texts.append(" ")
            continue
        if tag not in INLINE:
            end_block()
            ends, stop = ENDS.get(tag, ((), ()))
            if any(open_tags.get(x) for x in ends):
                e = top
                while e.up and e.tag not in ends and e.tag not in stop:
                    e = e.up
                if e.tag in ends:
                    while e.up and e.up.tag in ends and tag == "tr":
                        e = e.up
                    while top is not e.up:
                        pop()
        attrs = m[3]
        if tag in RAW:
            if not attrs.endswith("/") or tag in ("script", "style", "textarea", "title"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        classes, drop, factor, doubt = _evidence(tag, attrs, top.article)
        n += 1
        path = paths.setdefault((top.path, tag, classes, factor, doubt), len(paths) + 1)
        if attrs.endswith("/") and tag in ("svg", "math", "path"):
            continue
        top = Element(tag, top, path, top.drop or drop, top.link or tag == "a", n, top.article or tag in ("article", "main"),
                      top.doubt or (path if doubt else None), top.prior * factor, top.kind or tag in KINDS)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    end_block()
    share: dict[int, list[int]] = {}
    for b in out:
        if b.element.doubt:
            s = share.setdefault(b.element.doubt, [0, 0])
            s[0] += b.linked
            s[1] += len(b.text)
    for b in out:
        s = share.get(b.element.doubt)
        if s and s[0] > MAX_LINKED * s[1]:
            b.prior *= SUSPECT
    if out and all(b.prior < 1 for b in out):
        around = _around([b.element for b in out])
        if not around.kind:
            for b in out:
                b.prior /= around.prior
    return out


def _around(elements: list[Element]) -> Element:
    """The lowest element around all of ``elements``."""
    held: dict[Element, int] = {}
    for e in elements:
        held[e] = held.get(e, 0) + 1
    # Parents open before their children: from the last element on, each hands its count up once.
    seen: dict[Element, None] = {}
    for e in list(held):
        while e and e not in seen:
            seen[e] = None
            e = e.up
    for e in sorted(seen, key=lambda e: -e.at):
        if e.up:
            held[e.up] = held.get(e.up, 0) + held[e]
    return max((e for e, m in held.items() if m == len(elements)), key=lambda e: e.depth)


def _blocked(e: Element, tag: str) -> bool:
    """An inline end tag doesn't close block elements that were opened after it."""
    while e.tag != tag:
        if e.tag not in INLINE:
            return True
        e = e.up
    return False


def path_scores(blocks: list[Block], spread: float = 1.0) -> dict[int, float]:
    """Score of each path: smoothed text and punctuation ratios, fused with the path's share of the text and its prior."""
    stat: dict[int, list[float]] = {}
    prior = {b.element.path: b.prior for b in blocks}
    for b in blocks:
        s = stat.setdefault(b.element.path, [0, 0, 0, 0])
        for k, x in enumerate((1, len(b.text) - b.linked, len(_PUNCT.findall(b.text)), len(b.text))):
            s[k] += x
    order = list(stat)
    total = sum(s[3] * prior[p] for p, s in stat.items())
    weight = [math.exp(-k * k / (2 * spread * spread)) for k in range(3)]

    def smooth(x: list[float]) -> list[float]:
        near = [[(weight[abs(i - j)], x[j]) for j in range(max(0, i - 2), min(len(x), i + 3))] for i in range(len(x))]
        return [sum(w * v for w, v in ws) / sum(w for w, _ in ws) for ws in near]

    length = smooth([math.log1p(stat[p][1] / stat[p][0]) for p in order])
    punct = smooth([math.log1p(stat[p][2] / stat[p][0]) for p in order])
    # A path's own share of the text keeps a short path beside the article from living off its neighbours.
    return {p: prior[p] * a * (1 + b) * math.sqrt(min(1.0, max(stat[p][1], 0) / total)) for p, a, b in zip(order, length, punct)}


def content(blocks: list[Block], threshold: float = 0.5, max_linked: float = MAX_LINKED, weak: float = 0.25) -> list[Block]:
    """The blocks of the content element; see the module."""
    if all(b.prior < 1 for b in blocks):
        return []
    score = path_scores(blocks)
    mean, best = sum(score.values()) / len(score), max(score.values())
    deviation = math.sqrt(sum((x - mean) ** 2 for x in score.values()) / len(score))
    least = min(mean + threshold * deviation, best)
    plain = [b.linked <= max_linked * len(b.text) for b in blocks]
    chosen = [k for k, b in enumerate(blocks) if score[b.element.path] >= least]
    chosen = [k for k in chosen if plain[k]] or chosen
    box = _around([blocks[k].element for k in chosen])
    prior = max(blocks[k].prior for k in chosen)  # names around the content itself say nothing of its parts
    while box.tag in PARTS and box.up and box.up.tag:
        box = box.up
    around = box
    while around.up and around.tag not in ("article", "main"):
        around = around.up
    marked = around.tag in ("article", "main")
    if marked:
        box = around
    page = ("", "html", "body")
    room = box if box.tag in page else box.up
    place: dict[Element, tuple[bool, bool]] = {}

    def where(e: Element) -> tuple[bool, bool]:
        """(in the box, in the room around it)"""
        way = []
        while e not in place and e is not box and e is not room and e.up:
            way.append(e)
            e = e.up
        found = place.get(e, (e is box, e is box or e is room))
        place.update((x, found) for x in way)
        return found

    out = []
    for k, b in enumerate(blocks):
        inside, beside = where(b.element)
        s = score[b.element.path]
        if not beside or b.prior < prior and s < least:
            continue
        title = b.element.tag in HEADINGS and k < chosen[0]
        if inside and (marked or chosen[0] <= k <= chosen[-1]):
            out.append(b)
        elif marked:  # beside an article or main only headings are its own
            if title and b.element.up is room:
                out.append(b)
        elif title or plain[k] and (s >= weak * best or (box if inside else room).tag not in page):
            out.append(b)
    return out


def main_text(page: str | None) -> str:
    """The content blocks of a page, one a line."""
    return "\n".join(b.text for b in content(blocks_of(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row."""

    def run(batches):
        for b in batches:
            text = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cols.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
