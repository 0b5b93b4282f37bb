"""HTML pages as blocks of text and as sequences of tokens.

A token is a start tag, an end tag or a block of text.  A tag is told apart by its path: the names, classes and ids of all
elements that it stands in, without the numbers that ids and classes may hold for a page.  Only elements that make blocks are in paths; inline ones are part of their text.
End tags that HTML lets out are put in.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import xxhash

# Kinds of elements (fixed values, from the HTML standard).
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
SPACE = set("br img wbr hr input".split())
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: An open element of these ends where one of those starts, up to an element that holds them.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# What is not main text: elements, roles, and words of classes and ids (fixed values).
LEFT_OUT = set("head nav header footer aside form dialog menu noscript template svg math select button object audio video canvas applet datalist".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
LABELS = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar "
    "aside widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login search form comment comments respond replies disqus "
    "related recommended share sharing social toolbar pagination pager copyright legal disclaimer skip".split()
)
#: What a word of a label may end in, wherever the word stands in it; the others count at its beginning or end.
ENDINGS = tuple("comment comments sidebar footer navbar topnav sidenav menu banner breadcrumb breadcrumbs advert advertisement sponsored cookie cookies newsletter popup modal disqus".split())
#: Words of labels that say how a page is laid out, not what an element is.
NEGATED = set("has no not with without is hide show open closed enabled disabled allowed on off".split())
#: Elements that may hold a whole article; others are parts of one.
HOLDERS = set("body div section article main center table tbody tr td span html".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_DIGITS, _LONG = re.compile(r"\d+"), re.compile(r"\d{3,}")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
END = 0x5DEECE66D


def number(*parts: bytes) -> int:
    """A signed 64-bit number of these bytes."""
    h = xxhash.xxh3_64_intdigest(b"\0".join(parts))
    return h - (1 << 64) if h >> 63 else h


@lru_cache(1 << 14)
def described(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """An element's name in paths, whether its text is left out, and whether it is marked as main."""
    found = {(m[1] or m[5]).lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    classes, own = sorted(set(found.get("class", "").split())), found.get("id", "")
    role = found.get("role", "").strip().lower()
    out = tag in LEFT_OUT or role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    out = out or "display:none" in found.get("style", "").replace(" ", "").lower()
    if not out and tag not in ("html", "body", "article", "main"):
        for label in (*classes, own):
            words = [w.lower() for w in _WORDS.findall(label)]
            if words and not NEGATED & set(words):
                out = out or words[0] in LABELS or words[-1] in LABELS or any(w.endswith(ENDINGS) for w in words)
    elif not out and tag == "article":
        out = any(set(w.lower() for w in _WORDS.findall(label)) & {"comment", "comments", "ad", "advert", "promo"} for label in classes)
    name = tag + "".join("." + _LONG.sub("", c) for c in classes) + ("#" + _DIGITS.sub("", own) if own else "")
    return name, out, tag == "main" or role == "main"


@dataclass(slots=True)
class Element:
    tag: str
    path: int
    #: Its text is left out: by a name around it, and by its own.
    out: bool
    own: bool
    #: Depth of the outermost article and main that it stands in; 0: none.
    article: int
    main: int
    #: Paths of the elements from the top down to this one that may hold an article.
    holders: tuple[int, ...]


@dataclass(slots=True)
class Text:
    text: str
    token: int
    at: Element


@dataclass(slots=True)
class Page:
    tokens: list[int] = field(default_factory=list)
    texts: list[Text] = field(default_factory=list)


def parse(html: str) -> Page:
    """The tokens and texts of a page, in page order.  Time is in proportion to its length but for quotes that never end."""
    page, buf = Page(), []
    stack = [Element("", 0, False, False, 0, 0, ())]
    tokens, texts = page.tokens, page.texts

    def flush() -> None:
        if buf:
            text = " ".join(unescape("".join(buf)).split())
            buf.clear()
            if text:
                top = stack[-1]
                token = number(top.path.to_bytes(8, "little", signed=True), text.encode("utf-8", "surrogatepass"))
                tokens.append(token)
                texts.append(Text(text, token, top))

    def close(depth: int) -> None:
        while len(stack) > depth:
            tokens.append(stack.pop().path ^ END)

    def open_(tag: str, attributes: str) -> None:
        name, out, main = described(tag, attributes)
        top, depth = stack[-1], len(stack)
        path = number(top.path.to_bytes(8, "little", signed=True), name.encode("utf-8", "surrogatepass"))
        left = top.out
        if left and not out and (tag == "article" or main) and all(e.tag == "form" or not e.own for e in stack):
            left = False  # a form around the whole page
        if left and tag in HEADINGS and top.tag == "header" and top.article and not stack[-2].out:
            left = False  # the headings of an article's own header
        article = top.article or (depth if tag == "article" else 0)
        holders = (*top.holders, path) if tag in HOLDERS else top.holders
        stack.append(Element(tag, path, left or out, out, article, top.main or (depth if main else 0), holders))
        tokens.append(path)

    at, size, spans = 0, len(html), 0  # spans: open ones inside one whose text is left out
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        if lt > at and not spans:
            buf.append(html[at:lt])
        if lt == size:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        m = _TAG.match(html, lt) or _PLAIN_TAG.match(html, lt)
        if m is None:
            if html[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                buf.append("<")
                at = lt + 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        inline = tag in INLINE
        if tag in SPACE:
            buf.append(" ")
            if inline:
                continue
        if inline:
            if tag == "span":
                if closing:
                    spans = max(0, spans - 1)
                elif spans or described(tag, attributes)[1]:
                    spans += 1
            continue
        spans = 0
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            flush()
            if depth:
                close(depth)
            continue
        if tag in RAW:
            flush()
            end = _raw_end(tag).search(html, at)
            at = end.end() if end else size
            continue
        flush()
        if tag in VOID:
            continue
        if tag in ("html", "body") and any(e.tag == tag for e in stack):
            continue
        if stack[-1].tag == "head" and tag not in ("noscript", "template", "link", "meta", "base"):
            close(len(stack) - 1)
        if tag in CLOSES_P:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ("p", "table", "td", "th", "button", "object")), 0)
            if depth and stack[depth].tag == "p":
                close(depth)
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                close(len(stack) - 1)
        if tag in ENDED_BY:
            ended, until = ENDED_BY[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in until:
                    break
                if stack[i].tag in ended:
                    close(i)
                    break
        open_(tag, attributes)
    flush()
    close(1)
    return page


@lru_cache(32)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)


def candidates(page: Page) -> list[Text]:
    """Texts that may be of the article, by the names of the elements around them: if a page marks its article or main part,
    only that."""
    left = [t for t in page.texts if not t.at.out]
    in_article = [t for t in left if t.at.article]
    in_main = [t for t in left if t.at.main]
    sizes = [sum(len(t.text) for t in some) for some in (in_article, in_main)]
    if sizes[0] and 2 * sizes[0] >= sizes[1]:
        return in_article
    return in_main if sizes[1] else left


def holder(volumes: dict[int, tuple[int, int]], percent: int) -> int:
    """The deepest path that holds ``percent`` of all text; volumes: path -> (depth, chars), all text at path 0."""
    whole = volumes.get(0, (0, 0))[1]
    fit = [(depth, chars, path) for path, (depth, chars) in volumes.items() if path and 100 * chars >= percent * whole]
    return max(fit)[2] if fit else 0


def volumes(texts: list[Text]) -> dict[int, tuple[int, int]]:
    out: dict[int, tuple[int, int]] = {}
    for t in texts:
        for depth, path in enumerate((0, *t.at.holders)):
            out[path] = depth, out.get(path, (0, 0))[1] + len(t.text)
    return out
