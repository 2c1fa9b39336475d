"""Main text of a page by two passes of block rules.

The page is cut into blocks (paragraphs, headings, list items, cells, runs between block tags).
Regions that are never part of an article are skipped by tag, role or class name: menus, page
headers and footers, sidebars, notices, adverts, forms, scripts, styles, reader comments. Pass one
classifies each remaining block by link density, length and stop-word density as good, bad, near
good or short; blocks inside an ``article`` or ``main`` element are judged leniently, since the
author marked them. Stop words are known of four languages: a page that hardly holds any, and a block that is not
written in Latin letters, is classified by length and link density alone. Pass two gives ambiguous short blocks the label of the nearest decided neighbours
(good when both sides are good, or when the nearer side is).

Null and empty pages give an empty text. Text between a stray ``<`` and the next tag stays text. A region
whose end tag is missing ends with what surrounds it, or where an article begins. A short block as near to a good
neighbour as to a bad one goes with the one before it. Repeated pages are independent. The scan is linear in the page.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from attesta.llm.common import small_batches

MAX_LINK_DENSITY = 0.35
SHORT, LONG = 60, 180
STOP_LOW, STOP_HIGH = 0.12, 0.24

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two him see time could no make than been its who now people my made over did down only way find use may "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont ou avec son aux d l cette ont ses mais comme on tout nous sa fait été aussi leur bien peut ces y deux elle "
    "el que y a los se del las por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante".split()
)
_MARK = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[A-Za-z])")
_STOP = re.compile(r"[>\"']")
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"\w+")
_LATIN = re.compile(r"[A-Za-z\u00C0-\u024F\u1E00-\u1EFF]")
_FOREIGN = re.compile(r"[^\W\d_A-Za-z\u00AA\u00BA\u00C0-\u024F\u1E00-\u1EFF]")
#: Chinese, Japanese and Korean signs: one says about as much as three Latin letters.
_DENSE = re.compile(r"[\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF\U00020000-\U0003FFFF]")
_SPACE = re.compile(r"\s+")
_RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "select", "option"}
#: Elements whose content is text up to their end tag, whatever it holds.
_VERBATIM = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe")}
_SKIP = {"nav", "footer", "aside", "form", "head", "button", "menu", "dialog", "annotation", "annotation-xml"} | _RAW
_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "object", "param", "canvas"} | set(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd semantics maction".split()
)
_JUNK = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|foot|masthead|topbar|site-header|page-header|header|social|share|sharing|related|recommend\w*|comments?|comment-list|replies|disqus|respond|pagination|pager|tags|widget|login|signup|search|skip|copyright)(?:$|[\s_-])"
)
#: A header of the article itself, by class.
_OWN_HEADER = re.compile(r"(?:entry|post|article|story|content)[_-]+header", re.I)
#: Identifiers are often slugs of the text, so only a whole one counts, with the additions usual in page layouts.
_JUNK_ID = re.compile(
    r"(?i)(?:(?:site|page|main|top|bottom|left|right|global|primary|secondary|mobile|cookie|blog|wp)[_-]?)*(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|header|social|share|sharing|related|comments?|replies|disqus|respond|pagination|pager|tags|widget|login|signup|search)(?:[_-]?(?:bar|area|list|wrapper|wrap|container|inner|box|links|thread|form|menu|nav|posts|[0-9]+))*"
)
#: Class names, in full, that are no part even inside an article.
_JUNK_INSIDE = frozenset(
    "ad ads advert advertisement advertising adsbygoogle adsense ad-slot ad-container ad-banner banner-ad sponsored promo cookie-notice cookie-banner newsletter newsletter-signup subscribe sidebar nav navbar navigation breadcrumb breadcrumbs share share-buttons sharing social-share social-links related-posts related-articles comments comments-area comment-list disqus respond pagination pager".split()
)
#: Elements that end with what surrounds them where their end tag is missing, and those in which a beginning article shows that it is.
_REGIONS = {"nav", "header", "footer", "aside", "form", "menu", "div", "section", "dialog"}
_WITHOUT_ARTICLE = {"nav", "header", "form", "menu", "head"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose end tag may be left out: the start tags that end them, and the containers inside which those do not.
_CELL = ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"})
_TERM = ({"dt", "dd"}, {"dl"})
_IMPLIED = {
    "p": (
        _HEADINGS | _CELL[0] | _TERM[0] | {"address", "article", "aside", "blockquote", "center", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"},
        set(),
    ),
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": _TERM, "dd": _TERM, "td": _CELL, "th": _CELL, "tr": ({"tr", "tbody", "thead", "tfoot"}, {"table"}), "option": ({"option", "optgroup"}, set()),
}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}


class _Block:
    __slots__ = ("heading", "linked", "main", "parts", "tag")

    def __init__(self, tag: str, main: bool) -> None:
        self.tag, self.main, self.heading, self.parts, self.linked = tag, main, tag in _HEADINGS, [], 0


def _junk_class(token: str, name: str, in_article: bool) -> bool:
    if in_article:
        return name not in _HEADINGS and token.lower() in _JUNK_INSIDE
    return bool(_JUNK.search(token)) and not _OWN_HEADER.fullmatch(token) and not (name in _HEADINGS and token.lower() == "header")


def _junk(name: str, tag: str, in_article: bool) -> bool:
    if name in _SKIP or (name == "header" and not in_article):
        return True
    if name in {"html", "body", "article", "main"} or name in _INLINE or "=" not in tag and "hidden" not in tag:
        return False
    found = [(key.lower(), next((v for v in values if v), "")) for key, *values in _ATTR.findall(tag)]
    classes = [c for key, value in found if key == "class" for c in value.split()]
    for key, value in found:
        if key == "class" and any(_junk_class(c, name, in_article) for c in classes):
            return True
        if key == "id" and name not in _HEADINGS and not (in_article and (name == "section" or "section" in classes)) and _JUNK_ID.fullmatch(value):
            return True
        if key == "role" and value.lower() in _ROLES and not (in_article and value.lower() == "alert") or key == "hidden" and not value or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _ends(skip: str, inside: dict[str, int], around: dict[str, int], name: str, closing: bool) -> bool:
    """Whether a tag ends the skipped element without being its end tag: the next sibling's start, the end of what surrounds it, or an article in what cannot hold one.

    ``inside``, ``around``: open elements in the skipped one and around it.
    """
    if closing:
        outer = name in {"article", "main"} or around.get(name, 0) > 0 and (skip in _REGIONS or skip in _IMPLIED)
        return name != skip and inside.get(name, 0) <= 0 and name not in {"p", "html", "body"} and name not in _INLINE and name not in _VOID and (outer or skip in _IMPLIED)
    if skip in _WITHOUT_ARTICLE and name in {"article", "main"} and not around.get("article", 0) or skip == "head" and name == "body":
        return True
    return skip in _IMPLIED and name in _IMPLIED[skip][0] and not any(inside.get(c, 0) > 0 for c in _IMPLIED[skip][1])


def _next_mark(page: str, pos: int, last: dict[str, int]) -> tuple[int, int] | None:
    """Bounds of the next tag, comment or declaration. ``last``: the last place of each sign that can end one, so that none is sought in vain.

    A quote that never closes does not count as one; a tag without an end is text.
    """
    while m := _MARK.search(page, pos):
        at, kind = m.start(), m[0]
        if kind in {"<!--", "<![CDATA["}:
            end = page.find("-->" if kind == "<!--" else "]]>", m.end())
            return at, end + 3 if end >= 0 else len(page)
        if last[">"] < at:
            return None
        pos = m.end()
        if kind not in {"<!", "<?"}:
            while (s := _STOP.search(page, pos)) and s[0] != ">" and last[s[0]] > s.start():
                pos = page.index(s[0], s.end()) + 1
            if s and s[0] == ">":
                return at, s.end()
        return at, page.index(">", m.end()) + 1
    return None


def blocks(page: str, forms: bool = False) -> list[tuple[str, bool, bool, float]]:
    """(text, in article, heading, link density) of each block outside skipped regions, in page order; with ``forms``, what stands in forms counts too."""
    out, cur, pos = [], _Block("", False), 0
    skip, depth, main, links, inside, around = "", 0, 0, 0, {}, {}
    last = {c: page.rfind(c) for c in ">\"'"}

    def close(tag: str) -> None:
        nonlocal cur
        text = _SPACE.sub(" ", _html.unescape("".join(cur.parts))).strip()
        if text:
            out.append((text, cur.main, cur.heading, min(1.0, cur.linked / max(1, len(text)))))
        cur = _Block(tag, main > 0)

    def add(text: str) -> None:
        if skip or not text:
            return
        cur.parts.append(text)
        if links:
            cur.linked += len(text.strip())

    while m := _next_mark(page, pos, last):
        tag = page[m[0] : m[1]]
        add(page[pos : m[0]])
        pos = m[1]
        name_m = _NAME.match(tag)
        if not name_m:
            continue
        name, closing = name_m[1].lower(), tag[1] == "/"
        void = name in _VOID or tag.endswith("/>")
        if name in _VERBATIM and not closing and not void:
            if not skip and name in {"title", "textarea", "iframe"}:
                close("")
            end = _VERBATIM[name].search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if skip and _ends(skip, inside, around, name, closing):
            skip = ""
        if skip:
            if name not in _INLINE and not void:
                inside[name] = inside.get(name, 0) + (-1 if closing else 1)
            if name == skip and not void:
                depth += -1 if closing else 1
                if depth == 0:
                    skip = ""
            continue
        if not closing and not void and not (forms and name == "form") and _junk(name, tag, main > 0):
            if name != "template":
                close("")
            skip, depth, inside = name, 1, {}
            continue
        if name not in _INLINE and not void:
            around[name] = max(0, around.get(name, 0) + (-1 if closing else 1))
        if name == "a":
            links = max(0, links - 1) if closing else links + 1
        if name == "br":
            cur.parts.append(" ")
        elif name not in _INLINE:
            if name in {"article", "main"}:
                close(name)
                main = max(0, main - 1) if closing else main + 1
                cur.main = main > 0
            else:
                close("" if closing else name)
            if name in {"p", "div", "li", "td"}:
                links = 0
    add(page[pos:])
    close("")
    return out


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


def _stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _foreign(text: str) -> bool:
    """Mostly letters of another script than Latin."""
    return not text.isascii() and len(_FOREIGN.findall(text)) > len(_LATIN.findall(text))


def _label(text: str, main: bool, heading: bool, link: float, stop: float, known: bool) -> str:
    if link > MAX_LINK_DENSITY:
        return "short" if main else "bad"
    if "©" in text[:3] or re.match(r"(?i)copyright\b", text):
        return "bad" if not main else "short"
    size = _size(text)
    if main:
        return "good" if size >= SHORT or stop >= STOP_LOW or heading else "short"
    if size < SHORT:
        return "short"
    if stop >= STOP_HIGH or not known or _foreign(text):
        return "good" if size > LONG else "near"
    return "near" if stop >= STOP_LOW or size > LONG else "bad"


def _known_language(found: list[tuple[str, bool, bool, float]], stops: list[float]) -> bool:
    """Whether most of the running text outside links holds stop words."""
    sizes = [(_size(b[0]), x) for b, x in zip(found, stops, strict=True) if b[3] <= MAX_LINK_DENSITY]
    return 2 * sum(n for n, x in sizes if n >= SHORT and x >= STOP_LOW) >= sum(n for n, _ in sizes if n >= SHORT)


def extract(page: str | None) -> str:
    """The main text: kept blocks joined by one line feed. Where a form seems to hold all there is, it is read as part of the page."""
    if not page:
        return ""
    return _kept(blocks(page)) or (_kept(blocks(page, True)) if "<form" in page.lower() else "")


def _kept(found: list[tuple[str, bool, bool, float]]) -> str:
    if any(b[1] for b in found):
        found = [b for b in found if b[1]]  # the author marked the article; what stands outside is not part of it
    stops = [_stop_density(b[0]) for b in found]
    known = _known_language(found, stops)
    labels = [_label(*b, x, known) for b, x in zip(found, stops, strict=True)]
    decided = [(i, x) for i, x in enumerate(labels) if x in {"good", "bad"}]
    if not any(x == "good" for _, x in decided):
        labels = ["good" if x in {"near", "short"} and (b[1] or _size(b[0]) >= SHORT) else x for x, b in zip(labels, found, strict=True)]
        decided = [(i, x) for i, x in enumerate(labels) if x in {"good", "bad"}]
    final, k = list(labels), 0
    for i, x in enumerate(labels):
        if x in {"good", "bad"}:
            continue
        while k < len(decided) and decided[k][0] < i:
            k += 1
        before, after = (decided[k - 1] if k else None), (decided[k] if k < len(decided) else None)
        if before and after and before[1] == after[1]:
            final[i] = before[1]
        elif before and after:
            gap_b, gap_a = i - before[0], after[0] - i
            final[i] = "good" if x == "near" or found[i][1] else (before[1] if gap_b <= gap_a else after[1])
        else:
            near = before or after
            final[i] = near[1] if near else ("good" if found[i][1] else "bad")
    return "\n".join(b[0] for b, x in zip(found, final, strict=True) if x == "good")


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page; no shuffle."""
    small_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "cast(html as string) html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
