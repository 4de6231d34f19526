"""Main text of web pages by tree scoring.

Markup is read into a light tree that closes what pages leave open. Elements that are never article text (menus,
scripts, forms, notices, adverts, comments ...) are left out by name, role or class. Every remaining paragraph, which
is a block with text of its own, scores for its length and commas; the points go to its ancestors, halved for the
second and thinner above, and each container's sum is discounted by its share of link text. The best container is
kept, widened to the article element around it if there is one, with those siblings that score like it or read like
prose.

A null or empty page has an empty text. Pages are read whole, however long or deep; nothing that is kept is cut. Ties go
to the outermost, first container. Repeated rows have equal results, one each; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

#: A paragraph of fewer characters scores nothing (but stays in its container).
LEAST_CHARS = 25
LEVELS = 5
SIBLING_SHARE = 0.2

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes svg math".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
_NEVER = frozenset("head script style title noscript template iframe xmp noembed noframes svg math nav aside footer form button select textarea dialog menu object applet audio video canvas datalist fieldset input".split())
_WHOLE = frozenset("html body main article".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
_AWAY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|adbox|adsense|banner\w*|promo\w*|sponsor\w*|cookie\w*|consent|gdpr|notices?|alerts?|newsletter|subscri\w+|popup|modal|overlay|"
    r"side-?bar|side-?nav|sidemenu|nav|navbar|navigation|menus?|breadcrumbs?|footer|foot|masthead|site-header|page-header|topbar|comments?|commentlist|disqus|repl(?:y|ies)|respond|discussion|"
    r"shar(?:e|ing)|social|related|recommend\w*|widgets?|toolbar|pagination|pager|skip-?link|login|sign-?up|search|hidden|sr-only|visually-hidden)(?:$|[\s_-])",
    re.I,
)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|head|top)(?:$|[\s_-])", re.I)
_BASE_POINTS = {"article": 10, "main": 5, "section": 3, "div": 3, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "dd": -3, "dt": -3, "address": -3, "form": -3, "th": -5} | dict.fromkeys(_HEADINGS, -5)


class Tree:
    """Elements in page order: tag, parent, whether they are left out; and the page's pieces of text and block borders."""

    def __init__(self, page: str):
        self.tag, self.parent, self.away, self.by_class = ["#root"], [-1], [False], [False]
        self.within = [False]  # in an article
        self.pieces: list[tuple[int, str | None]] = []  # None: a block begins or ends here
        self._read(page)

    def _open(self, tag: str, attributes: str, stack: list[int]) -> int:
        up = stack[-1]
        away = tag in _NEVER
        named = False
        if attributes and not away:
            found = {}
            for m in _ATTR.finditer(attributes):
                found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
            if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
                away = True
            names = f"{found.get('class', '')} {found.get('id', '')}"
            inside = self.within[up]
            if tag not in ("html", "body") and (found.get("role", "").lower() in _ROLES or _AWAY.search(names) or (_HEADER.search(names) and not inside and tag not in _WHOLE)):
                named = True
        if tag == "header" and not self.within[up]:
            named = True
        self.tag.append(tag)
        self.parent.append(up)
        self.away.append(away)
        self.by_class.append(named)
        self.within.append(self.within[up] or tag in ("article", "main"))
        return len(self.tag) - 1

    def _read(self, page: str) -> None:
        stack, at, pieces = [0], 0, self.pieces
        while at < len(page):
            m = _TAG.search(page, at)
            text = page[at : m.start() if m else len(page)]
            if text:
                pieces.append((stack[-1], html.unescape(text) if "&" in text else text))
            if not m:
                break
            at = m.end()
            if m[0].startswith("<![CDATA["):
                pieces.append((stack[-1], m[0][9:].removesuffix("]]>")))
                continue
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            tag = name.lower()
            block = tag not in _INLINE
            if block:
                pieces.append((stack[-1], None))
            if closing:
                self._close(tag, stack)
            elif tag in _RAW:
                self._open(tag, "", stack)
                if not attributes.rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                    at = end.end() if end else len(page)
            else:
                self._implied(tag, stack)
                node = self._open(tag, attributes, stack)
                if tag not in _VOID and not (attributes.rstrip().endswith("/") and tag not in _CLOSES_P):
                    stack.append(node)
            if block:
                pieces.append((stack[-1], None))

    def _implied(self, tag: str, stack: list[int]) -> None:
        """Elements that a start tag closes."""
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                open_tag = self.tag[stack[k]]
                if open_tag == "p":
                    del stack[k:]
                    break
                if open_tag not in _INLINE:
                    break
        elif tag in _CLOSES:
            ends, scope = _CLOSES[tag], _SCOPE[tag]
            cut = None
            for k in range(len(stack) - 1, 0, -1):
                open_tag = self.tag[stack[k]]
                if open_tag in scope:
                    break
                if open_tag in ends:
                    cut = k
            if cut:
                del stack[cut:]

    def _close(self, tag: str, stack: list[int]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            open_tag = self.tag[stack[k]]
            if open_tag == tag:
                del stack[k:]
                return
            if tag in _INLINE and open_tag not in _INLINE or tag == "p" and open_tag in ("article", "body", "div", "section", "td", "li", "main") or open_tag in ("table", "td") and tag not in ("table", "tr", "tbody", "thead", "body", "html", "article", "main"):
                return  # a stray end tag


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = Tree(page)
    return _best_text(tree, True) or _best_text(tree, False)


def _best_text(t: Tree, strict: bool) -> str:
    """strict: classes throw out even the only article, as where readers' comments are articles."""
    n, tag, parent = len(t.tag), t.tag, t.parent
    # a class does not throw out what holds every article that has no such class itself
    holds = [x in ("article", "main") for x in tag]
    clean = [h and not c for h, c in zip(holds, t.by_class, strict=True)]
    clean = clean if strict or any(clean) else holds
    held = list(map(int, clean))
    for i in range(n - 1, 0, -1):
        held[parent[i]] += held[i]
    away, block, linked, inside = [False] * n, [0] * n, [False] * n, [-1] * n
    for i in range(1, n):
        up = parent[i]
        away[i] = away[up] or t.away[i] or (t.by_class[i] and not 0 < held[i] == held[0])
        block[i] = block[up] if tag[i] in _INLINE else i
        linked[i] = linked[up] or tag[i] == "a"
        inside[i] = i if holds[i] and inside[up] < 0 else inside[up]
    own: dict[int, list[str]] = {}
    chars, links = [0] * n, [0] * n
    for i, text in t.pieces:
        if text and not away[i]:
            own.setdefault(block[i], []).append(text)
            size = len(text) - text.count(" ")
            chars[i] += size
            links[i] += size * linked[i]
    for i in range(n - 1, 0, -1):
        chars[parent[i]] += chars[i]
        links[parent[i]] += links[i]
    score: dict[int, float] = {}
    for i, texts in own.items():
        text = " ".join("".join(texts).split())
        if len(text) < LEAST_CHARS:
            continue
        points = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) // 100, 3)
        at = parent[i] if tag[i] not in ("article", "main", "body", "div", "section", "td", "#root") else i
        for level in range(LEVELS):
            if at < 0:
                break
            if at not in score:
                score[at] = _BASE_POINTS.get(tag[at], 0)
            score[at] += points / (1, 2, 6, 9, 12)[level]
            at = parent[at]
    density = lambda i: links[i] / chars[i] if chars[i] else 0.0
    final = {i: s * (1 - density(i)) for i, s in score.items()}
    if final:
        best = min(final, key=lambda i: (-final[i], i))
        best = inside[best] if inside[best] > 0 else best
    else:
        best = next((i for i in range(n) if holds[i] and not away[i] and chars[i]), next((i for i in range(n) if tag[i] == "body"), 0))
    roots = {best}
    if tag[best] not in ("#root", "html", "body"):
        least = max(10.0, SIBLING_SHARE * final.get(best, 0.0))
        for i in range(1, n):
            if parent[i] == parent[best] and i != best and not away[i] and chars[i]:
                text = " ".join("".join(own.get(i, ())).split())
                prose = tag[i] == "p" and (len(text) > 80 and density(i) < 0.25 or 0 < len(text) <= 80 and not links[i] and text[-1] in ".!?…。")
                if final.get(i, 0.0) >= least or prose or tag[i] == "h1" and not links[i]:
                    roots.add(i)
    kept = [i in roots for i in range(n)]
    for i in range(1, n):
        kept[i] = (kept[i] or kept[parent[i]]) and not away[i]
    return " ".join("".join([" " if text is None else text for i, text in t.pieces if kept[i] or text is None]).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row."""

    def one(page: str | None) -> tuple[str, int]:
        text = main_text(page)
        return text, len(text)

    return map_texts(pages, ["html"], lambda: one, "text string, n_chars long", ["page_id", "url"])


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
