"""Cutting a web page into blocks of text, each with the path of elements it stands in."""

from __future__ import annotations

import html
import re

RAW = "script|style|noscript|template|iframe|svg|math|title|textarea|object|canvas"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(?:svg|math)\b[^>]*/>|<({RAW})\b[^>]*+>.*?(?:</\1\b[^>]*+>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>""",
    re.S | re.I,
)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
LEAVES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"option", "button", "select"}

# Elements, and words of class, id and role names, that mark what is not the article.
SIDE_TAGS = frozenset("nav header footer aside button select dialog menu".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adbox banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer cookie cookies notice consent newsletter subscribe subscription signup popup modal overlay "
    "comment comments commentlist disqus replies share sharing social related recommended widget toolbar pagination pager search "
    "contentinfo complementary login disclaimer".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article main content post entry story articlebody maincontent".split())
BREAK = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

# WORDS is the side by class, id or role only, or a form; DOUBT is an article element in it, or one that names both.
SIDE, MAIN, PLAIN, WORDS, DOUBT = "-", "+", "", "~", "?"


def role_of(tag: str, attributes: str) -> tuple[str, str]:
    """What an element is for, and its name in a path: the tag and the words of its class, id and role."""
    words: list[str] = []
    whole = tag == "main"  # a class or id that says nothing but article
    hidden = False
    for m in NAMED.finditer(attributes) if attributes else ():
        value = (m[2] or "").strip("\"'")
        if m[1].lower() in ("hidden", "aria-hidden"):
            hidden |= value.lower() != "false"
        else:
            for name in value.split():
                parts = [w for w in BREAK.split(CAMEL.sub(" ", name).lower()) if w and not w.isdigit()]
                whole |= bool(parts) and MAIN_WORDS.issuperset(parts)
                words += parts
    name = ".".join([tag, *words[:4]])
    if hidden or tag in SIDE_TAGS:
        return SIDE, name
    if tag == "form":  # some pages are one form, so an article in it wins back
        return WORDS, name
    if tag not in ("html", "body") and not SIDE_WORDS.isdisjoint(words):
        return DOUBT if whole else WORDS, name
    if tag in MAIN_TAGS or tag in ("div", "section", "td") and not MAIN_WORDS.isdisjoint(words):
        return MAIN, name
    return PLAIN, name


def _inside(above: str, tag: str, own: str) -> str:
    """The role of an element of role ``own`` by itself that stands in one of role ``above``."""
    if SIDE in (above, own):
        return SIDE
    if above == WORDS:
        return DOUBT if tag in MAIN_TAGS and own != WORDS else WORDS
    if own == WORDS or above == PLAIN:
        return own
    return above


def blocks_of(page: str | None) -> list[tuple[str, str, str]]:
    """``(path, role, text)`` of every block with text, in page order.

    The role is ``-`` inside anything that is not the article, ``~`` inside what only a class, id or role says so of,
    ``+`` inside an article element, ``?`` inside an article element within the former, else empty.
    Character references are decoded, white space becomes one space. Paragraphs, list items and table cells
    close where the next one opens, and an end tag closes what is open inside it, so pages with missing end tags are read too.
    """
    page = page or ""
    stack: list[tuple[str, str, str]] = [("", PLAIN, "")]  # tag, role, path
    held: list[str] = []
    out: list[tuple[str, str, str]] = []

    def flush():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((stack[-1][2], stack[-1][1], text))
            held.clear()

    def shut(tags):
        """Close open leaf elements up to the next container."""
        while len(stack) > 1 and stack[-1][0] in tags:
            stack.pop()

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if tag == "br":
            held.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if m[2] or m[5]:  # an end tag
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag == "hr":
            continue
        shut(LEAVES.get(tag, {"p"} if tag in CLOSES_P else ()))
        role, name = role_of(tag, m[4] or m[7] or "")
        _, above, path = stack[-1]
        role = _inside(above, tag, role)
        stack.append((tag, role, f"{path}>{name}" if path else name))
    held.append(page[at:])
    flush()
    return out
