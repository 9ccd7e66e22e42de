"""Web pages as elements and text blocks (for operator 11).

A forgiving reader of HTML: comments, raw-text elements (scripts, styles), quoted
attributes, missing and stray end tags, paragraphs, list items, table cells and
headings that end where the next one starts. A block is the text between two
starts or ends of elements that are not inline; white space in it (also from
line-break elements) becomes one space, character references are decoded. Reading is
one pass, linear in the page.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections import Counter
from dataclasses import dataclass, field

# ---- fixed values: element kinds of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr input".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("html table td th caption template object button marquee applet".split())
# an element on the left ends those on the right, up to the boundary
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
        "option": ({"option"}, {"select", "datalist"}), "td": ({"td", "th"}, {"table", "tr"}),
        "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
        "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
        "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"})}

# ---- fixed values: what is never main text, by element, role, or words of class and id
NEVER = frozenset(
    "head script style template noscript svg canvas iframe object audio video nav footer aside menu button select "
    "textarea datalist dialog title xmp noembed noframes search".split())
LAYOUT_ELEMENTS = frozenset(["header", "form"])
NEVER_ROLES = frozenset("navigation contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
NEVER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adcontainer sponsor "
    "sponsored sponsors promo promos promotion comment comments commentlist disqus respond reply replies cookie cookies "
    "consent gdpr notice notices notification notifications alert popup modal overlay lightbox newsletter subscribe "
    "share sharing sharebar social related recommended recommendations".split())
LAYOUT_WORDS = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs sidebar rail aside footer header masthead topbar "
    "banner widget widgets pagination pager toolbar searchform searchbox login signup form disclaimer skip".split())
CONTENT_CLASSES = frozenset(
    "content main article post entry story main-content article-body article-content post-body post-content entry-content "
    "story-body body-content page-content".split())
CONTENT_WORDS = frozenset("article content post entry story main body text blog".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
WORD = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
MODIFIER = re.compile(r"(?:^|[-_])(?:has|with|no|without|is)[-_]")

KEEP, LAYOUT, GONE = 0, 1, 2          # main text; left out by its place in the layout; left out always
PATH_CHARS = 600                       # a longer path goes on from its digest


def general_class(name: str) -> str:
    """A class as it reads on other pages: digits become 0, names made of several numbers ``*``."""
    low = name.lower()
    numbers = re.findall(r"[0-9]+", low)
    if len(numbers) > 1 or (numbers and len(numbers[0]) > 5):
        return "*"
    return re.sub(r"[0-9]+", "0", low)


@functools.lru_cache(maxsize=8192)
def describe(tag: str, attrs: str) -> tuple[str, int, float]:
    """``(step of the path, level, weight as a container)`` of a start tag."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    classes = found.get("class", "").split()
    step = ".".join([tag, *sorted({general_class(c) for c in classes})])
    level = GONE if tag in NEVER else LAYOUT if tag in LAYOUT_ELEMENTS else KEEP
    role = found.get("role", "").strip().lower()
    if role in NEVER_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(
            r"display\s*:\s*none", found.get("style", "").lower()):
        level = GONE if tag not in ("html", "body") else level
    elif role in ("banner", "form"):
        level = max(level, LAYOUT)
    plain = {c.lower() for c in classes}
    words: set[str] = set()
    for name in [*classes, found.get("id", "")]:
        if MODIFIER.search(name.lower()):
            continue
        some = WORD.findall(CAMEL.sub("-", name).lower())
        words |= set(some) | {a + b for a, b in zip(some, some[1:])}
    if tag not in ("html", "body", "main"):
        sure = plain | {found.get("id", "").lower()}
        if plain & CONTENT_CLASSES:
            words &= sure                        # "content sidebar-right" is content; "content ad" is an advert
        if words & NEVER_WORDS:
            level = GONE
        elif words & LAYOUT_WORDS and tag != "article":
            level = max(level, LAYOUT)
    weight = 1.0
    if tag == "article" or "articlebody" in found.get("itemprop", "").lower():
        weight = 1.5
    elif tag == "main" or role == "main":
        weight = 1.3
    elif tag in ("html", "body"):
        weight = 0.7
    elif words & CONTENT_WORDS:
        weight = 1.25
    return step, level, weight


@dataclass
class Page:
    """Elements in page order (parents first) and the blocks they directly hold."""
    tag: list[str] = field(default_factory=lambda: ["#page"])
    parent: list[int] = field(default_factory=lambda: [-1])
    path: list[str] = field(default_factory=lambda: [""])
    weight: list[float] = field(default_factory=lambda: [0.0])
    holder: list[int] = field(default_factory=list)      # of each block
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)      # characters inside links
    links: list[int] = field(default_factory=list)
    level: list[int] = field(default_factory=list)


def read_page(source: str) -> Page:
    page = Page()
    # the open elements: (element, tag, inline, level); a header keeps its headings where it heads an article
    stack: list[tuple[int, str, bool, int]] = [(0, "#page", False, KEEP)]
    pieces: list[str] = []
    state = {"linked": 0, "links": 0, "open_links": 0}
    open_tags: Counter[str] = Counter()         # a tag that is not open is not looked for, however deep the page

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                for place in range(len(stack) - 1, -1, -1):
                    if not stack[place][2]:
                        break
                page.holder.append(stack[place][0])
                page.text.append(text)
                page.linked.append(min(state["linked"], len(text)))
                page.links.append(state["links"])
                page.level.append(stack[place][3])
            pieces.clear()
        state["linked"], state["links"] = 0, 0

    def add(text: str) -> None:
        if stack[-1][3] == GONE:
            return
        if "&" in text:
            text = html.unescape(text)
        pieces.append(text)
        if state["open_links"]:
            state["linked"] += len(text)

    def cut(to: int) -> None:
        if any(not x[2] for x in stack[to:]):
            flush()
        for x in stack[to:]:
            open_tags[x[1]] -= 1
        state["open_links"] = open_tags["a"]
        del stack[to:]

    def start(tag: str, attrs: str) -> None:
        if tag in CLOSES_P and open_tags["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][1] == "p":
                    cut(i)
                    break
                if stack[i][1] in SCOPE:
                    break
        if tag in ENDS:
            ended, boundary = ENDS[tag]
            last = 0
            for i in range(len(stack) - 1, 0, -1) if any(open_tags[t] for t in ended) else ():
                if stack[i][1] in boundary:
                    break
                if stack[i][1] in ended:
                    last = i
                    if tag not in ("tr", "tbody", "thead", "tfoot"):
                        break
            if last:
                cut(last)
        if tag in HEADINGS and stack[-1][1] in HEADINGS:
            cut(len(stack) - 1)
        if tag == "a" and state["open_links"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][1] == "a":
                    cut(i)
                    break
                if not stack[i][2]:
                    break
        inline = tag in INLINE
        if tag in VOID:
            if tag == "br":
                add(" ")
            elif not inline:
                flush()
            return
        parent, _, _, level = stack[-1]
        if inline and not attrs:
            own, step, weight = KEEP, tag, 0.0
        else:
            step, own, weight = describe(tag, attrs if "class" in attrs.lower() or not inline else "")
        if not inline:
            flush()
            if level == LAYOUT and tag in HEADINGS and heads_article(stack):
                level = KEEP
            number = len(page.tag)
            above = page.path[parent]
            if len(above) > PATH_CHARS:
                above = hashlib.sha1(above.encode("utf-8", "replace")).hexdigest()
            page.tag.append(tag)
            page.parent.append(parent)
            page.path.append(f"{above}>{step}" if above else step)
            page.weight.append(weight)
            parent = number
        elif own != KEEP:
            own = GONE                            # an inline advert or share button; its neighbours stay
        stack.append((parent, tag, inline, max(level, own)))
        open_tags[tag] += 1
        if tag == "a":
            state["open_links"] += 1
            state["links"] += 1

    def end(tag: str) -> None:
        if tag == "br":
            add(" ")
            return
        if tag in ("body", "html") or tag in VOID:
            return
        if not (any(open_tags[h] for h in HEADINGS) if tag in HEADINGS else open_tags[tag]):
            return
        inline = tag in INLINE
        for i in range(len(stack) - 1, 0, -1):
            name = stack[i][1]
            if name == tag or (tag in HEADINGS and name in HEADINGS):
                cut(i)
                return
            if (inline and not stack[i][2]) or (name in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot")):
                return

    at, n, pattern = 0, len(source), TAG
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            add(source[at:])
            break
        if lt > at:
            add(source[at:lt])
        following = source[lt + 1:lt + 2]
        if following in ("!", "?") or (following == "/" and not source[lt + 2:lt + 3].isalpha()):
            if source.startswith("<!--", lt):
                close = re.compile(r"--!?>").search(source, lt + 2)
                at = close.end() if close else n
            else:
                close_at = source.find(">", lt)
                at = close_at + 1 if close_at >= 0 else n
            continue
        m = pattern.match(source, lt)
        if m is None and pattern is TAG and re.compile(r"</?[a-zA-Z]").match(source, lt):
            pattern = LOOSE_TAG                   # a quote never closed: from here on tags end at the next ">"
            m = pattern.match(source, lt)
        if m is None:
            if re.compile(r"</?[a-zA-Z]").match(source, lt):
                break                             # the page was cut inside a tag
            add("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            end(tag)
            continue
        attrs = m[3].strip()
        if attrs.endswith("/"):
            attrs = attrs[:-1].rstrip()
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            if tag not in ("title", "textarea") and tag not in INLINE:
                flush()
            if close is None:
                at = n
            else:
                gt = source.find(">", close.end())
                at = gt + 1 if gt >= 0 else n
            continue
        start(tag, attrs)
    flush()
    return page


def heads_article(stack: list[tuple[int, str, bool, int]]) -> bool:
    """Whether a left-out header is inside an article or main element (its headings are then the article's)."""
    out = [x for x in stack if x[3] != KEEP]
    inside = [x[1] for x in stack if x[3] == KEEP]
    return bool(out) and out[0][1] != "form" and ("article" in inside or "main" in inside)
