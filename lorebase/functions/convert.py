"""HTML to Markdown with title and links, and the smaller conversions; plain Python for use in Arrow functions."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from .urls import resolve

#: Elements whose content is no text of the page.
SILENT = frozenset("script style template noscript svg canvas iframe object button input select textarea".split())
#: Selectors of what surrounds the text.
NOISE = """
aside nav footer script style noscript svg link meta iframe header button input textarea select
.ads .advertisement .banner .cookie-banner .cookie-consent .hidden .hide .mobile-menu .mobile-nav .modal .nav-bar .overlay .popup .promo .mw-editsection
.search-bar .search-form .side-bar .sidebar .social-share .sticky .table-of-contents .toc
#ads #banner #cookieBanner #mobile-menu #mobile-nav #modal #nav #overlay #popup #sidebar #socialMediaBox #stickyHeader #ad-container
.ad-container .login-form .signup-form .tooltip .dropdown-menu .breadcrumb .pagination
[role="banner"] [role="complementary"] [role="dialog"] [role="alertdialog"] [role="navigation"] [role="search"] [role="region"][aria-label*="skip"i] [aria-modal="true"]
.noprint a.sr-only a.skip-link a.skip-nav a.screen-reader-only a.visually-hidden [aria-label="Breadcrumb"i] [itemtype*="BreadcrumbList"]
#carbonads .carbonads .carbon-wrap .carbon-text .carbon-img .carbon-poweredby a[href*="srv.carbonads.net"]
.bsa-promotion .bsa-cpc [id^="bsap_"] [id^="bsa-zone_"] img[src*="buysellads.com"] img[src*="buysellads.net"]
.ethical-rtd .ethical-fixedfooter .ethical-bottom-right [data-ea-publisher] .keep-us-sustainable img[src*="ethicalads.io"]
.adsbygoogle ins.adsbygoogle [id^="google_ads_iframe"] img[src*="googlesyndication.com"] img[src*="doubleclick.net"]
.OUTBRAIN [data-widget-id^="OB_"] .taboola [id^="taboola-"]
img[src*="bidr.io"] img[src*="adnxs.com"] img[src*="adsrvr.org"] img[src*="analytics.yahoo.com"]
.DocSearch .DocSearch-Button .DocSearch-Container .DocSearch-Modal #docsearch [id^="docsearch-"] .algolia-autocomplete .algolia-docsearch-suggestion
.md-search-result .md-search__output #searchbox #search-results .wy-side-search #st-search-input #st-results-container .st-default-search-input
""".split()
#: Fixed value: the share of a page's text that its main region holds at least.
MAIN_SHARE = 0.5
#: Elements nested deeper become siblings, as in browsers; no text is lost.
MOST_DEEP = 256
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in SILENT:
                todo += reversed(n.children)
        return "".join(out)

    def walk(self) -> list[Node]:
        """This element and all in it, in reading order."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            out.append(n)
            todo += reversed([c for c in n.children if isinstance(c, Node)])
        return out

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def holds(self, tags: frozenset[str]) -> bool:
        """Whether this element or one in it is of the tags."""
        todo = [self]
        while todo:
            n = todo.pop()
            if n.tag in tags:
                return True
            todo += [c for c in n.children if not isinstance(c, str)]
        return False


class Selectors:
    """Simple selectors: an element, a class, an id, attributes (there, equal, beginning, holding; i: in either case), or an element with those."""

    _PARTS = re.compile(r'([a-z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^]?=)"([^"]*)"(i?))?\]')

    def __init__(self, selectors: list[str]):
        self.tags, self.classes, self.ids = set(), set(), set()
        self.rest: dict[tuple[bool, str], list] = {}  # by the element or the attribute that they need
        for s in selectors:
            parts = self._PARTS.findall(s)
            if len(parts) == 1 and not parts[0][3]:
                tag, cls, id_ = parts[0][:3]
                (self.tags if tag else self.classes if cls else self.ids).add(tag or cls or id_)
            else:
                tag, attr = next((p[0] for p in parts if p[0]), ""), next((p[3] for p in parts if p[3]), "")
                need = "class" if any(p[1] for p in parts) else "id"
                self.rest.setdefault((bool(tag), tag or attr or need), []).append(parts)

    def fits(self, n: Node) -> bool:
        if not n.attrs:
            return n.tag in self.tags
        classes = n.attrs.get("class", "").split()
        if n.tag in self.tags or not self.classes.isdisjoint(classes) or n.attrs.get("id") in self.ids:
            return True
        return any(all(self._fits(n, classes, *p) for p in parts) for key in ((True, n.tag), *((False, a) for a in n.attrs)) for parts in self.rest.get(key, ()))

    @staticmethod
    def _fits(n: Node, classes: list[str], tag: str, cls: str, id_: str, attr: str, how: str, value: str, fold: str) -> bool:
        if not attr:
            return n.tag == tag if tag else cls in classes if cls else n.attrs.get("id") == id_
        own = n.attrs.get(attr)
        if own is None or not how:
            return own is not None
        if fold:
            own, value = own.lower(), value.lower()
        return own == value if how == "=" else own.startswith(value) if how == "^=" else value in own


_NOISE = Selectors(NOISE)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#", {}, None)
        self.depth = 0
        self.flat: list[str] = []  # elements too deep to be entered, that wait for their ends

    def updatepos(self, i, j):
        """Places in lines are not asked for, so line breaks need not be counted."""
        return j

    def up(self) -> None:
        self.now, self.depth = self.now.parent, self.depth - 1

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and self.now.tag == "p":  # a block closes an open paragraph
            self.up()
        if tag == "li" and self.now.tag == "li":
            self.up()
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag in VOID:
            return
        if self.depth >= MOST_DEEP:
            self.flat.append(tag)
        else:
            self.now, self.depth = node, self.depth + 1

    def handle_startendtag(self, tag, attrs):
        self.now.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.now))

    def handle_endtag(self, tag):
        if tag in self.flat:
            del self.flat[len(self.flat) - 1 - self.flat[::-1].index(tag) :]
            return
        n, up = self.now, 1
        while n.parent is not None and n.tag != tag:
            n, up = n.parent, up + 1
        if n.parent is not None:
            self.now, self.depth, self.flat = n.parent, self.depth - up, []

    def handle_data(self, data):
        self.now.children.append(data)


def squeezed(text: str) -> str:
    """Each run of white space as one space."""
    out = " ".join(text.split())
    if not out:
        return " " if text else ""
    return f"{' ' if text[0].isspace() else ''}{out}{' ' if text[-1].isspace() else ''}"


def stripped(text: str) -> str:
    """The same without white space at the ends."""
    return " ".join(text.split())


def parsed(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def title(root: Node) -> str:
    found = root.find("title", "h1")
    for tag in ("title", "h1"):
        for n in found:
            if n.tag == tag and (t := stripped(n.text())):
                return t
    return "Untitled"


def links(root: Node, base: str) -> list[str]:
    """Addresses of all anchors, resolved, each once in order."""
    given = [n for n in root.find("base", "a") if n.attrs.get("href")]
    b = next((n.attrs["href"] for n in given if n.tag == "base"), None)
    base = resolve(b, base) or base if b else base
    found = (resolve(n.attrs["href"], base) for n in given if n.tag == "a")
    return list(dict.fromkeys(x for x in found if x))


def visible(n: Node) -> int:
    return len(stripped(n.text()))


def cleaned(root: Node) -> Node:
    """A copy without what surrounds the text."""
    out = Node(root.tag, root.attrs, None)
    todo = [(root, out)]
    while todo:
        old, new = todo.pop()
        for c in old.children:
            if isinstance(c, str):
                new.children.append(c)
            elif c.tag not in SILENT and c.tag != "head" and not _NOISE.fits(c):
                kept = Node(c.tag, c.attrs, new)
                new.children.append(kept)
                todo.append((c, kept))
    return out


def sanitized(root: Node) -> Node:
    """The text of the page: noise goes; where the page declares main regions and the largest holds half of what is left, they alone stay; a page that would be empty is kept as it was."""
    out = cleaned(root)
    size = visible(out)
    if not size and visible(root):
        return root
    regions = out.find("main") or [n for n in out.walk() if n.attrs.get("role") == "main" and n.tag not in ("html", "body")]
    outer = []
    for n in regions:
        up = n.parent
        while up is not None and up not in outer:
            up = up.parent
        if up is None:
            outer.append(n)
    if outer and size and max(map(visible, outer)) >= MAIN_SHARE * size:
        if len(outer) == 1:
            return outer[0]
        both = Node("#", {}, None)
        both.children = list(outer)
        return both
    return out


def _inline(n: Node | str, base: str) -> str:
    if isinstance(n, str):
        return squeezed(n)
    if n.tag in SILENT:
        return ""
    inner = "".join(_inline(c, base) for c in n.children)
    if n.tag == "br":
        return "  \n"
    if n.tag == "img":
        src = n.attrs.get("src", "")
        alt = n.attrs.get("alt", "").strip()
        if src.startswith("data:"):
            return alt
        to = resolve(src, base)
        return f"![{alt}]({to})" if to else alt
    bare = inner.strip()
    if n.tag in ("code", "kbd", "samp", "tt") and bare:
        mark = "`" * (max([0, *map(len, re.findall("`+", bare))]) + 1)
        return f"{mark}{bare}{mark}" if not bare.startswith("`") else f"{mark} {bare} {mark}"
    if n.tag in ("strong", "b") and bare and "\n\n" not in bare:
        return f"**{bare}**"
    if n.tag in ("em", "i") and bare and "\n\n" not in bare:
        return f"*{bare}*"
    if n.tag in ("del", "s") and bare:
        return f"~~{bare}~~"
    if n.tag == "a" and bare:
        to = resolve(n.attrs.get("href"), base)
        return f"[{bare}]({to})" if to and not n.attrs.get("href", "").startswith("#") else inner
    return inner


def _block(n: Node, base: str, depth: int = 0) -> list[str]:
    out: list[str] = []
    run = ""

    def close():
        nonlocal run
        if run.strip():
            out.append((re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"(?<!  )[ \t]+\n", "\n", run)) if "\n" in run else run).strip())
        run = ""

    for c in n.children:
        if isinstance(c, str) or not c.holds(BLOCK):
            run += _inline(c, base)
            continue
        close()
        t = c.tag
        if t in SILENT or t == "head":
            continue
        if t[0] == "h" and len(t) == 2 and t[1].isdigit():
            if text := stripped(_inline(c, base)):
                out.append("#" * int(t[1]) + " " + text)
        elif t == "pre":
            code = c.find("code")
            lang = re.search(r"(?:language|lang|highlight-source)-([\w+#-]+)", " ".join([c.attrs.get("class", ""), *(x.attrs.get("class", "") for x in code), c.attrs.get("data-language", "")]))
            body = c.text().strip("\n")
            mark = "`" * max(3, max([0, *map(len, re.findall("`+", body))]) + 1)
            out.append(f"{mark}{lang[1] if lang else c.attrs.get('data-language', '')}\n{body}\n{mark}")
        elif t in ("ul", "ol"):
            rows = []
            for k, li in enumerate(x for x in c.children if isinstance(x, Node) and x.tag == "li"):
                body = "\n".join(_block(li, base, depth + 1)) or _inline(li, base).strip()
                mark = f"{k + int(c.attrs.get('start') or 1) if str(c.attrs.get('start') or 1).isdigit() else k + 1}. " if t == "ol" else "- "
                rows.append(mark + body.replace("\n", "\n" + " " * len(mark)))
            if rows:
                out.append("\n".join(rows))
        elif t == "blockquote":
            out.append("\n".join("> " + x if x else ">" for x in "\n\n".join(_block(c, base)).split("\n")))
        elif t == "table":
            out += _table(c, base)
        elif t == "hr":
            out.append("---")
        else:
            out += _block(c, base, depth)
    close()
    return out


#: A larger table is given in pieces of so many rows.
TABLE_ROWS, TABLE_CELLS, TABLE_CHARS, TABLE_PIECE = 500, 1000, 100_000, 100


def _table(n: Node, base: str) -> list[str]:
    rows = []
    for tr in n.find("tr"):
        rows.append([stripped(_inline(c, base)).replace("|", "\\|") for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")])
    rows = [r for r in rows if r]
    if not rows:
        return []
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    line = lambda r: "| " + " | ".join(r) + " |"
    head, body = [line(rows[0]), "|" + " --- |" * width], [line(r) for r in rows[1:]]
    if len(body) <= TABLE_ROWS and len(rows) * width <= TABLE_CELLS and sum(map(len, body)) <= TABLE_CHARS:
        return ["\n".join(head + body)]
    return ["\n".join(head + body[i : i + TABLE_PIECE]) for i in range(0, len(body), TABLE_PIECE)]


def to_markdown(root: Node, base: str = "") -> str:
    return "\n\n".join(x for x in _block(root, base) if x.strip())


def html_page(html: str, base: str) -> dict:
    """title, links and Markdown of a page."""
    root = parsed(html)
    return {"title": title(root), "links": links(root, base), "markdown": to_markdown(sanitized(root), base)}


# --- Markdown --------------------------------------------------------------------------------------------------


def markdown_title(text: str) -> str:
    from .split import frontmatter

    front, rest = frontmatter(text)
    if front and (m := re.search(r"^title[ \t]*:[ \t]*[\"']?(.+?)[\"']?[ \t]*$", front, re.M)):
        return m[1]
    m = re.search(r"^#[ \t]+(.+?)[ \t]*$", rest, re.M)
    return m[1] if m else "Untitled"


def markdown_links(text: str, base: str) -> list[str]:
    """Inline and reference links, no images, resolved, each once in order."""
    refs = {re.sub(r"\s+", " ", m[1]).strip().lower(): m[2] for m in re.finditer(r"^ {0,3}\[([^\]]+)\]:\s*<?([^\s>]+)>?", text, re.M)}
    found = []
    for m in re.finditer(r"(?<!!)\[((?:[^\[\]]|\[[^\]]*\])*)\](?:\(\s*<?([^\s)>]+)>?[^)]*\)|\[([^\]]*)\])?", text):
        if m[2]:
            found.append((m.start(), m[2]))
        elif not text[m.end() : m.end() + 1] == ":":
            key = re.sub(r"\s+", " ", m[3] or m[1]).strip().lower()
            if key in refs:
                found.append((m.start(), refs[key]))
    return list(dict.fromkeys(x for x in (resolve(u, base) for _, u in sorted(found)) if x))


def without_embedded_images(text: str) -> str:
    """Images given as data become their captions, outside of code."""
    parts = re.split(r"(^ {0,3}(?:```|~~~)[\s\S]*?^ {0,3}(?:```|~~~)[ \t]*$|`[^`\n]+`)", text, flags=re.M)
    return "".join(p if i % 2 else re.sub(r"!\[([^\]]*)\]\(\s*<?data:image/[^)>]*>?[^)]*\)", lambda m: re.sub(r"([\\`*_\[\]<>])", r"\\\1", m[1]), p) for i, p in enumerate(parts))
