"""URL functions as Spark expressions."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX_FILES = r"index\.(?:html?|asp|php|jsp)"
#: Fixed value: suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.kr", "co.nz",
    "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.za", "github.io", "gitlab.io", "netlify.app", "vercel.app", "readthedocs.io", "pages.dev",
)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scheme(u: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(u), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(u: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(u), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(u: Column | str) -> Column:
    return F.regexp_extract(col(u), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_string(u: Column | str) -> Column:
    return F.regexp_extract(col(u), r"^[^?#]*(\?[^#]*)", 1)


def path_and_query(u: Column | str) -> Column:
    p = path(u)
    return F.concat(F.when(p == "", F.lit("/")).otherwise(p), query_string(u))


def valid(u: Column | str) -> Column:
    return col(u).isNotNull() & col(u).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")


def normalize(u: Column | str, drop_query: bool = False) -> Column:
    """Without fragment, index file and trailing slashes; query and case stay. A fragment that is a route (``#/`` or ``#!``) is one page of its own and stays."""
    x = col(u)
    routed = x.rlike(r"#[/!]")
    bare = F.when(routed, x).otherwise(F.regexp_replace(x, r"#.*$", ""))
    q = F.lit("") if drop_query else query_string(bare)
    tail = F.when(routed, F.regexp_extract(bare, r"(#.*)$", 1)).otherwise(F.lit(""))
    stem = F.regexp_replace(bare, r"[?#].*$", "")
    short = F.regexp_replace(F.regexp_replace(stem, rf"(?i)/{INDEX_FILES}$", "/"), r"^([^/]+//[^/]+/.*?[^/])/+$", "$1")
    stem = F.when(routed, stem).otherwise(F.when(short.rlike(r"^[^/]+//[^/]+$"), F.concat(short, F.lit("/"))).otherwise(short))
    return F.when(valid(x), F.concat(stem, q, tail)).otherwise(x)


def bare(u: Column | str) -> Column:
    return F.substring_index(col(u), "?", 1)


def for_evaluation(u: Column | str) -> Column:
    """Fragment, query, one trailing slash, then a Markdown or HTML extension, dropped in this order."""
    x = F.regexp_replace(F.regexp_replace(col(u), r"#.*$", ""), r"\?.*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"/$", ""), r"\.md$", ""), r"\.html$", "")


def is_markdown_twin(p: Column | str) -> Column:
    return col(p).rlike(r"(?i)(?:\.md\.txt|\.(?:md|mdx|markdown|mkd|mkdn|mkdown|mdown|mdwn|ronn))$")


def strip_markdown_extension(u: Column | str) -> Column:
    """The address of the page whose Markdown form this is; a name that is all extension stays."""
    p = path(u)
    short = F.regexp_replace(p, r"(?i)([^/])(?:\.md\.txt|\.[^/.]*)$", "$1")
    head = F.regexp_extract(col(u), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    tail = F.regexp_extract(col(u), r"^[^?#]*([?#].*)$", 1)
    return F.when(valid(u) & is_markdown_twin(p), F.concat(head, short, tail)).otherwise(col(u))


def twins(u: Column | str) -> Column:
    """Markdown addresses that may hold the page: page.md, page/index.md, page.html.md."""
    x = F.regexp_replace(bare(F.regexp_replace(col(u), r"#.*$", "")), r"/+$", "")
    html = x.rlike(r"\.html?$")
    return F.when(html, F.array(F.regexp_replace(x, r"\.html?$", ".md"), F.concat(x, F.lit(".md")))).otherwise(F.array(F.concat(x, F.lit(".md")), F.concat(x, F.lit("/index.md")), F.concat(x, F.lit(".html.md"))))


def primary_domain(h: Column | str) -> Column:
    """The registrable domain of a host; addresses and single names as they are."""
    x = F.regexp_replace(F.lower(col(h)), r"\.$", "")
    parts = F.split(x, r"\.")
    n = F.size(parts)
    last = lambda k: F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), k), ".")
    address = x.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") | x.contains(":")
    return F.when(address | (n < 3), x).when(last(2).isin(*TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))


def base_directory(p: Column | str) -> Column:
    """The folder that a start path stands for: the parent of an index file, else the path itself as a folder."""
    x = F.when(col(p) == "", F.lit("/")).otherwise(col(p))
    index = F.regexp_extract(x, r"([^/]*)$", 1).rlike(r"(?i)^index(?:\.[a-z0-9]+)?$")
    return F.when(x.endswith("/"), x).when(index, F.regexp_replace(x, r"[^/]*$", "")).otherwise(F.concat(x, F.lit("/")))


#: Fixed value: extensions that name a page.
PAGE_EXTENSIONS = r"html?|xhtml|php|aspx?|jsp|mdx?|markdown|txt|rst|adoc|json|ya?ml|xml|pdf"


def file_like(p: Column | str) -> Column:
    """Whether the last segment of a path names a page: a page extension, or an index file."""
    last = F.regexp_extract(F.regexp_replace(col(p), r"/+$", ""), r"([^/]*)$", 1)
    return last.rlike(rf"(?i)\.(?:{PAGE_EXTENSIONS})$") | last.rlike(r"(?i)^index(?:\.[a-z0-9]+)?$")


def descendant(child: Column | str, parent: Column | str) -> Column:
    """Whether child is parent or lies below it, parent taken as a folder."""
    folder = F.when(col(parent).endswith("/"), col(parent)).otherwise(F.concat(col(parent), F.lit("/")))
    return F.concat(col(child), F.lit("/")).startswith(folder)


def in_scope(target: Column | str, start: Column | str, scope: str) -> Column:
    """Whether target lies in the scope of start: subpages, hostname or domain."""
    t, s = col(target), col(start)
    if scope == "subpages":
        return (scheme(t) == scheme(s)) & (host(t) == host(s)) & path(t).startswith(base_directory(path(s)))
    if scope == "hostname":
        return host(t) == host(s)
    if scope == "domain":
        return primary_domain(host(t)) == primary_domain(host(s))
    raise ValueError(scope)


def resolve(href: str | None, base: str) -> str | None:
    """An absolute http, https or file address, or None (plain Python, for use in Arrow functions). A page's links are asked for twice, so short ones are kept."""
    return (_kept if len(href or "") + len(base) <= 1000 else _resolved)(href, base)


def _resolved(href: str | None, base: str) -> str | None:
    try:
        out = urljoin(base, (href or "").strip())
        return out if urlsplit(out).scheme in ("http", "https", "file") else None
    except ValueError:
        return None


_kept = lru_cache(4096)(_resolved)


def glob_regex(pattern: str) -> str:
    """A Java and RE2 expression for a path glob: * within a folder, ** across, ?, [..], {a,b}; anchored."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            body = pattern[i + 1 : j]
            out.append("[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]")
            i = j
        elif c == "{" and "}" in pattern[i:]:
            j = pattern.index("}", i)
            out.append("(?:" + "|".join(glob_regex(x)[1:-1] for x in pattern[i + 1 : j].split(",")) + ")")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def pattern_regex(pattern: str) -> str:
    """``/expression/`` as it is, else a glob, which a leading slash does not change."""
    if len(pattern) > 1 and pattern.startswith("/") and pattern.endswith("/"):
        return pattern[1:-1]
    return glob_regex(pattern.lstrip("/")).replace("^", "^/?", 1)


def matches_any(x: Column | str, patterns: list[str]) -> Column:
    """Whether any pattern fits. They are one expression, but for those that refer back to groups of their own."""
    each = [pattern_regex(p) for p in patterns]
    alone = [r for r in each if re.search(r"\\[1-9k]", r)]
    together = [r for r in each if r not in alone]
    out = F.lit(False) if not together else col(x).rlike("|".join(f"(?:{r})" for r in together))
    for r in alone:
        out = out | col(x).rlike(r)
    return out


#: Globs of files and folders that are left out unless the caller gives a list, even an empty one.
DEFAULT_EXCLUDES = (
    "**/CHANGELOG.md", "**/changelog.md", "**/CHANGELOG.mdx", "**/changelog.mdx", "**/LICENSE", "**/LICENSE.md", "**/license.md",
    "**/CODE_OF_CONDUCT.md", "**/code_of_conduct.md", "**/*.test.*", "**/*.spec.*", "**/*_test.py", "**/*_test.go",
    "**/*.lock", "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml", "**/go.sum", "**/*.min.js", "**/*.min.css", "**/*.map", "**/*.d.ts",
    "**/.DS_Store", "**/Thumbs.db", "**/*.swp", "**/*.swo", "/.*\\.(ini|cfg|conf|log|pid)$/",
    "**/archive/**", "**/archived/**", "**/deprecated/**", "**/legacy/**", "**/old/**", "**/outdated/**", "**/previous/**", "**/superseded/**", "docs/old/**",
    "**/test/**", "**/tests/**", "**/__tests__/**", "**/spec/**", "**/dist/**", "**/build/**", "**/out/**", "**/target/**", "**/.next/**", "**/.nuxt/**", "**/.vscode/**", "**/.idea/**",
    "**/i18n/ar*/**", "**/i18n/de*/**", "**/i18n/es*/**", "**/i18n/fr*/**", "**/i18n/hi*/**", "**/i18n/it*/**", "**/i18n/ja*/**", "**/i18n/ko*/**", "**/i18n/nl*/**", "**/i18n/pl*/**", "**/i18n/pt*/**",
    "**/i18n/ru*/**", "**/i18n/sv*/**", "**/i18n/th*/**", "**/i18n/tr*/**", "**/i18n/vi*/**", "**/i18n/zh*/**",
    "**/zh-cn/**", "**/zh-hk/**", "**/zh-mo/**", "**/zh-sg/**", "**/zh-tw/**",
)


def included(u: Column | str, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Exclude patterns win over include patterns; each is held against the whole address, its path with query, and for files its name."""
    skip = list(DEFAULT_EXCLUDES) if exclude is None else exclude
    name = F.regexp_extract(path(u), r"([^/]*)$", 1)
    hit = lambda ps: matches_any(u, ps) | matches_any(path_and_query(u), ps) | ((scheme(u) == "file") & matches_any(name, ps))
    ok = ~hit(skip) if skip else F.lit(True)
    return ok & hit(include) if include else ok
