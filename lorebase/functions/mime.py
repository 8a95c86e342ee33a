"""MIME types and character sets as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import col


def _table(text: str) -> dict[str, str]:
    """``type: name name`` lines to name -> type."""
    return {n: k.strip() for k, _, names in (line.partition(":") for line in text.strip().splitlines()) for n in names.split()}


#: Types by file extension that general tables lack or hold otherwise.
BY_EXTENSION = _table("""
text/x-typescript: ts mts cts
text/x-tsx: tsx
text/javascript: js cjs mjs
text/x-jsx: jsx
text/x-python: py pyw pyi
text/x-cython: pyx pxd
text/x-go: go
text/x-rust: rs
text/x-csrc: c
text/x-chdr: h
text/x-c++src: cpp cxx cc
text/x-c++hdr: hpp hxx
text/x-zig: zig
text/x-nim: nim
text/x-v: v
text/x-crystal: cr
text/x-kotlin: kt kts
text/x-scala: scala
text/x-groovy: groovy
text/x-gradle: gradle
text/x-swift: swift
text/x-dart: dart
text/x-ruby: rb rake
text/x-php: php
text/x-lua: lua
text/x-perl: pl pm
text/x-r: r
text/x-haskell: hs lhs
text/x-elm: elm
text/x-erlang: erl
text/x-elixir: ex exs
text/x-clojure: clj cljs cljc
text/x-scheme: scm ss
text/x-tcl: tcl
text/x-julia: jl
text/x-csharp: cs
text/x-solidity: sol
text/x-move: move
text/x-cairo: cairo
text/x-vue: vue
text/x-svelte: svelte
text/x-astro: astro
text/x-shellscript: sh bash zsh fish csh tcsh ksh
text/x-powershell: ps1
text/x-batch: bat cmd
text/markdown: md markdown mkd mkdn mkdown mdown mdwn ronn
text/mdx: mdx
text/x-gfm: gfm
text/x-rst: rst
text/x-asciidoc: adoc asciidoc
text/x-textile: textile
text/x-org: org
text/x-pod: pod
text/x-rdoc: rdoc
text/x-wiki: wiki
text/x-rmarkdown: rmd
text/x-toml: toml
text/x-ini: ini cfg
text/x-conf: conf
text/x-properties: properties
text/x-dotenv: env
text/x-dockerfile: dockerfile containerfile
text/x-makefile: makefile
text/x-cmake: cmake
text/x-bazel: bazel bzl
text/x-buck: buck
text/x-terraform: tf tfvars
text/x-hcl: hcl
text/x-sql: sql
text/x-graphql: graphql gql
text/x-proto: proto
text/x-prisma: prisma
text/x-thrift: thrift
text/x-avro: avro
text/x-tex: tex latex
application/msword: doc
application/vnd.ms-excel: xls
application/vnd.ms-powerpoint: ppt
application/vnd.oasis.opendocument.text: odt
application/vnd.oasis.opendocument.spreadsheet: ods
application/vnd.oasis.opendocument.presentation: odp
application/rtf: rtf
application/epub+zip: epub
application/x-fictionbook+xml: fb2
text/html: html htm
text/plain: txt text
text/css: css
text/csv: csv
application/json: json
application/xml: xml
text/yaml: yaml yml
application/pdf: pdf
application/zip: zip
application/x-tar: tar
application/gzip: gz
image/png: png
image/jpeg: jpg jpeg
image/gif: gif
image/svg+xml: svg
""")

#: Corrections of types that other tables file elsewhere.
MISFILED = {
    "application/node": "text/javascript",
    "video/mp2t": "text/x-typescript",
    "application/rls-services+xml": "text/x-rust",
    "application/vnd.lotus-organizer": "text/x-org",
    "application/vnd.dart": "text/x-dart",
    "application/x-perl": "text/x-perl",
    "application/x-tex": "text/x-tex",
    "application/x-latex": "text/x-latex",
    "application/toml": "text/x-toml",
    "application/x-csh": "text/x-shellscript",
    "application/x-tcl": "text/x-tcl",
    "application/vnd.lotus-screencam": "text/x-scheme",
    "application/x-msdownload": "text/x-batch",
}

#: The language of each type of source code.
LANGUAGES = {
    "text/x-typescript": "typescript",
    "text/typescript": "typescript",
    "application/typescript": "typescript",
    "text/x-tsx": "tsx",
    "text/javascript": "javascript",
    "application/javascript": "javascript",
    "application/x-javascript": "javascript",
    "text/x-jsx": "jsx",
    "text/x-python": "python",
    "text/x-cython": "cython",
    "text/x-c": "c",
    "text/x-csrc": "c",
    "text/x-chdr": "c",
    "text/x-c++": "cpp",
    "text/x-c++src": "cpp",
    "text/x-c++hdr": "cpp",
    "text/x-go": "go",
    "text/x-rust": "rust",
    "text/x-zig": "zig",
    "text/x-nim": "nim",
    "text/x-v": "v",
    "text/x-crystal": "crystal",
    "text/x-java": "java",
    "text/x-kotlin": "kotlin",
    "text/x-scala": "scala",
    "text/x-groovy": "groovy",
    "text/x-gradle": "groovy",
    "text/x-swift": "swift",
    "text/x-dart": "dart",
    "text/x-csharp": "csharp",
    "text/x-ruby": "ruby",
    "text/x-php": "php",
    "text/x-lua": "lua",
    "text/x-perl": "perl",
    "text/x-r": "r",
    "text/x-haskell": "haskell",
    "text/x-elm": "elm",
    "text/x-erlang": "erlang",
    "text/x-elixir": "elixir",
    "text/x-clojure": "clojure",
    "text/x-scheme": "scheme",
    "text/x-tcl": "tcl",
    "text/x-batch": "batch",
    "text/x-julia": "julia",
    "text/x-solidity": "solidity",
    "text/x-move": "move",
    "text/x-cairo": "cairo",
    "text/x-vue": "vue",
    "text/x-svelte": "svelte",
    "text/x-astro": "astro",
    "text/css": "css",
    "text/x-scss": "scss",
    "text/x-sass": "sass",
    "text/less": "less",
    "text/x-sh": "bash",
    "text/x-shellscript": "bash",
    "application/x-sh": "bash",
    "text/x-powershell": "powershell",
    "text/x-rst": "rst",
    "text/x-asciidoc": "asciidoc",
    "text/x-textile": "textile",
    "text/x-org": "org",
    "text/x-pod": "pod",
    "text/x-rdoc": "rdoc",
    "text/x-wiki": "wiki",
    "text/x-rmarkdown": "rmarkdown",
    "text/x-toml": "toml",
    "text/x-ini": "ini",
    "text/x-conf": "conf",
    "text/x-properties": "properties",
    "text/x-dotenv": "dotenv",
    "text/x-dockerfile": "dockerfile",
    "text/x-makefile": "makefile",
    "text/x-cmake": "cmake",
    "text/x-bazel": "bazel",
    "text/x-buck": "buck",
    "text/x-terraform": "hcl",
    "text/x-hcl": "hcl",
    "text/x-yaml": "yaml",
    "text/yaml": "yaml",
    "application/x-yaml": "yaml",
    "application/yaml": "yaml",
    "text/x-json": "json",
    "application/json": "json",
    "text/x-xml": "xml",
    "text/xml": "xml",
    "application/xml": "xml",
    "application/xslt+xml": "xml",
    "application/xml-dtd": "xml",
    "application/wsdl+xml": "xml",
    "text/x-sql": "sql",
    "text/x-graphql": "graphql",
    "text/x-proto": "protobuf",
    "text/x-prisma": "prisma",
    "text/x-thrift": "thrift",
    "text/x-avro": "avro",
    "text/x-tex": "tex",
    "text/x-latex": "latex",
}

#: Aliases of character sets.
CHARSETS = {"iso-8859-1": "latin1", "iso_8859-1": "latin1", "latin-1": "latin1", "windows-1252": "cp1252", "cp-1252": "cp1252", "ms-ansi": "cp1252", "utf8": "utf-8", "unicode": "utf-8", "us-ascii": "ascii", "ascii": "ascii"}

OFFICE = tuple(f"application/vnd.openxmlformats-officedocument.{x}" for x in ("wordprocessingml.document", "spreadsheetml.sheet", "presentationml.presentation"))
LEGACY_OFFICE = ("application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint")
OPEN_DOCUMENT = tuple(f"application/vnd.oasis.opendocument.{x}" for x in ("text", "spreadsheet", "presentation"))


def mapped(x: Column, table: dict[str, str], default: Column) -> Column:
    m = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.try_element_at(m, x), default)


def normalized(mime: Column | str) -> Column:
    x = F.lower(F.trim(col(mime)))
    return mapped(x, MISFILED, x)


def content_type(header: Column | str) -> Column:
    """The MIME type of a Content-Type header, application/octet-stream if there is none."""
    x = F.trim(F.substring_index(col(header), ";", 1))
    return F.coalesce(normalized(F.when(x != "", x)), F.lit("application/octet-stream"))


def charset(header: Column | str) -> Column:
    x = F.lower(F.trim(F.regexp_extract(col(header), r"(?i)charset=\s*[\"']?([^\s;\"']+)", 1)))
    return F.when(x != "", x)


def normalized_charset(name: Column | str) -> Column:
    x = F.lower(F.trim(col(name)))
    return mapped(x, CHARSETS, x)


def meta_charset(html: Column | str) -> Column:
    """Of the first 1024 characters: <meta charset>, else the http-equiv form."""
    head = F.substring(col(html), 1, 1024)
    short = F.regexp_extract(head, r"(?i)<meta\s+charset=[\"']?([^\"'>\s]+)", 1)
    long = F.regexp_extract(head, r"(?i)<meta\s+http-equiv=[\"']?content-type[\"']?[^>]*charset=([^\"'>\s]+)", 1)
    return F.when(short != "", F.lower(short)).when(long != "", F.lower(long))


def resolved_charset(html: Column | str, header: Column | str, mime: Column | str) -> Column:
    """HTML: meta, then header, then utf-8; others: header, then utf-8."""
    return normalized_charset(F.coalesce(F.when(is_html(mime), meta_charset(html)), charset(header), F.lit("utf-8")))


def extension(path: Column | str) -> Column:
    """Of a path or address without its query and fragment; of a bare name like Dockerfile the name."""
    name = F.regexp_extract(F.regexp_replace(col(path), r"[?#].*$", ""), r"([^/\\]*)$", 1)
    return F.lower(F.when(name.contains("."), F.regexp_extract(name, r"\.([^.]*)$", 1)).otherwise(name))


def detect(path: Column | str) -> Column:
    return mapped(extension(path), BY_EXTENSION, F.lit(None).cast("string"))


def language(mime: Column | str) -> Column:
    return mapped(col(mime), LANGUAGES, F.lit(""))


def is_source_code(mime: Column | str) -> Column:
    return language(mime) != ""


def is_html(mime: Column | str) -> Column:
    return col(mime).isin("text/html", "application/xhtml+xml")


def is_markdown(mime: Column | str) -> Column:
    return col(mime).isin("text/markdown", "text/x-markdown", "text/mdx", "text/x-gfm")


def is_json(mime: Column | str) -> Column:
    return col(mime).isin("application/json", "text/json", "text/x-json")


def is_text(mime: Column | str) -> Column:
    return col(mime).startswith("text/") & ~is_html(mime) & ~is_markdown(mime) & ~is_json(mime)


def is_safe_text(mime: Column | str) -> Column:
    return col(mime).startswith("text/") | is_json(mime) | is_source_code(mime)


def is_binary_media(mime: Column | str) -> Column:
    return col(mime).rlike(r"^(?:image|video|audio|font)/")


def is_document(mime: Column | str) -> Column:
    return col(mime).isin("application/pdf", "application/rtf", "application/epub+zip", "application/x-fictionbook+xml", "application/x-ipynb+json", *OFFICE, *LEGACY_OFFICE, *OPEN_DOCUMENT)


def pipeline(mime: Column | str, content: Column | str) -> Column:
    """The conversion that takes a page: OpenAPI, JSON, source code, document, HTML, Markdown, else text; null for binary media."""
    x = F.lower(F.substring(F.ltrim(col(content)), 1, 2000))
    openapi = (is_json(mime) | col(mime).isin("text/yaml", "application/yaml", "text/x-yaml")) & x.rlike(r"[\"']?(?:openapi|swagger)[\"']?\s*:")
    code = is_source_code(mime) & ~is_json(mime) & ~col(mime).isin("text/x-rst", "text/x-asciidoc", "text/x-org")
    return (
        F.when(is_binary_media(mime), F.lit(None).cast("string")).when(openapi, F.lit("openapi")).when(is_json(mime), F.lit("json")).when(code, F.lit("source"))
        .when(is_document(mime), F.lit("document")).when(is_html(mime), F.lit("html")).when(is_markdown(mime), F.lit("markdown")).otherwise(F.lit("text"))
    )
