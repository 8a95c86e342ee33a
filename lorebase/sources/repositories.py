"""Repository addresses, trees and file filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mime, urls
from ..operators import convert

_URL = r"^https?://(?:www\.)?github\.com/([^/?#]+)/([^/?#]+?)(?:\.git)?(?:/(?:tree|blob)/([^/?#]+)(?:/([^?#]*))?)?/?(?:[?#].*)?$"

#: Extensions of text files worth reading, and of documents.
TEXT_EXTENSIONS = (
    "md markdown mdx gfm mkd mkdn mkdown mdown mdwn ronn txt rst adoc asciidoc textile org pod rdoc wiki rmd "
    "html htm xml xsl xslt xsd dtd wsdl xhtml css scss sass less js jsx mjs cjs ts tsx mts cts py pyw pyi pyx pxd "
    "java kt kts scala groovy gradle cs c cpp cc cxx h hpp hxx go rs zig nim v cr swift dart m mm rb rake php lua pl pm r "
    "hs lhs elm erl ex exs clj cljs cljc jl sol move cairo vue svelte astro sh bash zsh fish ps1 bat cmd "
    "json yaml yml csv tsv sql graphql gql toml ini cfg conf properties env gitignore dockerignore gitattributes editorconfig "
    "pom sbt maven cmake make dockerfile containerfile makefile bazel bzl buck tf tfvars hcl mod sum "
    "proto prisma thrift avro tex latex log"
).split()
DOCUMENT_EXTENSIONS = "pdf docx xlsx pptx ipynb doc xls ppt odt ods odp rtf epub fb2".split()
#: Names of text files, alone or before a dot.
TEXT_NAMES = "readme license changelog contributing authors maintainers dockerfile makefile rakefile gemfile podfile cartfile brewfile procfile vagrantfile gulpfile gruntfile .prettierrc .eslintrc .babelrc .nvmrc .npmrc".split()


def parse(url: str) -> list[Column]:
    """owner, repo, branch and sub_path of an address, the last two null if it names none."""
    part = lambda i: F.nullif(F.regexp_extract(url, _URL, i), F.lit(""))
    return [part(1).alias("owner"), part(2).alias("repo"), part(3).alias("branch"), F.regexp_replace(part(4), "/+$", "").alias("sub_path")]


def below(path: str | Column, sub: str) -> Column:
    """Whether a path lies in a folder of the tree; every path does in the root."""
    p = F.col(path) if isinstance(path, str) else path
    clean = sub.strip("/")
    return F.lit(True) if not clean else (p == clean) | p.startswith(clean + "/")


def readable(path: str | Column) -> Column:
    """Files of text or documents by extension or name, settings and lock files, and what else has a text type."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    name, last = F.regexp_extract(p, r"([^/]*)$", 1), F.regexp_extract(p, r"\.([^.]*)$", 1)
    known = last.isin(*TEXT_EXTENSIONS, *DOCUMENT_EXTENSIONS)
    settings = F.contains(p, F.lit(".env.")) | p.endswith(".env") | F.contains(p, F.lit(".config.")) | F.contains(p, F.lit(".lock"))
    named = F.lit(False)
    for n in TEXT_NAMES:
        named = named | (name == n) | name.startswith(f"{n}.")
    return known | settings | named | F.coalesce(mime.detect(p).startswith("text/"), F.lit(False))


def blobs(trees: DataFrame, sub: str = "") -> DataFrame:
    """(owner, repo, branch, path, url) of the readable files of tree listings (owner, repo, branch, listing as JSON)."""
    items = F.from_json("listing", "struct<tree:array<struct<path:string,type:string>>>")["tree"]
    x = trees.select("owner", "repo", "branch", F.explode(items).alias("i")).where(F.col("i.type") == "blob")
    x = x.where(below("i.path", sub) & readable("i.path"))
    return x.select("owner", "repo", "branch", "i.path", F.concat_ws("/", F.lit("https://github.com"), "owner", "repo", F.lit("blob"), "branch", "i.path").alias("url"))


def blob_pages(blobs: DataFrame, contents: DataFrame) -> DataFrame:
    """Converted pages of a repository's files: blobs (owner, repo, branch, path, url) meet a snapshot of their contents (owner, repo, branch, path, mime, body). A general type gives way to that of the path; an empty title to the file's name; a file has no links."""
    x = blobs.join(contents, ["owner", "repo", "branch", "path"])
    general = F.coalesce(F.col("mime"), F.lit("text/plain")).isin("text/plain", "application/octet-stream")
    kind = F.when(general, F.coalesce(mime.detect("path"), F.col("mime"))).otherwise(F.col("mime"))
    rows = convert.converted(x.select(F.xxhash64("url").alias("page_id"), "url", F.coalesce(kind, F.lit("text/plain")).alias("mime"), "body"))
    name = F.regexp_extract("url", r"([^/]*)$", 1)
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(name, F.lit("")), F.lit("Untitled"))
    return rows.withColumns({"title": title, "links": F.array().cast("array<string>")})


_WIKI = r"^(/[^/]+/[^/]+/wiki)"


def wiki_pages(pages: DataFrame) -> DataFrame:
    """Converted pages of wikis from a snapshot (page_id, url, mime, body): titled by their path below the wiki, Home at its root; only links into the same wiki stay."""
    rows = convert.converted(pages.where(F.regexp_extract(urls.path("url"), _WIKI, 1) != ""))
    root = F.regexp_extract(urls.path("url"), _WIKI, 1)
    below = F.regexp_replace(F.substring(urls.path("url"), F.length(root) + 1, F.length("url")), "^/", "")
    own = F.filter("links", lambda x: (urls.host(x) == urls.host("url")) & urls.path(x).startswith(root))
    return rows.withColumns({"title": F.coalesce(F.nullif(below, F.lit("")), F.lit("Home")), "links": own})
