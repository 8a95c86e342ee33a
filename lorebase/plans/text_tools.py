"""Conversion and splitting: CNV, SPL and SRC entries that run in Arrow functions or in plain text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import split, text
from ..operators import convert as ops
from ..registry import query


#: The words of each line of a text that has any, as lists of lines, in Spark and in SQL.
_LINES = r"[y FOR y IN [trim(regexp_replace(x, '[^\p{L}\p{N}]+', ' ', 'g')) FOR x IN string_split(coalesce(text, ''), chr(10))] IF y <> '']"


def lines():
    return F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))), lambda x: x != "")


def per_line(f, joiner=""):
    """One string from each line and its number."""
    return F.array_join(F.transform(lines(), f), joiner)


_OPERATIONS = f"SELECT doc_id, unnest({_LINES}) AS l, generate_subscripts({_LINES}, 1) - 1 AS i FROM documents"


def html_pages(t):
    return t.pages.select("page_id", "url", F.lit("text/html").alias("mime"), F.col("html").alias("body"))


@query("cnv_02_html_pipeline")
def _(t):
    """Title, links and Markdown of every page; the conversion's cases are held in tests."""
    return ops.converted(html_pages(t)).select("page_id", "title", F.size("links").cast("long").alias("n_links"), "markdown")


@query("cnv_03_title", r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages")
def _(t):
    return ops.converted(html_pages(t)).select("page_id", "title")


@query("cnv_04_links")
def _(t):
    return ops.converted(html_pages(t)).select("page_id", F.explode("links").alias("link"))


@query("cnv_08_markdown_title", r"SELECT doc_id, coalesce(nullif(regexp_extract(x, '(?m)^#\s+(.*)$', 1), ''), 'Untitled') AS title FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '# ' ELSE '' END || text AS x FROM documents)")
def _(t):
    x = F.concat(F.when(F.col("doc_id") % 2 == 0, "# ").otherwise(""), "text")
    return t.documents.select("doc_id", F.coalesce(F.nullif(F.regexp_extract(x, r"(?m)^#\s+(.*)$", 1), F.lit("")), F.lit("Untitled")).alias("title"))


@query("cnv_09_markdown_links", r"SELECT page_id, url || '#a' AS link FROM pages UNION ALL SELECT page_id, url || 'b' FROM pages")
def _(t):
    body = F.concat(F.lit("[a]("), "url", F.lit("#a) ![i](http://x/i.png) [b]("), "url", F.lit("b \"t\")"))
    found = F.regexp_extract_all(body, F.lit(r"(?:^|[^!])\[[^\]]*\]\(([^\s)]+)"), 1)
    return t.pages.select("page_id", F.explode(F.array_distinct(found)).alias("link"))


@query("cnv_12_document_gate", "SELECT doc_id, n_chars <= 5000 AS admitted FROM documents")
def _(t):
    """The size gate before a document is extracted, with a small limit."""
    return t.documents.select("doc_id", (F.length("text") <= 5000).alias("admitted"))


@query("cnv_13_twin_choice", "SELECT split_part(url, '#', 1) AS page, arg_min(page_id, (NOT contains(url, '#'), page_id)) AS page_id FROM pages GROUP BY 1")
def _(t):
    """Of a page and its Markdown twin (here: the address with a fragment) the twin."""
    return t.pages.groupBy(F.substring_index("url", "#", 1).alias("page")).agg(F.min_by("page_id", F.struct(~F.contains("url", F.lit("#")), "page_id")).alias("page_id"))


def text_pages(t, kind="text"):
    return t.documents.select(F.col("doc_id").alias("page_id"), F.lit(kind).alias("pipeline"), F.lit("").alias("language"), F.col("text").alias("markdown"))


@query("spl_01_text_chunks")
def _(t):
    """Chunks of every document; that they stay within bounds and add up is held in tests."""
    return ops.chunked(text_pages(t)).select("page_id", "sort_order", F.length("content").cast("long").alias("n"), F.md5("content").alias("content"))


@query("spl_02_lossless", "SELECT doc_id AS page_id, length(regexp_replace(text, '\\s', '', 'g')) AS n FROM documents WHERE length(trim(text)) > 0")
def _(t):
    """The chunks of a document hold all its characters but white space."""
    x = ops.chunked(text_pages(t)).select("page_id", F.length(F.regexp_replace("content", r"\s", "")).cast("long").alias("n"))
    return x.groupBy("page_id").agg(F.sum("n").alias("n"))


@query("spl_05_markdown_chunks")
def _(t):
    return ops.chunked(ops.converted(html_pages(t))).select("page_id", "sort_order", F.array_join("types", ",").alias("types"), "level", F.array_join("path", " > ").alias("path"), F.md5("content").alias("content"))


@query("spl_06_frontmatter", r"SELECT doc_id, regexp_matches(x, '^---\n[\s\S]*?[A-Za-z_]\w*:[\s\S]*?\n---') AS has FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) WHEN 1 THEN '---' || chr(10) ELSE '' END || text AS x FROM documents)")
def _(t):
    head = F.when(F.col("doc_id") % 3 == 0, "---\ntitle: x\n---\n").when(F.col("doc_id") % 3 == 1, "---\n").otherwise("")
    x = F.concat(head, "text")
    return t.documents.select("doc_id", x.rlike(r"^---\n[\s\S]*?[A-Za-z_]\w*:[\s\S]*?\n---").alias("has"))


@query("spl_11_json_chunks", f"SELECT doc_id, 2 + len({_LINES}) AS n, list_sum([length(x) FOR x IN {_LINES}])::BIGINT AS chars FROM documents WHERE len({_LINES}) > 0")
def _(t):
    """An object with a property for each line: its two brackets and a chunk for each property."""
    body = F.concat(F.lit("{"), F.array_join(F.transform(lines(), lambda x, i: F.concat(F.lit('"p'), i.cast("string"), F.lit('":"'), x, F.lit('"'))), ","), F.lit("}"))
    x = t.documents.where(F.size(lines()) > 0).select(F.col("doc_id").alias("page_id"), F.lit("json").alias("pipeline"), F.lit("").alias("language"), body.alias("markdown"))
    text = F.regexp_extract("content", r'"p\d+": "([^"]*)"', 1)
    return ops.chunked(x).groupBy(F.col("page_id").alias("doc_id")).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"))


@query("spl_12_source_chunks", f"SELECT doc_id AS page_id, 1 + len({_LINES}) AS n, md5(array_to_string([md5(x) FOR x IN {_LINES}], '')) AS body FROM documents")
def _(t):
    """An import, then a function for each line: a chunk each, in order."""
    body = F.concat(F.lit("import os\n"), F.array_join(F.transform(lines(), lambda x, i: F.concat(F.lit("def f"), i.cast("string"), F.lit("():\n    return '"), F.md5(x), F.lit("'\n"))), ""))
    x = t.documents.select(F.col("doc_id").alias("page_id"), F.lit("source").alias("pipeline"), F.lit("python").alias("language"), body.alias("markdown"))
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", F.regexp_extract("content", "return '([0-9a-f]{32})'", 1).alias("h")))), lambda y: y["h"]), "")
    return ops.chunked(x).groupBy("page_id").agg(F.count("*").alias("n"), F.md5(kept).alias("body"))


@query("spl_15_openapi_chunks", f"SELECT doc_id AS page_id, count(*) + count(*) FILTER (i % 2 = 0) AS n, md5(string_agg(CASE WHEN i % 2 = 0 THEN md5(l) || md5(l) ELSE md5(l) END, '' ORDER BY i)) AS body FROM ({_OPERATIONS}) GROUP BY 1")
def _(t):
    """A path for each line, with one operation or two: a chunk for each operation, in order."""
    op = lambda verb, x: F.concat(F.lit(f'"{verb}":{{"summary":"'), F.md5(x), F.lit('"}'))
    paths = F.transform(lines(), lambda x, i: F.concat(F.lit('"/p'), F.lpad(i.cast("string"), 7, "0"), F.lit('":{'), op("get", x), F.when(i % 2 == 0, F.concat(F.lit(","), op("post", x))).otherwise(""), F.lit("}")))
    body = F.concat(F.lit('{"openapi":"3.0.0","paths":{'), F.array_join(paths, ","), F.lit("}}"))
    x = t.documents.where(F.size(lines()) > 0).select(F.col("doc_id").alias("page_id"), F.lit("openapi").alias("pipeline"), F.lit("").alias("language"), body.alias("markdown"))
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", F.regexp_extract("content", '"summary": "([0-9a-f]{32})"', 1).alias("h")))), lambda y: y["h"]), "")
    return ops.chunked(x).groupBy("page_id").agg(F.count("*").alias("n"), F.md5(kept).alias("body"))


@query("src_02_web_source", r"SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'markdown' WHEN 2 THEN 'json' ELSE 'text' END AS pipeline, CASE page_id % 4 WHEN 0 THEN NULL ELSE length(html) END AS chars FROM pages")
def _(t):
    """Pages of four types, each by its own pipeline; all but HTML keep their text."""
    kinds = F.array(*map(F.lit, ("text/html", "text/markdown", "application/json", "text/plain")))
    x = ops.converted(t.pages.select("page_id", "url", F.element_at(kinds, (F.col("page_id") % 4 + 1).cast("int")).alias("mime"), F.col("html").alias("body")))
    return x.select("page_id", "pipeline", F.when(F.col("pipeline") != "html", F.length("markdown")).cast("long").alias("chars"))


def made(docs, body):
    return docs.select(F.col("doc_id").alias("id"), body.alias("body"))


def _id():
    return F.col("doc_id").cast("string")


@query("spl_03_greedy_merge", f"SELECT doc_id AS page_id, 2 + sum(length(replace(l, ' ', '')))::BIGINT AS chars, 0 AS oversized, 0 AS mergeable FROM (SELECT doc_id, unnest({_LINES}) AS l FROM documents) GROUP BY 1")
def _(t):
    """A section with a paragraph for each line: chunks lose nothing, none is too large, and no two neighbours are small enough to be one."""
    body = F.concat(F.lit("# A\n\n"), per_line(lambda x: x, "\n\n"))
    x = ops.chunked(t.documents.where(F.size(lines()) > 0).select(F.col("doc_id").alias("page_id"), F.lit("markdown").alias("pipeline"), F.lit("").alias("language"), body.alias("markdown")))
    size = F.length("content")
    before = F.lag(size).over(Window.partitionBy("page_id").orderBy("sort_order"))  # a page's chunks
    x = x.withColumn("joint", F.coalesce((before + 1 + size <= split.PREFERRED_SIZE) & (before < split.MIN_SIZE), F.lit(False)))
    return x.groupBy("page_id").agg(F.sum(F.length(F.regexp_replace("content", r"\s", ""))).alias("chars"), F.count(F.when(size > split.MAX_SIZE, 1)).alias("oversized"), F.count(F.when(F.col("joint"), 1)).alias("mergeable"))


@query("spl_04_section_merge", "SELECT doc_id AS page_id, 1::BIGINT AS level, 'A > B' AS path FROM documents")
def _(t):
    """A section and its child: the smaller level, the deeper path."""
    body = F.concat(F.lit("# A\none "), _id(), F.lit("\n\n## B\ntwo"))
    x = t.documents.select(F.col("doc_id").alias("page_id"), F.lit("markdown").alias("pipeline"), F.lit("").alias("language"), body.alias("markdown"))
    return ops.chunked(x).select("page_id", "level", F.array_join("path", " > ").alias("path"))


@query("spl_07_overlap", "SELECT doc_id AS id, sum(length(text))::BIGINT AS n FROM documents WHERE length(text) > 0 GROUP BY doc_id")
def _(t):
    """The last resort cuts with an overlap of twenty; less the overlaps the pieces are the text."""
    x = ops.pieces(made(t.documents, F.col("text")), "recursive", 1000).where("length(piece) > 0")
    return x.groupBy("id").agg((F.sum(F.length("piece")) - 20 * (F.count("*") - 1)).cast("long").alias("n"))


@query("spl_08_list", f"SELECT doc_id AS id, len({_LINES}) AS items, list_sum([length(replace(x, ' ', '')) FOR x IN {_LINES}])::BIGINT AS chars FROM documents WHERE len({_LINES}) > 0")
def _(t):
    """A list with an item for each line: pieces hold every item once and whole."""
    x = ops.pieces(made(t.documents.where(F.size(lines()) > 0), per_line(lambda x: F.concat(F.lit("- "), x), "\n")), "list", 300)
    return x.groupBy("id").agg(F.sum(F.regexp_count("piece", F.lit("(?m)^- "))).alias("items"), F.sum(F.length(F.regexp_replace("piece", r"(?m)^- |\s", ""))).alias("chars"))


@query("spl_09_table", f"SELECT doc_id AS id, len({_LINES}) AS data_rows, true AS headed FROM documents WHERE len({_LINES}) > 0")
def _(t):
    """A table with a row for each line: pieces repeat its head."""
    body = F.concat(F.lit("| a | b |\n|---|---|\n"), per_line(lambda x: F.concat(F.lit("| "), F.md5(x), F.lit(" | cell |")), "\n"))
    x = ops.pieces(made(t.documents.where(F.size(lines()) > 0), body), "table", 200)
    return x.groupBy("id").agg((F.sum(F.regexp_count("piece", F.lit(r"\| cell \|")))).alias("data_rows"), F.bool_and(F.col("piece").startswith("| a | b |\n|---|---|\n")).alias("headed"))


@query("spl_10_code", f"SELECT doc_id AS id, len({_LINES}) AS code_lines, true AS fenced FROM documents WHERE len({_LINES}) > 0")
def _(t):
    """A block of code with a line for each line: pieces are fenced as it is."""
    body = F.concat(F.lit("```py\n"), per_line(lambda x: F.concat(F.lit("x = '"), F.md5(x), F.lit("'")), "\n"), F.lit("\n```"))
    x = ops.pieces(made(t.documents.where(F.size(lines()) > 0), body), "code", 120)
    return x.groupBy("id").agg(F.sum(F.regexp_count("piece", F.lit("x = "))).alias("code_lines"), F.bool_and(F.col("piece").startswith("```py\n") & F.col("piece").endswith("\n```")).alias("fenced"))


@query("spl_13_script_boundaries", f"SELECT doc_id AS id, 'Foo' || doc_id AS name, 'structural' AS kind FROM documents UNION ALL SELECT doc_id, 'bar', 'content' FROM documents UNION ALL SELECT doc_id, 'f' || i, 'content' FROM ({_OPERATIONS})")
def _(t):
    """A class with a method, then a function for each line."""
    functions = F.array_join(F.transform(lines(), lambda x, i: F.concat(F.lit("\nexport function f"), i.cast("string"), F.lit("() {\n  return `} ${'"), F.md5(x), F.lit("'}`;\n}\n"))), "")
    body = F.concat(F.lit("export class Foo"), _id(), F.lit(" {\n  bar(a: string): void {\n    const x = 1;\n  }\n}\n"), functions)
    return ops.boundaries(made(t.documents, body), "typescript").select("id", "name", "kind")


@query("spl_14_python_boundaries", f"SELECT doc_id AS id, 'import' AS name, 'structural' AS kind FROM documents UNION ALL SELECT doc_id, 'C' || doc_id, 'structural' FROM documents UNION ALL SELECT doc_id, 'f' || i, 'content' FROM ({_OPERATIONS} WHERE len({_LINES}) > 0) UNION ALL SELECT doc_id, 'g', 'content' FROM documents")
def _(t):
    """A class with a method for each line, each with a function inside that is none of its own."""
    methods = F.array_join(F.transform(lines(), lambda x, i: F.concat(F.lit("    def f"), i.cast("string"), F.lit("(self):\n        def inner():\n            return '"), F.md5(x), F.lit("'\n        return inner\n"))), "")
    body = F.concat(F.lit("import os\n\nclass C"), _id(), F.lit(":\n    def g(self):\n        pass\n"), methods)
    return ops.boundaries(made(t.documents, body), "python").select("id", "name", "kind")


@query("spl_16_openapi_references", "SELECT page_id, length(html)::BIGINT AS size, md5(url) AS name FROM pages")
def _(t):
    """What a reference stands for is in the operation's chunk, also behind a second reference."""
    body = F.concat(F.lit('{"openapi":"3.0.0","paths":{"/p":{"get":{"x":{"$ref":"#/c/L"}}}},"c":{"L":{"size":'), F.length("html").cast("string"), F.lit(',"m":{"$ref":"#/c/M"}},"M":{"name":"'), F.md5("url"), F.lit('"}}}'))
    x = t.pages.select("page_id", F.lit("openapi").alias("pipeline"), F.lit("").alias("language"), body.alias("markdown"))
    return ops.chunked(x).select("page_id", F.regexp_extract("content", r'"size": (\d+)', 1).cast("long").alias("size"), F.regexp_extract("content", r'"name": "([0-9a-f]+)"', 1).alias("name"))


_NOISY = '<nav>menu</nav><div class="x cookie-banner">take cookies</div><a class="skip-link" href="#m">skip</a><div role="search">find</div><img src="https://ad.doubleclick.net/p.gif"><div id="bsap_7">buy</div>'


@query("cnv_05_sanitise", f"SELECT doc_id AS page_id, array_to_string({_LINES}, chr(10) || chr(10)) AS markdown FROM documents WHERE len({_LINES}) > 0")
def _(t):
    """Lines as paragraphs among what surrounds a page: only they reach the Markdown."""
    body = F.concat(F.lit("<body>" + _NOISY + "<div>"), per_line(lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), F.lit("</div><footer>end</footer><script>track()</script><style>p{margin:0}</style></body>"))
    x = t.documents.where(F.size(lines()) > 0).select(F.col("doc_id").alias("page_id"), F.lit("https://e.com/").alias("url"), F.lit("text/html").alias("mime"), body.alias("body"))
    return ops.converted(x).select("page_id", "markdown")


@query("cnv_06_absolute_links", f"SELECT doc_id AS page_id, string_agg('x [' || l || '](https://e.com/r' || i || ') ![](https://e.com/d/i' || i || '.png)', chr(10) || chr(10) ORDER BY i) AS markdown FROM ({_OPERATIONS}) GROUP BY 1")
def _(t):
    """A link and an image for each line, made absolute."""
    part = lambda x, i: F.concat(F.lit('<p>x <a href="/r'), i.cast("string"), F.lit('">'), x, F.lit('</a> <img src="i'), i.cast("string"), F.lit('.png"></p>'))
    body = F.concat(F.lit("<main>"), per_line(part), F.lit("</main>"))
    x = t.documents.where(F.size(lines()) > 0).select(F.col("doc_id").alias("page_id"), F.lit("https://e.com/d/p").alias("url"), F.lit("text/html").alias("mime"), body.alias("body"))
    return ops.converted(x).select("page_id", "markdown")


@query("cnv_07_html_to_markdown", f"SELECT doc_id AS page_id, '# H' || doc_id || chr(10) || chr(10) || '- ' || array_to_string({_LINES}, chr(10) || '- ') || chr(10) || chr(10) || '| x |' || chr(10) || '| --- |' || chr(10) || '| ' || array_to_string({_LINES}, ' |' || chr(10) || '| ') || ' |' AS markdown FROM documents WHERE len({_LINES}) BETWEEN 1 AND 400 AND length(text) < 50000")
def _(t):
    """A heading, then the lines as a list and as a table (tables that are not given in pieces)."""
    body = F.concat(F.lit("<main><h1>H"), _id(), F.lit("</h1><ul>"), per_line(lambda x: F.concat(F.lit("<li>"), x)), F.lit("</ul><table><tr><th>x</th></tr>"), per_line(lambda x: F.concat(F.lit("<tr><td>"), x, F.lit("</td></tr>"))), F.lit("</table></main>"))
    x = t.documents.where((F.size(lines()) > 0) & (F.size(lines()) <= 400) & (F.length("text") < 50000)).select(F.col("doc_id").alias("page_id"), F.lit("").alias("url"), F.lit("text/html").alias("mime"), body.alias("body"))
    return ops.converted(x).select("page_id", "markdown")


@query("cnv_10_embedded_images", f"SELECT doc_id AS id, 'a ' || array_to_string([x || ' pic ' || x FOR x IN {_LINES}], chr(10)) AS text FROM documents WHERE len({_LINES}) > 0")
def _(t):
    """An image given as data in each line becomes its caption."""
    from ..functions import convert

    body = F.concat(F.lit("a "), per_line(lambda x: F.concat(x, F.lit(" ![pic "), x, F.lit("](data:image/png;base64,AAAA)")), "\n"))
    return ops.rewritten(made(t.documents.where(F.size(lines()) > 0), body), convert.without_embedded_images)


@query("cnv_11_passthrough", r"SELECT page_id, coalesce(nullif(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), ''), 'Untitled') AS title, md5(html) AS body, 0 AS n_links FROM pages")
def _(t):
    """Text of other kinds stays as it is, titled by its address, without links."""
    kinds = F.array(*map(F.lit, ("application/json", "text/x-python", "text/plain")))
    x = ops.converted(t.pages.select("page_id", "url", F.element_at(kinds, (F.col("page_id") % 3 + 1).cast("int")).alias("mime"), F.col("html").alias("body")))
    return x.select("page_id", "title", F.md5("markdown").alias("body"), F.size("links").alias("n_links"))


@query("str_09_fence_state", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN '```py' ELSE '' END AS text FROM documents")
def _(t):
    """The fence that is still open at the end of a text, here of two copies of the document's own."""
    plain = F.translate(F.coalesce("text", F.lit("")), "`~", "")
    body = F.concat(F.lit("```\n"), plain, F.lit("\n```\n"), F.when(F.col("doc_id") % 2 == 0, "```py\n").otherwise(""), plain)
    return ops.rewritten(made(t.documents, body), lambda x: split.open_fence(x) or "")


@query("str_12_query_phrases", r"SELECT doc_id AS id, md5(CASE WHEN len(w) > 1 THEN array_to_string(w, ' ') || '|' ELSE '' END || array_to_string(w, '|')) AS text FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+') AS w FROM documents) WHERE len(w) > 0")
def _(t):
    """Whole texts as queries: the words, and the whole first where there are several."""
    words = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}]+"), 0), " ")
    x = ops.rewritten(made(t.documents.where(words != ""), words), lambda x: "|".join(text.phrases(x)))
    return x.select("id", F.md5("text").alias("text"))


@query("url_09_base_href", "SELECT page_id, 'https://b.com/x/r' || page_id AS link FROM pages")
def _(t):
    body = F.concat(F.lit('<base href="https://b.com/x/"><p><a href="r'), F.col("page_id").cast("string"), F.lit('">y</a>'))
    x = ops.converted(t.pages.select("page_id", "url", F.lit("text/html").alias("mime"), body.alias("body")))
    return x.select("page_id", F.explode("links").alias("link"))


@query("sto_11_bisect", "SELECT doc_id AS id, length(text)::BIGINT AS size, length(text) > 20000 AS failed FROM documents")
def _(t):
    return ops.bisected(made(t.documents, F.col("text")), 20_000).select("id", "size", "failed")


@query("src_24_fetch_url", r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\s+', ' ', 'g')) AS title, true AS converted FROM pages")
def _(t):
    """Pages to Markdown, nothing stored."""
    return ops.converted(html_pages(t)).select("page_id", "title", (F.length("markdown") > 0).alias("converted"))


@query("src_14_registry_page", "SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS url FROM pages WHERE NOT regexp_matches(url, '/([?#]|$)')")
def _(t):
    """Package registries are read as web pages whose query does not count."""
    from ..functions import urls

    return t.pages.where(~F.col("url").rlike(r"/(?:[?#]|$)")).select("page_id", urls.normalize("url", drop_query=True).alias("url"))


@query("msc_10_exact_guard", "SELECT event_id, event_id % 2 = 0 OR event_id % 3 > 0 AS ok FROM events")
def _(t):
    """An exact request needs a version."""
    exact, version = F.col("event_id") % 2 != 0, F.when(F.col("event_id") % 3 > 0, "1.0.0")
    return t.events.select("event_id", (~exact | version.isNotNull()).alias("ok"))


@query("flt_28_allowed_roots", "SELECT page_id, starts_with(p, '/en/') AND NOT contains(p, '..') AS allowed FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS p FROM pages)")
def _(t):
    """Whether a path lies in an allowed root and does not lead out of it."""
    p = F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1)
    return t.pages.select("page_id", (p.startswith("/en/") & ~F.contains(p, F.lit(".."))).alias("allowed"))
