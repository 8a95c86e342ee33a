"""Splitters, conversion, archives, text and version functions on small fixtures; and streams against batches."""

import io
import json
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lorebase.functions import convert, split, text, urls
from lorebase.operators import evaluation, ingest, scan, search, vectors
from lorebase.operators.versions import best_version, ordered
from lorebase.sources import archives, listings
from lorebase.streaming import jobs


def prose(seed, n=400):
    r = random.Random(seed)
    return "".join(r.choice(["word ", "longer-word ", "x\n", "para\n\n", "```\n", "- item\n"]) for _ in range(n))


@pytest.mark.parametrize("size", [20, 80, 500])
def test_text_split_adds_up(size):
    for seed in range(30):
        body = prose(seed).replace("```\n", "")
        pieces = split.split_text(body, size)
        assert "".join(pieces) == body and all(0 < len(p) <= size for p in pieces)


def test_fences_stay_whole_or_are_mended():
    body = "text\n\n```python\n" + "line = 1\n" * 60 + "```\n\nmore"
    pieces = split.split_text(body, 120)
    assert len(pieces) > 3 and all(p.count("```") % 2 == 0 for p in pieces)


@pytest.mark.parametrize(
    "sizes,given,want",
    [
        ((15, 200, 5000), [(3, ["Test"], "a"), (3, ["Test"], "b")], [(3, ["Test"], "a\nb")]),
        ((10, 30, 5000), [(1, ["a"], "x" * 40), (1, ["a"], "y" * 40)], [(1, ["a"], "x" * 40), (1, ["a"], "y" * 40)]),
        ((20, 200, 5000), [(1, ["Section 1"], "a"), (2, ["Section 1", "Sub 1.1"], "b")], [(1, ["Section 1", "Sub 1.1"], "a\nb")]),
        ((20, 200, 5000), [(2, ["Section 1", "Sub 1.1"], "a"), (2, ["Section 1", "Sub 1.2"], "b")], [(2, ["Section 1"], "a\nb")]),
        ((20, 200, 5000), [(1, ["Section 1"], "a"), (1, ["Section 2"], "b")], [(1, [], "a\nb")]),
    ],
)
def test_greedy(sizes, given, want):
    out = split.greedy([split.chunk(c, ["text"], lv, p) for lv, p, c in given], *sizes)
    assert [(c["level"], c["path"], c["content"]) for c in out] == want
    big = split.greedy([split.chunk("x" * 301, ["text"], 2, ["Guide"])], 20, 80, 100)
    assert "".join(c["content"] for c in big) == "x" * 301 and all(len(c["content"]) <= 100 and c["path"] == ["Guide"] for c in big)


def test_markdown_sections():
    md = "---\ntitle: T\n---\nintro\n\n# A {#a}\ntext\n\n## B\n- one\n- two\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n***\n\n```js\nx\n```\n\n# C\n> quote"
    got = [(c["types"][0], c["level"], c["path"]) for c in split.split_markdown(md)]
    assert got == [
        ("frontmatter", 0, []), ("text", 0, []), ("heading", 1, ["A"]), ("text", 1, ["A"]), ("heading", 2, ["A", "B"]), ("list", 2, ["A", "B"]), ("table", 2, ["A", "B"]), ("code", 2, ["A", "B"]), ("heading", 1, ["C"]), ("blockquote", 1, ["C"]),
    ]
    table = "| h |\n|---|\n" + "".join(f"| row {i} |\n" for i in range(40))
    assert all(p.startswith("| h |\n|---|\n") and len(p) <= 100 for p in split.split_table(table, 100))


@pytest.mark.parametrize("value", ['{"name":"test","version":"1.0.0"}', '{"config":{"debug":true,"port":8080}}', '{"items":[1,2,3]}', "[]", "3", '{"a":{"b":{"c":{"d":{"e":{"f":1}}}}}}'])
def test_json_chunks(value):
    out = split.split_json(value)
    assert json.loads("\n".join(c["content"] for c in out)) == json.loads(value)
    assert all(c["level"] == len(c["path"]) for c in out)
    assert split.split_json("{bad")[0]["path"] == ["invalid-json"]
    assert len(split.split_json(json.dumps(list(range(2000))))) < 1000


def test_source_chunks_add_up():
    py = '"""doc"""\nimport os\n\n\nclass A:\n    x = 1\n\n    def f(self):\n        def g():\n            return 1\n        return g\n\n\ndef h():\n    pass\n'
    out = split.split_source(py, "python")
    assert "".join(c["content"] for c in out) == py
    assert ["A", "f"] in [c["path"] for c in out] and not any("g" in c["path"] for c in out)
    ts = "import x from 'y';\n\nexport class Foo {\n  bar(a: string): void {\n    if (a) { return; }\n  }\n}\n\nexport function baz() {\n  return `}`;\n}\n"
    out = split.split_source(ts, "typescript")
    assert "".join(c["content"] for c in out) == ts
    assert ["Foo", "bar"] in [c["path"] for c in out] and ["baz"] in [c["path"] for c in out]


def test_openapi():
    spec = {"openapi": "3.0.0", "paths": {"/a": {"get": {"summary": "S", "x": {"$ref": "#/c/L"}}}}, "c": {"L": {"next": {"$ref": "#/c/L"}}}}
    out = split.split_openapi(json.dumps(spec))
    assert [c["path"] for c in out] == [["/a", "GET"]] and '"$ref": "#/c/L"' in out[0]["content"]
    assert split.split_openapi(json.dumps(spec), 20)[0]["content"].endswith("…")


def test_html():
    html = """<html><head><title> A  &amp; B </title><script>x</script></head><body><nav><a href="/n">n</a></nav><main><h1>Top</h1><p>Some <b>bold</b> and <a href="p?q=1">link</a>.
    <ul><li>one<li>two <code>c`d</code></ul><pre><code class="language-py">a = 1
b = 2</code></pre><table><tr><th>x</th><th>y|z</th></tr><tr><td>1</td><td>2</td></tr></table><img src="i.png" alt="pic"><blockquote><p>q</p></blockquote></main><footer>f</footer></body></html>"""
    page = convert.html_page(html, "https://e.com/d/")
    assert page["title"] == "A & B" and page["links"] == ["https://e.com/n", "https://e.com/d/p?q=1"]
    assert page["markdown"] == "# Top\n\nSome **bold** and [link](https://e.com/d/p?q=1).\n\n- one\n- two ``c`d``\n\n```py\na = 1\nb = 2\n```\n\n| x | y\\|z |\n| --- | --- |\n| 1 | 2 |\n\n![pic](https://e.com/d/i.png)\n\n> q"
    assert convert.markdown_links("[a](/x) ![i](/i.png) [b][R] [r]\n\n[r]: /y", "https://e.com/") == ["https://e.com/x", "https://e.com/y"]
    assert convert.without_embedded_images("![a*](data:image/png;base64,AA) `![b](data:image/png;x)`") == "a\\* `![b](data:image/png;x)`"
    assert convert.markdown_title("---\ntitle: 'F'\n---\n# H") == "F" and convert.markdown_title("# H ") == "H" and convert.markdown_title("x") == "Untitled"


def test_archives(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a/b.md", "# B")
        f.writestr("../out.md", "no")
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        i = tarfile.TarInfo("c.py")
        i.size = 5
        f.addfile(i, io.BytesIO(b"x = 1"))
    (tmp_path / "x.zip").write_bytes(z.getvalue())
    (tmp_path / "y.tar.gz").write_bytes(t.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"PK")
    (tmp_path / ".hidden").write_text("h")
    rows = archives.unpacked(archives.files(spark, str(tmp_path))).collect()
    assert sorted((r["path"].rsplit("/", 2)[-1], bytes(r["content"])) for r in rows) == [("b.md", b"# B"), ("c.py", b"x = 1")]
    assert archives.member(archives.files(spark, str(tmp_path)), next(r["path"] for r in rows if r["path"].endswith("b.md"))).count() == 1


@pytest.mark.parametrize("query,want", [("foo bar", ["foo bar", "foo", "bar"]), ('"hello world"', ["hello world"]), ('test "exact phrase" word', ["test exact phrase word", "test", "exact phrase", "word"]), ("  ", [])])
def test_phrases(query, want):
    assert text.phrases(query) == want


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("electrical", "electr"), ("adjustment", "adjust"), ("controll", "control"), ("probate", "probat"), ("sky", "sky")])
def test_porter(word, want):
    assert text.stem(word) == want


def test_version_order_and_ladder():
    assert ordered(["18.2.0", "17.0.2", "", "18.0.0", "19.0.0-rc.1"]) == ["", "19.0.0-rc.1", "18.2.0", "18.0.0", "17.0.2"]
    assert ordered(["1.20", "1.20.0"]) == ["1.20.0", "1.20"] and ordered(["stable", "1.0.0", "", "next"]) == ["", "1.0.0", "next", "stable"]
    for have, asked, best in [
        ("latest", "latest", "latest"), ("stable", " STABLE ", "stable"), ("1.20 1.20.0", "1.20", "1.20"), ("1.20 1.20.0", None, "1.20.0"), ("2.0.0 2.0.0-beta", "2.0.0-beta", "2.0.0-beta"), ("1.x 1.0.0", "1.x", "1.x"),
        ("1.0.0 2.0.0-beta", None, "2.0.0-beta"), ("1.0.0 2.0.0-beta", "2.0.0", "2.0.0-beta"), ("1.0.0 2.0.0-beta", "2.x", "2.0.0-beta"), ("1.0.0 2.0.0-beta", "3.0.0", "2.0.0-beta"), ("1.0.0 2.0.0-beta 2.0.0", "latest", "2.0.0"),
        ("1.0.0 1.0.1-beta", "1.0.0", "1.0.0"), ("2.0.0-rc.1 2.0.0-rc.2", None, "2.0.0-rc.2"), ("1.20 5", None, "5"), ("1.0.0 stable-2024 node18", "latest", "1.0.0"), ("1.0.0 1.1.0 2.0.0", "1.5.0", "1.1.0"), ("1.0.0 1.1.0", "1.0.x", "1.0.0"),
    ]:
        assert best_version(have.split(), asked)[0] == best, (have, asked)
    assert best_version(["2.0.0-beta", ""], "1.20") == (None, True)


def test_urls(spark):
    cases = {"https://e.com/page#section": "https://e.com/page", "https://e.com/page/": "https://e.com/page", "https://e.com/PAGE": "https://e.com/PAGE", "https://e.com/p?version=1.0": "https://e.com/p?version=1.0", "https://e.com/path/index.html": "https://e.com/path", "https://e.com/docs#/guide": "https://e.com/docs#/guide", "not a url": "not a url", "https://e.com": "https://e.com/"}
    rows = spark.createDataFrame(list(cases.items()), "u string, w string").select(urls.normalize("u").alias("n"), "w").collect()
    assert [(r["n"]) for r in rows] == [r["w"] for r in rows]
    hosts = {"docs.python.org": "python.org", "subdomain.example.co.uk": "example.co.uk", "org.github.io": "org.github.io", "localhost": "localhost", "192.168.1.1": "192.168.1.1"}
    rows = spark.createDataFrame(list(hosts.items()), "h string, w string").select(urls.primary_domain("h").alias("d"), "w").collect()
    assert all(r["d"] == r["w"] for r in rows)
    dirs = {"": "/", "/api": "/api/", "/api/index.html": "/api/", "/api/indexes": "/api/indexes/", "/v1.0": "/v1.0/", "/foo.html": "/foo.html/"}
    rows = spark.createDataFrame(list(dirs.items()), "p string, w string").select(urls.base_directory("p").alias("b"), "w").collect()
    assert all(r["b"] == r["w"] for r in rows)
    globs = [("foo*bar", "fooxbar", True), ("foo*bar", "foo/bar", False), ("foo/*/bar", "foo/abc/bar", True), ("/foo/.*/bar/", "foo/abc/bar", True), ("**/*.test.*", "a/b/x.test.js", True)]
    for p, x, want in globs:
        assert spark.range(1).select(urls.matches_any(F.lit(x), [p]).alias("m")).first()["m"] == want, p


def test_grep(spark):
    pages = spark.createDataFrame([(1, "alpha\nfoo.bar()\nfooXbar"), (2, "nothing here\nfoo.bar"), (3, "x" * 500 + "needle" + "y" * 500)], "page_id long, markdown string")
    run = lambda p, n=10: [(r["page_id"], r["line"], r["total"]) for r in scan.grep(pages, p, n).collect()]
    assert run("foo.bar") == [(1, 2, 2), (2, 2, 2)] and run("/^foo.bar$/i") == [(1, 3, 2), (2, 2, 2)] and len(run("/o/", 1)) == 1
    cut = scan.grep(pages, "needle").first()["excerpt"]
    assert "needle" in cut and len(cut) < 210
    for bad in ("/(/", "/(a+)+$/", ""):
        with pytest.raises(ValueError):
            scan.grep(pages, bad)


def test_fusion_scores(spark):
    docs = spark.createDataFrame([(1, "semantic candidate"), (2, "rarekeyword")], "id long, content string")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    r = search.hybrid(docs, vecs, "rarekeyword", [1.0, 0.0], limit=1, overfetch=1, multiplier=1, weight_fts=2).first()
    assert (r["id"], r["vec_rank"], r["fts_rank"]) == (2, None, 1) and abs(r["score"] - 2 / 61) < 1e-8
    assert search.full_text(docs, "  ", 5).count() == 0
    stemmed = search.full_text(spark.createDataFrame([(1, "Running Créations"), (2, "none")], "id long, content string"), "run creation", 5, stemmed=True).collect()
    assert [x["id"] for x in stemmed] == [1]


def test_context_clusters(spark):
    chunks = spark.createDataFrame([(10 + i, 1, i, f"c{i}", ["a"], ["text"]) for i in range(8)] + [(30, 2, 0, "c0", ["a"], ["text"])], "id long, page_id long, sort_order long, content string, path array<string>, types array<string>")
    hits = spark.createDataFrame([(10, 0.5), (17, 0.9), (30, 0.4)], "id long, score double")
    out = search.with_context(hits, chunks).collect()
    assert [(r["page_id"], r["score"]) for r in out][0] == (1, 0.9) and out[0]["content"] == "c6\n\nc7" and {r["content"] for r in out} == {"c6\n\nc7", "c0\n\nc1\n\nc2", "c0"}


def test_folds(spark):
    rows = [(1, i, n) for i, n in enumerate((3, 3, 9, 1, 5, 20, 1))]
    got = {r["o"]: r["batch"] for r in ingest.batches(spark.createDataFrame(rows, "k long, o long, n long"), ["k"], "o", "n", 10).collect()}
    want, total, b = {}, 0, 0
    for _, o, n in rows:
        if total and total + n > 10:
            b, total = b + 1, 0
        total += n
        want[o] = b
    assert got == want
    r = random.Random(1)
    w = [(k % 5, k, r.random() < 0.5, r.random() < 0.5) for k in range(40)]
    d = spark.createDataFrame(w, "page long, seq long, is_markdown boolean, extra boolean")
    a, b2 = ({tuple(x) for x in ingest.winners(x, ["page"]).collect()} for x in (d, d.orderBy(F.rand(3))))
    assert a == b2 and len(a) == 5
    assert vectors.hashed_vector("a b", 32) == vectors.hashed_vector("A  B", 32)
    assert evaluation.same_setup({"model": "openai:m", "k": 5}, {"model": "m", "k": 5}) and not evaluation.same_setup({"model": "x"}, {"model": "m"})
    with pytest.raises(Exception, match="too long"):
        spark.range(1).select(vectors.padded(F.array(F.lit(1.0), F.lit(2.0)), 1)).collect()


def test_sitemap_walk(spark):
    files = spark.createDataFrame([("i", "<sitemapindex><loc>a</loc><loc>i</loc></sitemapindex>"), ("a", "<urlset><loc><![CDATA[p&q]]></loc></urlset>"), ("z", "<urlset><loc>no</loc></urlset>")], "url string, body string")
    assert [r["loc"] for r in listings.walk_sitemaps(files.where("url = 'i'").select("url"), files).collect()] == ["p&q"]
    raw = spark.createDataFrame([('{"docs":[{"location":"a/#x"},{"location":"a/"}]}', 'typeSearchIndex = [{"p":"a.b","l":"C"}];updateSearchResults();')], "m string, j string")
    r = raw.select(listings.mkdocs_pages("m").alias("m"), listings.javadoc_pages("j").alias("j")).first()
    assert r["m"] == ["a/"] and r["j"] == ["a/b/C.html"]


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = F.element_at(F.array(*[F.lit(x) for x in ("queued", "running", "completed", "cancelling", "failed")]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = events.where("user_id < 12").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), s.alias("status"))
    rows.orderBy("seq").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = jobs.streamed(stream).writeStream.outputMode("update").format("memory").queryName("job_status").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("job_status").collect()} == {tuple(r) for r in jobs.folded(rows).collect()}
    hourly = jobs.activity(spark.readStream.schema(events.schema).parquet(sf_dir + "/eve*.parquet")).writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    hourly.processAllAvailable()
    hourly.stop()
    assert {tuple(r) for r in spark.table("hourly").collect()} == {tuple(r) for r in jobs.activity(events).collect()}


def test_backlog_stream(spark, tmp_path):
    from lorebase.streaming import backlog

    rows = spark.createDataFrame([(i, "lib", 1, ["a"], f"text {i}") for i in range(5)], "id long, library string, page_id long, path array<string>, content string")
    rows.write.parquet(str(tmp_path / "in"))
    calls = []

    def flaky(df, n):
        calls.append(n)
        if len(calls) == 1:
            raise OSError("busy")
        return backlog.hashed(df, n)

    for _ in range(2):  # the second run finds nothing new
        backlog.start(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), 64, flaky).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5 and len(calls) == 2
    assert [backlog.backoff(n) for n in (0, 1, 2, 30)] == [0, 1000, 2000, 600000] and backlog.backoff(1, 5000) == 5000


def test_api(spark):
    from lorebase.api import Corpus

    rows = [(1, 1, "lib", "1.0.0", 0, "needle one", ["a"], ["text"]), (2, 1, "lib", "1.0.0", 1, "two", ["a"], ["text"]), (3, 2, "lib", "2.0.0", 0, "needle three", ["a"], ["text"]), (4, 3, "other", "", 0, "needle four", ["a"], ["text"])]
    chunks = spark.createDataFrame(rows, "id long, page_id long, library string, version string, sort_order long, content string, path array<string>, types array<string>")
    c = Corpus(chunks, spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>"))
    assert c.find_version("LIB ", "1.x") == ("1.0.0", False)
    assert [r["content"] for r in c.search("needle", "lib").collect()] == ["needle three"]
    assert [r["content"] for r in c.search("needle", "lib", "1.0.0", exact=True).collect()] == ["needle one\n\ntwo"]
    assert {r["page_id"] for r in c.grep("needle").collect()} == {1, 2, 3} and c.read_page(1).first()["content"] == "needle one\n\ntwo"
    assert c.stats("lib", "1.0.0").first().asDict() == {"pages": 1, "chunks": 2, "embedded": 1, "avg_chunks": 2.0} and c.stats("x", "").first()["avg_chunks"] is None
    assert c.validate("lib") == [] and c.validate("lob") == ["lib"]
    assert c.removed("lib", "1.0.0").chunks.count() == 2 and c.removed("lib").chunks.count() == 1
    assert [r["id"] for r in c.waiting(2).collect()] == [2, 3] and c.catalog().count() == 3 and c.list_chunks("lib", "1.0.0", "TWO").first()["id"] == 2
    with pytest.raises(ValueError):
        c.search("x", exact=True)
    with pytest.raises(LookupError):
        Corpus(chunks.where("version = '2.0.0'")).search("x", "lib", "1.0")


def test_stored_index_agrees_with_texts(spark):
    """BM25 from postings and from the texts themselves: phrases, repeats, columns, stemming, filters, empty rows."""
    import random

    from lorebase.operators import postings, search

    r = random.Random(21)
    word = lambda: r.choice(["the", "running", "run", "of", "a", "été"])
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 30))), r.choice([None, word()]), r.choice("xy")) for i in range(60)] + [(60, None, None, "x"), (61, "a a a a a", "a", "y")]
    docs = spark.createDataFrame(rows, "id long, content string, title string, lang string")
    phrases = [["of", "the"], ["a", "a"], ["run"], ["the", "the", "the"]]
    for stemmed in (False, True):
        index = postings.build(docs, ["content", "title"], ["lang"], stemmed=stemmed)
        for where in (None, "lang = 'x'"):
            own, some = (index, docs) if where is None else (index.where(where), docs.where(where))
            got = {(x["id"], round(x["score"], 9)) for x in postings.bm25(own, phrases, weights=search.WEIGHTS).collect()}
            want = {(x["id"], round(x["score"], 9)) for x in search.bm25(search.indexed(some, ["content", "title"], ["id"], stemmed), ["id"], ["content", "title"], phrases, search.WEIGHTS).collect()}
            assert got == want and want
    assert postings.bm25(postings.build(docs.limit(0), ["content"]), [["a"]]).count() == 0


def test_deep_and_noisy_html():
    from lorebase.functions import convert

    page = convert.html_page("<div>" * 5000 + "deep text" + "</div>" * 5000 + "<p>after", "")
    assert "deep text" in page["markdown"] and "after" in page["markdown"]
    kept = '<p class="adsense-free">stay</p><div class="related">also</div>'
    noise = '<a class="sr-only" href="#x">skip</a><span class="sr-only">label</span><div aria-label="BREADCRUMB">way</div><div role="region" aria-label="Skip to it">go</div><ins data-ea-publisher="x">ad</ins>'
    assert convert.html_page(kept + noise, "")["markdown"].split() == ["stay", "also", "label"]
    both = "<div>outside</div><main><p>first region holds most of the words here</p></main><main><p>second</p></main>"
    assert "outside" not in convert.html_page(both, "")["markdown"] and "second" in convert.html_page(both, "")["markdown"]
    small = "<div>" + "outside words " * 20 + "</div><main>tiny</main>"
    assert "outside" in convert.html_page(small, "")["markdown"]
