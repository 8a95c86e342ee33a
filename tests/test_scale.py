"""What steps hold and read: each text once, bounded runs, sections once."""

import gzip
import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lorebase.functions import convert as html
from lorebase.functions import mime, urls
from lorebase.functions.batches import parts
from lorebase.operators import convert, hierarchy, ingest, postings, search
from lorebase.sources import archives


def counted_reads(df, spark):
    """df through a function that counts its rows each time they are read."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_inverted_and_runs():
    r = random.Random(1)
    words = [[r.choice(["a", "b", "é", "zz", "b2"]) for _ in range(r.randrange(9))] for _ in range(300)] + [[], None]
    lists = pa.array(words, pa.list_(pa.string())).slice(3)
    row, term, places = postings.inverted(lists)
    want = {}
    for i, x in enumerate(words[3:]):
        for k, w in enumerate(x or []):
            want.setdefault((w.encode(), i), []).append(k)
    assert list(zip(term.to_pylist(), row.tolist(), places.to_pylist(), strict=True)) == [(w.decode(), i, p) for (w, i), p in sorted(want.items())]
    assert [len(x) for x in postings.inverted(pa.array([[], None], pa.list_(pa.string())))] == [0, 0, 0]
    batch = pa.record_batch([pa.array(range(len(lists))), lists], names=["i", "w"])
    for most in (1, 5, 100, 10**6):
        out = list(postings.runs(iter([batch] * 3), 1, most))
        assert [i for x in out for i in x["i"].to_pylist()] == list(range(len(lists))) * 3
        assert all(sum(len(w or []) for w in x["w"].to_pylist()) < most + 9 for x in out)


def test_index_reads_texts_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "of the sea " * (i % 3) + f"w{i}" if i % 7 else None) for i in range(200)], "id long, content string")
    read, seen = counted_reads(docs, spark)
    index = postings.build(read, ["content"])
    assert seen.value == 200
    plain = search.bm25(search.indexed(docs, ["content"], ["id"]), ["id"], ["content"], [["of", "the"], ["w5"]])
    near = lambda df: {r["id"]: round(r["score"], 9) for r in df.collect()}
    assert near(postings.bm25(index, [["of", "the"], ["w5"]])) == near(plain)
    assert index.stats.first()["_rows"] == 200


def test_parts():
    batch = pa.record_batch([pa.array(range(1000)), pa.array(["x" * (i % 7 * 100_000) for i in range(1000)])], names=["i", "x"])
    out = list(parts([batch, batch.slice(0, 0), batch.slice(990)]))
    assert [i for b in out for i in b.column(0).to_pylist()] == [*range(1000), *range(990, 1000)]
    assert all(b.num_rows == 1 or (b.num_rows <= 256 and b.nbytes <= 4 * 1024 * 1024) for b in out)
    assert {b.num_rows for b in parts([batch], 50, None)} == {50}


class Caught:
    """In place of a DataFrame: hands out the function that would run over its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def most_held(run, batches) -> int:
    """Bytes of Python's own objects at the most while the batches, which are Arrow's, are worked on."""
    tracemalloc.start()
    try:
        for _ in run(iter(batches)):
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_texts_are_not_all_held():
    texts = pa.record_batch([pa.array(range(10_000)), pa.array(["x" * 2000] * 10_000)], names=["id", "body"])
    assert most_held(convert.rewritten(Caught(), lambda x: x[:1]), [texts, texts]) < 5_000_000
    assert most_held(convert.pieces(Caught(), "list", 300), [texts]) < 5_000_000


def test_archives_are_not_all_held():
    packed = pa.record_batch([pa.array([f"{i}.gz" for i in range(200)]), pa.array([gzip.compress(random.Random(i).randbytes(100_000)) for i in range(200)])], names=["path", "content"])
    assert most_held(archives.unpacked(Caught()), [packed, packed]) < 2_000_000


def test_subtrees_once(spark):
    """Eight chunks of a section ask for it: its text is sent once, and roots of several lengths meet their own."""
    lines = [(i, i // 16, i % 16, [f"s{i // 8}"] if i % 8 == 0 else [f"s{i // 8}", "a"], f"line {i} " * 50) for i in range(64)]
    chunks = spark.createDataFrame(lines, "id long, page_id long, sort_order long, path array<string>, content string")
    roots = chunks.select("id", "page_id", F.when(F.col("id") % 3 == 0, F.slice("path", 1, 1)).otherwise(F.col("path")).alias("root"))
    got = {r["id"]: r["content"] for r in hierarchy.subtrees(roots, chunks).collect()}
    held = lambda p, i: "".join(c for _, q, _, path, c in lines if q == lines[i][1] and path[: len(p)] == p)
    assert got == {r["id"]: held(r["root"], r["id"]) for r in roots.collect()}
    plan = hierarchy.subtrees(roots, chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.index("Join") < plan.index("collect_list")


def test_compacted_files_are_bounded(spark, tmp_path):
    spark.range(0, 40_000, 1, 16).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    ingest.compacted(many, str(tmp_path / "two"), 2)
    assert len(list((tmp_path / "two").glob("*.parquet"))) == 2
    size = sum(p.stat().st_size for p in (tmp_path / "many").glob("*.parquet"))
    ingest.compacted(many, str(tmp_path / "more"), 2, size // 4 + 1)
    assert len(list((tmp_path / "more").glob("*.parquet"))) == 4 and spark.read.parquet(str(tmp_path / "more")).count() == 40_000


def test_approximate_distinct_keeps_no_sketch_per_pair(spark, tmp_path):
    rows = [(t, i if i % 50 else None) for t in ("view", "click", None) for i in range(300)]
    spark.createDataFrame(rows * 2, "event_type string, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    df = queries()["agg_25_approximate"](spark, str(tmp_path))
    assert {(r["event_type"], r["close"]) for r in df.collect()} == {("view", True), ("click", True), (None, True)}
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert not any("approx_count_distinct" in line and "keys=[event_type" in line and "user_id" in line.split("functions=")[0] for line in plan.splitlines())


def test_conversion_asks_once(monkeypatch):
    """A link is resolved once for the list and the text; an element meets the selectors that its own attributes can fit."""
    joined, asked = [], []
    join, fits = urls.urljoin, html.Selectors._fits
    monkeypatch.setattr(urls, "urljoin", lambda b, u: joined.append(u) or join(b, u))
    monkeypatch.setattr(html.Selectors, "_fits", staticmethod(lambda n, *p: asked.append(n.tag) or fits(n, *p)))
    page = html.html_page("<p>\x1c a\n b <a href='/once-1'>x</a><a class=skip-link href='/once-2'>skip</a><img src='once.png'></p>", "https://asks-once.org/d/p")
    assert page == {"title": "Untitled", "links": ["https://asks-once.org/once-1", "https://asks-once.org/once-2"], "markdown": "a b [x](https://asks-once.org/once-1)![](https://asks-once.org/d/once.png)"}
    assert sorted(joined) == ["/once-1", "/once-2", "once.png"] and len(asked) < 40


def test_types_are_worked_out_once(spark):
    """Binary media and documents without a text have no row, and no condition repeats the type's expression below."""
    rows = [(1, "a.txt", "x"), (2, "b.png", "x"), (3, "c.pdf", "x"), (4, "d.pdf", None), (5, "e.md", None), (6, "f.pdf", "y" * (convert.MAX_DOCUMENT + 1)), (7, "g.pdf", "é" * convert.MAX_DOCUMENT)]
    pages = spark.createDataFrame(rows, "page_id long, url string, body string").withColumn("mime", F.coalesce(mime.detect("url"), F.lit("text/plain")))
    out = convert.converted(pages)
    assert sorted((r["page_id"], r["pipeline"]) for r in out.select("page_id", "pipeline").collect()) == [(1, "text"), (3, "document"), (5, "markdown"), (7, "document")]
    assert "Filter" not in out._jdf.queryExecution().optimizedPlan().toString()
