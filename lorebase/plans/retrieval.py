"""Search, context, scans: RET-01..16, RET-19, RET-20 and SRT-01/03 entries of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, postings, scan, search
from ..registry import query
from ..tables import CHUNKS

QUERY = '"of the" tion'
_W = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
#: BM25 of the query's three phrases over documents, in SQL: the whole, the quoted part, the word.
_BM25 = rf"""k AS MATERIALIZED (SELECT doc_id, len(w) AS n, ' ' || array_to_string(w, '  ') || ' ' AS x FROM (SELECT doc_id, {_W} AS w FROM documents)),
c AS MATERIALIZED (SELECT doc_id, n, ((length(x) - length(replace(x, ' of  the  tion ', ''))) // 15) AS t0, ((length(x) - length(replace(x, ' of  the ', ''))) // 9) AS t1, ((length(x) - length(replace(x, ' tion ', ''))) // 6) AS t2 FROM k),
s AS (SELECT count(*) AS nr, avg(n) AS a, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM c),
b AS (SELECT doc_id AS id, round(
  CASE WHEN t0 > 0 THEN greatest(ln((nr - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / a)) ELSE 0 END +
  CASE WHEN t1 > 0 THEN greatest(ln((nr - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / a)) ELSE 0 END +
  CASE WHEN t2 > 0 THEN greatest(ln((nr - d2 + 0.5) / (d2 + 0.5)), 1e-6) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * n / a)) ELSE 0 END, 6)::DOUBLE AS score FROM c, s WHERE t0 > 0 OR t1 > 0 OR t2 > 0)"""


def docs(t):
    return t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


@query("ret_01_match", rf"WITH k AS (SELECT doc_id, ' ' || array_to_string({_W}, '  ') || ' ' AS x FROM documents WHERE lang = 'en') SELECT doc_id AS id FROM k WHERE contains(x, ' of  the ') OR contains(x, ' tion ')")
def _(t):
    """The rows of one version that hold any phrase of the query."""
    return postings.hits(t.index("documents").where("lang = 'en'"), [["of", "the"], ["tion"]]).select("id")


@query("mth_02_bm25", f"WITH {_BM25} SELECT id, score FROM b")
def _(t):
    x = postings.bm25(t.index("documents"), search.parsed(QUERY))
    return x.select("id", F.round("score", 6).alias("score"))


@query("srt_03_full_text_top", f"WITH {_BM25} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b ORDER BY score DESC, id LIMIT 10")
def _(t):
    return search.full_text(docs(t), QUERY, 10, index=t.index("documents"))


@query("ret_02_full_text", rf"""WITH {CHUNKS}, k AS MATERIALIZED (SELECT id, types, len(w) AS n, ' ' || array_to_string(w, '  ') || ' ' AS x FROM (SELECT id, types, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+') AS w FROM chunks)), c AS MATERIALIZED (SELECT id, types, n, ((length(x) - length(replace(x, ' with ', ''))) // 6) AS t FROM k),
s AS (SELECT count(*) AS nr, avg(n) AS a, count(*) FILTER (t > 0) AS d FROM c), b AS (SELECT id, round(greatest(ln((nr - d + 0.5) / (d + 0.5)), 1e-6) * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * n / a)), 6)::DOUBLE AS score FROM c, s WHERE t > 0 AND NOT list_contains(types, 'structural'))
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b ORDER BY score DESC, id LIMIT 20""")
def _(t):
    return hits(t)


def hits(t):
    return search.full_text(t.chunks().select("id", "content", "types"), "with", 20, index=t.index("chunks"))


_KNN = "v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY d, vec_id) AS vec_rank FROM (SELECT e.vec_id, round(sqrt(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) ** 2))), 6) AS d FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q) ORDER BY d, vec_id LIMIT 200)"
_HYBRID = f"""WITH {_BM25}, f AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS fts_rank FROM b ORDER BY score DESC, id LIMIT 200), {_KNN},
h AS (SELECT id, vec_rank, fts_rank, round(coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + fts_rank), 0), 9) AS score FROM v FULL JOIN f USING (id))"""


def parts(t):
    vecs = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    probe = t.embeddings.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return docs(t), vecs, QUERY, probe


@query("ret_03_hybrid", f"{_HYBRID} SELECT id, vec_rank, fts_rank, score FROM h ORDER BY score DESC, id LIMIT 10")
def _(t):
    return search.hybrid(*parts(t), limit=10, index=t.index("documents"))


@query("srt_01_top_by_fusion", f"{_HYBRID} SELECT id, score FROM h ORDER BY score DESC, id LIMIT 3")
def _(t):
    # the window of candidates is that of ten results here as well
    return search.hybrid(*parts(t), limit=10, index=t.index("documents")).orderBy(F.desc("score"), "id").limit(3).select("id", "score")


@query("ret_04_degraded", f"WITH {_BM25}, f AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS fts_rank FROM b) SELECT id, NULL::BIGINT AS vec_rank, fts_rank, round(1.0::DOUBLE / (60 + fts_rank), 9) AS score FROM f ORDER BY score DESC, id LIMIT 10")
def _(t):
    return search.hybrid(docs(t), None, QUERY, None, limit=10, index=t.index("documents"))


_CHUNK_HITS = rf"""k AS MATERIALIZED (SELECT id, page_id, sort_order, types, len(w) AS n, ' ' || array_to_string(w, '  ') || ' ' AS x FROM (SELECT id, page_id, sort_order, types, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+') AS w FROM chunks)), c AS MATERIALIZED (SELECT *, ((length(x) - length(replace(x, ' with ', ''))) // 6) AS t FROM k),
s AS (SELECT count(*) AS nr, avg(n) AS a, count(*) FILTER (t > 0) AS d FROM c),
hits AS (SELECT id, page_id, sort_order, round(greatest(ln((nr - d + 0.5) / (d + 0.5)), 1e-6) * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * n / a)), 6)::DOUBLE AS score FROM c, s WHERE t > 0 AND NOT list_contains(types, 'structural') ORDER BY score DESC, id LIMIT 20),
cl AS (SELECT *, sum(f) OVER (PARTITION BY page_id ORDER BY sort_order ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN sort_order - lag(sort_order) OVER (PARTITION BY page_id ORDER BY sort_order) > 3 THEN 1 ELSE 0 END AS f FROM hits)),
p AS (SELECT * FROM chunks WHERE page_id IN (SELECT page_id FROM hits)),
near AS (SELECT h.id AS hit, h.id FROM hits h
  UNION SELECT h.id, (SELECT q.id FROM p q WHERE q.page_id = o.page_id AND q.path = o.path[1:-2] AND q.sort_order < o.sort_order ORDER BY q.sort_order DESC LIMIT 1) FROM hits h JOIN p o USING (id)
  UNION SELECT h.id, x.v FROM hits h JOIN (SELECT id, unnest([lag(id) OVER w, lead(id) OVER w, lead(id, 2) OVER w]) AS v FROM p WINDOW w AS (PARTITION BY page_id, path ORDER BY sort_order, id)) x ON x.id = h.id
  UNION SELECT id, child FROM (SELECT o.id, q.id AS child, row_number() OVER (PARTITION BY o.id ORDER BY q.sort_order, q.id) AS r FROM hits h JOIN p o USING (id) JOIN p q ON q.page_id = o.page_id AND q.path[1:-2] = o.path AND q.sort_order > o.sort_order) WHERE r <= 3),
m AS (SELECT DISTINCT cl.page_id, cl.cluster, near.id FROM near JOIN cl ON cl.id = near.hit WHERE near.id IS NOT NULL),
body AS (SELECT m.page_id, m.cluster, string_agg(p.content, chr(10) || chr(10) ORDER BY p.sort_order, p.id) AS content FROM m JOIN p USING (id) GROUP BY 1, 2),
r AS (SELECT page_id, content, score FROM body JOIN (SELECT page_id, cluster, max(score) AS score FROM cl GROUP BY 1, 2) USING (page_id, cluster))"""


@query("ret_05_search_with_context", f"WITH {CHUNKS}, {_CHUNK_HITS} SELECT page_id, content, score FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY score DESC, page_id) AS n FROM r) WHERE n = 1 ORDER BY score DESC, page_id LIMIT 10")
def _(t):
    """The flagship: full-text hits over chunks, clustered, with parents, neighbours and children, assembled and deduplicated."""
    chunks = t.chunks()
    return search.with_context(hits(t), chunks)


@query("ret_06_strategy", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'markdown' ELSE 'hierarchical' END AS strategy FROM events")
def _(t):
    from ..functions import mime

    m = F.when(F.col("event_id") % 3 == 0, "text/markdown").when(F.col("event_id") % 3 == 1, "application/json").otherwise("text/x-python")
    return t.events.select("event_id", F.when(mime.is_source_code(m) | mime.is_json(m), "hierarchical").otherwise("markdown").alias("strategy"))


@query("ret_07_markdown_context", f"WITH {CHUNKS}, {_CHUNK_HITS} SELECT DISTINCT hit, id FROM near WHERE id IS NOT NULL")
def _(t):
    chunks = t.chunks()
    own = chunks.join(F.broadcast(hits(t).select("id")), "id").select("id", "page_id")  # the search limit bounds it
    return context.expanded(own, chunks)


_SUB = f"WITH {CHUNKS}, h AS (SELECT id, page_id, path FROM chunks)"


def picked(t):
    """Every chunk as a hit."""
    return t.chunks().select("id", "page_id", "path")


@query("ret_08_hierarchy_single", f"{_SUB} SELECT h.id, md5(string_agg(c.content, '' ORDER BY c.sort_order)) AS body FROM h JOIN chunks c ON c.page_id = h.page_id AND c.path[1] = h.path[1] GROUP BY h.id")
def _(t):
    """A hit's section: from its top-level ancestor the whole subtree, joined without a separator."""
    top = picked(t).select("id", "page_id", F.slice("path", 1, 1).alias("root"))
    return context_subtree(t, top).select("id", F.md5("content").alias("body"))


def context_subtree(t, roots):
    from ..operators import hierarchy

    return hierarchy.subtrees(roots, t.chunks())


@query("ret_09_hierarchy_many", f"{_SUB}, g AS (SELECT page_id, path[1] AS s FROM h GROUP BY 1, 2) SELECT g.page_id, g.s, count(*) AS n FROM g JOIN chunks c ON c.page_id = g.page_id AND c.path[1] = g.s GROUP BY 1, 2")
def _(t):
    """Several hits of a section: their common ancestor's subtree."""
    from ..operators import hierarchy

    groups = context.common_prefix(picked(t).withColumn("s", F.element_at("path", 1)), ["page_id", "s"], "path")
    return hierarchy.members(groups.select("page_id", "s", F.slice("prefix", 1, 1).alias("root")), t.chunks()).groupBy("page_id", "s").agg(F.count("*").alias("n"))


@query("ret_10_walk_to_root", f"{_SUB} SELECT h.id, c.id AS ancestor FROM h JOIN chunks c ON c.page_id = h.page_id AND len(c.path) < len(h.path) AND h.path[1:len(c.path)] = c.path")
def _(t):
    from ..operators import hierarchy

    return hierarchy.chain(picked(t), t.chunks().select("id", "page_id", "path"), 10)


@query("ret_11_structural_ancestor", f"{_SUB} SELECT h.id, max(len(c.path)) AS level FROM h JOIN chunks c ON c.page_id = h.page_id AND len(c.path) < len(h.path) AND h.path[1:len(c.path)] = c.path AND list_contains(c.types, 'heading') GROUP BY h.id")
def _(t):
    marked = t.chunks().where(F.array_contains("types", "heading")).select("page_id", "path").distinct()
    return context.ancestors(picked(t), marked).select("id", F.size("ancestor").cast("long").alias("level"))


@query("ret_12_subtree", f"WITH {CHUNKS}, h AS (SELECT id, page_id, path FROM chunks WHERE len(path) = 1) SELECT h.id, c.id AS member FROM h JOIN chunks c ON c.page_id = h.page_id AND c.path[1] = h.path[1]")
def _(t):
    from ..operators import hierarchy

    roots = t.chunks().where("level = 1").select("id", "page_id", F.col("path").alias("root"))
    return hierarchy.members(roots, t.chunks().select(F.col("id").alias("member"), "page_id", "path")).select("id", "member")


@query("ret_13_exact_path", f"WITH {CHUNKS} SELECT id FROM chunks WHERE path = ['s1', 'a']")
def _(t):
    return t.chunks().where(F.col("path") == F.array(F.lit("s1"), F.lit("a"))).select("id")


@query("ret_14_fallback", f"{_SUB} SELECT id AS hit, id FROM h UNION SELECT h.id, q.id FROM (SELECT id, page_id, path[1:-2] AS up, sort_order FROM chunks WHERE len(path) > 0) h ASOF LEFT JOIN chunks q ON q.page_id = h.page_id AND q.path = h.up AND q.sort_order < h.sort_order")
def _(t):
    chunks = t.chunks().select("id", "page_id", "sort_order", "path")
    up = context.parents(chunks).join(picked(t).select("id"), "id", "left_semi").select(F.col("id").alias("hit"), F.col("parent").alias("id"))
    return picked(t).select(F.col("id").alias("hit"), "id").union(up).distinct()


@query("ret_15_concatenate", f"WITH {CHUNKS} SELECT page_id, md5(string_agg(content, '' ORDER BY sort_order)) AS body FROM chunks WHERE level = 3 GROUP BY page_id")
def _(t):
    return context.assembled(t.chunks().where("level = 3").select("page_id", "sort_order", "id", "content"), ["page_id"], "").select("page_id", F.md5("content").alias("body"))


@query("ret_16_search_tool", f"WITH {CHUNKS}, {_CHUNK_HITS} SELECT page_id, score, length(content) AS n FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY score DESC, page_id) AS n0 FROM r) WHERE n0 = 1 ORDER BY score DESC, page_id LIMIT 5")
def _(t):
    from ..api import Corpus

    return Corpus(t.chunks(), index=t.index("chunks")).search("with", limit=5, candidates=20).select("page_id", "score", F.length("content").cast("long").alias("n"))


@query("ret_19_grep", f"WITH {CHUNKS}, g AS (SELECT page_id, sort_order + 1 AS line, content, count(*) OVER () AS total, row_number() OVER (ORDER BY page_id, sort_order) AS r FROM chunks WHERE regexp_matches(content, '(?i)th[aeiou]+n ')) SELECT page_id, line, total, md5(content) AS line_md5 FROM g WHERE r <= 30")
def _(t):
    pages = t.documents.select(F.col("doc_id").alias("page_id"), F.col("text").alias("markdown"))
    return scan.grep(pages, "/th[aeiou]+n /i", 30).select("page_id", "line", "total", F.md5("content").alias("line_md5"))


@query("ret_20_read_page", f"WITH {CHUNKS} SELECT d.doc_id AS page_id, md5(coalesce(CASE WHEN d.doc_id % 3 > 0 THEN d.text END, (SELECT string_agg(content, chr(10) || chr(10) ORDER BY sort_order) FROM chunks c WHERE c.page_id = d.doc_id))) AS body FROM documents d")
def _(t):
    pages = t.documents.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 3 > 0, F.col("text")).alias("markdown"))
    return scan.read_pages(pages, t.chunks()).select("page_id", F.md5("content").alias("body"))
