"""What a caller asks of a corpus, over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import catalog, scan, search
from .operators.postings import Index
from .operators.versions import best_version

MAX_RESULTS = 100


class Corpus:
    """Chunks (id, page_id, library, version, sort_order, content, path, types), and, where there are, vectors (id, embedding), pages (page_id, markdown) and a stored index of the chunks that keeps types, library and version."""

    def __init__(self, chunks: DataFrame, vectors: DataFrame | None = None, pages: DataFrame | None = None, index: Index | None = None):
        self.chunks, self.vectors, self.pages, self.index = chunks, vectors, pages, index

    @staticmethod
    def of_scope(library: str | None, version: str | None) -> Column | None:
        """The condition that a library and a version set."""
        out = None
        if library is not None:
            out = F.lower(F.trim("library")) == library.strip().lower()
        if version is not None:
            own = F.coalesce("version", F.lit("")) == version.strip().lower()
            out = own if out is None else out & own
        return out

    def scoped(self, library: str | None = None, version: str | None = None) -> DataFrame:
        where = self.of_scope(library, version)
        return self.chunks if where is None else self.chunks.where(where)

    def versions(self, library: str) -> list[str]:
        """The labels of one library."""
        return sorted(r[0] or "" for r in self.scoped(library).select("version").distinct().collect())

    def find_version(self, library: str, wanted: str | None = None) -> tuple[str | None, bool]:
        return best_version(self.versions(library), wanted)

    def search(self, query: str, library: str | None = None, version: str | None = None, limit: int = 5, probe: list[float] | None = None, candidates: int | None = None, exact: bool = False) -> DataFrame:
        """Results (page_id, content, score) with context. ``exact`` needs a version."""
        if not 1 <= limit <= MAX_RESULTS:
            raise ValueError("limit must be from 1 to 100")
        if exact and not version:
            raise ValueError("an exact match needs a version")
        if library is not None and not exact:
            label, unversioned = self.find_version(library, version)
            if label is None and not unversioned:
                raise LookupError(f"no version of {library} fits {version}")
            version = label or ""
        chunks, where = self.scoped(library, version), self.of_scope(library, version)
        index = self.index.where(where) if self.index and where is not None else self.index
        n = candidates or search.ranking.candidate_window(limit, 2, 1)
        if self.vectors is None or probe is None:
            hits = search.full_text(chunks.select("id", "content", "types"), query, n, index=index)
        else:
            hits = search.hybrid(chunks.select("id", "content", "types"), self.vectors, query, probe, n, index=index)
        return search.with_context(hits.select("id", "score"), chunks, limit=limit)

    def grep(self, pattern: str, library: str | None = None, version: str | None = None, limit: int = 30) -> DataFrame:
        """Over the pages' Markdown, else over their chunks' text."""
        own = self.scoped(library, version)
        pages = self.pages.join(own.select("page_id").distinct(), "page_id", "left_semi") if self.pages is not None else own.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "id", "content"))), lambda x: x["content"]), "\n").alias("markdown"))
        return scan.grep(pages, pattern, limit)

    def read_page(self, page_id: int) -> DataFrame:
        chunks = self.chunks.where(F.col("page_id") == page_id)
        pages = self.pages.where(F.col("page_id") == page_id) if self.pages is not None else chunks.select("page_id", F.lit(None).cast("string").alias("markdown")).distinct()
        return scan.read_pages(pages, chunks)

    def list_chunks(self, library: str, version: str, text: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        return catalog.list_chunks(self.scoped(library, version), text, offset, limit)

    def catalog(self) -> DataFrame:
        have = self.vectors.select("id", F.lit(1).alias("has")) if self.vectors is not None else None
        rows = self.chunks if have is None else self.chunks.join(have, "id", "left")
        pending = F.count("*") if have is None else F.count(F.when(F.col("has").isNull(), 1))
        return catalog.catalog(rows.groupBy("library", "version", "page_id").agg(F.count("*").alias("n"), pending.alias("pending")))

    def stats(self, library: str, version: str) -> DataFrame:
        """One row: pages, chunks, embedded chunks and chunks a page (null without pages)."""
        own = self.scoped(library, version)
        rows = own.withColumn("has", F.lit(None).cast("int")) if self.vectors is None else own.join(self.vectors.select("id", F.lit(1).alias("has")), "id", "left")
        per = rows.groupBy("page_id").agg(F.count("*").alias("n"), F.count("has").alias("e"))
        return per.agg(F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("e"), F.lit(0)).alias("embedded"), F.try_divide(F.sum("n"), F.count("*")).alias("avg_chunks"))

    def validate(self, library: str) -> list[str]:
        """Empty if the library is there, else the three nearest names. Raises LookupError for an empty corpus."""
        names = self.chunks.select(F.lower(F.trim("library")).alias("library")).distinct()
        want = library.strip().lower()
        near = names.select("library", (F.levenshtein("library", F.lit(want)) / F.greatest(F.length("library"), F.lit(len(want)))).alias("d"))
        found = near.where("d <= 0.7").orderBy("d", "library").limit(3).collect()
        if found and found[0]["d"] == 0:
            return []
        if not found and names.isEmpty():
            raise LookupError("the corpus is empty")
        return [r["library"] for r in found]

    def removed(self, library: str, version: str | None = None) -> Corpus:
        """The corpus without a version, or without a library; its next state, to be written by the caller."""
        mine = F.lower(F.trim("library")) == library.strip().lower()
        if version is not None:
            mine = mine & (F.coalesce("version", F.lit("")) == version.strip().lower())
        left = self.chunks.where(~mine)
        keep = lambda t, k: None if t is None else t.join(left.select(k).distinct(), k, "left_semi")
        return Corpus(left, keep(self.vectors, "id"), keep(self.pages, "page_id"))

    def waiting(self, batch: int = 100) -> DataFrame:
        """The oldest chunks without a vector."""
        from .operators import ingest

        have = self.vectors if self.vectors is not None else self.chunks.limit(0).select("id")
        return ingest.backlog(self.chunks, have, batch)
