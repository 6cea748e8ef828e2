"""One object for the whole: index documents, ask queries."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import rank
from .operators.index import Index, in_order, index_stats, present_zones
from .plans import planner
from .sources.files import read_documents
from .streaming.append import append


class SearchEngine:
    """Boolean, zone-ranked and BM25 queries over one set of documents."""

    def __init__(self, spark: SparkSession, index: Index):
        self.spark, self.index = spark, index

    @classmethod
    def of_documents(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SearchEngine:
        """Over one text column, the body."""
        return cls(docs.sparkSession, Index.of(docs, id_col, text_col))

    @classmethod
    def of_zones(cls, docs: DataFrame, id_col: str = "doc_id") -> SearchEngine:
        """Over a column for each zone: author, title, annotation, body."""
        return cls(docs.sparkSession, Index.of(docs, id_col, zones=present_zones(docs.columns)))

    @classmethod
    def of_files(cls, spark: SparkSession, paths: Sequence[str], extension: str | None = None, recursive: bool = False) -> SearchEngine:
        """Over files: books with their zones, other texts as body."""
        return cls.of_zones(read_documents(spark, paths, extension, recursive))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SearchEngine:
        return cls(spark, Index.load(spark, path))

    def save(self, path: str, parts: int | None = None, **options) -> None:
        """Write the index; see Index.save for the options."""
        self.index.save(path, parts, **options)

    def append(self, path: str, texts: DataFrame, order: str = "path") -> SearchEngine:
        append(self.spark, path, texts, order)
        return SearchEngine.load(self.spark, path)

    def search(self, query: str, limit: int | None = None, allow_negation: bool = True) -> DataFrame:
        """(doc_id) in order of ids."""
        node = planner.parse(query)
        if planner.complement(node) and not allow_negation:
            raise planner.UnsupportedQuery("the query holds for documents without any of its words")
        out = planner.search(node, self.index).orderBy("doc_id")
        return out if limit is None else out.limit(limit)

    def search_all(self, queries: Iterable[str]) -> dict[str, DataFrame]:
        return {q: self.search(q) for q in queries}

    def search_zones(self, query: str, compat: bool = False, allow_negation: bool = False) -> DataFrame:
        """(doc_id, rating, compound_of), best first."""
        if self.index.saved:
            return rank.zone_search_index(query, self.index, compat, allow_negation)
        return rank.zone_search(query, self.index.documents, "doc_id", compat, allow_negation, self.index.zones)

    def search_bm25(self, query: str, missing: str = "skip", compat: bool = False, allow_negation: bool = False) -> DataFrame:
        """(doc_id, rating, compound_of), best first."""
        return rank.bm25_search(query, self.index, missing, compat, allow_negation)

    def stats(self) -> DataFrame:
        columns = [F.coalesce(F.col(c), F.lit("")) for _, c in in_order(self.index.zones)]
        if len(columns) == 1:
            return index_stats(self.index.documents, "doc_id", next(iter(self.index.zones.values())))
        return index_stats(self.index.documents.select("doc_id", F.concat_ws("\n", *columns).alias("text")))

    def with_documents(self, found: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """Found documents, in their order, with columns of their own: the path, where files were read, or else the texts."""
        if columns is None:
            columns = ["path"] if "path" in self.index.documents.columns else [c for _, c in in_order(self.index.zones)]
        out = found.join(self.index.documents.select("doc_id", *columns), "doc_id")
        return out.orderBy(F.desc("rating"), "doc_id") if "rating" in found.columns else out.orderBy("doc_id")
