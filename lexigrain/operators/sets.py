"""Sets of documents with a sign: a table of ids, or the complement of one, which is made only when it is asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class DocSet:
    """``ids`` is a (doc_id) table; ``negated`` stands for all documents without them."""

    ids: DataFrame
    negated: bool = False

    def __invert__(self) -> DocSet:
        return DocSet(self.ids, not self.negated)

    def __and__(self, other: DocSet) -> DocSet:
        if self.negated and other.negated:
            return ~(~self | ~other)
        if self.negated:
            return other & self
        how = "left_anti" if other.negated else "left_semi"
        return DocSet(self.ids.join(other.ids, "doc_id", how).distinct())

    def __or__(self, other: DocSet) -> DocSet:
        if self.negated or other.negated:
            return ~(~self & ~other)
        return DocSet(self.ids.union(other.ids).distinct())

    def within(self, documents: DataFrame) -> DataFrame:
        """The set's ids among all documents."""
        if self.negated:
            return documents.select("doc_id").join(self.ids, "doc_id", "left_anti")
        return self.ids.distinct()
