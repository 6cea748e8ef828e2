"""Wildcard lookups in a vocabulary by prefix and suffix, trigrams or rotations; all give the same words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

STRATEGIES = ("prefix-tree", "trigram", "relocation")
#: Table that a saved index keeps for each.
TABLES = {"prefix-tree": "reversed", "trigram": "grams", "relocation": "rotations"}


def suffix_index(vocabulary: DataFrame) -> DataFrame:
    """(reversed, term): words by their end, as a sorted vocabulary has them by their beginning."""
    return vocabulary.select(F.reverse("term").alias("reversed"), "term")


def trigram_index(vocabulary: DataFrame) -> DataFrame:
    """(gram, term)."""
    return vocabulary.select(F.explode(F.array_distinct(T.trigrams(F.col("term")))).alias("gram"), "term")


def permuterm_index(vocabulary: DataFrame) -> DataFrame:
    """(rotation, term)."""
    return vocabulary.select(F.explode(T.rotations(F.col("term"))).alias("rotation"), "term")


def index_table(vocabulary: DataFrame, strategy: str) -> DataFrame:
    """What a saved index keeps for a strategy."""
    return {"prefix-tree": suffix_index, "trigram": trigram_index, "relocation": permuterm_index}[strategy](vocabulary)


def by_prefix(vocabulary: DataFrame, pattern: str, suffixes: DataFrame | None = None) -> DataFrame:
    """Candidates by what stands before the first * and after the last; then verified. A sorted vocabulary prunes by prefix, a
    sorted ``suffixes`` table patterns without one by suffix."""
    head, tail = pattern.split("*", 1)[0], pattern.rsplit("*", 1)[-1]
    if suffixes is not None and "*" in pattern and len(tail) > len(head):
        return suffixes.filter(F.col("reversed").startswith(tail[::-1])).filter(T.matches("term", pattern)).select("term")
    out = vocabulary.filter(F.col("term").startswith(head)) if head else vocabulary
    if tail and "*" in pattern:
        out = out.filter(F.col("term").endswith(tail))
    return out.filter(T.matches("term", pattern)).select("term")


def by_trigrams(grams: DataFrame, pattern: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """Words that have all the pattern's trigrams, verified. Patterns without a trigram fall back to the vocabulary."""
    needed = T.wildcard_trigrams(pattern)
    if not needed:
        words = vocabulary.select("term") if vocabulary is not None else grams.select("term").distinct()
    else:
        words = grams.filter(F.col("gram").isin(needed)).groupBy("term").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(needed))
    return words.filter(T.matches("term", pattern)).select("term")


def by_rotation(rotations: DataFrame, pattern: str) -> DataFrame:
    """Words of the rotations that begin with the pattern's end, the end mark and its beginning, verified."""
    head, tail = pattern.split("*", 1)[0], pattern.rsplit("*", 1)[-1]
    start = f"{tail}{T.END}{head}" if "*" in pattern else f"{pattern}{T.END}"
    return rotations.filter(F.col("rotation").startswith(start)).select("term").filter(T.matches("term", pattern)).distinct()


def expand(vocabulary: DataFrame, pattern: str, strategy: str = "prefix-tree") -> DataFrame:
    """(term) of the words that match, by one of STRATEGIES."""
    if strategy == "prefix-tree":
        return by_prefix(vocabulary, pattern)
    if strategy == "trigram":
        return by_trigrams(trigram_index(vocabulary), pattern, vocabulary)
    if strategy == "relocation":
        return by_rotation(permuterm_index(vocabulary), pattern)
    raise ValueError(f"strategy must be one of {STRATEGIES}")


def documents(terms: DataFrame, expanded: DataFrame) -> DataFrame:
    """(doc_id) of documents with any of the expanded words, from (term, doc_id)."""
    return terms.join(expanded, "term", "left_semi").select("doc_id").distinct()
