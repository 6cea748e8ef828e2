"""Phrases and proximity as tables, for use outside the query language."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lang import Leaf
from ..plans.planner import follows, positions_of, scan
from .index import documents_held


def bigram_phrase(bigrams: DataFrame, first: str, second: str) -> DataFrame:
    """(doc_id) from a bigram table."""
    return bigrams.filter((F.col("prev") == first) & (F.col("term") == second)).select("doc_id").distinct()


def phrase(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id) where each two neighbours stand together somewhere."""
    return scan(Leaf(tuple(words)), docs)


def phrase_strict(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id) where the words stand in one run."""
    held = documents_held(docs, id_col, text_col)
    run = F.lit(" ".join(words))
    return held.filter(F.contains(F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")), F.concat(F.lit(" "), run, F.lit(" ")))).select("doc_id")


def proximity(docs: DataFrame, words: list[str], gaps: list[int]) -> DataFrame:
    """(doc_id) where each word stands exactly gap + 1 words after the one before, pair by pair."""
    return scan(Leaf(tuple(words), tuple(gaps)), docs)


def within(docs: DataFrame, first: str, second: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id) where at most ``most`` words lie between the first word and a later second one."""
    held = documents_held(docs, id_col, text_col)
    tests = [follows(positions_of(F.col("tokens"), first), positions_of(F.col("tokens"), second), g) for g in range(most + 1)]
    return held.filter(reduce(lambda a, b: a | b, tests)).select("doc_id")
