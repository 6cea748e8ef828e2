"""Ranked retrieval: zone weights and BM25."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from ..plans.lang import Leaf, UnsupportedQuery, complement, leaves, parse
from ..plans.planner import ranked
from .index import Index, documents_held, in_order, present_zones


def _zone_rating(present: list[str], columns: dict[str, Column]):
    """Rating of a leaf's word by whether each zone's column holds it."""

    def rating(x: Leaf) -> Column:
        return reduce(Column.__add__, [F.when(F.array_contains(columns[z], _word(x)), F.lit(T.WEIGHTS[z])).otherwise(0.0) for z in present])

    return rating


def _word(x: Leaf) -> str:
    if len(x.words) > 1 or x.wildcard:
        raise UnsupportedQuery(f"zone ranking takes single words, not {x}")
    return x.words[0]


def zone_search(query: str, zones: DataFrame, id_col: str = "doc_id", compat: bool = False, allow_negation: bool = False, columns: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, rating, compound_of) by the weights of the zones, columns of ``zones``, that hold a leaf's word. ``columns`` names
    the column of each zone where it isn't the zone's own name."""
    columns = columns or present_zones(zones.columns)
    present = [z for z, _ in in_order(columns)]
    words = F.struct(*[T.tokens(F.col(columns[z])).alias(z) for z in present])
    held = zones.select(F.col(id_col).alias("doc_id"), F.explode(F.array(words)).alias("_z"))  # texts are split once, whatever the query
    return ranked(query, held, _zone_rating(present, {z: F.col(f"_z.{z}") for z in present}), compat, allow_negation)


def zone_search_index(query: str, index: Index, compat: bool = False, allow_negation: bool = False) -> DataFrame:
    """As zone_search, from the zones in a saved index's postings: only those of the query's words are read."""
    node = parse(query)
    words = sorted({_word(x) for x in leaves(node)})
    hits = index.postings(words)
    by_doc = hits.groupBy("doc_id").agg(*[F.max(F.when(F.col("term") == w, F.col("zones"))).alias(f"z{i}") for i, w in enumerate(words)])
    if complement(node) and allow_negation:
        by_doc = index.documents.select("doc_id").join(by_doc, "doc_id", "left")
    return ranked(node, by_doc, lambda x: T.zone_rating(F.coalesce(F.col(f"z{words.index(_word(x))}"), F.lit(0))), compat, allow_negation)


def _with_idf(counted: DataFrame, totals: DataFrame, words: int) -> DataFrame:
    """Add avg and each word's idf from one row of n, length and each word's df."""
    idf = [T.idf(F.col("n"), F.nullif(F.col(f"df{i}"), F.lit(0))).alias(f"idf{i}") for i in range(words)]
    return counted.crossJoin(F.broadcast(totals.select(F.floor(F.col("length") / F.nullif(F.col("n"), F.lit(0))).alias("avg"), *idf)))


def _scored(docs: DataFrame, distinct: list[str], id_col: str, text_col: str, zones: dict[str, str] | None = None) -> DataFrame:
    """doc_id, dl, avg, and for each word its tf and idf. Texts are read and split once: the counts within rows, a few numbers a
    document, are kept in the shared folder, and the global sums are over those."""
    held = documents_held(docs, id_col, text_col, zones)
    tf = [F.size(F.filter("tokens", T.equals(t))).alias(f"tf{i}") for i, t in enumerate(distinct)]
    counted = storage.checkpoint(held.select("doc_id", F.size(F.array_distinct("tokens")).alias("dl"), *tf))
    totals = counted.agg(F.count("*").alias("n"), F.sum("dl").alias("length"), *[F.sum(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(distinct))])
    return _with_idf(counted, totals, len(distinct))


def _scored_index(index: Index, distinct: list[str]) -> DataFrame:
    """The same of a saved index, for documents with any of the words: only these words' postings are read."""
    hits = index.postings(distinct)
    here = [F.when(F.col("term") == w, F.col("tf")) for w in distinct]
    counted = hits.groupBy("doc_id").agg(F.max("length").alias("dl"), *[F.coalesce(F.max(x), F.lit(0)).alias(f"tf{i}") for i, x in enumerate(here)])
    n, length = index.totals()
    totals = hits.agg(F.lit(n).alias("n"), F.lit(length).alias("length"), *[F.count(x).alias(f"df{i}") for i, x in enumerate(here)])
    return _with_idf(counted, totals, len(distinct))


def bm25_rating(words: list[str], place: dict[str, int], missing: str, k: float = 1.5, b: float = 0.75) -> Column:
    """Score of a bag of words on scored rows. ``missing='skip'`` leaves absent words out; ``'stop'`` ends at the first."""
    if missing not in ("skip", "stop"):
        raise ValueError("missing must be 'skip' or 'stop'")
    score, alive = F.lit(0.0), F.lit(True)
    for i in (place[w] for w in words):
        here = F.col(f"tf{i}") > 0
        alive = alive & here if missing == "stop" else alive
        score = score + F.when(alive & here, T.bm25_part(F.col(f"idf{i}"), F.col(f"tf{i}"), F.col("dl"), F.col("avg"), k, b)).otherwise(0.0)
    return score


def _best(scored: DataFrame, words: list[str], distinct: list[str], missing: str, k: float, b: float, limit: int | None) -> DataFrame:
    rating = bm25_rating(words, {w: i for i, w in enumerate(distinct)}, missing, k, b)
    out = scored.select("doc_id", rating.alias("rating")).filter("rating > 0").orderBy(F.desc("rating"), "doc_id")
    return out.limit(limit) if limit is not None else out


def bm25(docs: DataFrame, query: str, missing: str = "skip", k: float = 1.5, b: float = 0.75, limit: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rating) of a bag of words, best first. Length is a document's distinct words, the average rounded down;
    a word that every document has counts nothing, and documents without a positive score are left out. Where the average
    is 0 all scores are."""
    words = bag(query)
    distinct = list(dict.fromkeys(words))
    if not words:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0.0).alias("rating")).limit(0)
    return _best(_scored(docs, distinct, id_col, text_col), words, distinct, missing, k, b, limit)


def bm25_index(index: Index, query: str, missing: str = "skip", k: float = 1.5, b: float = 0.75, limit: int | None = None) -> DataFrame:
    """As bm25, from a saved index."""
    words = bag(query)
    distinct = list(dict.fromkeys(words))
    if not words:
        return index.documents.select("doc_id", F.lit(0.0).alias("rating")).limit(0)
    return _best(_scored_index(index, distinct), words, distinct, missing, k, b, limit)


def bag(query: str) -> list[str]:
    """(str to list) Words of a query, repeats kept; everything else parts them."""
    return [w.lower() for w in re.findall(r"\w+", query, re.ASCII)]


def bm25_search(query: str, docs: DataFrame | Index, missing: str = "skip", compat: bool = False, allow_negation: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rating, compound_of) of a query whose leaves are bags of words, over documents or an index."""
    node = parse(query)
    words = {x: bag(str(x)) for x in leaves(node)}
    every = list(dict.fromkeys(w for ws in words.values() for w in ws))
    place = {w: i for i, w in enumerate(every)}
    if isinstance(docs, Index) and docs.saved:
        held = _scored_index(docs, every)
        if complement(node) and allow_negation:
            held = docs.documents.select("doc_id").join(held, "doc_id", "left")
    elif isinstance(docs, Index):
        held = _scored(docs.documents, every, "doc_id", text_col, docs.zones)
    else:
        held = _scored(docs, every, id_col, text_col)
    return ranked(node, held, lambda x: bm25_rating(words[x], place, missing), compat, allow_negation)
