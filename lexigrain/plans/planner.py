"""From a query to one DataFrame plan.

Every leaf becomes a column, the query one boolean expression over them. Two providers give the columns:

* a scan evaluates leaves on each document's own token array. The whole query, complement included, is then one filter
  without a shuffle.
* a saved index reads the postings of the query's words (pushed down to the sorted files), brings a document's words
  together in one shuffle and filters. A query that also holds for documents without any of its words is an anti-join of the
  documents with those that fail it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from ..operators.index import Index, documents_held
from .lang import And, Leaf, Node, Not, Or, QuerySyntaxError, UnsupportedQuery, complement, leaves, normalise, parse


def positions_of(tokens: Column, word: str) -> Column:
    return F.filter(F.transform(tokens, lambda w, i: F.when(w == word, i)), lambda p: p.isNotNull())


def follows(left: Column, right: Column, gap: int) -> Column:
    """Whether some right position is ``gap`` + 1 after a left one."""
    return F.coalesce(F.arrays_overlap(F.transform(left, lambda p: p + (gap + 1)), right), F.lit(False))


def _pairs(leaf: Leaf) -> list[tuple[str, str, int]]:
    gaps = leaf.gaps or (0,) * (len(leaf.words) - 1)
    return list(zip(leaf.words, leaf.words[1:], gaps, strict=False))


def scan_column(leaf: Leaf, tokens: Column) -> Column:
    """Truth of a leaf on a token array. Phrases ask for each pair of neighbours, wherever in the document."""
    if leaf.wildcard:
        return F.exists(tokens, lambda w: T.matches(w, leaf.words[0]))
    if len(leaf.words) == 1:
        return F.array_contains(tokens, leaf.words[0])
    if leaf.gaps is None or not any(leaf.gaps):
        pairs = F.arrays_zip(tokens.alias("a"), T.rest(tokens).alias("b"))

        def together(a: str, b: str) -> Column:
            return F.exists(pairs, lambda p: (p["a"] == a) & (p["b"] == b))

        tests = [together(a, b) for a, b, _ in _pairs(leaf)]
    else:
        tests = [follows(positions_of(tokens, a), positions_of(tokens, b), g) for a, b, g in _pairs(leaf)]
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False))


def combine(node: Node, columns: dict[Leaf, Column]) -> Column:
    if isinstance(node, Leaf):
        return columns[node]
    if isinstance(node, Not):
        return ~combine(node.of, columns)
    return reduce(Column.__and__ if isinstance(node, And) else Column.__or__, [combine(p, columns) for p in node.parts])


def scan(query: str | Node, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", zones: dict[str, str] | None = None) -> DataFrame:
    """(doc_id) of the documents that match, by one pass over them."""
    node = parse(query) if isinstance(query, str) else query
    held = documents_held(docs, id_col, text_col, zones)
    tests = {x: scan_column(x, F.col("tokens")) for x in leaves(node)}
    return held.filter(combine(normalise(node), tests)).select("doc_id")


def _by_bigrams(leaf: Leaf, index: Index) -> bool:
    """Whether a phrase is answered by the bigram table, as the index has no positions."""
    return not any(leaf.gaps or ()) and "positions" not in index.tables["postings"].columns and "bigrams" in index.tables


def signals(found: list[Leaf], index: Index) -> tuple[DataFrame, dict[Leaf, Column]]:
    """What a saved index has for the leaves: one row for each document with any of their words, and each leaf's truth on it.

    Rows of the postings, of words that wildcards expand to and of the bigram table are brought together by document.
    """
    words = sorted({w for x in found if not x.wildcard for w in x.words})
    patterns = [x for x in found if x.wildcard]
    held = index.postings()
    placed = "positions" in held.columns
    near = [x for x in found if not x.wildcard and len(x.words) > 1]
    if not placed and any(any(x.gaps or ()) for x in near):
        raise UnsupportedQuery("the index has no positions, which a distance needs")
    pairs = list(dict.fromkeys((a, b) for x in near if _by_bigrams(x, index) for a, b, _ in _pairs(x)))
    none = F.array().cast("array<int>")
    signal = lambda df, name, n, at=none: df.select("doc_id", name.alias("_k"), n.alias("_i"), at.alias("positions"))
    parts = [signal(index.postings(words), F.lit("word"), F.array_position(F.lit(words), F.col("term")).cast("int") - 1, F.col("positions") if placed else none)] if words else []
    for i, x in enumerate(patterns):
        terms = storage.checkpoint(index.expand(x.words[0]))
        parts.append(signal(held.join(storage.small(terms, 40), "term", "left_semi"), F.lit("wild"), F.lit(i)))
    for i, (a, b) in enumerate(pairs):
        parts.append(signal(index.tables["bigrams"].filter((F.col("prev") == a) & (F.col("term") == b)), F.lit("pair"), F.lit(i)))
    rows = reduce(DataFrame.unionByName, parts)
    is_ = lambda name, i: (F.col("_k") == name) & (F.col("_i") == i)
    aggregates = [F.max(F.when(is_("word", i), F.col("positions"))).alias(f"p{i}") for i in range(len(words))]
    aggregates += [F.max(is_(name, i)).alias(f"{name}{i}") for name, of in (("wild", patterns), ("pair", pairs)) for i in range(len(of))]
    place = {w: F.col(f"p{i}") for i, w in enumerate(words)}

    def column(x: Leaf) -> Column:
        if x.wildcard:
            return F.col(f"wild{patterns.index(x)}")
        if len(x.words) == 1:
            return place[x.words[0]].isNotNull()
        if _by_bigrams(x, index):
            return reduce(Column.__and__, [F.col(f"pair{pairs.index((a, b))}") for a, b, _ in _pairs(x)])
        if not placed:
            return reduce(Column.__and__, [place[w].isNotNull() for w in x.words])
        return reduce(Column.__and__, [follows(place[a], place[b], g) for a, b, g in _pairs(x)])

    return rows.groupBy("doc_id").agg(*aggregates), {x: column(x) for x in found}


def search(query: str | Node, index: Index) -> DataFrame:
    """(doc_id) of the documents that match, by the postings of the query's words. Without positions a phrase is asked of the
    bigram table, and without that one it asks for its words only."""
    node = parse(query) if isinstance(query, str) else query
    if not index.saved:
        return scan(node, index.documents, zones=index.zones)
    by_doc, tests = signals(leaves(node), index)
    test = combine(normalise(node), tests)
    if complement(node):
        return index.documents.select("doc_id").join(by_doc.filter(~test).select("doc_id"), "doc_id", "left_anti")
    return by_doc.filter(test).select("doc_id")


# -- ranked ------------------------------------------------------------------------------------------------------------


def _merge(a: tuple, b: tuple, compat: bool) -> tuple[Column, Column, Column]:
    """(matches, rating, n) of two operands' union."""
    (am, ar, an), (bm, br, bn) = a, b
    both = (ar * an + (bn * an if compat else br * bn)) / (an + bn)
    return am | bm, F.when(am & bm, both).when(am, ar).otherwise(br), F.when(am & bm, an + bn).when(am, an).otherwise(bn)


def ranked_columns(node: Node, columns: dict[Leaf, tuple[Column, Column]], compat: bool = False) -> tuple[Column, Column, Column]:
    """(matches, rating, compound_of) of a query over leaves' (matches, rating).

    By default & keeps documents that match all parts, and ratings combine to their mean weighted by compound_of; what is
    negated filters and adds no rating. ``compat`` unites for & as for |, and combines as (l * ln + rn * ln) / (ln + rn).
    """
    if isinstance(node, Leaf):
        return (*columns[node], F.lit(1))
    if isinstance(node, Not):
        if compat:
            raise UnsupportedQuery("a negation has no rating")
        return ~ranked_columns(node.of, columns)[0], F.lit(0.0), F.lit(0)
    parts = [ranked_columns(p, columns, compat) for p in node.parts]
    negated = [isinstance(p, Not) for p in node.parts]
    if compat:
        return reduce(lambda a, b: _merge(a, b, True), parts)
    rated = [p for p, no in zip(parts, negated, strict=True) if not no]
    united = reduce(lambda a, b: _merge(a, b, False), rated) if rated else (F.lit(False), F.lit(0.0), F.lit(0))
    matches = reduce(Column.__and__ if isinstance(node, And) else Column.__or__, [p[0] for p in parts])
    return matches, F.when(united[0], united[1]).otherwise(0.0), F.when(united[0], united[2]).otherwise(0)


def ranked(query: str | Node, docs: DataFrame, leaf_rating, compat: bool = False, allow_negation: bool = False) -> DataFrame:
    """(doc_id, rating, compound_of), best first, ties by doc_id. ``leaf_rating`` maps a leaf to its rating column on
    ``docs``, 0 or null where the leaf doesn't match."""
    node = normalise(parse(query) if isinstance(query, str) else query)
    if complement(node) and not allow_negation:
        raise UnsupportedQuery("the query holds for documents without any of its words; allow_negation answers it with rating 0")
    found = leaves(node)
    rated = docs.select("doc_id", *[F.coalesce(leaf_rating(x), F.lit(0.0)).alias(f"r{i}") for i, x in enumerate(found)])
    columns = {x: (F.col(f"r{i}") > 0, F.col(f"r{i}")) for i, x in enumerate(found)}
    matches, rating, n = ranked_columns(node, columns, compat)
    out = rated.filter(matches).select("doc_id", rating.alias("rating"), n.cast("int").alias("compound_of"))
    return out.orderBy(F.desc("rating"), "doc_id")


__all__ = ["QuerySyntaxError", "UnsupportedQuery", "ranked", "scan", "search"]
