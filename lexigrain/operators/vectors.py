"""Sparse document vectors in long form (doc_id, term, weight): norms, products, tf-idf and leader clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from .index import documents_held, inverse_frequencies, term_frequencies


def tf_normalised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, w): occurrences over the document's tokens, made within each row."""
    held = documents_held(docs, id_col, text_col)
    return held.select("doc_id", F.size("tokens").alias("_n"), F.inline(T.counts(F.col("tokens")))).select("doc_id", F.col("item").alias("term"), (F.col("n") / F.col("_n")).alias("w"))


def tf_idf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, w): occurrences times ln(N / df)."""
    tf = term_frequencies(docs, id_col, text_col)
    return tf.join(inverse_frequencies(docs, id_col, text_col), "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))


def norms(vectors: DataFrame, weight: str = "w") -> DataFrame:
    """(doc_id, norm): root of the sum of squares."""
    return vectors.groupBy("doc_id").agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("norm"))


def dot_products(left: DataFrame, right: DataFrame, weight: str = "w") -> DataFrame:
    """(left_id, right_id, dot) for pairs with a common term; ``left`` is meant to be a stated set of queries. While that fits a
    broadcast, pairs are summed where the right document's terms are, so a common term is spread like the documents that have it."""
    a = storage.checkpoint(left.select(F.col("doc_id").alias("left_id"), "term", F.col(weight).alias("_a")))
    b = right.select(F.col("doc_id").alias("right_id"), "term", F.col(weight).alias("_b")).repartition("right_id")
    return b.join(storage.small(a, 64), "term").groupBy("left_id", "right_id").agg(F.sum(F.col("_a") * F.col("_b")).alias("dot"))


def cosines(left: DataFrame, right: DataFrame, weight: str = "w") -> DataFrame:
    """(left_id, right_id, cosine) for pairs with a common term. It is 0 where a vector has norm 0, which points nowhere."""
    a = norms(left, weight).toDF("left_id", "_a")
    b = norms(right, weight).toDF("right_id", "_b")
    got = dot_products(left, right, weight).join(a, "left_id").join(b, "right_id")
    return got.select("left_id", "right_id", F.coalesce(F.try_divide("dot", F.col("_a") * F.col("_b")), F.lit(0.0)).alias("cosine"))


def outer_zip(left: DataFrame, right: DataFrame, weight: str = "w") -> DataFrame:
    """(term, l, r) of two vectors given as (term, weight): all terms of either, 0 where one has none."""
    a, b = left.select("term", F.col(weight).alias("l")), right.select("term", F.col(weight).alias("r"))
    return a.join(b, "term", "full").select("term", F.coalesce("l", F.lit(0.0)).alias("l"), F.coalesce("r", F.lit(0.0)).alias("r"))


def select_leaders(docs: DataFrame, count: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """(doc_id) of ``count`` documents drawn by a hash of id and seed."""
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return docs.select(F.col(id_col).alias("doc_id"), key.alias("_k")).orderBy("_k", "doc_id").limit(count).select("doc_id")


def assign_leaders(vectors: DataFrame, leaders: DataFrame, weight: str = "w") -> DataFrame:
    """(doc_id, leader, cosine): the nearest leader by cosine, the smaller id on ties. Documents whose cosine with every leader
    is 0, as they share no term with one or have norm 0, go to the smallest leader with cosine 0.

    A document's terms are brought together once; all that follows (its norm, products with the leaders' terms, the best of them)
    stays in that partition while the leaders' terms are few enough to broadcast, which their count decides.
    """
    dealt = vectors.select("doc_id", "term", F.col(weight).alias("_b")).repartition("doc_id")
    chosen = storage.checkpoint(vectors.join(storage.small(leaders, 16), "doc_id", "left_semi").select(F.col("doc_id").alias("leader"), "term", F.col(weight).alias("w")))
    length = chosen.groupBy("leader").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n")).filter("n > 0")
    unit = storage.checkpoint(chosen.join(length, "leader").select("leader", "term", (F.col("w") / F.col("n")).alias("_a")))
    norm = dealt.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("_b") * F.col("_b"))).alias("_n"))
    found = dealt.join(storage.small(unit, 64), "term").groupBy("doc_id", "leader").agg(F.sum(F.col("_a") * F.col("_b")).alias("dot"))
    best = found.join(norm, "doc_id").filter("_n > 0").groupBy("doc_id").agg(F.max(F.struct(F.round(F.col("dot") / F.col("_n"), 9).alias("cosine"), (-F.col("leader")).alias("n"))).alias("b"))
    first = leaders.agg(F.min("doc_id").alias("_first"))
    got = norm.join(best, "doc_id", "left").crossJoin(F.broadcast(first))
    near = F.col("b.cosine") > 0
    return got.select("doc_id", F.when(near, -F.col("b.n")).otherwise(F.col("_first")).alias("leader"), F.when(near, F.col("b.cosine")).otherwise(0.0).alias("cosine"))
