"""Queries over the test tables, one or more for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import index as I
from .operators import cosine_blocks, phrase, rank, vectors, wildcard
from .operators.sets import DocSet
from .plans import planner
from .session import ship
from .sources import books
from .storage import names, scratch, spread
from .streaming.append import append

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Pieces of the SQL: token arrays, token rows, vocabulary.
W = r"d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\w+'), lambda x: lower(x)) AS w FROM documents)"
TOK = W + ", tok AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM d)"
VOC = TOK + ", tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL), voc AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term)"
ZON = (
    r"z0 AS (SELECT page_id AS doc_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, "
    r"regexp_replace(regexp_replace(html, '(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS body FROM pages), "
    r"z AS (SELECT doc_id, list_transform(regexp_extract_all(title, '\w+'), lambda x: lower(x)) AS t, list_transform(regexp_extract_all(body, '\w+'), lambda x: lower(x)) AS b FROM z0)"
)


def register(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return books.page_zones(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))


_saved: dict[tuple[str, str, str], str] = {}


def saved_index(spark: SparkSession, sf: str, table: str = "documents") -> I.Index:
    """The saved index of a table, written once in a session's life (to a scratch folder) and loaded for each query. Pages are
    indexed by zone. The index has positions, bigrams and the tables of every wildcard strategy."""
    key = (spark.sparkContext.applicationId, sf, table)
    if key not in _saved or not names(spark, _saved[key]):
        path = scratch(spark, "index")
        source = zones(spark, sf) if table == "pages" else documents(spark, sf).select("doc_id", "text")
        index = I.Index.of(source, zones=I.present_zones(source.columns) or None)
        index.save(path, bigrams=True, wildcards=wildcard.STRATEGIES if table == "documents" else ())
        _saved[key] = path
    return I.Index.load(spark, _saved[key])


# -- tokens and indexes ------------------------------------------------------------------------------------------------


@register("tokenize", f"WITH {TOK} SELECT doc_id, CAST(pos AS BIGINT) AS pos, term FROM tok")
def _tokenize(spark, sf):
    return I.token_table(documents(spark, sf)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "term")


@register("term_positions", f"WITH {TOK} SELECT term, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM tok WHERE term IN ('und', 'der') GROUP BY ALL")
def _term_positions(spark, sf):
    got = I.Index.of(documents(spark, sf)).postings(["und", "der"])
    return got.select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@register("postings_tf", f"WITH {VOC} SELECT term, doc_id, tf FROM tf")
def _postings_tf(spark, sf):
    return I.term_frequencies(documents(spark, sf)).select("term", "doc_id", "tf")


@register("bigram_index", f"WITH {TOK} SELECT a.term AS prev, b.term AS term, doc_id, count(*) AS n FROM tok a JOIN tok b USING (doc_id) WHERE a.pos + 1 = b.pos GROUP BY ALL")
def _bigram_index(spark, sf):
    return I.bigrams(documents(spark, sf))


@register("vocabulary_df", f"WITH {VOC} SELECT term, df, cf FROM voc")
def _vocabulary_df(spark, sf):
    return I.vocabulary(documents(spark, sf))


@register("idf", f"WITH {VOC} SELECT term, df, round(ln((SELECT count(*) FROM documents) / df), 9) AS idf FROM voc")
def _idf(spark, sf):
    return I.inverse_frequencies(documents(spark, sf)).withColumn("idf", F.round("idf", 9))


@register("doc_stats", f"WITH {W} SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_tokens, CAST(coalesce(len(list_distinct(w)), 0) AS BIGINT) AS n_terms FROM d")
def _doc_stats(spark, sf):
    return I.document_stats(documents(spark, sf))


@register(
    "index_stats",
    f"WITH {VOC}, b AS (SELECT count(*) AS documents, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM documents), "
    "v AS (SELECT CAST(coalesce(sum(cf), 0) AS BIGINT) AS n_tokens, count(*) AS n_terms FROM voc) "
    "SELECT documents, n_tokens, n_terms, bytes, round(floor(bytes / 1024) / 1024.0, 2) AS megabytes FROM b, v",
)
def _index_stats(spark, sf):
    return I.index_stats(documents(spark, sf))


_BOUNDS = T.range_delimiters(4)


@register(
    "range_dictionary",
    f"WITH {VOC} SELECT {' + '.join(f'CASE WHEN term >= {b!r} THEN 1 ELSE 0 END' for b in _BOUNDS)} AS range_id, term, doc_id, 8 AS zones FROM tf",
)
def _range_dictionary(spark, sf):
    return I.range_dictionary(documents(spark, sf), 4)


@register("posting_gaps", f"WITH {VOC} SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM tf")
def _posting_gaps(spark, sf):
    return I.posting_gaps(documents(spark, sf))


@register("append_index", r"""WITH every AS (SELECT text FROM documents UNION ALL SELECT text FROM benchmark), n AS (SELECT row_number() OVER () AS id, text FROM every),
t AS (SELECT id, lower(unnest(regexp_extract_all(text, '\w+'))) AS term FROM n) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM t GROUP BY term""")
def _append_index(spark, sf):
    path = scratch(spark, "index")
    I.Index.of(documents(spark, sf).select("doc_id", "text")).save(path)
    append(spark, path, spark.read.parquet(f"{sf}/benchmark.parquet"), order="item_id")
    return I.Index.load(spark, path).vocabulary()


@register("json_index", f"WITH {VOC} SELECT term, df, cf FROM voc")
def _json_index(spark, sf):
    path = scratch(spark, "index")
    I.Index.of(documents(spark, sf).select("doc_id", "text")).save(path, kind="json")
    return I.Index.load(spark, path).vocabulary()


@register("index_manifest", f"WITH {VOC} SELECT {' + '.join(f'CASE WHEN term >= {b!r} THEN 1 ELSE 0 END' for b in _BOUNDS)} AS range_id, min(term) AS first_term, max(term) AS last_term, count(*) AS rows FROM tf GROUP BY ALL")
def _index_manifest(spark, sf):
    """Ranges between delimiters, each a folder with one or more files."""
    path = scratch(spark, "index")
    I.Index.of(documents(spark, sf).select("doc_id", "text")).save(path, delimiters=_BOUNDS)
    return I.Index.manifest(spark, path).groupBy("range_id").agg(F.min("first_term").alias("first_term"), F.max("last_term").alias("last_term"), F.sum("rows").alias("rows"))


@register("index_range_lookup", f"WITH {VOC} SELECT term, doc_id, tf FROM tf WHERE term IN ('und', 'der', 'zzzz')")
def _index_range_lookup(spark, sf):
    """Words are looked up in the folders of their ranges only."""
    path = scratch(spark, "index")
    I.Index.of(documents(spark, sf).select("doc_id", "text")).save(path, delimiters=_BOUNDS)
    return I.Index.load(spark, path).postings(["und", "der", "zzzz"]).select("term", "doc_id", "tf")


@register("index_remove", f"WITH {VOC}, k AS (SELECT term, doc_id, tf FROM tf WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM k GROUP BY term")
def _index_remove(spark, sf):
    """Documents taken out of a saved index."""
    path = scratch(spark, "index")
    I.Index.of(documents(spark, sf).select("doc_id", "text")).save(path)
    I.Index.remove(spark, path, spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1"))
    return I.Index.load(spark, path).vocabulary()


@register("deregister", f"WITH {VOC}, k AS (SELECT term, doc_id FROM tf WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT term, count(*) AS df FROM k GROUP BY term")
def _deregister(spark, sf):
    toxic = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1")
    return I.Index.of(documents(spark, sf)).without(toxic).vocabulary().select("term", "df")


# -- lookups and the boolean language ----------------------------------------------------------------------------------

_HAS = "list_contains(w, '{}')"


def _sql(condition: str) -> str:
    """``{word}`` stands for a document's having it."""
    import re

    return f"WITH {W} SELECT doc_id FROM d WHERE {re.sub(r'{(\w+)}', lambda m: _HAS.format(m[1]), condition)}"


_BOOLEAN = {
    "term_lookup": ("the", "{the}"),
    "term_lookup_missing": ("zzzzunknown", "{zzzzunknown}"),
    "bool_and": ("und & der", "{und} AND {der}"),
    "bool_or": ("und | pour", "{und} OR {pour}"),
    "bool_not": ("!the", "NOT {the}"),
    "bool_and_not": ("the & !(of | and)", "{the} AND NOT ({of} OR {and})"),
    "bool_nested": ("(und | pour) & !(der | anat)", "({und} OR {pour}) AND NOT ({der} OR {anat})"),
    "bool_nary": ("the & of & and & anat", "{the} AND {of} AND {and} AND {anat}"),
    "bool_de_morgan": ("!(und | pour)", "NOT {und} AND NOT {pour}"),
    "bool_double_negated_or": ("!und | !der", "NOT {und} OR NOT {der}"),
}
for _name, (_query, _condition) in _BOOLEAN.items():
    register(_name, _sql(_condition))(lambda spark, sf, q=_query: planner.scan(q, documents(spark, sf)))


_INDEXED = {
    "index_search": ("(the & !(of | and)) | (und & der)", _sql("({the} AND NOT ({of} OR {and})) OR ({und} AND {der})")),
    "index_search_complement": ("!(the & of)", _sql("NOT ({the} AND {of})")),
    "index_wildcard": ("re*ing | *anat*", f"WITH {TOK} SELECT DISTINCT doc_id FROM tok WHERE term LIKE 're%ing' OR term LIKE '%anat%'"),
}


def _indexed(query: str):
    return lambda spark, sf: planner.search(query, saved_index(spark, sf))


for _name, (_query, _oracle) in _INDEXED.items():
    register(_name, _oracle)(_indexed(_query))


@register("search_with_metadata", f"WITH {W} SELECT doc_id, lang, source FROM d JOIN documents USING (doc_id) WHERE list_contains(w, 'und') AND list_contains(w, 'der')")
def _search_with_metadata(spark, sf):
    docs = documents(spark, sf)
    return planner.scan("und & der", docs).join(docs.select("doc_id", "lang", "source"), "doc_id")


@register("set_algebra", _sql("({the} OR {of}) AND NOT {and}"))
def _set_algebra(spark, sf):
    docs = documents(spark, sf)
    one = {w: DocSet(planner.scan(w, docs)) for w in ("the", "of", "and")}
    return ((one["the"] | one["of"]) & ~one["and"]).within(docs)


# -- phrases -----------------------------------------------------------------------------------------------------------


def _pair(a: str, b: str, gap: int = 0) -> str:
    return f"SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + {gap + 1} WHERE a.term = '{a}' AND b.term = '{b}'"


@register("bigram_phrase", f"WITH {TOK} {_pair('of', 'the')}")
def _bigram_phrase(spark, sf):
    return phrase.bigram_phrase(I.bigrams(documents(spark, sf)), "of", "the")


@register("phrase_pairwise", f"WITH {TOK} {_pair('of', 'the')} INTERSECT {_pair('the', 'and')}")
def _phrase_pairwise(spark, sf):
    return planner.scan("of the and", documents(spark, sf))


register("index_phrase", f"WITH {TOK} {_pair('of', 'the')} INTERSECT {_pair('the', 'and')}")(_indexed("of the and"))
register("index_proximity", f"WITH {TOK} {_pair('of', 'the', 3)}")(_indexed("of /3 the"))


@register("phrase_strict", f"WITH {TOK} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN tok c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE a.term = 'of' AND b.term = 'the' AND c.term = 'and'")
def _phrase_strict(spark, sf):
    return phrase.phrase_strict(documents(spark, sf), ["of", "the", "and"])


@register("proximity_k", f"WITH {TOK} {_pair('of', 'the', 3)}")
def _proximity_k(spark, sf):
    return planner.scan("of /3 the", documents(spark, sf))


@register("proximity_chain", f"WITH {TOK} {_pair('of', 'the', 1)} INTERSECT {_pair('the', 'and', 2)}")
def _proximity_chain(spark, sf):
    return planner.scan("of /1 the /2 and", documents(spark, sf))


@register("proximity_within", f"WITH {TOK} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN 1 AND 4 WHERE a.term = 'of' AND b.term = 'the'")
def _proximity_within(spark, sf):
    return phrase.within(documents(spark, sf), "of", "the", 3)


# -- wildcards ---------------------------------------------------------------------------------------------------------

for _name, _pattern, _strategy in (
    ("wildcard_prefix", "re*", "prefix-tree"), ("wildcard_suffix", "*ing", "prefix-tree"), ("wildcard_infix", "*anat*", "prefix-tree"), ("wildcard_multi", "r*e*ing", "prefix-tree"),
    ("wildcard_trigram", "re*ing", "trigram"), ("wildcard_permuterm", "re*ing", "relocation"),
):
    register(_name, f"WITH {VOC} SELECT term FROM voc WHERE term LIKE '{_pattern.replace('*', '%')}'")(
        lambda spark, sf, p=_pattern, s=_strategy: wildcard.expand(I.distinct_terms(documents(spark, sf)).select("term").distinct(), p, s)
    )


@register("wildcard_docs", f"WITH {TOK} SELECT DISTINCT doc_id FROM tok WHERE term LIKE 're%ing'")
def _wildcard_docs(spark, sf):
    return planner.scan("re*ing", documents(spark, sf))


@register("trigram_index", f"WITH {VOC}, p AS (SELECT term, '$' || term || '$' AS s FROM voc) SELECT DISTINCT substr(s, i, 3) AS gram, term FROM (SELECT term, s, unnest(range(1, length(s) - 1)) AS i FROM p)")
def _trigram_index(spark, sf):
    return wildcard.trigram_index(I.distinct_terms(documents(spark, sf)).select("term").distinct())


@register("permuterm_index", f"WITH {VOC}, p AS (SELECT term, term || '$' AS s FROM voc) SELECT substr(s, i) || substr(s, 1, i - 1) AS rotation, term FROM (SELECT term, s, unnest(range(1, length(s) + 1)) AS i FROM p)")
def _permuterm_index(spark, sf):
    return wildcard.permuterm_index(I.distinct_terms(documents(spark, sf)).select("term").distinct())


# -- ranked ------------------------------------------------------------------------------------------------------------


def _rating(word: str) -> str:
    return f"(CASE WHEN list_contains(t, '{word}') THEN 0.3 ELSE 0.0 END + CASE WHEN list_contains(b, '{word}') THEN 0.1 ELSE 0.0 END)"


def _two(how: str, a: str = "the", b: str = "und") -> str:
    both = "(x + y) / 2" if how != "compat" else "(x + 1) / 2"
    keep = "x > 0 AND y > 0" if how == "and" else "x > 0 OR y > 0"
    return (
        f"WITH {ZON}, r AS (SELECT doc_id, CAST({_rating(a)} AS DOUBLE) AS x, CAST({_rating(b)} AS DOUBLE) AS y FROM z) "
        f"SELECT doc_id, round(CASE WHEN x > 0 AND y > 0 THEN {both} WHEN x > 0 THEN x ELSE y END, 9) AS rating, CASE WHEN x > 0 AND y > 0 THEN 2 ELSE 1 END AS compound_of FROM r WHERE {keep}"
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("rating", F.round("rating", 9))


@register("pages_zones", f"WITH {ZON} SELECT doc_id, title, body FROM z0")
def _pages_zones(spark, sf):
    return zones(spark, sf)


@register("zone_postings", f"WITH {ZON}, p AS (SELECT doc_id, unnest(t) AS term, 2 AS zone FROM z UNION ALL SELECT doc_id, unnest(b), 8 FROM z) SELECT term, doc_id, count(*) AS tf, bit_or(zone) AS zones FROM p GROUP BY ALL")
def _zone_postings(spark, sf):
    pages = zones(spark, sf)
    return I.postings(pages, I.present_zones(pages.columns)).select("term", "doc_id", "tf", "zones")


@register("zone_rating", f"WITH {ZON}, p AS (SELECT doc_id, unnest(t) AS term, 2 AS zone FROM z UNION ALL SELECT doc_id, unnest(b), 8 FROM z), g AS (SELECT term, doc_id, bit_or(zone) AS zones FROM p GROUP BY ALL) SELECT term, doc_id, round(CAST((CASE WHEN zones & 2 <> 0 THEN 0.3 ELSE 0 END) + (CASE WHEN zones & 8 <> 0 THEN 0.1 ELSE 0 END) AS DOUBLE), 9) AS rating FROM g")
def _zone_rating(spark, sf):
    pages = zones(spark, sf)
    got = I.postings(pages, I.present_zones(pages.columns))
    return _rounded(got.select("term", "doc_id", T.zone_rating("zones").alias("rating")))


@register("zone_search", f"WITH {ZON}, r AS (SELECT doc_id, CAST({_rating('the')} AS DOUBLE) AS x FROM z) SELECT doc_id, round(x, 9) AS rating, 1 AS compound_of FROM r WHERE x > 0")
def _zone_search(spark, sf):
    return _rounded(rank.zone_search("the", zones(spark, sf)))


@register("index_zone_search", ORACLE_SQL["zone_search"])
def _index_zone_search(spark, sf):
    """From the zones in the saved postings."""
    return _rounded(rank.zone_search_index("the", saved_index(spark, sf, "pages")))


@register("ranked_or", _two("or"))
def _ranked_or(spark, sf):
    return _rounded(rank.zone_search("the | und", zones(spark, sf)))


@register("ranked_and", _two("and", "the", "of"))
def _ranked_and(spark, sf):
    return _rounded(rank.zone_search("the & of", zones(spark, sf)))


@register("ranked_compat", _two("compat", "the", "of"))
def _ranked_compat(spark, sf):
    return _rounded(rank.zone_search("the & of", zones(spark, sf), compat=True))


@register("index_ranked_and", _two("and", "the", "of"))
def _index_ranked_and(spark, sf):
    return _rounded(rank.zone_search_index("the & of", saved_index(spark, sf, "pages")))


@register("ranked_and_not", f"WITH {ZON}, r AS (SELECT doc_id, CAST({_rating('the')} AS DOUBLE) AS x, CAST({_rating('and')} AS DOUBLE) AS y FROM z) SELECT doc_id, round(x, 9) AS rating, 1 AS compound_of FROM r WHERE x > 0 AND NOT y > 0")
def _ranked_and_not(spark, sf):
    return _rounded(rank.zone_search("the & !and", zones(spark, sf)))


def _bm25_sql(words: list[str], missing: str, limit: str = "") -> str:
    listed = ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))
    live = "run = 0" if missing == "stop" else "tf IS NOT NULL"
    return (
        f"WITH {VOC}, q(o, term) AS (VALUES {listed}), s AS (SELECT doc_id, coalesce(len(list_distinct(w)), 0) AS dl FROM d), "
        "a AS (SELECT floor(sum(dl) / count(*)) AS avg, count(*) AS n FROM s), "
        "g AS (SELECT s.doc_id, dl, o, q.term, tf, sum(CASE WHEN tf IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id ORDER BY o) AS run FROM s CROSS JOIN q LEFT JOIN tf ON tf.doc_id = s.doc_id AND tf.term = q.term), "
        f"r AS (SELECT doc_id, sum(ln(n / df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))) AS score FROM g JOIN voc USING (term) CROSS JOIN a WHERE {live} GROUP BY doc_id) "
        f"SELECT doc_id, round(score, 6) AS rating FROM r WHERE score > 0{limit}"
    )


for _missing in ("stop", "skip"):
    register(f"bm25_{_missing}", _bm25_sql(["und", "anat", "der"], _missing))(
        lambda spark, sf, m=_missing: rank.bm25(documents(spark, sf), "und anat der", m).withColumn("rating", F.round("rating", 6))
    )


@register("bm25_topk", _bm25_sql(["und", "anat", "der"], "skip", " ORDER BY score DESC, doc_id LIMIT 10"))
def _bm25_topk(spark, sf):
    return rank.bm25(documents(spark, sf), "und anat der", "skip", limit=10).withColumn("rating", F.round("rating", 6))


for _missing in ("stop", "skip"):
    register(f"index_bm25_{_missing}", _bm25_sql(["und", "anat", "der"], _missing))(
        lambda spark, sf, m=_missing: rank.bm25_index(saved_index(spark, sf), "und anat der", m).withColumn("rating", F.round("rating", 6))
    )


@register("bm25_boolean", _bm25_sql(["und", "der"], "skip").replace("FROM r WHERE", "FROM r WHERE doc_id NOT IN (SELECT doc_id FROM tok WHERE term = 'anat') AND"))
def _bm25_boolean(spark, sf):
    return rank.bm25_search("und der & !anat", documents(spark, sf)).select("doc_id", F.round("rating", 6).alias("rating"))


# -- vectors -----------------------------------------------------------------------------------------------------------

VEC = VOC + ", x AS (SELECT doc_id, term, tf * ln((SELECT count(*) FROM documents) / df) AS w FROM tf JOIN voc USING (term)), nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY doc_id)"


@register("tf_normalized", f"WITH {VOC}, s AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id) SELECT doc_id, term, round(CAST(tf / n AS DOUBLE), 9) AS w FROM tf JOIN s USING (doc_id)")
def _tf_normalized(spark, sf):
    return vectors.tf_normalised(documents(spark, sf)).withColumn("w", F.round("w", 9))


@register("tf_idf", f"WITH {VEC} SELECT doc_id, term, round(w, 6) AS w FROM x")
def _tf_idf(spark, sf):
    return vectors.tf_idf(documents(spark, sf)).withColumn("w", F.round("w", 6))


@register("doc_norm", f"WITH {VEC} SELECT doc_id, round(norm, 6) AS norm FROM nrm")
def _doc_norm(spark, sf):
    return vectors.norms(vectors.tf_idf(documents(spark, sf))).withColumn("norm", F.round("norm", 6))


@register(
    "cosine_pairs",
    f"WITH {VEC} SELECT a.doc_id AS left_id, b.doc_id AS right_id, round(sum(a.w * b.w) / max(m.norm * n.norm), 6) AS cosine FROM x a JOIN x b USING (term) "
    "JOIN nrm m ON m.doc_id = a.doc_id JOIN nrm n ON n.doc_id = b.doc_id WHERE a.doc_id % 20 = 0 AND m.norm > 0 AND n.norm > 0 GROUP BY ALL",
)
def _cosine_pairs(spark, sf):
    return cosine_blocks.tf_idf_cosines(documents(spark, sf), F.col("doc_id") % 20 == 0, digits=6)


@register("outer_zip", f"WITH {VOC}, v AS (SELECT lang, term, CAST(sum(tf) AS DOUBLE) AS w FROM tf JOIN documents USING (doc_id) GROUP BY ALL), l AS (SELECT term, w FROM v WHERE lang = 'en'), r AS (SELECT term, w FROM v WHERE lang = 'de') SELECT term, coalesce(l.w, 0) AS l, coalesce(r.w, 0) AS r FROM l FULL JOIN r USING (term)")
def _outer_zip(spark, sf):
    """Its operands are the term vectors of two languages' documents."""
    docs = documents(spark, sf)
    one = lambda lang: I.term_frequencies(docs.filter(F.col("lang") == lang)).groupBy("term").agg(F.sum("tf").cast("double").alias("w"))
    return vectors.outer_zip(one("en"), one("de"))


_LEADERS = "(SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS k FROM documents) WHERE k <= (SELECT floor(sqrt(count(*))) FROM documents))"


def _leaders(docs: DataFrame) -> DataFrame:
    return vectors.select_leaders(docs, int(docs.count() ** 0.5))


@register("leader_select", f"SELECT doc_id FROM {_LEADERS}")
def _leader_select(spark, sf):
    return _leaders(documents(spark, sf))


@register(
    "leader_assign",
    f"WITH {VEC}, k AS {_LEADERS}, c AS (SELECT a.doc_id AS leader, b.doc_id AS doc_id, round(sum(a.w * b.w) / max(m.norm * n.norm), 9) AS cosine FROM x a JOIN x b USING (term) JOIN k ON k.doc_id = a.doc_id "
    "JOIN nrm m ON m.doc_id = a.doc_id JOIN nrm n ON n.doc_id = b.doc_id WHERE m.norm > 0 AND n.norm > 0 GROUP BY ALL), "
    "o AS (SELECT doc_id, leader, cosine, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, leader) AS p FROM c) "
    "SELECT e.doc_id, coalesce(leader, (SELECT min(doc_id) FROM k)) AS leader, round(coalesce(cosine, 0), 6) AS cosine FROM (SELECT DISTINCT doc_id FROM x) e LEFT JOIN (SELECT * FROM o WHERE p = 1 AND cosine > 0) USING (doc_id)",
)
def _leader_assign(spark, sf):
    docs = documents(spark, sf)
    return vectors.assign_leaders(vectors.tf_idf(docs), _leaders(docs)).withColumn("cosine", F.round("cosine", 6))


# -- books -------------------------------------------------------------------------------------------------------------


@register("fb2_zones", "SELECT doc_id, lang AS author_first, source AS author_last, lang || ' ' || source AS author, 't' || CAST(doc_id AS VARCHAR) AS title, text AS body FROM documents WHERE doc_id % 7 <> 0")
def _fb2_zones(spark, sf):
    """Each document as a book; every seventh is malformed, which leaves it out."""
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    book = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info><author><first-name>'), "lang",
        F.lit("</first-name><last-name>"), "source", F.lit("</last-name></author><book-title>t"), F.col("doc_id").cast("string"),
        F.lit("</book-title></title-info></description><body>"), safe, F.when(F.col("doc_id") % 7 == 0, F.lit("</bdy>")).otherwise(F.lit("</body>")), F.lit("</FictionBook>"),
    )
    got = books.fb2_zones(documents(spark, sf).select("doc_id", book.alias("text")))
    return got.select("doc_id", "author_first", "author_last", "author", "title", "body")
