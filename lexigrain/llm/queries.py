"""The ten queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, langid, media, packing, pii, sentencepiece_codec, sharding, simhash, toxicity, warc
from .common import table


#: Byte limit of op3's shards: small, so that tables of any size split.
SHARD_BYTES = 128 << 10


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_embedding_dedup, op3_sharding, op4_warc, op5_packing, op6_language_id, op7_simhash, op8_pii, op9_toxicity, op10_media)}



def embeddings_sql(threshold: float = 0.98) -> str:
    return f"""WITH RECURSIVE v AS (SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {threshold}),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.w, r.c FROM r JOIN l ON r.id = l.u),
k AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, c AS component_id, coalesce(id = c, false) AS kept FROM k LEFT JOIN n ON u = id"""


def shards_sql(limit: int = SHARD_BYTES) -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS doc_bytes,
CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
w AS (SELECT doc_id, doc_bytes, h, 0 AS depth, sum(doc_bytes) OVER () AS b, count(*) OVER () AS n FROM d
UNION ALL SELECT doc_id, doc_bytes, h, depth + 1, sum(doc_bytes) OVER (PARTITION BY h >> (59 - depth)), count(*) OVER (PARTITION BY h >> (59 - depth)) FROM w WHERE b > {limit} AND n > 1 AND depth < 60)
SELECT doc_id, doc_bytes, substr(lpad(bin(h), 60, '0'), 1, depth) AS shard_id, depth, CAST(b AS BIGINT) AS shard_bytes, n AS shard_docs FROM w WHERE b <= {limit} OR n = 1"""


WARC_SQL = f"""WITH q AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS s FROM pages),
f AS (SELECT s, min(page_id) AS first FROM q WHERE n >= {warc.MIN_BYTES} GROUP BY s)
SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN first <> page_id THEN first END AS refers_to FROM q LEFT JOIN f USING (s)"""

_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(x, '.'), lambda v: length(ltrim(v, '0')) > 3 OR coalesce(TRY_CAST(ltrim(v, '0') AS INT), 0) > 255)) = 0"),
    "card": (r"[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: (CAST(substr(reverse({_DIGITS}), k, 1) AS INT) * (2 - k % 2) // 10) + (CAST(substr(reverse({_DIGITS}), k, 1) AS INT) * (2 - k % 2) % 10))) % 10 = 0"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    "iban": (
        r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
        "NOT regexp_matches(right(g, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(a, 1), '[A-Za-z0-9]') AND NOT (g = '' AND i > 1) AND NOT (a = '' AND i < n) AND "
        "list_reduce(list_transform(string_split(substr(replace(x, ' ', ''), 5) || substr(replace(x, ' ', ''), 1, 4), ''), lambda c: coalesce(TRY_CAST(c AS INT), ascii(c) - 55)), lambda z, v: (z * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1",
    ),
    "ssn": (
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "NOT regexp_matches(right(g, 1), '[A-Za-z0-9-]') AND NOT regexp_matches(left(a, 1), '[A-Za-z0-9-]') AND NOT (g = '' AND i > 1) AND NOT (a = '' AND i < n) AND "
        f"NOT regexp_matches(x, '^(?:000|666|9)|-00-|-0000$') AND regexp_matches(lower(right(g, {pii.CONTEXT})), '{pii.WORDS['ssn']}')",
    ),
}


def _pii_sql() -> str:
    found = " UNION ALL ".join(
        f"SELECT r, {k} AS rank, '{kind}' AS kind, e - length(x) AS s, e FROM (SELECT *, CAST(sum(length(g) + length(x)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS e "
        f"FROM (SELECT r, unnest(m) AS x, unnest(q[1:len(m)]) AS g, unnest(q[2:]) AS a, generate_subscripts(m, 1) AS i, len(m) AS n FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS q FROM t) WHERE len(m) > 0)) WHERE {good}"
        for k, (kind, (pattern, good)) in enumerate(_PII.items())
    )
    text = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank){}, '')"
    counts = ", ".join(f"count(*) FILTER (WHERE rank = {k}) AS n_{kind}" for k, kind in enumerate(pii.BASE))
    return (
        f"WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}) "
        f"SELECT doc_id, {counts}, sha256({text.format(' FILTER (WHERE rank < 4)')}) AS base_sha256, {text.format('')} AS spans FROM t LEFT JOIN f USING (r) GROUP BY r, doc_id"
    )


#: Token ids, hashes, classifiers and media can't be expressed; tests hold those to brute force.
ORACLE_SQL = {"op2_embedding_dedup": embeddings_sql(), "op3_sharding": shards_sql(), "op4_warc": WARC_SQL, "op8_pii": _pii_sql()}
