"""Sharding by extendible hashing.

Method: a directory indexed by bits of a hash prefix. Only a bucket above the byte limit splits, on one more bit, until
every shard fits. The directory is computed from the bytes of hash prefixes, eight levels at a time: a bucket is the
shallowest prefix that fits although its parent doesn't. Documents of buckets that still are too large go on to the next
eight levels. Byte counts are summed before the shuffle, so hot buckets cost no more than others, and the directory needs no text.

The hash has 120 bits: 60 of the MD5 of the id, then 60 of the MD5 of the row's number, so rows that repeat one id split
as well. A shard is named by its prefix of 0 and 1; the empty prefix is the whole table.

Defined cases: null text has 0 bytes; a null id hashes as the empty string; a document above the limit has a shard of its
own, which is the one case of a shard above the limit; an empty table gives an empty directory; columns other than id and
text are not read by ``shards``, and ``write_shards`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import scratch
from .common import checkpoint, free

#: Levels of the directory that one pass decides, and bits in the hash.
STEP, BITS = 8, 120
LIMIT = 16 << 20


def _bits(text: Column) -> Column:
    """60 bits as a string of 0 and 1: the first 15 hexadecimal digits of the MD5."""
    return F.lpad(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 2), 60, "0")


def hash_bits(id_col: str, row_col: str = "_row") -> Column:
    return F.concat(_bits(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), _bits(F.col(row_col).cast("string")))


def directory(sized: DataFrame, limit: int = LIMIT) -> list[tuple[int, DataFrame]]:
    """From (_h hash bits, _b bytes): for each pass the width of its prefixes and a table (_p, shard_id, depth, shard_bytes,
    shard_docs) that maps them to their buckets. A hash is found in exactly one of the tables."""
    total = sized.agg(F.coalesce(F.sum("_b"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    if total.b <= limit or total.n <= 1:
        one = sized.sparkSession.createDataFrame([("", "", 0, total.b, total.n)], "_p string, shard_id string, depth int, shard_bytes long, shard_docs long")
        return [(0, one)]
    tables, rest = [], sized
    for top in range(STEP, BITS + 1, STEP):
        fine = checkpoint(rest.groupBy(F.substring("_h", 1, top).alias("_p")).agg(F.sum("_b").alias("b"), F.count("*").alias("n")))
        levels = fine.select("_p", "b", "n", F.explode(F.sequence(F.lit(top - STEP + 1), F.lit(top))).alias("depth"))
        levels = levels.withColumn("shard_id", F.expr("substring(_p, 1, depth)"))
        nodes = levels.groupBy("depth", "shard_id").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = nodes.filter((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
        hit = levels.select("_p", "depth", "shard_id").join(fits, ["depth", "shard_id"])
        hit = hit.groupBy("_p").agg(F.min(F.struct("depth", "shard_id", "shard_bytes", "shard_docs")).alias("s"))
        found = checkpoint(hit.select("_p", "s.*"))
        tables.append((top, found))
        left = checkpoint(fine.join(found, "_p", "left_anti").select("_p"))
        if left.isEmpty():
            break
        rest = checkpoint(rest.withColumn("_p", F.substring("_h", 1, top)).join(left, "_p", "left_semi").drop("_p"))
    return tables


def lookup(df: DataFrame, tables: list[tuple[int, DataFrame]]) -> DataFrame:
    """Replace the hash bits in _h by shard_id, depth, shard_bytes and shard_docs."""
    names = ["shard_id", "depth", "shard_bytes", "shard_docs"]
    kept = [c for c in df.columns if c != "_h"]
    for k, (width, t) in enumerate(tables):
        df = df.withColumn("_p", F.substring("_h", 1, width)).join(t.select("_p", F.struct(*names).alias(f"_s{k}")), "_p", "left").drop("_p")
    return df.withColumn("_s", F.coalesce(*[f"_s{k}" for k in range(len(tables))])).select(*kept, *[f"_s.{n}" for n in names])


def shards(df: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, doc_bytes, shard_id, depth, shard_bytes, shard_docs) of every row."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")
    rows = checkpoint(df.select(id_col, size.alias("doc_bytes"), F.monotonically_increasing_id().alias("_row")))
    hashed = rows.withColumn("_h", hash_bits(id_col))
    tables = directory(hashed.select("_h", F.col("doc_bytes").alias("_b")), limit)
    return lookup(hashed.drop("_row"), tables)


def write_shards(df: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every row to ``path`` as Parquet, one folder s<shard_id> for each shard, named by a column shard (with _ in front
    where the table has one). Returns the directory: (shard_id, depth, shard_bytes, shard_docs).

    The rows are numbered in a copy in the shared folder, which both the directory and the shards are made from; texts are
    shuffled once, to their shards, none of which is above the limit."""
    spark, (shard,) = df.sparkSession, free(df, "shard")
    copy = scratch(spark, "numbered")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")
    df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), size.alias("_b"), F.monotonically_increasing_id().alias("_row")).write.parquet(copy)
    hashed = spark.read.parquet(copy).withColumn("_h", hash_bits("id"))
    tables = directory(hashed.select("_h", "_b"), limit)
    placed = lookup(hashed.select("row", "_h"), tables)
    placed.select("row.*", F.concat(F.lit("s"), "shard_id").alias(shard)).repartition(shard).write.partitionBy(shard).parquet(path)
    names = ["shard_id", "depth", "shard_bytes", "shard_docs"]
    found = tables[0][1].select(*names)
    for _, t in tables[1:]:
        found = found.unionByName(t.select(*names))
    return found.distinct().filter("shard_docs > 0")
