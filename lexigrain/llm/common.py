"""Helpers that the operators share: Arrow batches, and joins and grouping that hot keys don't slow down."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..storage import BROADCAST_BYTES, checkpoint, join_small, spread

#: Rows that one Arrow batch may hold; whole texts of some 100 KB each still stay far below Arrow's 2 GB.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows``, so that batches of long texts stay small."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def free(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many _ in front as the table's columns (whatever their case) and the other names ask for."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def text_udf(schema: str, start: Callable[[], Callable[[list], dict[str, pa.Array]]], rows: int = 256):
    """A struct-valued Arrow UDF over one column. ``start`` runs once in a task and returns the function that maps
    a list of values (None for null) to the struct's fields; it gets at most ``rows`` values at once.

    Not deterministic by declaration: the optimizer then never evaluates it twice for one row.
    """

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start()
        for batch in batches:
            parts = []
            for i in range(0, len(batch), rows):
                fields = work(batch.slice(i, rows).to_pylist())
                parts.append(pa.StructArray.from_arrays(list(fields.values()), list(fields)))
            yield pa.concat_arrays(parts) if parts else pa.array([], returned)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    spark = SparkSession.getActiveSession()
    returned = to_arrow_type(_parse_datatype_string(schema)) if spark else None
    return run.asNondeterministic()


def attach(left: DataFrame, right: DataFrame, on: Sequence[str], count: str, most: int = 100_000, row_bytes: int = 128) -> DataFrame:
    """Join every row of ``left`` with its row of ``right``, which is unique by ``on`` and whose ``count`` says how many rows of left
    have the key. Where right fits a broadcast it is; else keys with more rows than a ``most``-th of all are, of which there are
    fewer than ``most``, and only the others are shuffled. No key's rows meet in one task. Both sides are read several times."""
    size = right.agg(F.count("*"), F.coalesce(F.sum(count), F.lit(0))).first()
    bare = right.drop(count)
    if size[0] * row_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(bare), list(on))
    limit = max(1000, size[1] // most)
    hot, cold = right.filter(F.col(count) > limit).drop(count), right.filter(F.col(count) <= limit).drop(count)
    rest = left.join(F.broadcast(hot.select(*on)), list(on), "left_anti").join(cold, list(on))
    return left.join(F.broadcast(hot), list(on)).unionByName(rest)


def grouped_blocks(df: DataFrame, keys: Sequence[str], spread: Column, limit: int, partitions: int | None = None, weight: Column | None = None) -> DataFrame:
    """Deal rows out by ``keys`` so that mapInArrow can compare the rows of a key, whatever its size.

    Adds blk_a, blk_b and own. A key of at most ``limit`` rows (or sum of ``weight``) is one group (0, 0). A larger key is cut by the hash
    of ``spread`` into blocks of about ``limit`` / 2 rows and goes out as one group for each pair of blocks, so every two
    rows of a key meet: rows of one block in (a, a), rows of different blocks in (a, b). ``own`` is a row's block.
    Partitions come sorted by keys, blk_a, blk_b. No row is dropped.
    """
    hot = checkpoint(df.groupBy(*keys).agg((F.count("*") if weight is None else F.sum(weight)).alias("_n")).filter(F.col("_n") > limit))
    none = [F.lit(0).alias("blk_a"), F.lit(0).alias("blk_b"), F.lit(0).alias("own")]
    if hot.isEmpty():
        out = df.select("*", *none)
    else:
        marked = join_small(df, hot, keys, 64)
        cold = marked.filter(F.col("_n").isNull()).drop("_n").select("*", *none)
        n = F.ceil(F.col("_n") * 2 / F.lit(limit)).cast("int")
        cut = marked.filter(F.col("_n").isNotNull()).withColumn("_k", n).withColumn("own", F.pmod(F.xxhash64(spread), F.col("_k")).cast("int"))
        cut = cut.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        cut = cut.withColumns({"blk_a": F.least("own", "_o"), "blk_b": F.greatest("own", "_o")})
        out = cold.unionByName(cut.select(*cold.columns))
    by = [*keys, "blk_a", "blk_b"]
    return (out.repartition(partitions, *by) if partitions else out.repartition(*by)).sortWithinPartitions(*by)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """From batches sorted by ``keys``: tables that hold whole groups only, with the groups' borders."""
    import numpy as np

    kept: list[pa.RecordBatch] = []

    def borders(t: pa.Table):
        new = np.zeros(max(t.num_rows - 1, 0), bool)
        for k in keys:
            v = t.column(k).to_numpy()
            new |= v[1:] != v[:-1]
        return np.flatnonzero(new) + 1

    first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
        if first is not None and key == first:
            kept.append(batch)
            continue
        t = pa.Table.from_batches([*kept, batch])
        cuts = borders(t)
        if len(cuts):
            yield t.slice(0, int(cuts[-1])), [0, *cuts.tolist()]
            kept = t.slice(int(cuts[-1])).combine_chunks().to_batches()
        else:
            kept = t.to_batches()
        first = key
    if kept:
        t = pa.Table.from_batches(kept)
        cuts = borders(t)
        yield t, [0, *cuts.tolist(), t.num_rows]
