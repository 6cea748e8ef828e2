"""Near-duplicate embeddings within a label.

Method: randomised-rotation binary codes with stored correction factors. A unit vector is rotated by seeded random
rotations; the signs are its code, and the inner product of code and rotated vector is its correction factor, one for each
rotation. Both are computed once and stored with the vector. For two vectors, one's code times the other's rotation over the
factor estimates their inner product without bias, with a confidence bound from the factor. In a list, pairs whose codes differ in
more bits than a pair at the threshold does with near certainty are dropped first, eight bytes of code at a time; for the few others
the estimate is made, and pairs whose upper bound is below the threshold are dropped. What is left is recomputed in double precision,
and that value alone decides. No link is below the threshold.

Candidates meet in bands of code bits: vectors at the threshold differ in a bit with probability angle / pi, so enough
bands of k bits leave out a pair with probability below MISS. k follows the largest label's row count so that lists stay
short. A list above LIST_ROWS is cut into blocks, and every pair of blocks is a task's group of its own. Pairs never leave a
task: it emits for each vector the number of its links, counted in the first band that has the pair, and a representative
of its connected part.

Equal vectors of a label are one, which counts as often as there are ids; so copies cost nothing, however many there are.

Defined cases: a null label, null vector, zero vector or vector with null or non-finite components links with nothing, and
so does a null id (its component_id is null, kept is false); vectors of different lengths don't link; rows repeated exactly
count once; if an id comes with several vectors, its links are those of all of them, links to itself left out; an empty
table gives an empty result; columns other than id, vector and label are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded_batches, checkpoint, grouped_blocks, join_small, whole_groups
from .components import connected_components

#: Chance that no band has a pair at the threshold, and bound of an estimate's error in standard deviations.
MISS, SURE = 1e-7, 6.0
#: Vectors of one list that one task compares, and the list length that the number of band bits aims at.
LIST_ROWS, LIST_AIM = 2048, 256
#: Vectors compared at once.
BLOCK = 512


@lru_cache(maxsize=4)
def rotations(dim: int, count: int, seed: int = 7) -> np.ndarray:
    """(count * dim, dim): random orthogonal matrices, stacked."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])


def encode(unit: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes, packed to bytes, and correction factors (n x count) of unit vectors."""
    turned = unit @ rotations(unit.shape[1], count).T
    factor = np.abs(turned).reshape(len(unit), count, -1).sum(2) / math.sqrt(unit.shape[1])
    bits = np.packbits(turned >= 0, axis=1, bitorder="little")
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))), factor.astype(np.float32)


def code_bits(code: np.ndarray, many: int) -> np.ndarray:
    return np.unpackbits(code, axis=1, count=many, bitorder="little")


def estimates(code: np.ndarray, factor: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of coded rows with unit vectors, row by row, and their standard deviations."""
    dim, count = unit.shape[1], factor.shape[1]
    sign = code_bits(code, dim * count).astype(np.float32) * 2 - 1
    turned = (unit.astype(np.float32) @ rotations(dim, count).T.astype(np.float32)) * sign
    each = turned.reshape(len(unit), count, dim).sum(2) / (factor * np.float32(math.sqrt(dim)))
    estimate = each.mean(1)
    spread = (1 - factor**2).clip(0) / factor**2 / max(dim - 1, 1e-9)
    # what is across the coded vector is a part of the other one only
    across = np.sqrt((1 - estimate**2).clip(0))
    return estimate, across * np.sqrt(spread.sum(1)) / count + 1e-5


def most_bits(many: int, threshold: float) -> int:
    """Differing bits of codes up to which a pair is estimated; beyond it a pair at the threshold lies with probability below that
    of SURE deviations."""
    p = math.acos(threshold) / math.pi
    return math.ceil(many * p + SURE * math.sqrt(many * p * (1 - p)) + 2)


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """(bits in a band, bands) for a label of so many rows."""
    bits = max(1, min(40, math.ceil(math.log2(max(rows, 1) / LIST_AIM)))) if rows > LIST_AIM else 1
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - same)))


def band_keys(code: np.ndarray, bands: int, bits: int) -> np.ndarray:
    """(n x bands) values of consecutive runs of code bits."""
    on = code_bits(code, bands * bits).astype(np.int64).reshape(len(code), bands, bits)
    return on @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _links(ids, vectors, codes, factors, own, cross: bool, bands: int, bits: int, band: int, threshold: float) -> np.ndarray:
    """Links (i, j) of one group that no earlier band has. ``cross``: only between different blocks."""
    raw = np.stack(vectors).astype(np.float64)
    code, factor = np.stack(codes), np.stack(factors)
    norm = np.sqrt((raw * raw).sum(1))
    unit = raw / norm[:, None]
    words = code.view(np.uint64)
    most, keys, pairs = most_bits(factor.shape[1] * raw.shape[1], threshold), band_keys(code, bands, bits), []
    for a in range(0, len(raw), BLOCK):
        for b in range(a, len(raw), BLOCK):
            differ = np.zeros((len(raw[a : a + BLOCK]), len(raw[b : b + BLOCK])), np.uint16)
            for w in range(words.shape[1]):
                differ += np.bitwise_count(words[a : a + BLOCK, w, None] ^ words[None, b : b + BLOCK, w])
            i, j = np.nonzero(differ <= most)
            i, j = i + a, j + b
            ok = i < j
            if cross:
                ok &= own[i] != own[j]
            i, j = i[ok], j[ok]
            for k in range(0, len(i), 16_384):
                x, y = i[k : k + 16_384], j[k : k + 16_384]
                ok = ids[x] != ids[y]
                if band:
                    ok &= ~(keys[x, :band] == keys[y, :band]).any(1)
                x, y = x[ok], y[ok]
                estimate, spread = estimates(code[x], factor[x], unit[y])
                ok = estimate + SURE * spread >= threshold
                x, y = x[ok], y[ok]
                ok = (raw[x] * raw[y]).sum(1) / (norm[x] * norm[y]) >= threshold
                pairs.append(np.stack([x[ok], y[ok]], 1))
    return np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)


def _roots(pairs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each row's connected part."""
    least = ids.copy()
    while True:
        before = least.copy()
        low = np.minimum(least[pairs[:, 0]], least[pairs[:, 1]])
        np.minimum.at(least, pairs[:, 0], low)
        np.minimum.at(least, pairs[:, 1], low)
        if (least == before).all():
            return least


def near_duplicates(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", list_rows: int = LIST_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector id."""
    bounded_batches(df.sparkSession)
    narrow = df.schema[vector_col].dataType.simpleString() == "array<float>"  # their squares are finite in double precision, and they take half the room
    named = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>" if narrow else "array<double>").alias("vec"))
    fine = F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("vec") > 0)
    fine &= F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    vectors = named.filter(fine)
    if not narrow:  # dividing by the largest component leaves cosines as they are and keeps squares finite
        vectors = vectors.withColumn("_top", F.array_max(F.transform("vec", F.abs))).select("id", "label", F.transform("vec", lambda x: x / F.col("_top")).alias("vec"))
    vectors = checkpoint(vectors.dropDuplicates())
    # ids with several vectors keep each of them; of others equal vectors of a label are one
    several = checkpoint(vectors.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1").select("id", F.lit(True).alias("_several")))
    marked = join_small(vectors, several, ["id"], 16).withColumn("solo", F.when(F.col("_several"), F.col("id"))).drop("_several")
    kinds = ["label", "solo", "vec"]
    distinct = checkpoint(marked.groupBy(*kinds).agg(F.min("id").alias("id"), F.count("*").alias("m")))
    most = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, bands = plan(most, threshold)
    kind = np.float32 if narrow else np.float64

    def cut(batches):
        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            for dim in sorted({len(v) for v in vecs}):
                rows = [i for i, v in enumerate(vecs) if len(v) == dim]
                raw = np.array([vecs[i] for i in rows], np.float64)
                code, factor = encode(raw / np.sqrt((raw * raw).sum(1))[:, None], max(4, -(-bands * bits // dim)))
                keys, part = band_keys(code, bands, bits), batch.take(pa.array(rows))
                raws, codes, factors = (pa.array([v.tobytes() for v in x], pa.binary()) for x in (raw.astype(kind), code, factor))
                for band in range(bands):
                    band_of, dims = np.full(len(rows), band, np.int32), np.full(len(rows), dim, np.int32)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "label", "m")), pa.array(dims), pa.array(band_of), pa.array(keys[:, band]), raws, codes, factors], ["id", "label", "m", "dim", "band", "key", "raw", "code", "factor"])

    spread = distinct.select("id", "label", "m", "vec").mapInArrow(cut, "id long, label string, m long, dim int, band int, key long, raw binary, code binary, factor binary")
    # labels become numbers for the grouping; a clash only makes a longer list, and labels are compared below
    spread = spread.withColumn("lab", F.xxhash64("label"))
    by = ["lab", "dim", "band", "key"]
    dealt = grouped_blocks(spread, by, F.xxhash64("id", "raw"), list_rows)

    def link(batches):
        for t, cuts in whole_groups(batches, [*by, "blk_a", "blk_b"]):
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a < 2:
                    continue
                g = t.slice(a, b - a)
                first = {c: g.column(c)[0].as_py() for c in ("band", "blk_a", "blk_b")}
                label = np.array(g.column("label").to_pylist())
                ids, own, m = (g.column(c).to_numpy() for c in ("id", "own", "m"))
                vecs, codes, factors = ([np.frombuffer(r, k) for r in g.column(c).to_pylist()] for c, k in (("raw", kind), ("code", np.uint8), ("factor", np.float32)))
                pairs = _links(ids, vecs, codes, factors, own, first["blk_a"] != first["blk_b"], bands, bits, first["band"], threshold)
                pairs = pairs[label[pairs[:, 0]] == label[pairs[:, 1]]]
                if len(pairs):
                    n, root = np.zeros(len(ids), np.int64), _roots(pairs, ids)
                    np.add.at(n, pairs[:, 0], m[pairs[:, 1]])
                    np.add.at(n, pairs[:, 1], m[pairs[:, 0]])
                    at = np.flatnonzero(n)
                    out.append((ids[at], n[at], root[at]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["id", "n", "root"])

    found = checkpoint(dealt.mapInArrow(link, "id long, n long, root long").groupBy("id", "root").agg(F.sum("n").alias("n")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "id")
    # one row for each id that stands for equal vectors, or for itself
    own_links = F.coalesce("n", F.lit(0)) + F.coalesce("_m", F.lit(1)) - 1
    same = checkpoint(distinct.filter("m > 1").select("label", "vec", F.col("id").alias("rep"), "m"))
    known = checkpoint(counts.join(parts, "id", "full").withColumnRenamed("id", "rep"))
    if same.isEmpty():
        linked = known.select(F.col("rep").alias("id"), "n", F.lit(1).cast("long").alias("_m"), "component")
    else:
        wide = marked.filter(F.col("solo").isNull()).select("id", "label", "vec")
        members = checkpoint(attach(wide, same.withColumn("_m", F.col("m")), ["label", "vec"], "m", row_bytes=1024).select("id", "rep", "_m"))
        reps = checkpoint(same.select("rep", F.col("m").alias("_c")).join(known, "rep", "left"))
        copies = attach(members, reps, ["rep"], "_c").select("id", "n", "_m", F.coalesce("component", "rep").alias("component"))
        linked = known.join(same.select("rep"), "rep", "left_anti").select(F.col("rep").alias("id"), "n", F.lit(1).cast("long").alias("_m"), "component").unionByName(copies)
    every = named.select("id").distinct()
    out = every.join(linked, "id", "left").select(F.col("id").alias(id_col), own_links.cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
