"""SimHash near-duplicates of a stated similarity: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Method: the byte-position inverted index of ``simhash`` with count filtering, at the wide radius that this similarity asks for.
Two sets of Jaccard similarity j have a cosine of about 2j / (1 + j), so at 0.8 a fingerprint bit differs with probability 0.15
and 10 of 64 bits do, which no 64-bit index guarantees to find. Fingerprints here have 64 positional bytes. The index is keyed by
runs of ``width`` positional bytes (1 while lists of single bytes stay short, then 2 or 3); ``index_plan`` takes as many keys as
leave a pair at the threshold out with probability below MISS. Count filtering: of pairs that meet in a list all shared positional
bytes are tallied, and those that reach ``least_shared`` are kept. No count is certain at this radius; it is the largest that a pair at
the threshold falls short of with probability below SHORT, whatever the sizes of its sets. The bits of what is kept are verified: pairs
beyond ``most_bits``, which a pair at the threshold has with near certainty at most, are dropped. What is left is verified exactly, by
the shingle sets themselves; only that decides.

Only distinct word sequences are indexed, so copies cost nothing. A list's candidate links are reduced to a star per connected
part in the task. Verification works within candidate components: a component's texts are compared by their sets, in one task or in
blocks of LIMIT. A component that weighs LARGE blocks is first compared with HUBS of its texts for a few rounds, which covers groups
of near copies in time proportional to their size. What then could still join two verified parts involves a text outside the
component's largest part: these texts are compared with all of the component, in blocks. So no link that changes a group is lost
among candidates.

The table is copied to the shared folder with its rows numbered, and all steps read that copy.

Defined cases: words are runs of anything but white space, A-Z lowered; fewer than ``words`` words are one shingle, a text
without words (null included) equals any other such text; null ids come after all others; of rows that repeat an id the first
is kept; an empty table gives an empty result. Columns of any name are kept. Whole texts are read.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import scratch
from .common import attach, bounded_batches, checkpoint, free, grouped_blocks, join_small, text_udf, whole_groups
from .components import connected_components

#: Positional bytes of a fingerprint, and the fewest that are keys where single bytes are.
BYTES, CHECKED = 64, 24
#: Chance that no list has a pair at the threshold, and that it shares fewer bytes than the tally asks for; how far beyond its mean a
#: pair's differing bits may lie, in deviations.
MISS, SHORT, SURE = 0.005, 0.001, 4.5
#: Rows a list should have at most, and rows of a list compared in one task.
LIST_AIM, LIST_ROWS = 2048, 8192
#: Weight of a component's texts (one each, and one for every 4,096 shingles) up to which one task verifies it, and how many times
#: that a component is first compared with hubs.
LIMIT, LARGE = 512, 8
#: Texts of a large component that all others are compared with in a round, and rounds.
HUBS, ROUNDS = 4, 3


def bit_difference(similarity: float) -> float:
    """Probability that a fingerprint bit of two equally large sets of this Jaccard similarity differs."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def index_plan(rows: int, similarity: float) -> tuple[int, int]:
    """(positional bytes in a key, keys) for so many distinct texts."""
    width = 1
    while rows > LIST_AIM * 256**width and width < 4:
        width += 1
    same = (1 - bit_difference(similarity)) ** (8 * width)
    keys = math.ceil(math.log(MISS) / math.log(1 - same))
    return width, max(CHECKED, keys) if width == 1 else keys


@cache
def worst_difference(similarity: float, size: int = 24) -> float:
    """Probability that a bit differs for the pair of sets at this similarity where it is largest: sets of few shingles, counted
    out up to ``size``, differ more than large ones (of 4 and 5 with 4 in common, 3/16 at 0.8)."""
    ones = lambda n, least: sum(math.comb(n, k) for k in range(max(least, 0), n + 1)) / 2**n
    out = bit_difference(similarity)
    for a in range(1, size + 1):
        for b in range(a, size + 1):
            both = math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)
            if both <= a:
                p = 0.0
                for s in range(both + 1):  # ones among the common shingles; a bit is set in over half
                    x, y = ones(a - both, a // 2 + 1 - s), ones(b - both, b // 2 + 1 - s)
                    p += math.comb(both, s) / 2**both * (x * (1 - y) + y * (1 - x))
                out = max(out, p)
    return out


def most_bits(similarity: float, size: int = CHECKED) -> int:
    """Differing bits among ``size`` bytes up to which a pair is a candidate."""
    p, n = worst_difference(similarity), 8 * size
    return math.ceil(n * p + SURE * math.sqrt(n * p * (1 - p)))


def least_shared(similarity: float) -> int:
    """Shared positional bytes from which a pair that meets in a list is a candidate."""
    same, short, least = (1 - worst_difference(similarity)) ** 8, 0.0, 0
    while (short := short + math.comb(BYTES, least) * same**least * (1 - same) ** (BYTES - least)) < SHORT:
        least += 1
    return least


def key_bytes(width: int, keys: int) -> np.ndarray:
    """(keys x width) positions of each key's bytes: runs at growing strides, so that each byte is in many different runs."""
    out = []
    for stride in range(1, BYTES):
        for start in range(0, BYTES, width if width > 1 and stride == 1 else 1):
            run = [(start + stride * k) % BYTES for k in range(width)]
            if len(set(run)) == width and len(out) < keys:
                out.append(run)
        if len(out) >= keys:
            return np.array(out[:keys])
    raise ValueError("more keys than runs of bytes")


# -- shingles and fingerprints -----------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of a text's words and shingles. Hashes of words are cached within a task."""

    def __init__(self, words: int, cache: int = 500_000):
        self.words, self.cache, self.known = words, cache, {}

    def word_hashes(self, raw: bytes) -> np.ndarray:
        import xxhash

        if len(self.known) > self.cache:
            self.known.clear()
        known, parts = self.known, raw.lower().split()  # bytes: A-Z only, and exactly the white space \x20 \x09-\x0D
        for w in set(parts):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, 42)
        return np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))

    def shingles(self, h: np.ndarray) -> np.ndarray:
        """Sorted distinct hashes of the shingles, from those of the words."""
        n = max(1, len(h) - self.words + 1) if len(h) else 0
        with np.errstate(over="ignore"):
            out = np.full(n, len(h) if len(h) < self.words else self.words, np.uint64)
            for k in range(min(self.words, len(h))):
                out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(out)


def fingerprint(shingles: np.ndarray, size: int = BYTES) -> bytes:
    """A bit is 1 if set in over half the shingles' hashes; each 8 bytes come from another mixing of these."""
    out = []
    with np.errstate(over="ignore"):
        for k in range(size // 8):
            mixed = _mix(shingles + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k + 1))
            ones = np.zeros(64, np.int64)
            for at in range(0, len(mixed), 255):  # a byte counts to 255
                ones += np.add.reduce(np.unpackbits(mixed[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
            out.append(np.packbits(ones * 2 > len(mixed), bitorder="little").tobytes())
    return b"".join(out)


def sketches(df: DataFrame, words: int, size: int) -> DataFrame:
    """(id, row, digest, n, fp) from (id, row, text): a digest of the word sequence, its number of shingles, its fingerprint."""
    import hashlib

    bounded_batches(df.sparkSession)

    def start():
        shingler = Shingler(words)

        def sketch(texts):
            digest, n, fp = [], [], []
            for t in texts:
                h = shingler.word_hashes((t or "").encode())
                s = shingler.shingles(h)
                digest.append(hashlib.md5(h.tobytes()).digest())
                n.append(len(s))
                fp.append(fingerprint(s, size))
            return {"digest": pa.array(digest, pa.binary()), "n": pa.array(n, pa.int64()), "fp": pa.array(fp, pa.binary())}

        return sketch

    udf = text_udf("struct<digest: binary, n: bigint, fp: binary>", start)
    return df.select("id", "row", udf("text").alias("_r")).select("id", "row", "_r.*")


def shingle_sets(df: DataFrame, text_col: str, words: int) -> DataFrame:
    """Replace the text by its shingles' sorted hashes as bytes, in ``set``."""
    bounded_batches(df.sparkSession)

    def start():
        shingler = Shingler(words)
        return lambda texts: {"set": pa.array([shingler.shingles(shingler.word_hashes((t or "").encode())).tobytes() for t in texts], pa.binary())}

    others = [c for c in df.columns if c != text_col]
    return df.select(*others, text_udf("struct<set: binary>", start)(text_col).alias("_r")).select(*others, "_r.set")


# -- candidates --------------------------------------------------------------------------------------------------------


def _stars(fp: np.ndarray, least: int, most: int, own: np.ndarray | None) -> list[tuple[int, int]]:
    """(member, hub) places that connect all rows of a list that share ``least`` bytes and are within ``most`` bits; with ``own``
    only rows of different blocks are compared. Rows are taken up from one to its neighbours and on to theirs."""
    made, place, rest = [], np.arange(len(fp)), np.ascontiguousarray(fp.T)
    while len(place) > 1:
        fresh, place, rest = [int(place[0])], place[1:], rest[:, 1:]
        while fresh and len(place):
            hub = fresh.pop()
            one = fp[hub][:, None]
            tally = np.add.reduce((rest == one).view(np.uint8), axis=0, dtype=np.uint8)
            near = tally >= least
            if own is not None:
                near &= own[place] != own[hub]
            kept = np.flatnonzero(near)
            near[kept] = np.bitwise_count(rest[:, kept] ^ one).sum(0, dtype=np.int64) <= most
            if near.any():
                found = place[near].tolist()
                made += [(m, hub) for m in found]
                fresh += found
                place, rest = place[~near], rest[:, ~near]
    return made


def _short_pairs(fp: np.ndarray, owner: np.ndarray, least: int, most: int) -> np.ndarray:
    """Pairs of places in the same list (rows of one owner are adjacent) that share ``least`` bytes and are within ``most`` bits."""
    found = []
    for shift in range(1, len(fp)):
        at = np.flatnonzero(owner[shift:] == owner[:-shift])
        if not len(at):
            break
        at = at[(fp[at] == fp[at + shift]).sum(1) >= least]
        at = at[np.bitwise_count(fp[at] ^ fp[at + shift]).sum(1, dtype=np.int64) <= most]
        found.append(np.stack([at, at + shift], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def candidate_links(sketched: DataFrame, similarity: float, width: int, keys: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """(u, v) rows of distinct texts, from (row, fp): enough to connect all candidates that meet in a list."""
    runs, least, most = key_bytes(width, keys), least_shared(similarity), most_bits(similarity, BYTES)

    def cut(batches):
        for b in batches:
            if not b.num_rows:
                continue
            whole = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(b.num_rows, -1).astype(np.int64)
            for k, run in enumerate(runs):
                key = np.full(b.num_rows, k, np.int64)
                for at in run:
                    key = (key << 8) | whole[:, at]
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column("row"), b.column("fp")], ["key", "row", "fp"])

    index = sketched.select("row", "fp").mapInArrow(cut, "key long, row long, fp binary")
    dealt = grouped_blocks(index, ["key"], F.col("row"), list_rows)

    def link(batches):
        for t, cuts in whole_groups(batches, ["key", "blk_a", "blk_b"]):
            fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            row, sizes = t.column("row").to_numpy(), np.diff(cuts)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            short = np.flatnonzero((sizes <= 64)[owner])
            pairs = [short[_short_pairs(fp[short], owner[short], least, most)]] if len(short) else []
            for k in np.flatnonzero(sizes > 64):
                a, b = cuts[k], cuts[k + 1]
                cross = t.column("blk_a")[a].as_py() != t.column("blk_b")[a].as_py()
                if made := _stars(fp[a:b], least, most, t.column("own").to_numpy()[a:b] if cross else None):
                    pairs.append(np.array(made) + a)
            pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
            if len(pairs):
                made = np.unique(np.sort(row[pairs], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["u", "v"])

    return dealt.select("key", "blk_a", "blk_b", "own", "row", "fp").mapInArrow(link, "u long, v long").distinct()


# -- verification ------------------------------------------------------------------------------------------------------


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty sets are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return (both + 1e-12) / (len(a) + len(b) - both)


def _verified(sets: list[np.ndarray], similarity: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(member, hub) places that connect all sets at the similarity or above; with ``side`` only sets of different sides are
    compared. Elements are numbered within the group, so that a set meets all others in one pass over these numbers."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    names, element = np.unique(np.concatenate(sets), return_inverse=True)
    some = np.flatnonzero(sizes)
    mark, both = np.zeros(len(names), bool), np.zeros(len(sets), np.int64)

    def alike(hub: int) -> np.ndarray:
        if not sizes[hub]:
            return sizes == 0
        own = element[ends[hub] - sizes[hub] : ends[hub]]
        mark[own] = True
        both[some] = np.add.reduceat(mark[element], (ends - sizes)[some], dtype=np.int64)
        mark[own] = False
        return both + 1e-9 >= similarity * (sizes + sizes[hub] - both)

    made, left = [], np.arange(len(sets))
    while len(left) > 1:
        fresh, left = [int(left[0])], left[1:]
        while fresh and len(left):
            hub = fresh.pop()
            near = np.minimum(sizes[left], sizes[hub]) >= similarity * np.maximum(sizes[left], sizes[hub])
            if side is not None:
                near &= side[left] != side[hub]
            if not near.any():
                continue
            near &= alike(hub)[left]
            if near.any():
                found = left[near].tolist()
                made += [(m, hub) for m in found]
                fresh += found
                left = left[~near]
    return made


def _group_links(dealt: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """(u, v) verified links within groups of (keys, row, side, set): between a group's sides, or all where they are negative."""

    def link(batches):
        for t, cuts in whole_groups(batches, keys):
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a < 2:
                    continue
                g = t.slice(a, b - a)
                row = g.column("row").to_pylist()
                sets = [np.frombuffer(s, np.uint64) for s in g.column("set").to_pylist()]
                side = g.column("side").to_numpy()
                found = _verified(sets, similarity, None if side[0] < 0 else side)
                out += [(row[x], row[y]) for x, y in found if row[x] != row[y]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(link, "u long, v long")


def _minor_links(members: DataFrame, minor: DataFrame, similarity: float, limit: int) -> DataFrame:
    """(u, v) verified links of minor rows with any row of their component. The members of a component are cut into blocks, its
    minor rows too, and each pair of blocks is one group: members are sent once for each block of minor rows."""
    weight = F.sum(1 + F.floor(F.col("n") / 4096))
    parts = lambda rows, name: rows.groupBy("component").agg(F.ceil(weight * 2 / F.lit(limit)).cast("int").alias(name))
    cuts = checkpoint(parts(members, "kb").join(parts(minor, "km"), "component"))
    own = lambda k: F.pmod(F.xxhash64("row"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    a = join_small(members, cuts, ["component"], 32, "inner").select("component", "row", "set", F.lit(0).alias("side"), own("kb").alias("blk_b"), every("km").alias("blk_m"))
    b = join_small(minor, cuts, ["component"], 32, "inner").select("component", "row", "set", F.lit(1).alias("side"), own("km").alias("blk_m"), every("kb").alias("blk_b"))
    return _group_links(a.unionByName(b), ["component", "blk_m", "blk_b"], similarity)


def _hub_links(members: DataFrame, hubs: DataFrame, similarity: float) -> DataFrame:
    """(u, v) verified links of members (component, row, n, set) with their component's hubs (component, hub, hub_n, hub_set)."""
    size = hubs.agg(F.coalesce(F.sum(F.col("hub_n") * 8 + 64), F.lit(0))).first()[0]
    if size <= 16 << 20:
        met = members.join(F.broadcast(hubs), "component")
    else:  # every hub goes to each of as many places as its component's rows are dealt to
        salts = 256
        left = members.withColumn("_s", F.pmod(F.xxhash64("row"), F.lit(salts)))
        met = left.join(hubs.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["component", "_s"])
    fit = F.least("n", "hub_n") >= similarity * F.greatest("n", "hub_n")
    met = met.filter((F.col("row") != F.col("hub")) & fit)

    def verify(batches):
        for b in batches:
            keep = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity for x, y in zip(b.column("set").to_pylist(), b.column("hub_set").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row").filter(pa.array(keep, pa.bool_())), b.column("hub").filter(pa.array(keep, pa.bool_()))], ["u", "v"])

    return met.select("row", "set", "hub", "hub_set").mapInArrow(verify, "u long, v long")


def _block_links(rows: DataFrame, similarity: float, limit: int) -> DataFrame:
    """(u, v) verified links of all rows of a component, in blocks where it weighs more than ``limit``."""
    dealt = grouped_blocks(rows.select("component", "row", "n", "set"), ["component"], F.col("row"), limit, weight=1 + F.floor(F.col("n") / 4096))
    # two blocks are compared with each other, one block within itself
    side = F.when(F.col("blk_a") == F.col("blk_b"), F.lit(-1)).otherwise(F.col("own")).alias("side")
    return _group_links(dealt.select("component", "blk_a", "blk_b", "row", "set", side), ["component", "blk_a", "blk_b"], similarity)


def verified_links(rows: DataFrame, similarity: float, limit: int = LIMIT) -> DataFrame:
    """(u, v) that connect all texts of (component, row, n, set) whose sets are similar, component by component."""
    weight = F.sum(1 + F.floor(F.col("n") / 4096))
    large = checkpoint(rows.groupBy("component").agg(weight.alias("_w")).filter(F.col("_w") > LARGE * limit).select("component"))
    if large.isEmpty():
        return _block_links(rows, similarity, limit)
    inside = join_small(rows, large.withColumn("_l", F.lit(True)), ["component"], 16)
    small_ones = inside.filter(F.col("_l").isNull()).drop("_l")
    members = checkpoint(inside.filter("_l").drop("_l"))
    links, covered = None, None
    for turn in range(ROUNDS):
        # hubs are drawn among texts that no hub has covered so far
        open_ = members if covered is None else members.join(covered, "row", "left_anti")
        key = F.xxhash64(F.lit(turn), F.col("row"))
        drawn = open_.groupBy("component").agg(F.min_by(F.struct("row", "n"), key).alias("h0"), *[F.min_by(F.struct("row", "n"), F.xxhash64(F.lit(97 + turn), F.lit(k), F.col("row"))).alias(f"h{k}") for k in range(1, HUBS)])
        names = drawn.select(F.explode(F.array_distinct(F.array(*[F.col(f"h{k}.row") for k in range(HUBS)]))).alias("row"))
        hubs = checkpoint(members.join(F.broadcast(names), "row").select("component", F.col("row").alias("hub"), F.col("n").alias("hub_n"), F.col("set").alias("hub_set")))
        if hubs.isEmpty():
            break
        found = checkpoint(_hub_links(members, hubs, similarity))
        links = found if links is None else links.unionByName(found)
        covered = checkpoint(links.select(F.col("u").alias("row")).unionByName(links.select(F.col("v").alias("row"))).unionByName(hubs.select(F.col("hub").alias("row"))).distinct())
    verified = connected_components(links)
    placed = checkpoint(members.select("component", "row").join(verified.withColumnRenamed("node", "row").withColumnRenamed("component", "part"), "row", "left").withColumn("part", F.coalesce("part", "row")))
    sizes = placed.groupBy("component", "part").agg(F.count("*").alias("_c"))
    major = sizes.groupBy("component").agg(F.max(F.struct("_c", "part")).alias("_m")).select("component", F.col("_m.part").alias("_major"))
    minor = checkpoint(join_small(placed, checkpoint(major), ["component"], 24).filter(F.col("part") != F.col("_major")).select("row"))
    links = links.unionByName(_block_links(small_ones, similarity, limit))
    if minor.isEmpty():
        return links
    return links.unionByName(_minor_links(members, checkpoint(members.join(minor, "row", "left_semi")), similarity, limit))


# -- the operator ------------------------------------------------------------------------------------------------------


def text_groups(df: DataFrame, words: int = 5, similarity: float = 0.8, width: int | None = None, list_rows: int = LIST_ROWS, limit: int = LIMIT) -> DataFrame:
    """(row, first) from (id, row, text): for every row the row that stands for its group, the one with the smallest id. Rows must
    be numbered once for all, as in a stored table."""
    plan = index_plan(df.count() if width is None else LIST_AIM * 256 ** (width - 1) + (width > 1), similarity)
    docs = checkpoint(sketches(df, words, BYTES))
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("row").alias("row"))
    # copies of a word sequence are one text from here on; combined before the shuffle, however many there are
    texts = checkpoint(docs.groupBy("digest").agg(F.min(order).alias("o"), F.count("*").alias("_n"), F.first("n").alias("n"), F.first("fp").alias("fp")).withColumn("row", F.col("o.row")))
    candidates = connected_components(candidate_links(texts, similarity, *plan, list_rows)).withColumnRenamed("node", "row")
    known = checkpoint(candidates.join(texts.select("row", "n"), "row"))
    rows = checkpoint(shingle_sets(join_small(df.select("row", "text"), known, ["row"], 32, "inner"), "text", words))
    parts = connected_components(verified_links(rows.select("component", "row", "n", "set"), similarity, limit)).withColumnRenamed("node", "row")
    joined = checkpoint(texts.select("digest", "row", "o", "_n").join(parts, "row", "left").withColumn("component", F.coalesce("component", "row")))
    firsts = checkpoint(joined.groupBy("component").agg(F.min("o").alias("_f"), F.count("*").alias("_m")).select("component", F.col("_f.row").alias("first"), "_m"))
    named = checkpoint(attach(joined.select("digest", "component", "_n"), firsts, ["component"], "_m").select("digest", "first", "_n"))
    return attach(docs.select("digest", "row"), named, ["digest"], "_n").select("row", "first")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest id, null ids last, of rows that repeat it the first."""
    spark, (row,) = df.sparkSession, free(df, "row")
    path = scratch(spark, "numbered")
    df.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    groups = text_groups(stored.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.col(text_col).alias("text")), **options)
    return stored.join(groups.select(F.col("first").alias(row)).distinct(), row, "left_semi").drop(row)
