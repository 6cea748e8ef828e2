"""SimHash near-duplicate detection.

Method: a byte-position inverted index with count filtering. Fingerprints of 64 bits that differ in at most 4 bits
share at least 4 of their 8 positional bytes; that is the guaranteed minimum. The index is keyed by combinations of 3 of
the first 7 positional bytes (two fingerprints that share 4 of 8 bytes share 3 of any 7) rather than by single bytes, whose lists
would hold a 256th of all rows each. So the tally isn't a count over single bytes' lists: pairs that meet in a list have
all their shared positional bytes tallied there, those that reach 4 are kept, and the bits of these are verified.

Only distinct fingerprints are indexed, so exact copies cost nothing. A list's links are reduced to a star per connected
part before they leave the task: from an unvisited fingerprint all unvisited ones within 4 bits are taken up, then
their neighbours, and so on. A list above LIST_ROWS is cut into blocks, every pair of which is compared in a task of its own.

Defined cases: null text is the empty text; texts without words have fingerprint zero and link like any other;
repeated rows and null ids are kept (a null id never names a component unless all its members are null); an empty table
gives an empty result; columns other than id and text are not read. Whole texts are used.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded_batches, checkpoint, grouped_blocks, text_udf, whole_groups
from .components import connected_components

#: Fixed by the method: positional bytes, bytes in a key and positions keys are drawn from.
BYTES, KEY_BYTES, KEY_FROM = 8, 3, 7
#: Fingerprints of one list that one task compares.
LIST_ROWS = 65_536


def fingerprints(texts: list[bytes], words: int = 4, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit fingerprints of UTF-8 texts: a bit is 1 if set in over half the shingles' XXH64."""
    import xxhash

    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)
    for i, raw in enumerate(texts):
        ws = raw.lower().split()  # bytes: A-Z only, and exactly the white space \x20 \x09-\x0D
        if not ws:
            continue
        if len(ws) <= words:
            h = [digest(b" ".join(ws), seed)]
        else:
            line, ends, at = b" ".join(ws), [], -1
            for w in ws:
                at += len(w) + 1
                ends.append(at)
            starts = [0, *[e + 1 for e in ends]]
            h = [digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)]
        ones = np.zeros(64, np.int64)
        all_h = np.array(h, np.uint64)
        for k in range(0, len(h), 8192):  # bounded memory for very long texts
            bits = np.unpackbits(all_h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
        out[i] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def near(hub: np.uint64, others: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``others`` differ from ``hub`` in at most ``bits`` bits: tally shared positional bytes, filter, verify."""
    x = others ^ hub
    shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
    out = shared >= BYTES - bits
    out[out] = np.bitwise_count(x[out]) <= bits
    return out


def stars(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """(member, smallest member) for the connected parts of one list, without the pairs within it."""
    left, made = np.unique(fps), []
    while len(left) > 1:
        hub, left = left[0], left[1:]
        part, fresh = [], [hub]
        while fresh and len(left):
            hit = near(fresh.pop(), left, bits)
            if hit.any():
                fresh += left[hit].tolist()
                part += left[hit].tolist()
                fresh = [np.uint64(f) for f in fresh]
                left = left[~hit]
        made += [(m, int(hub)) for m in part]
    return made


def _list_links(t: pa.Table, cuts: list[int], bits: int) -> np.ndarray:
    """Links of whole lists: adjacent rows by shifted comparison for short lists, stars for long ones."""
    fp = t.column("fp").to_numpy().view(np.uint64)
    start = np.array(cuts)
    sizes = np.diff(start)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    found = []
    short = sizes <= 64
    for shift in range(1, int(sizes[short].max(initial=0))):
        at = np.flatnonzero((owner[shift:] == owner[:-shift]) & short[owner[:-shift]])
        if not len(at):
            break
        x = fp[at] ^ fp[at + shift]
        kept = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(1) >= BYTES - bits
        at = at[kept][np.bitwise_count(x[kept]) <= bits]
        found.append(np.stack([fp[at], fp[at + shift]], 1))
    for k in np.flatnonzero(~short):
        if made := stars(fp[start[k] : start[k + 1]], bits):
            found.append(np.array(made, np.uint64))
    return np.concatenate(found) if found else np.zeros((0, 2), np.uint64)


def near_links(fps: DataFrame, bits: int = 4, list_rows: int = LIST_ROWS) -> DataFrame:
    """(u, v) links between the distinct ``fp`` (long) of a table, enough to connect all within ``bits`` bits."""
    if bits != BYTES - KEY_BYTES - 1:
        raise ValueError("the key sizes hold for 4 differing bits")
    byte = [F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255)) for k in range(KEY_FROM)]
    keys = []
    for n, combo in enumerate(combinations(range(KEY_FROM), KEY_BYTES)):
        key = F.lit(n).cast("bigint")
        for k in combo:
            key = F.shiftleft(key, 8).bitwiseOR(byte[k])
        keys.append(key)
    index = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    dealt = grouped_blocks(index, ["key"], F.col("fp"), list_rows).select("key", "blk_a", "blk_b", "fp")

    def link(batches):
        for t, cuts in whole_groups(batches, ["key", "blk_a", "blk_b"]):
            made = np.unique(_list_links(t, cuts, bits), axis=0).view(np.int64)
            if len(made):
                yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["u", "v"])

    return dealt.mapInArrow(link, "u long, v long").filter("u != v").distinct()


def document_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """All columns but the text, and the fingerprint's 64 bits as a signed long in fp."""
    bounded_batches(df.sparkSession)

    def start():
        return lambda texts: {"fp": pa.array(fingerprints([(t or "").encode() for t in texts], words, seed).view(np.int64))}

    others = [c for c in df.columns if c != text_col]
    return df.select(*others, text_udf("struct<fp: bigint>", start)(text_col).alias("_r")).select(*others, F.col("_r.fp").alias("fp"))


def fingerprint_components(docs: DataFrame, bits: int = 4, list_rows: int = LIST_ROWS) -> DataFrame:
    """(fp, component) of every distinct fp; component is the smallest fp reachable."""
    distinct = checkpoint(docs.select("fp").distinct())
    parts = connected_components(near_links(distinct, bits, list_rows))
    return distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4, seed: int = 42, list_rows: int = LIST_ROWS) -> DataFrame:
    """(id, fingerprint, component_id) of every row."""
    docs = checkpoint(document_fingerprints(df.select(id_col, text_col), id_col, text_col, words, seed))
    firsts = docs.groupBy("fp").agg(F.min(id_col).alias("_first"), F.count("*").alias("_n"))  # combined before the shuffle
    joined = checkpoint(fingerprint_components(docs, bits, list_rows).join(firsts, "fp"))
    smallest = checkpoint(joined.groupBy("component").agg(F.min("_first").alias("component_id"), F.count("*").alias("_m")))
    # a component may have very many fingerprints, and a fingerprint very many rows
    named = checkpoint(attach(joined.select("fp", "component", "_n"), smallest, ["component"], "_m").select("fp", "component_id", "_n"))
    return attach(docs, named, ["fp"], "_n").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
