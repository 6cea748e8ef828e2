"""Packing of tokenised documents into sequences of a fixed length.

Method: first-fit decreasing with a tournament tree of bin capacities, run independently in randomised groups of
documents. A document is tokenised where it is read and cut into pieces; of each piece only numbers (place, length, checksum)
are shuffled to its document's group. A group's pieces are placed longest first, each in the leftmost sequence with room, which
the tree finds in logarithmic time; full-length pieces fill sequences of their own. Groups are drawn by a hash of id and row
number, so a hot source and copies of one row spread evenly, and their number follows the number of documents.

Token ids are those of the tokenizers library for a byte-level BPE vocabulary in its JSON format, special tokens in a text
included. White-space-led chunks of a text are independent in it, so chunks are encoded once and cached; texts with a special
token's string, and all texts of a file with another splitting than the common one, go through the library itself. In each batch
one whole text, another place in the batch each time, is compared with the library.

Defined cases: null text is the empty text, whose only id is the end id; repeated rows are packed as documents of
their own (a null or repeated id is kept as it is); an empty table gives an empty result; columns other than id and text are
not read. Rows are numbered as they are read: the table must give them in the same partitions each time, as stored ones do.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_udf

#: The split pattern of the public byte-level vocabularies, and Unicode's white space.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "\t-\r \x85\xa0  -     　"
#: Chunks that each half of a task's cache may hold.
CACHE = 300_000
#: Documents of a randomised group, on average.
GROUP_DOCS = 20_000


class ByteTokenizer:
    """Ids of a byte-level BPE vocabulary, equal to the tokenizers library's without added ones."""

    def __init__(self, path: str, cache: int = CACHE):
        import tiktoken
        from tokenizers import Tokenizer

        self.theirs = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        split = spec.get("pre_tokenizer") or {}
        self.common = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.special = re.compile("|".join(map(re.escape, sorted(special))) or "(?!)")
        self.turn = 0
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bpe = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for raw, i in ranks.items():
            self.width[i] = len(raw)
        self.chunk = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache = cache

    def split(self, text: str) -> list[str]:
        """Keys of chunks, cut before spaces and line ends: a bare word stands for a space and the word, a key that
        begins with a line end is the chunk itself, and so is what follows \0. Right unless white space touches."""
        keys = text.replace("\n", " \n").split(" ")
        if keys[0]:
            keys[0] = "\0" + keys[0]
        else:
            del keys[0]
        return keys

    def touching(self, key: str) -> bool:
        """Whether a key shows that white space touches in its text, so that its cuts may be wrong."""
        bare = key[1:] if key[0:1] in ("\n", "\0") else key
        return not bare or "\0" in bare or bare[0] in SPACE or bare[-1] in SPACE

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > self.cache:  # what is used again comes back from the older half
            self.older, self.known = self.known, {}
        known, older = self.known, self.older.get
        out, keyed, new = [b""] * len(texts), {}, []
        for i, text in enumerate(texts):
            if text and (not self.common or self.special.search(text)):
                out[i] = self.by_library(text)
            elif text:
                keyed[i] = self.split(text)
        asked = set().union(*keyed.values()).difference(known)
        wrong = {k for k in asked if self.touching(k)}
        asked -= wrong
        for i, keys in keyed.items():
            if "\0" in texts[i] or (wrong and not wrong.isdisjoint(keys)):
                keyed[i] = ["\0" + c for c in self.chunk.findall(texts[i])]
                asked |= set(keyed[i]).difference(known)
        for k in asked:
            if (raw := older(k)) is None:
                new.append(k)
            else:
                known[k] = raw
        self._learn(new)
        for i, keys in keyed.items():
            out[i] = b"".join(map(known.__getitem__, keys))
        if texts:
            self.turn += 1
            probe = self.turn * 7919 % len(texts)
            if out[probe] != self.by_library(texts[probe]):
                raise ValueError(f"the chunk encoder and the tokenizers library differ on a text that begins with {texts[probe][:80]!r}")
        return out

    def by_library(self, text: str) -> bytes:
        return np.array(self.theirs.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        known, plain, lined = self.known, [], []  # chunks that begin with white space and end otherwise can be encoded in one go
        for k in new:
            head = k[0]
            if head == "\0":
                known[k] = np.array(self.bpe.encode_ordinary(k[1:]), "<u4").tobytes()
            else:
                (lined if head == "\n" else plain).append(k)
        for lead, run in (("", lined), (" ", plain)):
            for i in range(0, len(run), 2000):
                part = run[i : i + 2000]
                ids = np.array(self.bpe.encode_ordinary(lead + lead.join(part)), "<u4")
                ends = np.cumsum(np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)) + len(lead))
                cuts = (4 * (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1)).tolist()
                raw = ids.tobytes()
                known.update(zip(part, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))


@functools.lru_cache(maxsize=1)
def shared_tokenizer(path: str) -> ByteTokenizer:
    """A process's tokenizer; tasks that run in one Python worker share what it has learned."""
    return ByteTokenizer(path)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size. ``sizes`` must come in falling order, none above ``capacity``.

    The tree's leaves are the bins' free room and each inner node is the larger of its children, so the leftmost bin with
    room is found from the root. An unused bin has all its room; the tree has as many leaves as could be needed.
    """
    n = len(sizes)
    leaves = 1 << max(0, int(n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        node >>= 1
        while node:
            top = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == top:
                break
            tree[node] = top
            node >>= 1
    return bins, offsets


def pieces(df: DataFrame, tokenizer: str, end_id: int, length: int, id_col: str, text_col: str) -> DataFrame:
    """(id, _row, doc_tokens, start, length, ids_crc32) of the pieces of every whole text, cut each ``length`` ids."""
    bounded_batches(df.sparkSession)
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def start():
        tokens = shared_tokenizer(tokenizer)
        end = np.array([end_id], "<u4").tobytes()

        def cut(texts):
            ids = [raw + end for raw in tokens.encode([t or "" for t in texts])]
            step = 4 * length
            made = [[{"start": i // 4, "length": min(step, len(raw) - i) // 4, "ids_crc32": zlib.crc32(raw[i : i + step])} for i in range(0, len(raw), step)] for raw in ids]
            return {"doc_tokens": pa.array([len(raw) // 4 for raw in ids], pa.int64()), "pieces": pa.array(made, pa.list_(kind))}

        return cut

    udf = text_udf("struct<doc_tokens: bigint, pieces: array<struct<start: bigint, length: bigint, ids_crc32: bigint>>>", start)
    made = df.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), udf(text_col).alias("_r"))
    return made.select(id_col, "_row", "_r.doc_tokens", F.explode("_r.pieces").alias("_p")).select(id_col, "_row", "doc_tokens", "_p.*")


def pack(df: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """Pack every document; one row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequence ids are unique and not dense: the group's number in the high bits, the sequence's within it in the low 32.
    """
    groups = max(1, -(-df.count() // group_docs))
    cut = pieces(df, tokenizer, end_id, length, id_col, text_col)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col("_row")), F.lit(groups))
    dealt = cut.select(*names, drawn.alias("_g")).repartition(min(groups, 10_000), "_g").sortWithinPartitions("_g", F.desc("length"), id_col, "start", "ids_crc32")
    kind = dealt.select(*names, F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).schema

    def place(batches):
        from .common import whole_groups

        for t, cuts in whole_groups(batches, ["_g"]):
            bins, offsets = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                group = int(t.column("_g")[a].as_py())
                k, o = first_fit_decreasing(t.column("length").slice(a, b - a).to_numpy(), length)
                bins.append(k + (group << 32))
                offsets.append(o)
            out = t.select(names).append_column("sequence_id", pa.array(np.concatenate(bins))).append_column("offset", pa.array(np.concatenate(offsets)))
            yield from out.to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(place, kind)
