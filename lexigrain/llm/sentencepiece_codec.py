"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Method: a score-ordered agenda of adjacent symbol pairs. A text starts as its characters; the pair whose
concatenation has the best score (leftmost on ties) is merged, its neighbours' pairs enter the agenda, until no pair is
in the vocabulary. Short segments run through one agenda in numpy, all of a batch at once; long ones through a heap.

Segments are independent: where no piece of the vocabulary has a space mark after another character, no merge can cross
the border before a space mark, so a text is the concatenation of its space-led segments, which are cached. Each newly met
segment's ids are compared with the sentencepiece library in the same Arrow batch, and so are one whole text of each batch, at
another place in it each time, and what its ids decode to; a difference raises an error. Decoded texts are made from the ids.

Defined cases: null encodes as the empty text, which has no ids but the end id; repeated rows give equal rows; an empty
table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, text_udf

MARK = "▁"
NEVER = np.int32(2**31 - 1)
#: Punctuation that is cut off the end of a word where no piece joins it to a letter or digit.
TAIL = ".,;:!?$#%&*|)(\"'"
#: Segments of up to this many characters share a numpy agenda.
SHORT = 24
#: Segments that each half of a task's cache may hold.
CACHE = 300_000


class PieceCodec:
    """Encoder and decoder of one merge-type model; equal to the library's encode and decode without sampling."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.unk, self.eos = sp.unk_id(), sp.eos_id()
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        normal = [i for i in range(n) if i not in self.control and i not in self.byte_of and not sp.is_unknown(i)]
        symbols = {self.pieces[i]: i for i in normal}
        for p in [self.pieces[i] for i in normal]:
            for ch in p:
                symbols.setdefault(ch, len(self.pieces) + len(symbols))
        self.symbols, self.size = symbols, n
        self.base = n + len(symbols) + 1
        joined: dict[int, tuple[int, float]] = {}
        for i in normal:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    joined[a * self.base + b] = (i, sp.get_score(i))
        self.joined = joined
        self.keys = np.array(sorted(joined), np.int64)
        ranked = sorted({got for got in joined.values()}, key=lambda got: -got[1])
        times = Counter(score for _, score in ranked)
        tied = [self.pieces[i] for i, score in ranked if times[score] > 1]
        self.distinct = not any(p.strip(MARK) for p in tied)  # only the heap orders ties; runs of marks may tie
        rank = {i: r for r, (i, _) in enumerate(ranked)}
        self.ranks = np.array([rank[joined[k][0]] for k in self.keys.tolist()], np.int32)
        self.of_rank = np.array([i for i, _ in ranked], np.int32)
        self.adjacent = {c for i in normal for pair in zip(self.pieces[i], self.pieces[i][1:], strict=False) if any(map(str.isalnum, pair)) for c in pair}
        self.spaced = not any(MARK in p.lstrip(MARK) for p in (self.pieces[i] for i in normal))
        self.lined = not any("\n" in p and len(p) > 1 for p in (self.pieces[i] for i in normal))
        self.by_char = np.full(0x110000, -2, np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.by_char[ord(p)] = i
        self.outside: dict[str, list[int]] = {}
        self.digits = [str(i) for i in range(n)]
        spelled = set(self.byte_of) | self.control | {self.unk}
        self.shown = {str(i): p.replace(MARK, " ") for i, p in enumerate(self.pieces) if i not in spelled}
        # no byte below 128 is part of a longer character; a byte for a space would pass for the mark in front
        self.shown |= {str(i): chr(b) for i, b in self.byte_of.items() if b < 128 and b != 32}
        self.anchor = next((i for i in normal if self.pieces[i].isascii()), None)

    # -- encoding -------------------------------------------------------------------------------------------------
    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's concatenation by falling score; NEVER where it isn't in the vocabulary."""
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NEVER)

    def _agenda(self, ids: np.ndarray) -> np.ndarray:
        """Rows of symbols, padded with -1 at the right, after all merges. -2 stands for a character outside."""
        done, rows, step = ids.copy(), np.arange(len(ids)), np.arange(ids.shape[1] - 1)
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = rank.argmin(1)
            at = np.arange(len(rows))
            top = rank[at, best]
            live = top < NEVER
            if not live.all():
                done[rows[~live]] = ids[~live]
                rows, ids, rank, best, top = rows[live], ids[live], rank[live], best[live], top[live]
                at = np.arange(len(rows))
                if not len(rows):
                    break
            later = step >= best[:, None]
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[at, best] = self.of_rank[top]
            rank[:, :-1] = np.where(later[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NEVER
            for side in (best - 1, best):
                ok = (side >= 0) & (side < rank.shape[1])
                r, c = at[ok], side[ok]
                rank[r, c] = self._ranks(ids[r, c], ids[r, c + 1])
        return done

    def _heap(self, symbols: list[int]) -> list[int]:
        """The same agenda as a heap with lazily dropped entries, for one long segment."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        after[-1] = -1
        heap: list[tuple[float, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and symbols[i] >= 0 and symbols[j] >= 0 and (got := self.joined.get(symbols[i] * self.base + symbols[j])):
                heapq.heappush(heap, (-got[1], i, j, symbols[i], symbols[j]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if symbols[i] != a or symbols[j] != b or after[i] != j:
                continue
            symbols[i], symbols[j] = self.joined[a * self.base + b][0], -3
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s != -3]

    def _fallback(self, ch: str) -> list[int]:
        if (ids := self.outside.get(ch)) is None:
            ids = [self.byte_ids[b] for b in ch.encode()] if self.byte_ids else [self.unk]
            self.outside[ch] = ids
        return ids

    def segments(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole segments, in which spaces are marks already."""
        out: list = [None] * len(texts)
        by_width: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            by_width.setdefault(max(4, -(-len(t) // 4) * 4) if self.distinct and len(t) <= SHORT and MARK not in t[1:] else 0, []).append(i)
        for width, members in by_width.items():
            own = [texts[i] for i in members]
            if width:
                grid = np.full((len(own), width), -1, np.int32)
                held = np.arange(width) < np.array([len(t) for t in own])[:, None]
                grid[held] = self.by_char[np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)]
                grid = self._agenda(grid)
                odd = ((grid == -2) | (grid >= self.size)).any(1).tolist()
                rows, counts = grid.tolist(), (grid != -1).sum(1).tolist()
                found = [r[:c] for r, c in zip(rows, counts, strict=True)]
            else:
                found = [self._heap([self.symbols.get(ch, -2) for ch in t]) for t in own]
                odd = [any(s < 0 or s >= self.size for s in r) for r in found]
            for i, t, row, spelled in zip(members, own, found, odd, strict=True):
                if spelled:
                    ids, k = [], 0
                    for s in row:
                        if 0 <= s < self.size:
                            ids.append(s)
                            k += len(self.pieces[s])
                        else:
                            ids += self._fallback(t[k])
                            k += 1
                    row = ids
                out[i] = row
        return out

    def split(self, text: str) -> list[str]:
        """Segments of a text. A plain word stands for the segment of a mark and the word; others begin with \\0."""
        if not text:
            return []
        if self.spaced and self.lined and "  " not in text and " \n" not in text and MARK not in text and "\0" not in text and text[0] != " ":
            return text.replace("\n", " \n").split(" ")
        marked = MARK + text.replace(" ", MARK)
        return ["\0" + s for s in (re.findall(f"{MARK}*[^{MARK}]+|{MARK}+$", marked) if self.spaced else [marked])]

    @staticmethod
    def segment(key: str) -> str:
        return key[1:] if key[0:1] == "\0" else key if key[0:1] == "\n" else MARK + key

    def encode(self, text: str) -> list[int]:
        ids = [i for s in self.segments([self.segment(k) for k in self.split(text)]) for i in s]
        if not self.byte_ids:  # the library joins runs of unknown characters
            ids = [i for k, i in enumerate(ids) if not (k and i == self.unk == ids[k - 1])]
        return ids

    # -- decoding -------------------------------------------------------------------------------------------------
    def decode_shown(self, ids: str) -> str:
        """Text of decimal ids parted by spaces. Ids that are spelled otherwise than their piece take the long way."""
        if not ids:
            return ""
        each = ids.split(" ")
        try:
            text = "".join(map(self.shown.__getitem__, each))
        except KeyError:
            return self.decode(list(map(int, each)))
        return text[1:] if text[:1] == " " else text

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids vanish, runs of byte ids become UTF-8 (bad bytes one replacement mark each), the
        mark that encoding puts in front goes."""
        out, run, first = [], bytearray(), True
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(utf8(bytes(run)))
                run.clear()
                first = False
            if i is None or i in self.control:
                continue
            piece = " ⁇ " if i == self.unk else self.pieces[i].replace(MARK, " ")
            out.append(piece[1:] if first and piece[0] == " " and i != self.unk else piece)
            first = False
        return "".join(out)


    def by_library(self, ids: list[int], block: int = 1000) -> str:
        """The library's decode(ids). It takes the square of a list's length, so longer lists go in blocks that no run of bytes
        crosses, each behind a known piece that keeps its first mark."""
        cuts = [0]
        for at in range(block, len(ids), block):
            while at < len(ids) and ids[at] in self.byte_of:
                at += 1
            if cuts[-1] < at < len(ids):
                cuts.append(at)
        if self.anchor is None:
            cuts = [0]
        blocks = [ids[a:b] if not a else [self.anchor, *ids[a:b]] for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
        first, *others = self.library.decode(blocks, num_threads=1)
        return first + "".join([t[len(self.pieces[self.anchor]) :] for t in others])


def utf8(raw: bytes) -> str:
    """Decode; each byte that belongs to no character gives one U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[: e.start].decode() + "�" + utf8(raw[e.start + 1 :])


@functools.lru_cache(maxsize=1)
def encoder(path: str, cache: int = CACHE):
    """A function from texts to (ids as text, count, text that these ids decode to) for each, with its own cache and checks.
    A process makes it once; tasks that run in one Python worker share what it has learned."""
    codec = PieceCodec(path)
    halves: list[dict[str, str]] = [{}, {}]  # ids as text; what is used again comes back from the older half
    turn = [0]
    front = codec.library.encode("\n")
    tail = "".join(c for c in TAIL if c not in codec.adjacent)

    def learn(new: list[str], known: dict[str, str]) -> None:
        cut = {}  # words with a tail are two segments
        for k in new:
            core = k.rstrip(tail)
            if core and core != k and core[-1].isalnum() and k[0] not in "\0\n":
                cut[k] = (core, "\0" + k[len(core) :])
        wanted = {p for two in cut.values() for p in two} | {k for k in new if k not in cut}
        fresh = [k for k in wanted if k not in known]
        parts = [codec.segment(k) for k in fresh]
        ids = codec.segments(parts)
        # the library puts a mark in front of what it encodes; a line end keeps it from segments that have none
        led = [p[:1] == MARK for p in parts]
        theirs = codec.library.encode([(p[1:] if m else "\n" + p).replace(MARK, " ") for p, m in zip(parts, led, strict=True)], num_threads=1)
        for k, p, m, mine, other in zip(fresh, parts, led, ids, theirs, strict=True):
            if (mine if m else front + mine) != other and p != MARK:
                raise ValueError(f"the agenda and the library differ on {p!r}")
            known[k] = " ".join([codec.digits[x] for x in mine])
        for k, (core, end) in cut.items():
            known[k] = f"{known[core]} {known[end]}"

    def work(texts: list[str | None]) -> list[tuple[str, int, str]]:
        texts = [t or "" for t in texts]
        if len(halves[0]) > cache:
            halves[:] = {}, halves[0]
        known, older = halves
        keys, new = [codec.split(t) for t in texts], []
        for k in set().union(*keys).difference(known):
            if (v := older.get(k)) is None:
                new.append(k)
            else:
                known[k] = v
        if new:
            learn(new, known)
        out = []
        for ks in keys:
            ids = " ".join(map(known.__getitem__, ks))
            out.append((ids, ids.count(" ") + 1 if ids else 0, codec.decode_shown(ids)))
        if texts:
            turn[0] += 1
            probe = turn[0] * 7919 % len(texts)
            theirs = codec.library.encode([texts[probe]], num_threads=1)[0]
            if out[probe][0] != " ".join(map(str, theirs)) or out[probe][2] != codec.by_library(theirs):
                raise ValueError(f"the agenda and the library differ on a text that begins with {texts[probe][:80]!r}")
        return out

    work.codec = codec
    return work


def encode_digests(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, with the end id, as contract op1 has them."""
    bounded_batches(df.sparkSession)

    def start():
        work = encoder(model)
        end = str(work.codec.eos)

        def digests(texts):
            got = work(texts)
            sha = [hashlib.sha256((f"{ids} {end}" if ids else end).encode()).hexdigest() for ids, _, _ in got]
            return {"n_tokens": pa.array([n + 1 for _, n, _ in got], pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for _, _, t in got], pa.string())}

        return digests

    udf = text_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>", start)
    return df.select(id_col, udf(text_col).alias("_r")).select(id_col, "_r.*")


def encode_ids(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """(id, ids) of every whole text."""
    bounded_batches(df.sparkSession)

    def start():
        work = encoder(model)
        tail = [work.codec.eos] if end else []
        return lambda texts: {"ids": pa.array([[*map(int, ids.split()), *tail] for ids, _, _ in work(texts)], pa.list_(pa.int32()))}

    return df.select(id_col, text_udf("struct<ids: array<int>>", start)(text_col).alias("_r")).select(id_col, "_r.*")


def decode_ids(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every list of ids; null decodes as the empty list."""
    bounded_batches(df.sparkSession)

    def start():
        codec = PieceCodec(model)
        return lambda lists: {"text": pa.array([codec.decode(ids or []) for ids in lists], pa.string())}

    return df.select(id_col, text_udf("struct<text: string>", start)(ids_col).alias("_r")).select(id_col, "_r.*")
