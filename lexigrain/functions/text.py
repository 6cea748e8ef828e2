"""Scalar functions: tokens, zones, scores, wildcard patterns and codecs. Columns in, columns out, unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits and weights of zones.
ZONES = {"author": 1, "title": 2, "annotation": 4, "body": 8}
WEIGHTS = {"author": 0.5, "title": 0.3, "annotation": 0.2, "body": 0.1}
#: Marks the end of a word in trigrams and rotations; it is never part of a word.
END = "$"


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of ASCII letters, digits and _; split before lowering. Null gives an empty array."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\W+"), lambda w: w != "")
    return F.transform(parts, F.lower)


def rest(array: Column | str) -> Column:
    """All elements but the first."""
    return F.slice(array, F.lit(2), F.size(array))


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(items: Column, key, make) -> Column:
    """Groups of an array within its row: the items are sorted, and ``make(first, run)`` gives what stands for each run of
    items with equal ``key``. Nothing is shuffled, and time follows n log n."""

    def grouped(a: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (key(F.get(a, i)) != key(F.get(a, i - 1))))
        return let(starts, lambda s: F.transform(s, lambda b, k: let(F.slice(a, b + 1, F.coalesce(F.get(s, k + 1), F.size(a)) - b), lambda run: make(F.get(a, b), run))))

    return let(F.sort_array(items), lambda a: F.when(F.size(a) > 0, grouped(a)))


def word_runs(tokens: Column) -> Column:
    """array<(term, tf, zones, positions)> of a document's array of (term, zone)."""
    placed = F.transform(tokens, lambda t, i: F.struct(t["term"].alias("term"), i.alias("pos"), t["zone"].alias("zone")))

    def make(first: Column, run: Column) -> Column:
        zones = F.aggregate(run, F.lit(0), lambda acc, t: acc.bitwiseOR(t["zone"]))
        return F.struct(first["term"].alias("term"), F.size(run).cast("bigint").alias("tf"), zones.alias("zones"), F.transform(run, lambda t: t["pos"]).alias("positions"))

    return runs(placed, lambda t: t["term"], make)


def counts(items: Column) -> Column:
    """array<(item, n)>: how often each item is in an array."""
    return runs(items, lambda t: t, lambda first, run: F.struct(first.alias("item"), F.size(run).cast("bigint").alias("n")))


def equals(value: str):
    """(str to function) A test for array elements."""
    return lambda x: x == value


def zone_rating(zones: Column | str) -> Column:
    """Sum of the weights of the zones whose bits are set."""
    zones = F.col(zones) if isinstance(zones, str) else zones
    parts = [F.when(zones.bitwiseAND(F.lit(bit)) != 0, F.lit(WEIGHTS[z])).otherwise(F.lit(0.0)) for z, bit in ZONES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def idf(documents: Column, df: Column) -> Column:
    return F.log(documents / df)


def bm25_part(idf_: Column, tf: Column, length: Column, average: Column, k: float = 1.5, b: float = 0.75) -> Column:
    """A query term's share of a document's BM25 score. It is 0 where the average length, rounded down, is 0: a length is
    infinitely many times such an average."""
    share = idf_ * tf * F.lit(k + 1) / (tf + F.lit(k) * (F.lit(1 - b) + F.lit(b) * length / F.nullif(average, F.lit(0))))
    return F.coalesce(share, F.lit(0.0))


def trigrams(word: Column | str) -> Column:
    """All 3-character pieces of the word between END marks; none for an empty word."""
    padded = F.concat(F.lit(END), word, F.lit(END))
    n = F.length(padded)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def rotations(word: Column | str) -> Column:
    """All rotations of the word with an END mark after it."""
    marked = F.concat(word, F.lit(END))
    n = F.length(marked)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(marked, i, n), F.substring(marked, F.lit(1), i - 1)))


def restored(rotation: Column | str) -> Column:
    """The word of a rotation."""
    return F.concat(F.substring_index(rotation, END, -1), F.substring_index(rotation, END, 1))


def like_pattern(wildcard: str) -> str:
    """(str to str) LIKE pattern of a word with * for any run."""
    return wildcard.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")


def matches(word: Column | str, wildcard: str) -> Column:
    return F.like(word, F.lit(like_pattern(wildcard)))


def wildcard_trigrams(wildcard: str) -> list[str]:
    """(str to list) Trigrams that every matching word has; empty if the pattern is too short for any."""
    out = []
    for part in f"{END}{wildcard}{END}".split("*"):
        out += [part[i : i + 3] for i in range(len(part) - 2)]
    return sorted(set(out))


def megabytes(size: Column) -> Column:
    """Bytes as MB with two decimals, of whole KB."""
    return F.round(F.floor(size / 1024) / F.lit(1024.0), 2)


def range_delimiters(parts: int, alphabet: str = "0abcdefghijklmnopqrstuvwxyz", width: int = 4) -> list[str]:
    """(int to list) parts - 1 strings that cut the words over ``alphabet`` into equal ranges, in its positional system."""
    size, out = len(alphabet) ** width, []
    for i in range(1, parts):
        value, text = size * i // parts, ""
        for _ in range(width):
            value, digit = divmod(value, len(alphabet))
            text = alphabet[digit] + text
        out.append(text)
    return out


def contiguous_splits(items: Sequence, parts: int) -> list[list]:
    """(list to lists) Contiguous runs of nearly equal length."""
    cuts = [len(items) * i // parts for i in range(parts + 1)]
    return [list(items[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def vbyte_encode(values: Sequence[int]) -> bytes:
    """(ints to bytes) Little-endian groups of 7 bits; the high bit marks a value's last byte."""
    out = bytearray()
    for v in values:
        if v < 0:
            raise ValueError("only values of at least 0 can be encoded")
        while v > 127:
            out.append(v & 127)
            v >>= 7
        out.append(v | 128)
    return bytes(out)


def vbyte_decode(raw: bytes) -> list[int]:
    """(bytes to ints) The inverse of vbyte_encode."""
    out, value, shift = [], 0, 0
    for byte in raw:
        value |= (byte & 127) << shift
        shift += 7
        if byte & 128:
            out.append(value)
            value = shift = 0
    if shift:
        raise ValueError("the last value breaks off")
    return out


def delta(values: Sequence[int]) -> list[int]:
    """(ints to ints) Gaps of a rising list, the first value first."""
    return [b - a for a, b in zip([0, *values], values, strict=False)]
