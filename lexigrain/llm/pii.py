"""Personal data: regular expressions propose, checksums confirm, context words adjust the score.

All of it is DataFrame functions. For each kind the matches of its pattern and the gaps between them (the text split
by the same pattern) give positions in code points, and in bytes, by running sums. Validators then confirm matches: octets of at
most 255 for ip, 12 to 19 digits and the Luhn sum for card, 9 to 15 digits for phone, mod-97 for iban, possible groups for ssn.
Words in the CONTEXT characters before a span (back to the previous match of its kind) raise its score. Base kinds (email, ip,
card, phone) stay whatever their score. The kinds that the method adds need ADDED_SCORE: an iban has it by its checksum, an ssn
(three, two and four digits) only beside a context word.

An iban may be followed by a word that looks like more of it, or stand in what looks like another. So its pattern matches
the first four characters only, wherever no letter or digit is before them, and captures the longest continuation without
one after it. Every end within that which is followed by a space is tried, the longest first, and mod-97 decides. A start
within a confirmed iban is passed over; one within a rejected candidate isn't.

The patterns are possessive and may start only at the beginning of a run or where the previous match ended, which finds
the same leftmost matches as the plain forms in linear time and without recursion on long runs. Running sums go by chunks, so
texts with very many matches take time little above proportion.

Defined cases: null text is the empty text, without spans; repeated rows give equal rows; spans of different kinds may
overlap, those of one kind never do; an empty table gives an empty result; columns other than id and text are not read by
``find``, and ``redact`` keeps them all, whatever their names. Whole texts are searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import free

#: Fixed order of kinds; the first four are the base.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = KINDS[:4]
#: Fixed patterns, in possessive form.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9]))[A-Z]{2}[0-9]{2}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: Characters of an iban that its pattern matches, and letters and digits that it has at least.
IBAN_HEAD, IBAN_LEAST = 4, 12
#: What a text must contain for a kind to be searched at all.
NEEDED = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"[0-9](?:[ -]?[0-9]){11}")),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: F.rlike(t, F.lit(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")),
    "ssn": lambda t: F.rlike(t, F.lit(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
}
#: Scores before context, words that raise them by CONTEXT_SCORE, and the characters before a span where they count.
SCORES = {"email": 0.75, "ip": 0.6, "card": 0.75, "phone": 0.6, "iban": 0.75, "ssn": 0.55}
WORDS = {
    "email": r"\b(?:e-?mail|mail|contact|kontakt|correo|courriel)\b",
    "ip": r"\b(?:ip|host|server|address|adresse)\b",
    "card": r"\b(?:card|credit|visa|mastercard|karte|carte|tarjeta)\b",
    "phone": r"\b(?:tel|phone|call|mobile|fax|telefon|t[eé]l[eé]phone|tel[eé]fono)\b",
    "iban": r"\b(?:iban|bank|account|konto|compte|cuenta)\b",
    "ssn": r"(?:^|[^a-z])(?:ssn|social security|sozialversicherung|seguro social)(?:[^a-z]|$)",
}
CONTEXT, CONTEXT_SCORE, ADDED_SCORE = 40, 0.25, 0.75
#: What must not touch an ssn.
TOUCHING = "[A-Za-z0-9-]"
#: A span's place in code points (start, end) and bytes (first, last), ends exclusive.
SPAN = "array<struct<start:bigint,rank:int,end:bigint,score:double,first:bigint,last:bigint>>"
#: Elements of a chunk of a running sum.
CHUNK = 128


def mod97(text: Column) -> Column:
    """Whether letters and digits, the first four moved to the end and letters read as 10 to 35, leave 1 modulo 97."""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    value = lambda c: F.conv(c, 36, 10).cast("int")
    step = lambda acc, c: F.pmod(acc * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)).cast("int")) == 1


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        octet = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)"
        return F.rlike(m, F.lit(rf"^{octet}(?:\.{octet}){{3}}$"))
    if kind == "card":
        digits = F.regexp_replace(m, "[ -]", "")
        return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    if kind == "ssn":
        return ~F.rlike(m, F.lit("^(?:000|666|9)|-00-|-0000$"))
    return mod97(m) if kind == "iban" else F.lit(True)


def running(values: Column, step, zero: Column) -> Column:
    """What ``step`` makes of an array's elements up to each of them. Chunk by chunk, as a list that grows with every element
    would be copied as often."""

    def within(v: Column, before: Column) -> Column:
        return F.transform(v, lambda x, i: F.aggregate(F.slice(v, i - i % CHUNK + 1, i % CHUNK + 1), F.get(before, F.floor(i / CHUNK).cast("int")), step))

    def over(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(v, c * CHUNK + 1, F.lit(CHUNK)), zero, step))
        return let(chunks, lambda c: let(F.transform(c, lambda x, i: F.aggregate(F.slice(c, F.lit(1), i), zero, step)), lambda before: within(v, before)))

    return let(values, lambda v: F.when(F.size(v) > 0, over(v)))


def account(body: Column) -> Column:
    """The longest start of ``body``, up to one of its spaces or its end, that mod-97 confirms; null if none does."""
    words = F.split(body, " ")
    starts = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    return F.get(F.filter(starts, lambda m: (F.length(F.replace(m, F.lit(" "), F.lit(""))) >= IBAN_LEAST) & confirmed("iban", m)), F.lit(0))


def _spans(kind: str, matches: Column, gaps: Column, bodies: Column) -> Column:
    """Confirmed spans of a kind from its pattern's matches, the gaps around them and, for iban, what ``account`` makes of them."""
    rank, plus = F.lit(KINDS.index(kind)), lambda acc, x: acc + x
    none = F.lit(0).cast("bigint")

    def sums(length) -> Column:
        return running(F.transform(matches, lambda m, i: (length(F.get(gaps, i)) + length(m)).cast("bigint")), plus, none)

    def span(m: Column, i: Column, after: Column, last: Column) -> Column:
        body = F.get(bodies, i) if kind == "iban" else m
        start, first = after - F.length(m), last - F.octet_length(m)
        score = F.lit(SCORES[kind]) + F.when(F.rlike(F.lower(F.right(F.get(gaps, i), F.lit(CONTEXT))), F.lit(WORDS[kind])), CONTEXT_SCORE).otherwise(0.0)
        good = body.isNotNull() if kind == "iban" else confirmed(kind, m)
        if kind == "ssn":
            good &= ~F.rlike(F.right(F.get(gaps, i), F.lit(1)), F.lit(TOUCHING)) & ~F.rlike(F.left(F.get(gaps, i + 1), F.lit(1)), F.lit(TOUCHING))
            good &= ~((F.get(gaps, i) == "") & (i > 0)) & ~((F.get(gaps, i + 1) == "") & (i < F.size(matches) - 1))
        if kind not in BASE:
            good &= score >= ADDED_SCORE
        # null where it isn't confirmed
        return F.when(good, F.struct(start.alias("start"), rank.alias("rank"), (start + F.length(body)).alias("end"), score.alias("score"), first.alias("first"), (first + F.octet_length(body)).alias("last")))

    def placed(after: Column) -> Column:
        return let(sums(F.octet_length), lambda last: F.filter(F.transform(matches, lambda m, i: span(m, i, F.get(after, i), F.get(last, i))), lambda s: s.isNotNull()))

    found = let(sums(F.length), placed).cast(SPAN)
    if kind != "iban":
        return found

    def outside(acc: Column, s: Column) -> Column:  # a start within an account is passed over
        return F.when((F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]), acc).otherwise(F.concat(acc, F.array(s)))

    return let(found, lambda f: F.aggregate(f, F.array().cast(SPAN), outside))


def with_spans(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """The table with a column more, and its name: array of (start, rank, end, score, first, last) by start, then rank, the kind's
    place in KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = free(df, "spans", *[f"_{x}_{k}" for x in "mgbs" for k in KINDS])
    m, g, b, s = (dict(zip(KINDS, names[1 + i * len(KINDS) :], strict=False)) for i in range(4))
    # each step is a projection of its own, so that no search runs twice
    heads = {m[k]: F.when(NEEDED[k](text), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))) for k in KINDS}
    found = df.withColumns(heads | {b["iban"]: F.when(NEEDED["iban"](text), F.regexp_extract_all(text, F.lit(PATTERNS["iban"]), F.lit(1)))})
    cut = found.withColumns({g[k]: F.when(F.size(m[k]) > 0, F.split(text, PATTERNS[k], -1)) for k in KINDS})
    cut = cut.withColumn(b["iban"], F.transform(b["iban"], account))
    placed = cut.withColumns({s[k]: F.when(F.size(m[k]) > 0, _spans(k, F.col(m[k]), F.col(g[k]), F.col(b["iban"]))) for k in KINDS})
    none = F.array().cast(SPAN)
    merged = placed.withColumn(names[0], F.sort_array(F.concat(*[F.coalesce(s[k], none) for k in KINDS])))
    return merged.select(*df.columns, names[0]), names[0]


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) with spans an array of (kind, start, end, score); end is exclusive, code points count."""
    names = F.array(*map(F.lit, KINDS))
    found, spans = with_spans(df.select(id_col, text_col), text_col)
    named = F.transform(spans, lambda s: F.struct(F.get(names, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    return found.select(id_col, named.alias("spans"))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest columns of contract op8."""
    found, spans = with_spans(df.select(F.col(id_col), F.col(text_col)), text_col)
    found = found.select(F.col(id_col).alias("_id"), F.col(spans).alias("_spans"), F.filter(spans, lambda s: s["rank"] < len(BASE)).alias("_base"))

    def of_kind(rank: int) -> Column:
        return F.filter("_base", lambda s: s["rank"] == rank)

    counts = [F.size(of_kind(i)).cast("bigint").alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    return found.select(F.col("_id").alias(id_col), *counts, F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with each span in the text replaced by its kind in brackets; spans that overlap become one, named
    after the first of them."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    found, spans = with_spans(df, text_col)

    def joined(raw: Column, s: Column, reach: Column) -> Column:
        """``reach`` is how far spans go up to each: one that starts beyond the reach before it begins a new piece."""
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["first"] >= F.get(reach, i - 1)))

        def piece(h: Column) -> Column:
            before = F.when(h == 0, F.lit(0).cast("bigint")).otherwise(F.get(reach, h - 1))
            plain = F.substring(raw, (before + 1).cast("int"), (F.get(s, h)["first"] - before).cast("int"))
            return F.concat(plain.cast("string"), F.get(names, F.get(s, h)["rank"]))

        rest = F.substring(raw, (F.element_at(reach, -1) + 1).cast("int"), F.octet_length(raw)).cast("string")
        return F.concat(F.array_join(F.transform(heads, piece), ""), rest)

    def whole(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["last"]), lambda acc, x: F.greatest(acc, x), F.lit(0).cast("bigint"))
        return let(F.col(text_col).cast("binary"), lambda raw: let(reach, lambda r: joined(raw, s, r)))

    changed = F.when(F.size(spans) > 0, let(F.col(spans), whole)).otherwise(F.col(text_col))
    return found.withColumn(text_col, changed).select(*df.columns)
