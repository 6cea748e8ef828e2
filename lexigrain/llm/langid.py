"""Language identification by string kernels.

Method: blended-spectrum presence kernels. A text's features are the letter n-grams of lengths 1 to 3 that it
contains, each once; the kernel of two texts is the number of n-grams they share over the root of the product of
their own numbers. Nyström landmarks span the feature space of a kernel ridge regression, one language against the rest. As
the kernel with a landmark is an inner product of presence vectors, landmarks and regression fold into one weight for
each n-gram and language, so batches of whole texts are scored by one matrix product each.

n-grams are of lower-cased letters of all scripts; every run of other characters is one space, and a text has one before and
after it. They are hashed to 2 ** 16 places. Long texts are read in slices that join without a seam.

Fitting: at most SAMPLE labelled texts in all, the same number of each language, those with the smallest hashes of their ids; but LEAST of
each however many languages there are (documented bound). Every language is learned and has LEAST landmarks, or all its rows. Only
rows with a language and whose crc32(id) mod 3 is not the held-out remainder 1 are learned from. Prediction uses the text alone.

Defined cases: null text, or text without a letter, is ``und`` with score 0; with no labelled rows every text is ``und``,
and ``keep_identified`` then rejects only null texts and those without a letter; ties go to the first language in order; repeated
rows give equal rows, and labelled ones whose number goes beyond the bound stay out together; an empty table gives an empty result;
columns other than id, text and language are not read, and ``keep_identified`` keeps all, whatever their names.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free, text_udf

#: Bounds of the fit: labelled texts, landmarks, and what each language has of both at least.
SAMPLE, LANDMARKS, LEAST = 3000, 400, 16
RIDGE = 1e-3
PLACES = 1 << 16
#: Characters of a text whose n-grams are hashed at once, and texts scored by one product.
SLICE, BATCH = 1 << 20, 32
#: Code points from here on are no letters, the last one before neither.
LETTERS_END = 0x40000


@cache
def _letter_table() -> np.ndarray:
    """Code of each character of the planes that have letters: its lower-case letter, or 0."""
    table = np.zeros(LETTERS_END, np.uint32)
    for c in range(LETTERS_END):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(ch.lower()[0])
    return table


def presence(texts: list[str], table: np.ndarray) -> np.ndarray:
    """(texts x PLACES) matrix of 0 and 1: the hashed n-grams, n = 1 to 3, in each whole text."""
    out = np.zeros((len(texts), PLACES), np.uint8)
    last, none = np.uint32(PLACES - 1), np.zeros(0, np.uint32)
    for row, text in zip(out, texts, strict=True):
        held = none  # the last two codes, with which the next slice's n-grams begin
        for i in range(0, max(len(text), 1), SLICE):
            part = (" " if not i else "") + text[i : i + SLICE] + (" " if i + SLICE >= len(text) else "")
            c = table[np.minimum(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), LETTERS_END - 1)]
            known = len(held)
            c = np.concatenate([held, c])
            fresh = np.ones(len(c), bool)
            fresh[1:] = (c[1:] | c[:-1]) != 0  # runs of what is no letter are one
            fresh[:known] = True
            c = c[fresh]
            row[(c * np.uint32(40503) ^ (c >> np.uint32(16)) * np.uint32(2531)) & last] = 1
            two = c[:-1] * np.uint32(92821) + c[1:] * np.uint32(31)
            row[(two ^ (two >> np.uint32(9))) & last] = 1
            three = two[:-1] * np.uint32(4099) + c[2:] * np.uint32(131)
            row[(three ^ (three >> np.uint32(11))) & last] = 1
            held = c[-2:]
    return out


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1)


def fit(bits: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = 3) -> tuple[list[str], np.ndarray]:
    """Languages in order and (PLACES x languages) weights, from presence rows packed to bits. Only some rows are unpacked at
    once, as this runs in the driver."""
    names = sorted(set(languages))
    target = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    dealt = np.random.default_rng(seed).permutation(len(bits))
    seen, chosen = dict.fromkeys(names, 0), []
    for i, row in enumerate(dealt):
        seen[languages[row]] += 1
        if i < landmarks or seen[languages[row]] <= LEAST:
            chosen.append(row)
    chosen = np.sort(chosen)
    used = np.flatnonzero(unpacked(np.bitwise_or.reduce(bits[chosen], axis=0)[None, :])[0])  # kernels with landmarks need no other n-grams
    sizes = np.sqrt(np.maximum(np.bitwise_count(bits).sum(1, dtype=np.int64), 1)).astype(np.float32)
    marks = np.concatenate([unpacked(bits[chosen[i : i + 64]])[:, used].astype(np.float32) for i in range(0, len(chosen), 64)]) / sizes[chosen, None]
    cross = np.concatenate([unpacked(bits[i : i + 64])[:, used].astype(np.float32) @ marks.T for i in range(0, len(bits), 64)])
    cross = (cross / sizes[:, None]).astype(np.float64)
    inner = cross[chosen]
    weight = np.linalg.solve(cross.T @ cross + ridge * len(cross) * inner + 1e-8 * np.eye(len(inner)), cross.T @ target)
    folded = np.zeros((PLACES, len(names)), np.float32)
    folded[used] = marks.T @ weight.astype(np.float32)
    return names, folded


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Fit on a bounded sample of the rows that may be learned from."""
    bounded_batches(df.sparkSession)
    open_ = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    counts = {r[0]: r[1] for r in open_.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).collect()}
    if not counts:
        return [], np.zeros((PLACES, 0), np.float32)
    each = max(sample // len(counts), LEAST)
    key = F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1 << 30))
    by_lang = lambda values: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[F.col(lang_col)]
    # somewhat more than wanted are drawn by the hash; of those, languages and hashes alone, rows with the smallest hashes stay
    wide = {k: int(min(1.0, (1.3 * each + 40) / n) * (1 << 30)) for k, n in counts.items()}
    drawn = open_.filter(key < by_lang(wide)).groupBy(F.col(lang_col).alias("lang"), key.alias("key")).count().toArrow().sort_by([("lang", "ascending"), ("key", "ascending")])
    bound, taken = dict.fromkeys(counts, 0), dict.fromkeys(counts, 0)
    for lang, k, n in zip(*[drawn.column(c).to_pylist() for c in ("lang", "key", "count")], strict=True):
        if taken[lang] + n <= each:
            taken[lang] += n
            bound[lang] = k + 1
        else:
            taken[lang] = each  # nothing after it either
    few = open_.filter(key < by_lang(bound)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def featurise(batches):
        table = _letter_table()
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                s = b.slice(i, BATCH)
                bits = np.packbits(presence(s.column("text").to_pylist(), table), axis=1)
                yield pa.RecordBatch.from_arrays([s.column("id").cast(pa.string()), s.column("lang"), pa.array([r.tobytes() for r in bits], pa.binary())], ["id", "lang", "bits"])

    rows = few.mapInArrow(featurise, "id string, lang string, bits binary").toArrow().sort_by([("id", "ascending"), ("bits", "ascending")])
    if not rows.num_rows:
        return [], np.zeros((PLACES, 0), np.float32)
    bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    return fit(bits, rows.column("lang").to_pylist())


def predictor(model: tuple[list[str], np.ndarray]):
    """A struct UDF (lang_pred, score) over a text column."""
    names, weights = model

    def start():
        table = _letter_table()

        def predict(texts):
            known = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            at = [i for i, k in enumerate(known) if k]
            if at and names:
                phi = presence([texts[i] for i in at], table)
                got = (phi.astype(np.float32) @ weights) / np.sqrt(np.maximum(phi.sum(1, keepdims=True, dtype=np.int64), 1))
                best = got.argmax(1)
                for i, k, s in zip(at, best, ((got[np.arange(len(at)), best] + 1) / 2).clip(0, 1), strict=True):
                    pred[i], score[i] = names[k], float(s)
            return {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())}

        return predict

    return text_udf("struct<lang_pred: string, score: double>", start, rows=BATCH)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model=None) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row."""
    bounded_batches(df.sparkSession)
    udf = predictor(model or learn(df, id_col, text_col, lang_col))
    out = df.select(F.col(id_col), held_out(id_col).alias("held_out"), udf(F.col(text_col)).alias("_r"))
    return out.select(id_col, "held_out", "_r.*")


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows, with all their columns, whose text has a learned language; ``und`` is what is rejected. Where no language could be learned,
    rows whose text has a letter."""
    bounded_batches(df.sparkSession)
    model = learn(df, id_col, text_col, lang_col)
    if not model[0]:
        return df.filter(F.rlike(F.col(text_col), F.lit(r"\p{L}")))
    (found,) = free(df, "language")
    marked = df.withColumn(found, predictor(model)(F.col(text_col)))
    return marked.filter(F.col(f"{found}.lang_pred") != "und").drop(found)
