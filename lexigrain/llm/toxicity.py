"""Toxicity by a classifier chain.

Method: categories are predicted one after the other, each by a logistic regression whose inputs are the text's features
and the earlier categories' probabilities; in training those are out-of-fold predictions. The chain here is low_quality,
then toxic.

Features are presences: words, word beginnings of PREFIXES letters, and coarse shares of capitals, digits, marks and
spaces. A category keeps the FEATURES features with the largest likelihood-ratio statistic over the fitted sample,
which are counted in the executors, fold by fold: what predicts a fold out of it is chosen without it. A document's fold is a
hash of its text, so copies share it.

Fitting: at most SAMPLE labelled documents (documented bound), those with the smallest hashes of their ids, up to half of them
toxic. The intercept is corrected to the categories' shares among all labelled documents. Prediction uses the text alone; a
document is rejected when its probability of toxic is THRESHOLD or more.

Defined cases: null text is the empty text; several labels of one document count as their largest, several rows of a labelled id
as the one with the smallest text; null labels are left out; without both classes of a category its probability is 0 and nothing is
rejected; repeated rows give equal rows; an empty table gives an empty result; columns other than id and text are not read,
and ``keep_clean`` keeps all, whatever their names. Whole texts are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint, free, text_udf

#: Bounds of the fit: labelled documents, features of a category; folds; documents a feature must be in, and its least gain
#: in log-likelihood, which chance alone rarely reaches among all words.
SAMPLE, FEATURES, FOLDS, LEAST, GAIN = 8000, 1500, 5, 5, 8
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
CATEGORIES = ("low_quality", "toxic")
#: Counted features held by a task before they are emitted.
HELD = 300_000

_WORD = re.compile(r"[^\W\d_]+")
_UPPER, _DIGIT, _MARK = (bytes(range(65, 91)), bytes(range(48, 58)), bytes(c for c in range(33, 127) if not chr(c).isalnum()))


def features(text: str) -> set[str]:
    """Words, word beginnings (with * after) and coarse shares (with # before) of a whole text."""
    words = set(_WORD.findall(text.lower()))
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    out |= shares(text)
    return out


def shares(text: str) -> set[str]:
    raw = text.encode()
    n = max(1, len(raw))
    out = {f"#{name}{min(9, (len(raw) - len(raw.translate(None, which))) * 40 // n)}" for name, which in (("upper", _UPPER), ("digit", _DIGIT), ("mark", _MARK), ("space", b" "), ("line", b"\n"))}
    out.add(f"#size{len(raw).bit_length()}")
    return out


class Selected:
    """Places of the selected features in a text."""

    def __init__(self, names: list[str]):
        self.words = {n: i for i, n in enumerate(names) if n[0] != "#" and n[-1] != "*"}
        self.heads = [(k, {n[:-1]: i for i, n in enumerate(names) if n[-1] == "*" and len(n) == k + 1}) for k in PREFIXES]
        self.shares = {n: i for i, n in enumerate(names) if n[0] == "#"}

    def __call__(self, text: str) -> list[int]:
        words = set(_WORD.findall(text.lower()))
        out = [self.words[w] for w in words & self.words.keys()]
        for k, heads in self.heads:
            if heads:
                out += [heads[h] for h in {w[:k] for w in words if len(w) > k} & heads.keys()]
        out += [self.shares[s] for s in shares(text) if s in self.shares]
        return out


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, n: int, ridge: float = 0.05, steps: int = 200) -> np.ndarray:
    """Weights of ``n`` inputs, intercept last, by accelerated gradient descent over the non-zero inputs (row, column, value).
    Inputs are scaled to one length, so that rare features move as fast as common ones."""
    m = len(y)
    rows, columns = np.concatenate([rows, np.arange(m)]), np.concatenate([columns, np.full(m, n)])
    values = np.concatenate([values, np.ones(m)])
    scale = 1 / np.sqrt(np.maximum(np.bincount(columns, values**2, n + 1), 1.0))
    values = values * scale[columns]
    times = lambda w: np.bincount(rows, values * w[columns], m)
    back = lambda g: np.bincount(columns, values * g[rows], n + 1)
    v = np.ones(n + 1)
    for _ in range(15):
        v = back(times(v))
        v /= np.linalg.norm(v)
    pull = ridge * scale**2
    pull[-1] = 0
    rate = 1 / (0.27 * float(v @ back(times(v))) + pull.max())
    w = look = np.zeros(n + 1)
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(look), -30, 30)))
        new = look - rate * (back(p - y) + pull * look)
        look, w = new + (t / (t + 3)) * (new - w), new
    return w * scale


def fit_chain(rows: np.ndarray, columns: np.ndarray, labels: dict[str, np.ndarray], own: dict[str, list[np.ndarray]], priors: dict[str, float], folds: np.ndarray) -> dict[str, np.ndarray]:
    """Weights of each category in turn: its own features, earlier categories' log-odds, intercept. Features come as
    (row, column) of those present; ``own`` has a category's features chosen over all rows and then, if another category follows,
    those chosen without each fold. Labels are 0, 1 or -1."""
    count, size = len(folds), int(columns.max(initial=-1)) + 1
    earlier, models = np.zeros((count, 0)), {}
    for name, y in labels.items():
        have = y >= 0

        def inputs(chosen: np.ndarray, earlier: np.ndarray = earlier) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
            """(row, column, value) of a category's inputs, and how many columns there are."""
            n = len(chosen)
            place = np.full(max([size, *(chosen + 1)]), -1, np.int64)
            place[chosen] = np.arange(n)
            mine = place[columns] >= 0
            r = np.concatenate([rows[mine], np.repeat(np.arange(count), earlier.shape[1])])
            c = np.concatenate([place[columns[mine]], np.tile(n + np.arange(earlier.shape[1]), count)])
            return r, c, np.concatenate([np.ones(mine.sum()), earlier.ravel()]), n + earlier.shape[1]

        def fit(some: np.ndarray, given: tuple, y: np.ndarray = y) -> np.ndarray:
            r, c, x, n = given
            at = np.cumsum(some) - 1
            k = some[r]
            return logistic(at[r[k]], c[k], x[k], y[some].astype(float), n)

        odds = np.full(count, -30.0)
        if have.any() and 0 < y[have].mean() < 1:
            mean = float(y[have].mean())
            shift = math.log(priors[name] / (1 - priors[name])) - math.log(mean / (1 - mean)) if 0 < priors[name] < 1 else 0.0
            models[name] = fit(have, inputs(own[name][0]))
            models[name][-1] += shift
            for k in range(FOLDS) if name != list(labels)[-1] else ():  # nothing follows the last
                train = have & (folds != k)
                if train.any() and 0 < y[train].mean() < 1:
                    given = inputs(own[name][1 + k])
                    w = fit(train, given)
                    score = np.bincount(given[0], given[2] * w[given[1]], count) + w[-1] + shift
                    odds[folds == k] = score[folds == k]
        else:
            models[name] = np.zeros(len(own[name][0]) + earlier.shape[1] + 1)
            models[name][-1] = -30
        earlier = np.concatenate([earlier, np.clip(odds, -5, 5)[:, None] / 5], 1)
    return {k: w.astype(np.float32) for k, w in models.items()}


class Chain:
    """A fitted chain: names of features, for each category its features and weights."""

    def __init__(self, names: list[str], own: dict[str, np.ndarray], models: dict[str, np.ndarray]):
        self.names, self.own, self.models = names, own, models
        self.select: Selected | None = None

    def predict(self, texts: list[str]) -> dict[str, np.ndarray]:
        self.select = self.select or Selected(self.names)
        x = np.zeros((len(texts), len(self.names)), np.float32)
        for i, t in enumerate(texts):
            x[i, self.select(t)] = 1
        earlier, out = np.zeros((len(texts), 0), np.float32), {}
        for name, w in self.models.items():
            odds = np.concatenate([x[:, self.own[name]], earlier], 1) @ w[:-1] + w[-1]
            out[name] = 1 / (1 + np.exp(-np.clip(odds, -30, 30).astype(np.float64)))
            earlier = np.concatenate([earlier, np.clip(odds, -5, 5)[:, None].astype(np.float32) / 5], 1)
        return out


def sampled(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> tuple[DataFrame, dict[str, float]]:
    """(id, text, low_quality, toxic) of the labelled documents that are learned from, one row an id, and the categories' shares
    among all that are labelled."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg((1 - F.min("quality")).alias("low_quality"), F.max("toxic").alias("toxic"))
    n = known.agg(F.count("*"), F.sum("toxic"), F.count("toxic"), F.sum("low_quality"), F.count("low_quality")).first()
    priors = {"low_quality": (n[3] or 0) / max(n[4], 1), "toxic": (n[1] or 0) / max(n[2], 1)}
    key = F.xxhash64(F.lit(23), F.col(id_col))
    positives = min(n[1] or 0, sample // 2)
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    drawn = known.filter(toxic).orderBy(key, id_col).limit(positives).unionByName(known.filter(~toxic).orderBy(key, id_col).limit(sample - positives))
    # ids and labels of the bounded sample
    few = F.broadcast(df.sparkSession.createDataFrame(drawn.toArrow(), drawn.schema))
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(few, id_col).groupBy(id_col, "low_quality", "toxic").agg(F.min("text").alias("text"))
    return rows.select(F.col(id_col).cast("string").alias("id"), "text", "low_quality", "toxic"), priors


def fold_of(text: str) -> int:
    return zlib.crc32(text.encode()) % FOLDS


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, top: int = FEATURES) -> Chain:
    bounded_batches(df.sparkSession)
    rows, priors = sampled(df, labels, id_col, text_col, sample)
    rows = checkpoint(rows)

    def count(batches):
        held: Counter = Counter()

        def flush():
            if held:
                keys, values = zip(*held.items(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([c for _, c in keys], pa.int32()), pa.array(values, pa.int64())], ["feature", "cell", "n"])
                held.clear()

        for b in batches:
            for text, q, t in zip(b.column("text").to_pylist(), b.column("low_quality").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                cell = (fold_of(text) * 4 + (3 if q is None else q)) * 4 + (3 if t is None else t)
                held.update([(f, cell) for f in features(text)])
                held[("", cell)] += 1
                if len(held) > HELD:
                    yield from flush()
        yield from flush()

    fold, low, bad = F.floor(F.col("cell") / 16), F.floor(F.col("cell") / 4) % 4, F.col("cell") % 4
    total = lambda test, name: F.sum(F.when(test, F.col("n")).otherwise(0)).alias(name)
    # of each feature: t0 and t1 over all, q0 and q1 of each fold
    cells = [total(bad == v, f"t{v}") for v in (0, 1)] + [total((low == v) & (fold == k), f"q{v}_{k}") for v in (0, 1) for k in range(FOLDS)]
    counts = rows.mapInArrow(count, "feature string, cell int, n bigint").groupBy("feature").agg(*cells)
    every = lambda v, without=None: sum((F.col(f"q{v}_{k}") for k in range(FOLDS) if k != without), F.lit(0))
    counts = checkpoint(counts.filter(every(0) + every(1) + F.col("t0") + F.col("t1") >= 2 * LEAST))
    totals = counts.filter("feature = ''")

    def choose(zero, one) -> list[str]:
        n = totals.select(zero.alias("n0"), one.alias("n1")).first()
        if not n or not n.n0 or not n.n1:
            return []
        a, b = one + 0.5, zero + 0.5
        gain = a * F.log(a * (n.n0 + n.n1) / ((a + b) * n.n1)) + b * F.log(b * (n.n0 + n.n1) / ((a + b) * n.n0))
        found = counts.filter("feature != ''").select("feature", gain.alias("gain")).filter(F.col("gain") > GAIN).orderBy(F.desc("gain"), "feature").limit(top)
        return [r[0] for r in found.select("feature").collect()]

    chosen = {"low_quality": [choose(every(0, k), every(1, k)) for k in (None, *range(FOLDS))], "toxic": [choose(F.col("t0"), F.col("t1"))]}
    names = sorted({f for lists in chosen.values() for v in lists for f in v})
    place = {f: i for i, f in enumerate(names)}
    own = {k: [np.array([place[f] for f in v], np.int64) for v in lists] for k, lists in chosen.items()}

    def locate(batches):
        select = Selected(names)
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("low_quality"), b.column("toxic"), pa.array(map(fold_of, texts), pa.int32()), pa.array(map(select, texts), pa.list_(pa.int32()))], ["id", "low_quality", "toxic", "fold", "places"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    got = rows.mapInArrow(locate, f"id string, low_quality {kinds['low_quality']}, toxic {kinds['toxic']}, fold int, places array<int>").toArrow().sort_by("id")
    y = {c: np.array([-1 if v is None else v for v in got.column(c).to_pylist()], np.int64) for c in CATEGORIES}
    places = got.column("places").combine_chunks()
    rows_of = np.repeat(np.arange(got.num_rows), np.diff(places.offsets.to_numpy()))
    models = fit_chain(rows_of, places.flatten().to_numpy(), y, own, priors, got.column("fold").to_numpy())
    used = np.unique(np.concatenate([v[0] for v in own.values()]))  # features of folds aren't needed any more
    return Chain([names[i] for i in used], {k: np.searchsorted(used, v[0]) for k, v in own.items()}, models)


def predictor(chain: Chain, threshold: float = THRESHOLD):
    """A struct UDF (p_low_quality, p_toxic, toxic) over a text column."""

    def start():
        def predict(texts):
            p = chain.predict([t or "" for t in texts])
            return {"p_low_quality": pa.array(p["low_quality"]), "p_toxic": pa.array(p["toxic"]), "toxic": pa.array(p["toxic"] >= threshold)}

        return predict

    return text_udf("struct<p_low_quality: double, p_toxic: double, toxic: boolean>", start)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, p_low_quality, p_toxic, toxic) of every row."""
    udf = predictor(learn(df, labels, id_col, text_col), threshold)
    return df.select(id_col, udf(text_col).alias("_r")).select(id_col, "_r.*")


def keep_clean(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows, with all their columns, that aren't rejected as toxic."""
    udf, (found,) = predictor(learn(df, labels, id_col, text_col), threshold), free(df, "toxicity")
    return df.withColumn(found, udf(F.col(text_col))).filter(~F.col(f"{found}.toxic")).drop(found)
