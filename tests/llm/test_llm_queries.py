import random
import re

import numpy as np
import pytest
from oracle import SF, difference
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrain.llm import langid, pii, sharding, similar_text, toxicity
from lexigrain.llm.common import table
from lexigrain.llm.queries import ORACLE_SQL, QUERIES, shards_sql


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(spark, QUERIES[name], ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("limit", [20_000, 300_000])
def test_sharding_equals_its_sql(spark, limit):
    assert difference(spark, lambda s, d: sharding.shards(table(s, d, "documents"), limit), shards_sql(limit), SF) == ""


def shingles_by_hand(text):
    ws = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return frozenset(b" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset()


def groups_by_hand(rows, similarity=0.8):
    """Root of each row: rows of equal word sequences or similar shingle sets are together, and what they lead to."""
    sets = [shingles_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(x & y) >= similarity * len(x | y) - 1e-9:
                root[find(a)] = find(b)
    return [find(a) for a in range(len(rows))]


def firsts_by_hand(rows):
    best = {}
    for (i, _), g in zip(rows, groups_by_hand(rows), strict=True):
        best[g] = min(best.get(g, i), i)
    return set(best.values())


def edited(r, words, share):
    return [r.choice(["alpha", "beta", "gamma"]) if r.random() < share else w for w in words]


@pytest.mark.parametrize("options", [{}, {"list_rows": 16, "limit": 4}, {"width": 2, "limit": 20}])
def test_similar_texts_against_brute_force(spark, options):
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, at = [], 0
    for family in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 6, 40, 150, 400]))]
        for _ in range(r.choice([1, 2, 5, 12])):
            rows.append((at, " ".join(edited(r, base, r.choice([0, 0.01, 0.02, 0.04, 0.06])))))
            at += 1
    base = [r.choice(vocabulary) for _ in range(120)]  # a large group: one base, many edits of it and edits of those
    for _ in range(60):
        rows.append((at, " ".join(edited(r, base, 0.015))))
        at += 1
    rows += [(at, "A b\tC d e f G"), (at + 1, "a b c  d e f g"), (at + 2, None), (at + 3, ""), (at + 4, " \n"), (at + 5, "x"), (at + 6, "X"), (at + 7, "é É"), (at + 8, "É é")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, row string, n int").repartition(3)
    kept = similar_text.keep_first(df, **options)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == firsts_by_hand(rows)


def test_similar_texts_of_one_large_group(spark):
    r = random.Random(12)
    base = [f"w{r.randrange(500)}" for _ in range(100)]
    rows = [(i, " ".join(edited(r, base, 0.01))) for i in range(700)] + [(i, " ".join(base)) for i in range(700, 1200)] + [(2000 + i, " ".join(f"v{r.randrange(900)}" for _ in range(50))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id for x in similar_text.keep_first(df, limit=64).collect()}
    assert got == firsts_by_hand(rows)


def test_index_plan_and_bounds():
    assert similar_text.index_plan(1000, 0.8) == (1, 24) and similar_text.index_plan(10**7, 0.8)[0] == 2 and similar_text.index_plan(10**10, 0.8)[0] == 3
    for width in (1, 2, 3):
        keys = similar_text.index_plan(similar_text.LIST_AIM * 256 ** (width - 1) + (width > 1), 0.8)[1]
        runs = similar_text.key_bytes(width, keys)
        assert runs.shape == (keys, width) and len({tuple(sorted(x)) for x in runs.tolist()}) == keys and all(len(set(x)) == width for x in runs.tolist())
    r = random.Random(13)
    missed, far = 0, 0
    for _ in range(300):  # pairs at the similarity itself
        both, one, two = ([r.getrandbits(64) for _ in range(k)] for k in (160, 20, 20))
        a, b = (np.frombuffer(similar_text.fingerprint(np.array(sorted(x), np.uint64)), np.uint8) for x in (both + one, both + two))
        missed += not (a[:24] == b[:24]).any()
        far += int(np.bitwise_count(a[:24] ^ b[:24]).sum()) > similar_text.most_bits(0.8)
    assert missed <= 6 and far == 0


def test_shared_positional_bytes_are_tallied_before_bits_are_verified():
    least, most = similar_text.least_shared(0.8), similar_text.most_bits(0.8, similar_text.BYTES)
    assert similar_text.worst_difference(0.8) == 3 / 16 and least == 4 and most < 256 - 8 * 11  # unrelated texts: 256, deviation 11
    base = np.arange(64, dtype=np.uint8)
    few = base ^ np.r_[[0] * (least - 1), [1] * (65 - least)].astype(np.uint8)  # 61 bits, in one byte each
    enough = base ^ np.r_[[0] * least, [1] * (64 - least)].astype(np.uint8)
    far = base ^ np.r_[[0] * 32, [255] * 32].astype(np.uint8)
    for other, linked in ((few, False), (enough, True), (far, False)):
        fp = np.stack([base, other])
        assert bool(similar_text._stars(fp, least, most, None)) is linked
        assert bool(len(similar_text._short_pairs(fp, np.zeros(2, int), least, most))) is linked
    r = random.Random(14)
    for sizes, allowed in (((160, 20, 20), 2), ((4, 0, 1), 8)):  # pairs at the similarity itself
        short = far = 0
        for _ in range(2000):
            both, one, two = ([r.getrandbits(64) for _ in range(k)] for k in sizes)
            a, b = (np.frombuffer(similar_text.fingerprint(np.array(sorted(x), np.uint64)), np.uint8) for x in (both + one, both + two))
            short += int((a == b).sum()) < least
            far += int(np.bitwise_count(a ^ b).sum()) > most
        assert short <= allowed and far <= 2


def test_pipeline_stages_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, language string, toxicity string, row string, spans string"
    rows = [(1, "ab cd", "en", "s", 5, "1", "2", "3", "4"), (1, "ab cd", "en", "s", 5, "1", "2", "3", "4"), (None, None, None, None, None, None, None, None, None), (2, "", None, "s", 0, "1", "2", "3", "4"), (3, "mail a@b.c " * 30_000, "en", "s", 9, "1", "2", "3", "4")]
    for docs in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, SF)
            n = len(got.collect())
            assert name == "packing" or got.columns == docs.columns
            assert (n > 0) == (docs.count() > 0), name


def test_pipeline(spark, tmp_path):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["language", "toxic", "near_duplicates", "personal_data", "pack"]
    docs, kinds = table(spark, SF, "documents"), None
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == before.columns and [t for _, t in docs.dtypes] == [t for _, t in before.dtypes]
        after[name] = (before, docs)
    before, kept = after["language"]
    und = langid.identify(before).filter("lang_pred = 'und'").count()
    assert kept.count() == before.count() - und
    before, kept = after["toxicity"]
    assert kept.count() == before.count() - toxicity.classify(before, table(spark, SF, "labels")).filter("toxic").count() < before.count()
    before, kept = after["near_duplicates"]
    assert {r.doc_id for r in kept.collect()} == firsts_by_hand([(r.doc_id, r.text) for r in before.collect()])
    before, kept = after["personal_data"]
    assert kept.count() == before.count()
    spans = pii.find(before).withColumn("n", F.size("spans"))
    changed = kept.join(before.select("doc_id", F.col("text").alias("old")), "doc_id").filter("text != old")
    assert changed.count() == spans.filter("n > 0").count() > 0
    assert kept.filter(F.length("text") != F.col("n_chars")).count() == 0
    _, packed = after["packing"]
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert sorted(corpus_pipeline.run(spark, SF).select("doc_id", "start", "ids_crc32").collect()) == sorted(packed.select("doc_id", "start", "ids_crc32").collect())


def test_near_duplicate_stage_with_repeated_and_null_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, "q w e r t"), (None, "zz yy xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "None"]
