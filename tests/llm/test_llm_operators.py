"""Each operator against a plain brute-force version, on texts that also hold its defined cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexigrain.llm import embedding_dedup, langid, media, packing, pii, sentencepiece_codec, sharding, simhash, toxicity, warc
from lexigrain.llm.components import connected_components
from lexigrain.llm.queries import vocabulary

WORDS = "the of und der pour anat reing nation erbe ciónes éleo thnded".split()


def random_text(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", ".", "!!", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    out = [None, "", " ", "  a  b \n\n c", "x" * 5000, "7", "日本語 ▁ \0 😀", "a\tb", "-", "<|endoftext|> </s>", "a <|endoftext|><|endoftext|>b \n<|endoftext|> the"]
    out += [random_text(r, r.choice([1, 3, 40, 700])) for _ in range(60)]
    long = random_text(r, 9000)
    return [*out, long, long, long.replace("the", "die", 1), out[15], None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    # columns that clash with the operators' own names
    rows = [(i, t, "a", 1.0, "z", 7, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, score double, _r string, length long, id long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_sentencepiece(docs, empty, texts):
    import sentencepiece

    model = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = by_id(sentencepiece_codec.encode_digests(docs, model))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = sp.encode(t or "") + [sp.eos_id()]
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_digests(empty, model).count() == 0
    back = by_id(sentencepiece_codec.decode_ids(sentencepiece_codec.encode_ids(docs, model), model))
    assert all(back[i].text == sp.decode(sp.encode(t or "")) for i, t in enumerate(texts))


def test_sentencepiece_small_cache_and_heap(texts):
    model = vocabulary("piece_bpe_32k.model")
    work = sentencepiece_codec.encoder(model, cache=20)
    codec = work.codec
    for t in texts:
        t = t or ""
        assert work([t])[0][0].split() == [str(i) for i in codec.library.encode(t)]
        symbols = [codec.symbols.get(c, -2) for c in "▁" + t[:200].replace(" ", "▁")]
        if t and -2 not in symbols:
            assert codec._heap(symbols) == codec.library.encode(t[:200])


def test_decoding_equals_the_library_in_blocks_and_by_byte_ids():
    codec = sentencepiece_codec.PieceCodec(vocabulary("piece_bpe_32k.model"))
    rng = random.Random(3)
    spelled, plain = list(codec.byte_of), [i for i in range(codec.size) if i not in codec.control]
    for size in (0, 1, 2, 9, 60, 400):
        for _ in range(50):
            ids = [rng.choice(spelled if rng.random() < 0.5 else plain) for _ in range(size)]
            want = codec.library.decode(ids) if ids else ""
            assert codec.decode_shown(" ".join(map(str, ids))) == codec.by_library(ids) == codec.by_library(ids, 7) == want


def links_by_hand(vecs, labels, threshold):
    n = len(vecs)
    fine = [v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) and lab is not None for v, lab in zip(vecs, labels)]
    links = set()
    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and labels[i] == labels[j] and len(vecs[i]) == len(vecs[j]):
                a, b = np.array(vecs[i]), np.array(vecs[j])
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                    links.add((i, j))
    return links


def parts_by_hand(n, links):
    root = list(range(n))
    for _ in range(n):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return root


@pytest.mark.parametrize("rows", [2048, 8])
def test_embeddings(spark, rows):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 24))
    vecs = [(base[k % 30] + rng.standard_normal(24) * s).tolist() for k, s in enumerate([0.0, 0.1, 0.15, 0.2] * 40)]
    hub = rng.standard_normal(24)
    vecs += [(hub + rng.standard_normal(24) * 0.1).tolist() for _ in range(40)]
    labels = [k % 2 if k < 160 else 1 for k in range(len(vecs))]
    vecs += [None, [], [0.0] * 24, [1.0, None], [float("nan")] * 24, [float("inf")] * 24, vecs[0], vecs[0][:12], vecs[0]]
    labels += [1, 1, 1, 1, 1, 1, labels[0], labels[0], None]
    df = spark.createDataFrame([(i, v, lab, "x", 3) for i, (v, lab) in enumerate(zip(vecs, labels))], "vec_id long, embedding array<double>, label int, id string, n int")
    df = df.unionByName(df.filter("vec_id = 3")).unionByName(df.filter("vec_id = 5").withColumn("vec_id", F.lit(None).cast("long")))
    got = embedding_dedup.near_duplicates(df, list_rows=rows).collect()
    links = links_by_hand(vecs, labels, 0.98)
    assert len(links) > 100
    root = parts_by_hand(len(vecs), links)
    want = {(i, sum(i in p for p in links), root[i], root[i] == i) for i in range(len(vecs))}
    assert {tuple(r) for r in got if r.vec_id is not None} == want and len(got) == len(vecs) + 1
    assert [tuple(r) for r in got if r.vec_id is None] == [(None, 0, None, False)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    unit = rng.standard_normal((400, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    code, factor = embedding_dedup.encode(unit, 4)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(400), np.arange(400)))
    estimate, spread = embedding_dedup.estimates(code[i], factor[i], unit[j])
    truth = (unit[i] * unit[j]).sum(1)
    off = i != j
    assert (estimate + embedding_dedup.SURE * spread >= truth).mean() > 0.9999
    assert abs((estimate - truth)[off].mean()) < 2e-3 and abs(((estimate - truth) / spread)[off].std() - 1) < 0.1


@pytest.mark.parametrize("dim,bits", [(16, 8), (64, 12), (64, 20), (5, 3)])
def test_no_pair_at_the_threshold_is_left_out(dim, bits):
    rng = np.random.default_rng(dim + bits)
    n, threshold = 4000, 0.98
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((n, dim))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = threshold * a + math.sqrt(1 - threshold**2) * b  # exactly at the threshold
    _, bands = embedding_dedup.plan(embedding_dedup.LIST_AIM << bits, threshold)
    assert embedding_dedup.plan(embedding_dedup.LIST_AIM << bits, threshold)[0] == bits
    (ca, fa), (cb, _) = embedding_dedup.encode(a, -(-bands * bits // dim)), embedding_dedup.encode(b, -(-bands * bits // dim))
    same = (embedding_dedup.band_keys(ca, bands, bits) == embedding_dedup.band_keys(cb, bands, bits)).any(1)
    estimate, spread = embedding_dedup.estimates(ca, fa, b)
    differ = np.bitwise_count(ca ^ cb).sum(1)
    assert same.all() and (estimate + embedding_dedup.SURE * spread >= threshold).all() and (differ <= embedding_dedup.most_bits(8 * ca.shape[1], threshold)).all()


def test_embeddings_with_many_equal_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((4, 32))
    vecs = [base[0].tolist() if k < 300 else (base[k % 4] + rng.standard_normal(32) * 0.05).tolist() for k in range(420)]
    labels = [1 if k != 5 else 2 for k in range(420)]
    links = links_by_hand(vecs, labels, 0.98)
    root = parts_by_hand(420, links)
    count = [0] * 420
    for i, j in links:
        count[i] += 1
        count[j] += 1
    rows = [(i, v, lab) for i, (v, lab) in enumerate(zip(vecs, labels))]
    for kind in ("double", "float"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(4)
        want = {(i, count[i], root[i], root[i] == i) for i in range(420)}
        assert {tuple(r) for r in embedding_dedup.near_duplicates(df, list_rows=64).collect()} == want or kind == "float"
    # an id with several vectors has the links of all of them, those to itself left out
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.999, 0.01], 0), (2, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (3, [0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(twice).collect()) == [(1, 4, 1, True), (2, 3, 1, False), (3, 3, 1, False)]


def test_sharding(docs, empty, texts, tmp_path):
    limit = 6000
    got = sharding.shards(docs, limit).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    sizes, members = {}, {}
    for r in got:
        assert r.doc_bytes == len((texts[r.doc_id] or "").encode())
        sizes[r.shard_id] = sizes.get(r.shard_id, 0) + r.doc_bytes
        members.setdefault(r.shard_id, []).append(r)
    for s, rows in members.items():
        assert {(r.shard_bytes, r.shard_docs, r.depth) for r in rows} == {(sizes[s], len(rows), len(s))}
        assert sizes[s] <= limit or len(rows) == 1
        for r in rows:
            h = bin(int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16))[2:].zfill(60)
            assert h.startswith(s)
        # no split without need: the parent is too large
        parent = sum(size for other, size in sizes.items() if other.startswith(s[:-1]))
        assert not s or parent > limit
    assert sharding.shards(empty, limit).count() == 0
    assert {r.shard_id for r in sharding.shards(docs, 1 << 30).collect()} == {""}
    clashing = docs.withColumnsRenamed({"fp": "depth", "score": "_row", "id": "shard", "_r": "_h"})
    written = sharding.write_shards(clashing, str(tmp_path / "shards"), limit)
    assert {tuple(r) for r in written.collect()} == {(s, len(s), sizes[s], len(m)) for s, m in members.items()}
    back = docs.sparkSession.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", False).parquet(str(tmp_path / "shards"))
    assert set(back.columns) == {*clashing.columns, "_shard"}
    assert sorted(tuple(r) for r in back.select("doc_id", "depth", "_row", "shard", "_h").collect()) == sorted(tuple(r) for r in clashing.select("doc_id", "depth", "_row", "shard", "_h").collect())
    where = {r.doc_id: str(r["_shard"]) for r in back.collect()}
    assert all(where[r.doc_id] == "s" + r.shard_id for r in got)
    assert sharding.write_shards(empty, str(tmp_path / "none"), limit).count() == 0


def test_sharding_of_one_repeated_id(spark):
    df = spark.createDataFrame([(None if k % 50 == 0 else 9, "x" * 100) for k in range(200)], "doc_id long, text string").repartition(5)
    got = sharding.shards(df, 1000).collect()
    assert len(got) == 200 and max(r.shard_bytes for r in got) <= 1000 and max(r.depth for r in got) > 60


@pytest.fixture(scope="module")
def pages(spark):
    body = "<html>" + "é" * 80
    html = [None, "", "short", body, body, body, "q" * 99, "q" * 99, "r" * 100, "r" * 100, "WARC/1.1 \x1f\x8b\x08" + "z" * 300] + [f"<p>{i}</p>" * 50 for i in range(40)]
    rows = [(i + 10, f"http://a/{i}\r\n x" if i % 3 else None, h, "x") for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, id string").repartition(3)


@pytest.mark.parametrize("few", [True, False])
def test_warc(spark, pages, tmp_path, few, monkeypatch):
    if not few:
        monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    rows = pages.collect()
    first = {}
    for r in rows:
        h = (r.html or "").encode()
        if len(h) >= 100:
            first[h] = min(first.get(h, r.page_id), r.page_id)
    want = set()
    for r in rows:
        h = (r.html or "").encode()
        to = first.get(h, r.page_id)
        want.add((r.page_id, len(h), hashlib.sha256(h).hexdigest(), "response" if to == r.page_id else "revisit", None if to == r.page_id else to))
    path = warc.write(pages, str(tmp_path / "w"))
    for size in (37, 1000, 1 << 25):
        got = warc.read(spark, path, range_bytes=size).collect()
        assert len(got) == len(rows) and {tuple(r) for r in got} == want
    payloads = {r.page_id: bytes(r.payload) for r in warc.read(spark, path, payloads=True).filter("record_type = 'response'").collect()}
    assert all(payloads[r.page_id] == (r.html or "").encode() for r in rows if r.page_id in payloads)
    nothing = warc.write(pages.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, nothing).count() == 0
    # other gzip readers see the same stream, empty members included
    import glob
    import gzip

    whole = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/part-*"))
    assert whole.count(b"WARC/1.1\r\n") == len(rows)


def test_warc_false_magic_and_broken_record(tmp_path):
    noise = warc.MAGIC + b"junk" + warc.MAGIC
    good = warc.record(1, None, b"abc", "d", None)
    f = tmp_path / "x.warc.gz"
    f.write_bytes(noise + good + b"\x1f\x8b" + warc.EMPTY_MEMBER + good + noise)
    assert [raw[:8] for _, raw in warc.members_in(warc.ByteSource(f"file://{f}"), 0, f.stat().st_size)] == [b"WARC/1.1"] * 2
    f.write_bytes(good[:-6])
    with pytest.raises(ValueError):
        list(warc.members_in(warc.ByteSource(f"file://{f}"), 0, f.stat().st_size))


def test_packing(docs, empty, texts):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    got = packing.pack(docs, path, group_docs=30).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(pieces) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids = [*theirs.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(empty, path).count() == 0


def test_packing_spreads_a_repeated_row(spark):
    df = spark.createDataFrame([(7, "a b c the of") for _ in range(4000)], "doc_id long, text string").repartition(3)
    got = packing.pack(df, vocabulary("byte_bpe_50k.json"), group_docs=200).collect()
    groups = {}
    for r in got:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
    assert len(got) == 4000 and len(groups) == 20 and max(groups.values()) < 400
    assert len({(r.sequence_id, r.offset) for r in got}) == 4000


def test_first_fit_decreasing():
    r = random.Random(2)
    for n in (1, 2, 7, 300):
        sizes = np.array(sorted((r.randint(1, 100) for _ in range(n)), reverse=True))
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room: list[int] = []
        for s, b, o in zip(sizes, bins, offsets):
            k = next((k for k, free in enumerate(room) if free >= s), len(room))
            if k == len(room):
                room.append(100)
            assert (b, o) == (k, 100 - room[k])
            room[k] -= s


def test_language(spark):
    r = random.Random(3)
    words = {"en": "the and of with that tion ing heer".split(), "de": "und der die ich nicht schaft ung keit".split(), "fr": "le la les de que eau tion été".split()}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(3, 60))), lang) for i in range(400) for lang in [r.choice(list(words))]]
    rows += [(1000, None, "en"), (1001, "12 34 !?", "de"), (1002, "the of and with that", None), (1002, "the of and with that", None), (None, "und der die nicht ich", "de")]
    df = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, lang string, score double").repartition(3)
    got = langid.identify(df).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got if g.doc_id is not None)
    truth = {x[0]: x[2] for x in rows}
    held = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 400]
    assert len(held) > 80 and np.mean([g.lang_pred == truth[g.doc_id] for g in held]) > 0.97
    pred = {g.doc_id: g.lang_pred for g in got}
    assert (pred[1000], pred[1001], pred[1002]) == ("und", "und", "en")
    # what isn't learned from doesn't count
    changed = df.withColumn("lang", F.when(langid.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(tuple, langid.identify(changed).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert langid.identify(df.limit(0)).count() == 0
    assert {g.lang_pred for g in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.keep_identified(df).columns == df.columns and langid.keep_identified(df).count() == len(rows) - 2


def test_every_language_is_learned(spark):
    words = {k: [f"{chr(97 + k // 26)}{chr(97 + k % 26)}{c}" for c in "qxzjk"] for k in range(60)}
    rows = [(100 * k + i, " ".join(random.Random(i).choices(words[k], k=20)), f"l{k:02}") for k in range(60) for i in range(12 if k < 55 else 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(langid.identify(df))
    assert {got[i].lang_pred for i, _, _ in rows} == {f"l{k:02}" for k in range(60)}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 0.98 * len(rows)


def test_languages_of_scripts_outside_the_basic_plane(spark):
    assert not any(chr(c).isalpha() for c in range(langid.LETTERS_END - 1, 0x110000))
    starts = {"adlam": 0x1E922, "gothic": 0x10330, "han": 0x20061, "en": 0x61}
    rows = [(1000 * k + i, " ".join("".join(chr(a + random.Random(9 * i + j).randrange(20)) for j in range(h, h + 6)) for h in range(0, 60, 6)), lang) for k, (lang, a) in enumerate(starts.items()) for i in range(30)]
    got = by_id(langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[i].lang_pred == lang for i, _, lang in rows)


def test_no_language_to_learn_keeps_texts_with_letters(spark):
    rows = [(0, "some words", None), (1, "é", None), (2, None, None), (3, "", None), (4, "12 !", None), (5, "\U0001e922", None)]
    got = langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, 5] and got.columns == ["doc_id", "text", "lang"]


def test_language_kernel_is_the_folded_one():
    table = langid._letter_table()
    texts = [random_text(random.Random(k), 30) for k in range(12)]
    x = langid.presence(texts, table).astype(float)
    gram = (x @ x.T) / np.sqrt(x.sum(1)[:, None] * x.sum(1)[None, :])
    names, weights = langid.fit(np.packbits(langid.presence(texts, table), axis=1), ["a", "b"] * 6, landmarks=12)
    y = np.where(np.array(["a", "b"] * 6)[:, None] == np.array(names), 1.0, -1.0)
    dual = np.linalg.solve(gram @ gram + langid.RIDGE * 12 * gram + 1e-8 * np.eye(12), gram @ y)
    assert np.allclose((x @ weights) / np.sqrt(x.sum(1))[:, None], gram @ dual, atol=1e-2)


def fingerprint_by_hand(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("rows", [65_536, 4])
def test_simhash(docs, empty, texts, rows):
    got = by_id(simhash.near_duplicates(docs, list_rows=rows))
    fps = [fingerprint_by_hand(t or "") for t in texts]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = parts_by_hand(len(fps), links)
    assert {(i, f"{fps[i]:016x}", root[i]) for i in range(len(fps))} == {tuple(r) for r in got.values()}
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_find_every_near_pair(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for n in (1, 2, 3, 4, 5, 6):
            f = b
            for bit in r.sample(range(64), n):
                f ^= 1 << bit
            fps.add(f)
    hub = r.getrandbits(64)
    fps |= {hub ^ sum(1 << b for b in r.sample(range(12), 3)) for _ in range(200)}
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = parts_by_hand(len(fps), links)
    for rows in (65_536, 10):
        found = connected_components(simhash.near_links(spark.createDataFrame(signed, "fp long"), list_rows=rows))
        part = {x.node: x.component for x in found.collect()}
        groups, want = {}, {}
        for k, (s,) in enumerate(signed):
            groups.setdefault(part.get(s, s), set()).add(k)
            want.setdefault(root[k], set()).add(k)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)]
    edges += [(5, 4), (7, 7), (None, 3)]
    nodes = sorted({x for e in edges for x in e if x is not None and None not in e and e[0] != e[1]})
    place = {n: k for k, n in enumerate(nodes)}
    root = parts_by_hand(len(nodes), [(place[a], place[b]) for a, b in edges if a in place and b in place])
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: nodes[root[place[n]]] for n in nodes}


# -- personal data -----------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_by_hand(text):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub(r"\D", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def pii_texts():
    r = random.Random(6)
    bits = ["a@b.c", "x.y%z@h-1.example.com", "a@b", "@", "+1 (555) 123-4567", "+1", "127.0.0.1", "300.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.004", "4111 1111 1111 1111", "4111111111111112", "4111-1111-1111-1111", "79927398713", " ", "é😀", "\n", ".", "-", "_", "GB82 WEST 1234 5698 7654 32", "iban", "DE89370400440532013000", "x", "9" * 30, "a@b.c_d@e.f.g", "..@..", "+49 (0)30 1234567", "123-45-6789", "000-45-6789", " ssn ", "SSN: 219-09-9999", "social security 5"]
    out = [None, "", "a@" + "b." * 3000 + "c", "a" * 20000, "1" * 20000, ("1" * 30 + ".") * 200, "+1" + "(" * 5000, "a@b.c " * 300]
    return out + ["".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(1500)]


def test_personal_data(spark):
    texts = pii_texts()
    df = spark.createDataFrame([(i, t, "s", i) for i, t in enumerate(texts)], "doc_id long, text string, spans string, rank long").repartition(4)
    got = by_id(pii.digests(df))
    kept = by_id(pii.redact(df))
    found = by_id(pii.find(df))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base_by_hand(t or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w[1] == k for w in want) for k in range(4)]
        spans = [s.split(":") for s in got[i].spans.split(",") if s]
        assert set(joined.split(",")) - {""} <= {":".join(s) for s in spans}
        assert [[s.kind, str(s.start), str(s.end)] for s in found[i].spans] == spans
        merged = []
        for kind, a, b in spans:
            if merged and int(a) < merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], int(b))
            else:
                merged.append([kind, int(a), int(b)])
        back, at = "", 0
        for kind, a, b in merged:
            back += t[at:a] + f"[{kind.upper()}]"
            at = b
        assert kept[i].text == (t if t is None else back + t[at:])
    assert any("iban:" in g.spans for g in got.values())
    assert pii.digests(df.limit(0)).count() == 0 and pii.redact(df).columns == df.columns


def test_very_many_spans_in_one_text(spark):
    import time

    text = "é a@b.c, 192.168.0.1 and +1 555 123 4567\n"
    df = spark.createDataFrame([(1, text * 20_000, 5, 6), (2, text, 5, 6)], "doc_id long, text string, spans int, _m_email int").repartition(2)
    began = time.time()
    got = by_id(pii.digests(df))
    assert (got[1].n_email, got[1].n_ip, got[1].n_phone) == (20_000, 20_000, 20_000)
    assert got[1].spans.endswith(":".join(["phone", str(len(text) * 19_999 + text.index("+")), str(len(text) * 20_000 - 1)]))
    kept = by_id(pii.redact(df))
    assert kept[1].text == "é [EMAIL], [IP] and [PHONE]\n" * 20_000 and kept[2][2:] == (5, 6)
    assert time.time() - began < 60


def test_context_decides_what_a_number_is(spark):
    rows = [(0, "her SSN is 219-09-9998"), (1, "part 219-09-9998"), (2, "ssn 000-09-9998"), (3, "ssn 219-09-99981"), (4, "ssn" + " x" * 30 + " 219-09-9998"), (5, "lessn 219-09-9998"), (6, "Seguro Social: 219-09-9998")]
    got = by_id(pii.find(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i for i in got if [s.kind for s in got[i].spans] == ["ssn"]} == {0, 6} and all(not got[i].spans for i in (1, 2, 3, 4, 5))


def test_personal_data_sql_on_odd_texts(spark, tmp_path):
    from oracle import difference

    from lexigrain.llm.queries import ORACLE_SQL, op8_pii

    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(pii_texts())], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert difference(spark, op8_pii, ORACLE_SQL["op8_pii"], str(tmp_path)) == ""


def test_personal_data_context_and_mod97(spark):
    rows = [(0, "iban GB82 WEST 1234 5698 7654 32."), (1, "GB83 WEST 1234 5698 7654 32"), (2, "call +1 555 123 4567"), (3, "so +1 555 123 4567")]
    got = by_id(pii.find(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [s.kind for s in got[0].spans] == ["iban"] and not [s for s in got[1].spans if s.kind == "iban"]
    assert got[2].spans[0].score > got[3].spans[0].score


def ibans_by_hand(text):
    shape = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
    out, at = [], 0
    for a in range(len(text)):
        if a < at or re.match("[A-Za-z0-9]", text[a - 1 : a]):
            continue
        for b in range(min(len(text), a + 43), a, -1):
            bare = text[a:b].replace(" ", "")
            if shape.fullmatch(text, a, b) and not re.match("[A-Za-z0-9]", text[b : b + 1]) and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
                out.append((a, b))
                at = b
                break
    return out


def test_account_numbers_beside_words_and_numbers(spark):
    told = ["AT611904300234573201 Herr", "ES91 2100 0418 4502 0005 1332 Bitte", "ES91 2100 0418 4502 0005 1332 BITTE", "KUNDENNR1234567890 DE89 3704 0044 0532 0130 00", "AB12 3456 7890 DE89 3704 0044 0532 0130 00", "éAT611904300234573201 ABCD EFGH"]
    bits = ["AT611904300234573201", "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "SE4550000000058398257466", "NO93 8601 1117 947", "Herr", "BITTE", "X", "AB12 3456 7890", "KUNDENNR1234567890", "9", "é", ","]
    r = random.Random(7)
    texts = told + ["".join(r.choice(bits) + r.choice([" ", " ", " ", ""]) for _ in range(r.randint(1, 7))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, kept = by_id(pii.find(df)), by_id(pii.redact(df))
    for i, t in enumerate(texts):
        assert [(s.start, s.end) for s in found[i].spans if s.kind == "iban"] == ibans_by_hand(t), t
    assert all("[IBAN]" in kept[i].text for i in range(len(told)))
    assert kept[0].text == "[IBAN] Herr" and kept[2].text == "[IBAN] BITTE"


# -- toxicity, media ---------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        words = [r.choice(WORDS) for _ in range(r.randint(5, 80))]
        bad = i % 7 == 0
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["moron", "scum", f"vexor{r.choice(WORDS)}"]))
        rows.append((i, " ".join(words), 0.1))
        if i < 600:
            labels.append((i, None if i % 50 == 1 else int(i % 5 > 0), int(bad)))
    rows += [(2000, None, 0.1), (2001, "", 0.1), (2002, "you moron", 0.1), (2002, "you moron", 0.1)]
    labels += [(7, 1, 0), (None, 1, 1), (5000, 1, 1), (8, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic double").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = by_id(toxicity.classify(df, lab))
    new = [(g.toxic, i % 7 == 0) for i, g in got.items() if 600 <= i < 900]
    assert sum(a and b for a, b in new) >= 0.95 * sum(b for _, b in new) and not any(a and not b for a, b in new)
    assert not got[2000].toxic and not got[2001].toxic and got[2002].toxic
    assert toxicity.classify(df, lab).count() == len(rows)
    assert toxicity.keep_clean(df, lab).columns == df.columns
    assert not any(g.toxic for g in toxicity.classify(df, lab.limit(0)).collect())
    assert toxicity.classify(df.limit(0), lab).count() == 0


def test_logistic_is_the_minimum():
    rng = np.random.default_rng(2)
    x = rng.random((300, 12)) < 0.3
    y = (rng.random(300) < 1 / (1 + np.exp(1 - 3.0 * x[:, 0] + 2.0 * x[:, 3]))).astype(float)
    r, c = np.nonzero(x)
    got = toxicity.logistic(r, c, np.ones(len(r)), y, 12, ridge=0.05, steps=4000)
    full = np.concatenate([x, np.ones((300, 1))], 1).astype(float)
    w, pull = np.zeros(13), np.array([0.05] * 12 + [0.0])
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-full @ w))
        w -= np.linalg.solve(full.T * (p * (1 - p)) @ full + np.diag(pull), full.T @ (p - y) + pull * w)
    assert np.allclose(got, w, atol=1e-3)


def test_chain_feeds_predictions_made_without_the_fold():
    rng = np.random.default_rng(4)
    n = 400
    x = rng.random((n, 10)) < 0.4
    low = (rng.random(n) < 0.2 + 0.6 * x[:, 1]).astype(np.int64)
    bad = (rng.random(n) < 0.1 + 0.5 * low * x[:, 2]).astype(np.int64)
    low[:7] = -1
    folds = rng.integers(0, toxicity.FOLDS, n)
    chosen = [np.arange(6)] + [np.array([1, 2, 3 + k % 3]) for k in range(toxicity.FOLDS)]
    own, priors = {"low_quality": chosen, "toxic": [np.arange(2, 8)]}, {"low_quality": 0.3, "toxic": 0.1}
    r, c = np.nonzero(x)
    got = toxicity.fit_chain(r, c, {"low_quality": low, "toxic": bad}, own, priors, folds)

    def plain(inputs, y):
        r, c = np.nonzero(inputs)
        return toxicity.logistic(r, c, inputs[r, c], y.astype(float), inputs.shape[1])

    def shift(y, prior):
        return math.log(prior / (1 - prior)) - math.log(y.mean() / (1 - y.mean()))

    have, odds = low >= 0, np.zeros(n)
    moved = shift(low[have], 0.3)
    for k in range(toxicity.FOLDS):
        train, out = have & (folds != k), folds == k
        w = plain(x[train][:, chosen[1 + k]].astype(float), low[train])
        odds[out] = x[out][:, chosen[1 + k]] @ w[:-1] + w[-1] + moved
    first = plain(x[have][:, chosen[0]].astype(float), low[have])
    first[-1] += moved
    second = plain(np.concatenate([x[:, 2:8], np.clip(odds, -5, 5)[:, None] / 5], 1), bad)
    second[-1] += shift(bad, 0.1)
    assert np.allclose(got["low_quality"], first, atol=1e-5) and np.allclose(got["toxic"], second, atol=1e-5)


def test_toxicity_of_odd_rows(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(20)) + (" scum" if i % 5 == 0 else ""), "k") for i in range(300)]
    rows += [(None, "you scum", "k"), (7, None, "k"), (5, "zzz", "k")] + [(10, "the of scum", "k")] * 500 + [(400, "the of und " * 100_000 + "scum", "k")]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(300)] + [(10, 1, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, toxicity string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.classify(df, lab).collect()
    assert len(got) == len(rows) and {g.toxic for g in got if g.doc_id in (None, 10, 400)} == {True}
    sample, _ = toxicity.sampled(df, lab, "doc_id", "text", 100)
    ids = [x.id for x in sample.collect()]
    assert len(ids) == len(set(ids)) == 100 and sample.filter("toxic = 1").count() == 50
    kept = toxicity.keep_clean(df, lab)
    assert kept.columns == df.columns and {x.toxicity for x in kept.collect()} == {"k"}
    fold = [toxicity.fold_of(t) for t in ("a b", "a b", "c")]
    assert fold[0] == fold[1]


def test_language_slices_join_without_a_seam(monkeypatch):
    table = langid._letter_table()
    texts = [random_text(random.Random(k), 60) + "  \n 12 é𞤢 日本" * k for k in range(6)] + ["", "a", "1", " ab "]
    whole = langid.presence(texts, table)
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "SLICE", size)
        assert (langid.presence(texts, table) == whole).all()


def test_language_bound_holds_with_repeated_ids(spark):
    rows = [(i, f"the of and {i}", "en") for i in range(2000)] + [(3, "und der die", "de")] * 500 + [(i, "und der die", "de") for i in range(5000, 5400)]
    names, _ = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), sample=100)
    assert names == ["de", "en"]
    df = spark.createDataFrame([(1, "the", "en", 5)], "doc_id long, text string, lang string, language int")
    assert langid.keep_identified(df).columns == df.columns


def test_language_predictions_against_plain_python(spark):
    rows = [(i, random_text(random.Random(i), 12), "x" if i % 2 else "y") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, weights = model = langid.learn(df)

    def grams(text):
        letters = "".join(c.lower()[0] if c.isalpha() else " " for c in f" {text} ")
        letters = re.sub(" +", " ", letters)
        return {letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1)}

    def place(gram):
        c = [0 if g == " " else ord(g) for g in gram]
        if len(c) == 1:
            return (c[0] * 40503 & 0xFFFFFFFF) ^ ((c[0] >> 16) * 2531 & 0xFFFFFFFF)
        two = (c[0] * 92821 + c[1] * 31) & 0xFFFFFFFF
        if len(c) == 2:
            return two ^ two >> 9
        three = (two * 4099 + c[2] * 131) & 0xFFFFFFFF
        return three ^ three >> 11

    for got in langid.identify(df, model=model).collect():
        at = sorted({place(g) % langid.PLACES for g in grams(rows[got.doc_id][1])})
        score = weights[at].astype(float).sum(0) / math.sqrt(len(at))
        assert got.lang_pred == names[int(score.argmax())] and got.score == pytest.approx(min(1, max(0, (score.max() + 1) / 2)), abs=1e-4)


def test_media(docs, empty, texts):
    got = by_id(media.media_columns(docs))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        g = got[i]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert g.media_bytes == len(g.media) and g.media_sha256 == hashlib.sha256(g.media).hexdigest() and media.from_wav(bytes(g.media)) == payload
        assert g.feature.startswith(f"{len(g.fingerprint)}:") and list(g.fingerprint) == sorted(g.fingerprint)
    assert got[0].feature == got[1].feature and media.media_columns(empty).count() == 0


def test_media_fingerprint_against_plain_python():
    for seed in (1, 2):
        samples = np.frombuffer(random_text(random.Random(seed), 300).encode(), np.uint8)
        peaks = []
        for t in range(max(1, math.ceil((len(samples) - media.WINDOW) / media.HOP) + 1)):
            frame = np.zeros(media.WINDOW, np.float32)
            part = samples[t * media.HOP : t * media.HOP + media.WINDOW]
            frame[: len(part)] = part.astype(np.float32) - 128
            power = [round(float(abs(x)), 3) for x in np.fft.rfft(frame * np.hanning(media.WINDOW).astype(np.float32))]
            tops = [(-power[k], k) for k in range(2, len(power) - 1) if power[k] > power[k - 1] and power[k] >= power[k + 1]]
            peaks.append([k for _, k in sorted(tops)[: media.PEAKS]])
        want = sorted((t << 32) | (a << 16) | (b << 4) | gap for t in range(len(peaks)) for gap in range(1, media.REACH + 1) if t + gap < len(peaks) for a in peaks[t] for b in peaks[t + gap])
        got = media.fingerprint(samples).tolist()
        assert len(want) > 50 and len(set(want) ^ set(got)) <= 0.02 * len(want)  # equal but for peaks that tie in their third decimal


def test_media_peaks_of_a_tone():
    tone = (128 + 100 * np.sin(2 * np.pi * 20 / media.WINDOW * np.arange(4000))).astype(np.uint8)
    bins, _ = media.spectral_peaks(tone)
    assert (bins[:-2, 0] == 20).all()
    # slices meet without a seam
    long = np.frombuffer(random_text(random.Random(1), 80_000).encode(), np.uint8)
    whole = media.spectral_peaks(long)[0]
    part = media.spectral_peaks(long[media.HOP * 2000 :])[0]
    assert (whole[2000 : 2000 + 200] == part[:200]).all()
