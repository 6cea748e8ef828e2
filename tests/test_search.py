import pytest
from pyspark.sql import functions as F

from lexigrain.engine import SearchEngine
from lexigrain.functions import text as T
from lexigrain.operators import index as I
from lexigrain.operators import phrase, rank, vectors, wildcard
from lexigrain.operators.sets import DocSet
from lexigrain.plans import planner
from lexigrain.plans.lang import UnsupportedQuery
from lexigrain.sources import books, files

TEXTS = ["Hello evening, hello world", "goodbye evening", "hello goodbye", None, "", "naïve a_b Kelvin 42", "a b x b c", "a b c", "hello one two three evening", "!!! ---"]


@pytest.fixture(scope="module")
def docs(docs_of):
    return docs_of(TEXTS).repartition(3)


@pytest.fixture(scope="module")
def saved(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "x")
    I.Index.of(docs).save(path, parts=3)
    return I.Index.load(spark, path)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_tokens(docs):
    got = {}
    for r in I.token_table(docs).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.term)
    assert got[0] == ["hello", "evening", "hello", "world"]
    # words are split before they are lowered, so the Kelvin sign and letters with marks part words
    assert got[5] == ["na", "ve", "a_b", "elvin", "42"]
    assert 3 not in got and 4 not in got and 9 not in got


QUERIES = {
    "hello & !(goodbye | evening)": [],
    "hello & goodbye": [2],
    "hello | goodbye": [0, 1, 2, 8],
    "!hello": [1, 3, 4, 5, 6, 7, 9],
    "hello & evening & world": [0],
    "!hello | !goodbye": [0, 1, 3, 4, 5, 6, 7, 8, 9],
    "!(hello | a) & !goodbye": [3, 4, 5, 9],
    "a & !a": [],
    "a | !a": list(range(10)),
    "hello evening": [0],
    "a b c": [6, 7],
    "hello \\3 evening": [8],
    "a /1 b": [],
    "b /1 b": [6],
    "hello hello": [],
    "he*": [0, 2, 8],
    "*e*ing & !world": [1, 8],
    "a*b": [5],
    "zzz": [],
    "!zzz & hello": [0, 2, 8],
}


@pytest.mark.parametrize("query", QUERIES)
def test_queries_by_scan_and_by_index(docs, saved, query):
    assert ids(planner.scan(query, docs)) == QUERIES[query]
    assert ids(planner.search(query, saved)) == QUERIES[query]


def test_scan_has_no_shuffle_and_index_pushes_down(docs, saved, capsys):
    planner.scan("hello & !(goodbye | evening)", docs.coalesce(1)).explain()
    assert "Exchange" not in capsys.readouterr().out.replace("Exchange RoundRobin", "")
    planner.search("hello & evening", saved).explain("formatted")
    out = capsys.readouterr().out
    assert "PushedFilters: [In(term" in out or "PushedFilters: [Or(" in out or "In(term, [evening,hello])" in out


def test_phrases(docs):
    assert ids(phrase.phrase(docs, ["a", "b", "c"])) == [6, 7]
    assert ids(phrase.phrase_strict(docs, ["a", "b", "c"])) == [7]
    assert ids(phrase.bigram_phrase(I.bigrams(docs), "hello", "evening")) == [0]
    assert ids(phrase.within(docs, "hello", "evening", 3)) == [0, 8]
    assert {tuple(r) for r in I.bigrams(docs).filter("doc_id = 6").collect()} == {("a", "b", 6, 1), ("b", "x", 6, 1), ("x", "b", 6, 1), ("b", "c", 6, 1)}


def test_empty_corpus(docs):
    none = docs.limit(0)
    for q in ("a", "!a", "a b", "a*"):
        assert ids(planner.scan(q, none)) == []
    assert I.index_stats(none).first().asDict() == {"documents": 0, "n_tokens": 0, "n_terms": 0, "bytes": 0, "megabytes": 0.0}
    assert rank.bm25(none, "a b").count() == 0 and I.inverse_frequencies(none).count() == 0


def test_stats_count_documents_without_tokens(docs):
    s = I.index_stats(docs).first()
    assert s.documents == 10 and s.n_tokens == sum(r.n_tokens for r in I.document_stats(docs).collect())
    idf = {r.term: r.idf for r in I.inverse_frequencies(docs).collect()}
    assert idf["hello"] == pytest.approx(__import__("math").log(10 / 3))


@pytest.mark.parametrize("pattern", ["he*", "*ing", "*o*", "h*l*o", "a*b", "hello", "*", "e*g", "*a*b*", "a_*", "zz*"])
def test_wildcard_strategies_agree(docs, pattern):
    vocab = I.vocabulary(docs)
    import re

    want = sorted(r.term for r in vocab.collect() if re.fullmatch(pattern.replace("*", ".*"), r.term))
    for s in wildcard.STRATEGIES:
        assert sorted(r.term for r in wildcard.expand(vocab, pattern, s).collect()) == want, s


def test_rotations_restore(docs):
    vocab = I.vocabulary(docs)
    rotated = wildcard.permuterm_index(vocab)
    assert rotated.filter(T.restored("rotation") != F.col("term")).count() == 0
    assert rotated.filter("term = 'b'").select("rotation").count() == 2


def test_sets(spark):
    make = lambda *x: DocSet(spark.createDataFrame([(i,) for i in x], "doc_id long"))
    every = spark.createDataFrame([(i,) for i in range(1, 7)], "doc_id long")
    for x, want in [
        (make(1) | make(1), [1]), (make(1, 2, 3) | make(5), [1, 2, 3, 5]), (make(1, 2, 3, 4) & ~make(1), [2, 3, 4]), (make(5) & ~make(1, 5), []),
        (make(1, 2) & make(1, 3), [1]), (make(1, 2) | ~make(1, 3), [1, 2, 4, 5, 6]), (~make(1, 2) & ~make(1, 3), [4, 5, 6]), (~make(1, 2) | ~make(1, 3), [2, 3, 4, 5, 6]),
        (~make(1) & make(1, 2), [2]), (~~make(4), [4]), (make() & make(1), []), (~make(), [1, 2, 3, 4, 5, 6]),
    ]:
        assert ids(x.within(every)) == want


def test_bm25(docs_of):
    docs = docs_of(["x a a b", "x a c", "x b", "x", None])
    skip = {r.doc_id: r.rating for r in rank.bm25(docs, "a b x").collect()}
    stop = {r.doc_id: r.rating for r in rank.bm25(docs, "a b x", "stop").collect()}
    assert set(skip) == {0, 1, 2, 3} and set(stop) == {0, 1}
    assert all(stop[d] <= skip[d] + 1e-12 for d in stop)
    import math

    avg = (3 + 3 + 2 + 1 + 0) // 5
    part = lambda idf, f, dl: idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avg))
    assert skip[0] == pytest.approx(part(math.log(5 / 2), 2, 3) + part(math.log(5 / 2), 1, 3) + part(math.log(5 / 4), 1, 3))
    twice = {r.doc_id: r.rating for r in rank.bm25(docs, "a a").collect()}
    once = {r.doc_id: r.rating for r in rank.bm25(docs, "a").collect()}
    assert twice[0] == pytest.approx(2 * once[0])
    # a word of every document counts nothing
    assert rank.bm25(docs_of(["x", "x y"]), "x").count() == 0
    assert [r.doc_id for r in rank.bm25(docs, "a", limit=1).collect()] == [0]
    mixed = rank.bm25_search("a & !c", docs).collect()
    assert [r.doc_id for r in mixed] == [0]


def test_zones(spark):
    z = spark.createDataFrame([(1, "the x", "the", "the", "the"), (2, None, "und", "", "the und"), (3, "", "", "", "x")], "doc_id long, author string, title string, annotation string, body string")
    one = {r.doc_id: r.rating for r in rank.zone_search("the", z).collect()}
    assert one == {1: pytest.approx(1.1), 2: pytest.approx(0.1)}
    both = {r.doc_id: (r.rating, r.compound_of) for r in rank.zone_search("the | und", z).collect()}
    assert both == {1: (pytest.approx(1.1), 1), 2: (pytest.approx((0.1 + 0.4) / 2), 2)}
    assert [r.doc_id for r in rank.zone_search("the & und", z).collect()] == [2]
    compat = {r.doc_id: r.rating for r in rank.zone_search("the & und", z, compat=True).collect()}
    assert compat == {1: pytest.approx(1.1), 2: pytest.approx((0.1 + 1) / 2)}
    assert {r.doc_id: r.rating for r in rank.zone_search("the & !und", z).collect()} == {1: pytest.approx(1.1)}
    assert [r.doc_id for r in rank.zone_search("x | the", z).collect()] == [1, 2, 3]
    with pytest.raises(UnsupportedQuery):
        rank.zone_search("!the", z)
    assert {r.doc_id: r.rating for r in rank.zone_search("!the", z, allow_negation=True).collect()} == {3: 0.0}
    with pytest.raises(UnsupportedQuery):
        rank.zone_search("the und", z)
    p = {(r.term, r.doc_id): r.zones for r in I.postings(z, I.present_zones(z.columns)).collect()}
    assert p["the", 1] == 15 and p["und", 2] == 10


def test_vectors(docs_of):
    docs = docs_of(["a a b", "b c", "a b c", "d"])
    w = {(r.doc_id, r.term): r.w for r in vectors.tf_normalised(docs).collect()}
    assert w[0, "a"] == pytest.approx(2 / 3)
    x = vectors.tf_idf(docs)
    cos = {(r.left_id, r.right_id): r.cosine for r in vectors.cosines(x, x).collect()}
    assert cos[0, 0] == pytest.approx(1) and cos[0, 1] == pytest.approx(cos[1, 0]) and (0, 3) not in cos
    z = {r.term: (r.l, r.r) for r in vectors.outer_zip(x.filter("doc_id = 1"), x.filter("doc_id = 3")).collect()}
    assert set(z) == {"b", "c", "d"} and z["d"][0] == 0 and z["b"][1] == 0
    leaders = vectors.select_leaders(docs, 2)
    assert leaders.count() == 2 and ids(leaders) == ids(vectors.select_leaders(docs, 2))
    assert ids(vectors.assign_leaders(x, leaders)) == [0, 1, 2, 3]


def test_range_dictionary_and_gaps(docs):
    got = I.range_dictionary(docs, 4).collect()
    bounds = T.range_delimiters(4)
    assert all(r.range_id == sum(r.term >= b for b in bounds) for r in got)
    gaps = sorted((r.doc_id, r.gap) for r in I.posting_gaps(docs).filter("term = 'hello'").collect())
    assert gaps == [(0, 0), (2, 2), (8, 6)]


def test_files_engine_and_append(spark, tmp_path, capsys):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, text in {"in/b.txt": "beta word", "in/a.txt": "alpha\nword", "in/c.md": "gamma", "in/deep/d.txt": "delta", "z.txt": "zeta"}.items():
        (tmp_path / name).write_text(text)
    flat = files.read_texts(spark, [str(tmp_path / "z.txt"), str(tmp_path / "in"), str(tmp_path / "gone")], "txt")
    assert [(r.doc_id, r.path.rsplit("/", 1)[1]) for r in flat.orderBy("doc_id").collect()] == [(0, "a.txt"), (1, "b.txt"), (2, "z.txt")]
    assert "gone doesn't exist" in capsys.readouterr().err
    assert files.read_texts(spark, [str(tmp_path / "in")], recursive=True).count() == 4
    engine = SearchEngine.of_files(spark, [str(tmp_path / "in")], "txt")
    path = str(tmp_path / "index")
    engine.save(path)
    assert ids(SearchEngine.load(spark, path).search("alpha word")) == [0]
    more = engine.append(path, files.read_texts(spark, [str(tmp_path / "z.txt"), str(tmp_path / "in" / "c.md")]))
    assert ids(more.search("zeta | gamma")) == [2, 3] and ids(more.search("!word")) == [2, 3]
    assert more.stats().first().documents == 4
    assert [r.doc_id for r in more.search("word | zeta", limit=1).collect()] == [0]
    assert set(more.search_all(["zeta", "beta"])) == {"zeta", "beta"}
    assert [r.doc_id for r in more.search_bm25("zeta").collect()] and [r.doc_id for r in more.search_zones("zeta").collect()]
    with pytest.raises(UnsupportedQuery):
        more.search("!word", allow_negation=False)


def test_cli(tmp_path, capsys):
    from lexigrain.cli import main

    (tmp_path / "a.txt").write_text("hello world")
    (tmp_path / "b.txt").write_text("hello evening")
    assert main([str(tmp_path), "-s", "-x", "hello & !evening", "-x", "(a", "-x", "!hello"]) == 0
    out = capsys.readouterr()
    assert "documents: 2" in out.out and out.out.strip().endswith("a.txt") and "QuerySyntaxError" in out.err and "UnsupportedQuery" in out.err
    assert main([str(tmp_path), "-m", "bm25", "-x", "world"]) == 0
    assert "a.txt -- 0." in capsys.readouterr().out


def test_books(spark):
    head = '<?xml version="1.0"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info>'
    good = head + "<genre>g</genre><author><first-name>Ann</first-name><last-name>Lee</last-name></author><author><last-name>Poe</last-name></author><book-title>A <!-- no --> title</book-title><annotation><p>short</p></annotation></title-info></description><body><p>a <b>x</b> tail</p></body><binary>QUJD</binary></FictionBook>"
    df = spark.createDataFrame([(1, good), (2, "<FictionBook><body>"), (3, ""), (4, None), (5, "<FictionBook><body>plain</body></FictionBook>")], "doc_id long, text string")
    got = {r.doc_id: r for r in books.fb2_zones(df).collect()}
    assert set(got) == {1, 5}
    b = got[1]
    assert b.author_first == "Ann" and b.author_last == "Lee Poe" and b.genre == "g" and b.annotation == "short"
    assert b.title.split() == ["A", "title"] and b.body.split() == ["a", "x", "tail"]
    assert got[5].body == "plain" and got[5].title == ""
    page = spark.createDataFrame([(1, "<html><title>T &</title><script>no</script><p>yes</p>"), (2, None)], "page_id long, html string")
    z = {r.doc_id: r for r in books.page_zones(page).collect()}
    assert z[1].title == "T &" and z[1].body.split() == ["yes"] and z[2].title == ""


def test_json_manifest_and_removal(spark, docs, tmp_path):
    index = I.Index.of(docs)
    index.save(str(tmp_path / "j"), kind="json")
    index.save(str(tmp_path / "p"), parts=3)
    back = I.Index.load(spark, str(tmp_path / "j"))
    key = lambda df: sorted(tuple(r) for r in df.select("term", "doc_id", "tf", "zones", F.col("positions").cast("string")).collect())
    assert key(back.postings()) == key(index.postings())
    assert ids(planner.search("!hello", back)) == QUERIES["!hello"]
    ranges = I.Index.manifest(spark, str(tmp_path / "p")).orderBy("first_term").collect()
    assert sum(r.rows for r in ranges) == index.postings().count()
    assert all(a.last_term <= b.first_term for a, b in zip(ranges, ranges[1:]))
    gone = spark.createDataFrame([(0,), (8,)], "doc_id long")
    for left in (index.without(gone), back.without(gone)):
        assert ids(planner.search("hello", left)) == [2] and 0 not in ids(planner.search("!zzz", left))


def test_scores_where_the_average_length_or_a_norm_is_0(docs_of, spark, tmp_path):
    docs = docs_of(["a b", None, "", "?"])  # two distinct words over four documents
    assert rank.bm25(docs, "a b").collect() == [] and rank.bm25_search("a & !c", docs).collect() == []
    I.Index.of(docs).save(str(tmp_path / "i"))
    assert rank.bm25_index(I.Index.load(spark, str(tmp_path / "i")), "a b").collect() == []
    same = docs_of(["a b", "a b"])  # each word in every document
    x = vectors.tf_idf(same)
    assert {(r.left_id, r.right_id): r.cosine for r in vectors.cosines(x, x).collect()} == {(a, b): 0.0 for a in (0, 1) for b in (0, 1)}
    assert {tuple(r) for r in vectors.assign_leaders(x, vectors.select_leaders(same, 2)).collect()} == {(0, 0, 0.0), (1, 0, 0.0)}
    mixed = vectors.tf_idf(docs_of(["a b", "a b c", "a"]))
    got = {r.doc_id: (r.leader, r.cosine) for r in vectors.assign_leaders(mixed, spark.createDataFrame([(1,), (2,)], "doc_id long")).collect()}
    assert got[1] == (1, 1.0) and got[0][0] == 1 and got[2] == (1, 0.0)


def test_ranked_results_are_in_order(docs_of, spark, tmp_path):
    docs = docs_of(["a", "b a", "a a b", "b c", "a", "c c c a"])
    I.Index.of(docs).save(str(tmp_path / "i"))
    index = I.Index.load(spark, str(tmp_path / "i"))
    z = docs.select("doc_id", F.col("text").alias("body"), F.when(F.col("doc_id") % 2 == 0, "a").alias("title"))
    for df in (rank.bm25(docs, "b c a"), rank.bm25_index(index, "b c a"), rank.bm25_search("b | c", docs), rank.bm25_search("b | c", index), rank.zone_search("a", z), rank.zone_search("a | b", z)):
        got = [(-r.rating, r.doc_id) for r in df.collect()]
        assert len(got) > 2 and got == sorted(got)
    key = lambda df: [(r.doc_id, round(r.rating, 9)) for r in df.collect()]
    for how in ("skip", "stop"):
        assert key(rank.bm25(docs, "c a a", how)) == key(rank.bm25_index(index, "c a a", how))
    assert key(rank.bm25_search("b & !c", docs)) == key(rank.bm25_search("b & !c", index))
    assert key(rank.bm25_search("!c", docs, allow_negation=True)) == key(rank.bm25_search("!c", index, allow_negation=True))


def test_saved_zones(spark, tmp_path, capsys):
    z = spark.createDataFrame([(1, "the x", "the", "the", "the"), (2, None, "und", "", "the und"), (3, "", "", "", "x"), (4, None, None, None, None)], "doc_id long, author string, title string, annotation string, body string")
    I.Index.of(z, zones=I.present_zones(z.columns)).save(str(tmp_path / "z"))
    index = I.Index.load(spark, str(tmp_path / "z"))
    key = lambda df: [(r.doc_id, round(r.rating, 9), r.compound_of) for r in df.collect()]
    for q in ("the", "the | und", "the & und", "the & !und", "x | the", "zzz"):
        assert key(rank.zone_search_index(q, index)) == key(rank.zone_search(q, z)), q
    assert key(rank.zone_search_index("!the", index, allow_negation=True)) == key(rank.zone_search("!the", z, allow_negation=True))
    assert ids(planner.search("x the", index)) == [1] and ids(planner.search("x und", index)) == [] and ids(planner.search("the und", index)) == [2] and ids(planner.search("the und", I.Index.of(z, zones=I.present_zones(z.columns)))) == [2]
    capsys.readouterr()
    rank.zone_search_index("the", index).explain("formatted")
    plan = capsys.readouterr().out
    assert "In(term, [the])" in plan or "EqualTo(term,the)" in plan
    rank.bm25_index(index, "the").explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("EqualTo(term,the)") + plan.count("In(term, [the])") >= 2 and "positions" not in plan.split("ReadSchema")[1].splitlines()[0]


@pytest.mark.parametrize("options", [{"wildcards": [w]} for w in wildcard.STRATEGIES] + [{"delimiters": T.range_delimiters(4)}, {"positions": False, "bigrams": True}])
def test_saved_index_structures(spark, docs, tmp_path, options):
    I.Index.of(docs).save(str(tmp_path / "x"), parts=2, **options)
    index = I.Index.load(spark, str(tmp_path / "x"))
    for q, want in QUERIES.items():
        if not options.get("positions", True) and "/" in q.replace("\\", "/"):
            with pytest.raises(UnsupportedQuery):
                planner.search(q, index)
        else:
            assert ids(planner.search(q, index)) == want, q
    for pattern in ("he*", "*ing", "*o*", "h*l*o", "*", "e*g", "zz*"):
        assert sorted(r.term for r in index.expand(pattern).collect()) == sorted(r.term for r in wildcard.expand(I.vocabulary(docs), pattern).collect())


def test_index_without_positions_and_bigrams_asks_for_words(spark, docs, tmp_path):
    I.Index.of(docs).save(str(tmp_path / "x"), positions=False)
    assert ids(planner.search("hello evening", I.Index.load(spark, str(tmp_path / "x")))) == [0, 8]


def test_saved_index_lives_by_its_manifest(spark, docs, tmp_path):
    from lexigrain import storage
    from lexigrain.streaming.append import append

    path = str(tmp_path / "x")
    I.Index.of(docs).save(path)
    with pytest.raises(FileExistsError):
        I.Index.of(docs).save(path)
    (tmp_path / "x" / "batch-broken" / "documents").mkdir(parents=True)  # a batch that broke off doesn't count
    assert I.Index.load(spark, path).totals()[0] == len(TEXTS)
    more = spark.createDataFrame([("b", "hello again"), ("a", None)], "path string, text string")
    assert append(spark, path, more) == len(TEXTS)
    index = I.Index.load(spark, path)
    assert ids(planner.search("hello", index)) == [0, 2, 8, 11] and ids(planner.search("!hello & !a", index)) == [1, 3, 4, 5, 9, 10]
    I.Index.remove(spark, path, spark.createDataFrame([(2,), (11,), (99,)], "doc_id long"))
    left = I.Index.load(spark, path)
    assert ids(planner.search("hello", left)) == [0, 8] and left.totals()[0] == len(TEXTS)
    assert {r.term: r.df for r in left.vocabulary().collect()}["hello"] == 2
    want = rank.bm25(I.Index.load(spark, path).documents, "hello evening")
    assert [(r.doc_id, round(r.rating, 9)) for r in rank.bm25_index(left, "hello evening").collect()] == [(r.doc_id, round(r.rating, 9)) for r in want.collect()]
    assert append(spark, path, more) == len(TEXTS) + 2  # ids aren't given out anew
    I.Index.delete(spark, path)
    assert storage.names(spark, path) == []


def test_gaps_over_many_partitions(spark):
    rows = [(i * 3 % 997, "the rare" if i % 100 == 0 else "the") for i in range(997)]
    got = I.posting_gaps(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    for term, of in (("the", sorted(i for i, _ in rows)), ("rare", sorted(i for i, t in rows if "rare" in t))):
        assert sorted((r.doc_id, r.gap) for r in got if r.term == term) == [(d, d - (of[k - 1] if k else 0)) for k, d in enumerate(of)]


def test_word_runs_against_plain_python(spark, docs):
    from collections import defaultdict

    r = __import__("random").Random(3)
    texts = [" ".join(r.choice("a b c dd e_1 FF".split()) for _ in range(r.choice([0, 1, 5, 300]))) for _ in range(40)]
    got = {(x.term, x.doc_id): (x.tf, x.length, x.positions) for x in I.postings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {}
    for i, t in enumerate(texts):
        at = defaultdict(list)
        for k, w in enumerate(t.lower().split()):
            at[w].append(k)
        want |= {(w, i): (len(p), len(at), p) for w, p in at.items()}
    assert got == want


def test_books_among_files(spark, tmp_path, capsys):
    from lexigrain.cli import main

    book = "<FictionBook><description><title-info><author><first-name>Ann</first-name></author><book-title>hello</book-title></title-info></description><body><p>world</p></body></FictionBook>"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fb2").write_text(book)
    (tmp_path / "in" / "b.txt").write_text("hello fictionbook")
    (tmp_path / "in" / "c.fb2").write_text("<FictionBook><body>")
    engine = SearchEngine.of_files(spark, [str(tmp_path / "in")])
    assert ids(engine.search("fictionbook")) == [1]
    path = str(tmp_path / "index")
    engine.save(path)
    for e in (engine, SearchEngine.load(spark, path)):
        assert [(r.doc_id, round(r.rating, 9)) for r in e.search_zones("hello").collect()] == [(0, 0.3), (1, 0.1)]
        assert [r.path.rsplit("/", 1)[1] for r in e.with_documents(e.search_zones("hello")).collect()] == ["a.fb2", "b.txt"]
        assert e.stats().first().documents == 2
    assert main([str(tmp_path / "in"), "-m", "zones", "-x", "hello", "-o", str(tmp_path / "i2"), "-w", "trigram", "--bigrams"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0].endswith("a.fb2 -- 0.3") and out[1].endswith("b.txt -- 0.1")
    assert main(["--from", str(tmp_path / "i2"), "-x", "hel*", "-x", "hello fictionbook"]) == 0
    assert [x.rsplit("/", 1)[1] for x in capsys.readouterr().out.splitlines()] == ["a.fb2", "b.txt", "b.txt"]


TEXTS_OF_PAIRS = {
    "a word in every row": {0: "all", 20: "all b c c", 40: "all b", 1: "all c d", 2: "ALL b, b e", 3: "all"},
    "rows without words, ids or partners": {0: "b c", 20: "", 40: None, 60: "z", -20: "c", 1: "b b", 2: "?", 3: "c d b", None: "b c z"},
}


@pytest.mark.parametrize("texts", TEXTS_OF_PAIRS.values(), ids=TEXTS_OF_PAIRS)
@pytest.mark.parametrize("sizes", [(1024, 400_000), (2, 400_000), (1024, 3)])
def test_cosine_pairs_by_blocks_equal_their_sql(spark, tmp_path, monkeypatch, texts, sizes):
    """Vectors of norm 0 are in no pair there."""
    from oracle import difference

    from lexigrain.operators import cosine_blocks
    from lexigrain.queries import ORACLE_SQL, QUERIES

    for name, value in zip(("BLOCK_ROWS", "BLOCK_ENTRIES"), sizes, strict=True):
        monkeypatch.setattr(cosine_blocks, name, value)
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert difference(spark, QUERIES["cosine_pairs"], ORACLE_SQL["cosine_pairs"], str(tmp_path)) == ""


def test_cosine_pairs_make_no_row_for_each_shared_word(spark, tmp_path):
    """At 0.1 GB these would be 2.3 billion rows, to be summed by pair."""
    from lexigrain.queries import QUERIES

    spark.createDataFrame([(i, "a b c") for i in range(50)] + [(99, "d")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["cosine_pairs"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 3 * 50 and "MapInArrow" in plan and "Aggregate" not in plan and "Exchange" not in plan.replace("BroadcastExchange", "")


def test_cosine_pairs_store_little_beside_their_texts(spark, tmp_path):
    """The copies of the blocks that stay; they were 0.22 of these texts."""
    import random
    from pathlib import Path

    from lexigrain.queries import QUERIES

    held = lambda: sum(f.stat().st_size for f in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("*") if f.is_file())
    draw = random.Random(7)
    texts = [" ".join(f"word{int(draw.paretovariate(0.6)) % 50_000}" for _ in range(200)) for _ in range(3000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    before = held()
    df = QUERIES["cosine_pairs"](spark, str(tmp_path))
    assert held() - before < 0.12 * sum(map(len, texts))
    assert df.count() == 150 * 3000  # word1 is in every text


def test_packed_numbers_and_words():
    import numpy as np
    import pyarrow as pa

    from lexigrain.operators import cosine_blocks as C

    for x in ([0], [0, 0, 0], [1, 255, 256, 70_000, 0], [1 << 40, 3], [-1, 5], []):
        assert C._restore(C._squeeze(np.array(x, np.int64))).tolist() == x
    words = pa.array(["a", "b" * 1000, "ab", "b" * 999 + "c", "0_"])
    assert C._restore_words(C._squeeze_words(words)).equals(words) and C._restore_words(C._squeeze_words(words.slice(1, 3))).equals(words.slice(1, 3))
    for buckets in (1, 2, 64):
        at = C._bucket(words, buckets)
        assert C._bucket(words.slice(2), buckets).tolist() == at[2:].tolist() and 0 <= at.min() and at.max() < buckets
    ends, term = np.array([3, 1, 2]), np.array([0, 4, 9, 9, 2, 3])
    assert C._numbers(C._steps(term, ends), ends).tolist() == term.tolist()
    spread = np.bincount(C._bucket(pa.array([f"word{i}" for i in range(8000)]), 8), minlength=8)
    assert spread.min() > 800 and spread.max() < 1200
