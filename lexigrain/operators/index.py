"""Inverted indexes over a table of documents.

All tables derive from (doc_id, text), or from a text column for each zone: tokens, postings, bigrams, vocabulary, document
statistics. A row is a document, ids are meant to be unique. What concerns one document is made within its row: postings and
frequencies need no shuffle, the vocabulary one, of each document's distinct words.

A saved index is a folder of batches and manifests. A batch holds documents, postings (range-partitioned and sorted by term and
document, so a lookup reads the row groups of its terms only; each posting carries its document's length), the
vocabulary and, on request, bigrams and wildcard tables. The newest manifest names the batches that count: a batch that
broke off is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from ..session import shared_dir
from . import wildcard


def documents_with_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens): one row for each document, also for those without tokens."""
    return docs.select(F.col(id_col).alias("doc_id"), T.tokens(F.col(text_col)).alias("tokens"))


def documents_held(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", zones: dict[str, str] | None = None) -> DataFrame:
    """As documents_with_tokens, but a filter on tokens isn't pushed below: it would split the text anew for each use. With
    ``zones`` (zone to column) the tokens of all zones in order."""
    words = F.concat(*[T.tokens(F.col(c)) for _, c in in_order(zones)]) if zones else T.tokens(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(words)).alias("tokens"))


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", zone: int = T.ZONES["body"]) -> DataFrame:
    """(doc_id, pos, term, zone): positions count the document's tokens from 0."""
    held = documents_with_tokens(docs, id_col, text_col)
    return held.select("doc_id", F.posexplode("tokens").alias("pos", "term"), F.lit(zone).alias("zone"))


def in_order(zones: dict[str, str]) -> list[tuple[str, str]]:
    """Zones and their columns in the order of positions."""
    return [(z, zones[z]) for z in T.ZONES if z in zones]


def present_zones(columns: Sequence[str]) -> dict[str, str]:
    """Zones among a table's columns."""
    return {z: z for z in T.ZONES if z in columns}


def zoned_words(zones: dict[str, str]) -> Column:
    """array<(term, zone)> of a row with a text column for each zone; positions go on from zone to zone."""

    def marked(column: str, zone: str) -> Column:
        return F.transform(T.tokens(F.col(column)), lambda w: F.struct(w.alias("term"), F.lit(T.ZONES[zone]).alias("zone")))

    return F.concat(*[marked(c, z) for z, c in in_order(zones)])


def zoned_tokens(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, pos, term, zone) of a table with a text column for each zone."""
    held = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(zoned_words(present_zones(docs.columns))).alias("pos", "t"))
    return held.select("doc_id", "pos", "t.term", "t.zone")


def postings(docs: DataFrame, zones: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, tf, zones, length, positions), one row for each word of a document; length is the document's number of
    distinct words. Made within each row."""
    made = T.word_runs(zoned_words(zones or {"body": text_col}))
    held = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(made)).alias("_r"))
    return held.select("doc_id", F.size("_r").alias("length"), F.inline("_r")).select("term", "doc_id", "tf", "zones", "length", "positions")


def term_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf), made within each row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(T.counts(T.tokens(F.col(text_col))))).toDF("doc_id", "term", "tf")


def bigrams(docs: DataFrame, zones: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(prev, term, doc_id, n): how often a word follows another in a document. Pairs are made and counted within each row."""
    held = documents_held(docs, id_col, text_col, zones)
    pairs = F.arrays_zip(F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - 1, F.lit(0))).alias("prev"), T.rest("tokens").alias("term"))
    return held.select("doc_id", F.inline(T.counts(pairs))).select("item.prev", "item.term", "doc_id", "n")


def distinct_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term) without repeats, made within each row."""
    return documents_with_tokens(docs, id_col, text_col).select("doc_id", F.explode(F.array_distinct("tokens")).alias("term"))


def _vocabulary(each: DataFrame) -> DataFrame:
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df, cf): documents with the term and its occurrences."""
    return _vocabulary(term_frequencies(docs, id_col, text_col))


def inverse_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df, idf): idf = ln(N / df), N counting documents with or without tokens."""
    df = distinct_terms(docs, id_col, text_col).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", T.idf(F.col("n"), F.col("df")).alias("idf"))


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_terms)."""
    held = documents_held(docs, id_col, text_col)
    return held.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("bigint").alias("n_terms"))


def index_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: documents, n_tokens, n_terms (distinct words of all), bytes, megabytes."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    rows = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))
    words = vocabulary(docs, id_col, text_col).agg(F.coalesce(F.sum("cf"), F.lit(0)).cast("bigint").alias("n_tokens"), F.count("*").alias("n_terms"))
    return rows.crossJoin(words).select("documents", "n_tokens", "n_terms", "bytes", T.megabytes(F.col("bytes")).alias("megabytes"))


def posting_gaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, gap): distance to the term's previous document, the id itself for its first.

    Postings are sorted by term and id over range partitions, so a common term is spread over many tasks. The first row of a
    term in a partition takes the last one of earlier partitions, of which there is one row a partition."""
    terms = distinct_terms(docs, id_col, text_col)
    ranged = storage.checkpoint(terms.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").withColumn("_p", F.spark_partition_id()))
    own = Window.partitionBy("_p", "term").orderBy("doc_id")
    ends = ranged.groupBy("_p").agg(F.max(F.struct("term", "doc_id")).alias("_e")).select(F.col("_p").alias("_q"), F.col("_e.term").alias("term"), F.col("_e.doc_id").alias("_d"))
    begins = ranged.groupBy("_p").agg(F.min("term").alias("term"))
    carried = begins.join(F.broadcast(ends), "term").filter("_q < _p").groupBy("_p", "term").agg(F.max("_d").alias("_before"))
    found = ranged.withColumn("_lag", F.lag("doc_id").over(own)).join(F.broadcast(carried), ["_p", "term"], "left")
    return found.select("term", "doc_id", (F.col("doc_id") - F.coalesce("_lag", "_before", F.lit(0))).alias("gap"))


def range_of(term: Column, bounds: Sequence[str]) -> Column:
    """Number of the range of a word; a range's upper bound is exclusive."""
    return sum((F.when(term >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def range_dictionary(docs: DataFrame, parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(range_id, term, doc_id, zones): postings dealt to dictionaries by delimiters."""
    got = postings(docs, None, id_col, text_col)
    return got.select(range_of(F.col("term"), T.range_delimiters(parts)).alias("range_id"), "term", "doc_id", "zones")


def with_ids(files: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Number rows from ``start`` in the given order: positions within range partitions plus the sizes of earlier ones.
    The partitions are written to the shared folder first, as ranges drawn anew could differ."""
    shared_dir(files.sparkSession)
    ranged = files.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).checkpoint()
    own = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = ranged.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_b"))
    return own.join(F.broadcast(before), "_p").withColumn("doc_id", (F.col("_b") + F.col("_i") - 1 + start).cast("bigint")).drop("_p", "_i", "_b")


class Index:
    """Documents and their postings, computed on demand or read from a saved folder.

    ``documents`` has doc_id, the text columns that ``zones`` names (zone to column) and any others. ``tables`` holds what a
    saved index has: postings, terms, and perhaps bigrams, reversed, grams, rotations.
    """

    def __init__(self, documents: DataFrame, zones: dict[str, str], tables: dict[str, DataFrame] | None = None, info: dict | None = None):
        self.documents, self.zones, self.tables, self.info = documents, zones, tables or {}, info

    @classmethod
    def of(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", zones: dict[str, str] | None = None) -> Index:
        """Over one text column, or over a column for each zone. Other columns stay with the documents."""
        return cls(docs if id_col == "doc_id" else docs.withColumnRenamed(id_col, "doc_id"), zones or {"body": text_col})

    @property
    def saved(self) -> bool:
        return "postings" in self.tables

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """Postings, of some terms only if given: the filter reaches the sorted files, and the ranges' folders where there are."""
        got = self.tables["postings"] if self.saved else postings(self.documents, self.zones)
        if terms is None:
            return got.drop("range_id")
        if bounds := (self.info or {}).get("delimiters"):
            got = got.filter(F.col("range_id").isin(sorted({sum(t >= b for b in bounds) for t in terms})))
        return got.filter(F.col("term").isin(list(terms))).drop("range_id")

    def vocabulary(self) -> DataFrame:
        if "terms" in self.tables:
            return self.tables["terms"].groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        if self.saved:
            return _vocabulary(self.tables["postings"])
        return _vocabulary(self.postings())

    def totals(self) -> tuple[int, int]:
        """Documents, and the sum of their lengths: a document has as many postings as distinct words."""
        if self.info:
            return sum(b["documents"] for b in self.info["batches"]), sum(b["postings"] for b in self.info["batches"])
        return self.documents.count(), self.postings().count()

    def expand(self, pattern: str) -> DataFrame:
        """(term) of the vocabulary that match a wildcard, by the tables that were saved for wildcards, else by prefix."""
        if "grams" in self.tables and T.wildcard_trigrams(pattern):
            return wildcard.by_trigrams(self.tables["grams"], pattern).distinct()
        if "rotations" in self.tables:
            return wildcard.by_rotation(self.tables["rotations"], pattern)
        words = self.tables["terms"].select("term") if "terms" in self.tables else self.vocabulary().select("term")
        return wildcard.by_prefix(words, pattern, self.tables.get("reversed")).distinct()

    # -- on disk ------------------------------------------------------------------------------------------------------

    def save(self, path: str, parts: int | None = None, kind: str = "parquet", positions: bool = True, bigrams: bool = False, wildcards: Sequence[str] = (), delimiters: Sequence[str] = ()) -> None:
        """Write a new index. ``parts`` is the number of ranges of terms (as many as shuffle partitions if None); with
        ``delimiters`` the postings stand in a folder for each range between them instead of sampled ranges. ``kind`` is parquet,
        which lookups prune, or json for exchange. ``wildcards`` names strategies whose tables are saved."""
        spark = self.documents.sparkSession
        if manifest_number(spark, path) is not None:
            raise FileExistsError(path)
        info = {"kind": kind, "zones": self.zones, "columns": self.documents.schema.json(), "positions": positions, "bigrams": bigrams, "wildcards": list(wildcards), "delimiters": list(delimiters), "next_id": 0, "batches": [], "removed": []}
        self.add_to(path, info, parts)

    def add_to(self, path: str, info: dict, parts: int | None = None) -> None:
        """Write the documents as a batch more, and a manifest that names it: documents and postings count together or not at all."""
        spark, kind, batch = self.documents.sparkSession, info["kind"], f"batch-{uuid.uuid4().hex}"
        parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        folder = f"{path}/{batch}"
        storage.spread(self.documents).write.format(kind).save(f"{folder}/documents")
        documents = _documents(spark, folder, info)

        def staged(df: DataFrame) -> DataFrame:
            """A copy, from which ranges are drawn: nothing is computed twice."""
            place = f"{path}/.staged-{uuid.uuid4().hex}"
            df.write.parquet(place)
            copies.append(place)
            return spark.read.parquet(place)

        def write(df: DataFrame, name: str, *by: str, folders: Sequence[str] = ()) -> None:
            out = df.repartitionByRange(parts, *folders, *by).sortWithinPartitions(*folders, *by).write.format(kind)
            (out.partitionBy(*folders) if folders else out).save(f"{folder}/{name}")

        copies: list[str] = []
        made = staged(postings(documents, self.zones).drop(*([] if info["positions"] else ["positions"])))
        if info["delimiters"]:
            write(made.withColumn("range_id", range_of(F.col("term"), info["delimiters"])), "postings", "term", "doc_id", folders=["range_id"])
        else:
            write(made, "postings", "term", "doc_id")
        write(staged(_vocabulary(made)), "terms", "term")
        terms = _reader(spark, kind, TABLES["terms"]).load(f"{folder}/terms").select("term")
        if info["bigrams"]:
            write(staged(bigrams(documents, self.zones)), "bigrams", "prev", "term", "doc_id")
        for strategy in info["wildcards"]:
            name = wildcard.TABLES[strategy]
            write(wildcard.index_table(terms, strategy), name, TABLES[name].split()[0], "term")
        stored = _reader(spark, kind, _postings_schema(info)).load(f"{folder}/postings")
        ranges = stored.groupBy(F.input_file_name().alias("file")).agg(*([F.max("range_id").alias("range_id")] if info["delimiters"] else []), F.min("term").alias("first_term"), F.max("term").alias("last_term"), F.count("*").alias("rows"))
        ranges.coalesce(1).write.format(kind).save(f"{folder}/ranges")
        for place in copies:
            storage.delete(spark, place)
        n = documents.agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).first()
        last = n.last + 1 if isinstance(n.last, int) else 0
        batches = [*info["batches"], {"name": batch, "documents": n.n, "postings": stored.count()}]
        write_manifest(spark, path, info | {"batches": batches, "next_id": max(info["next_id"], last)})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """The index as its newest manifest has it, without removed documents."""
        info = read_manifest(spark, path)
        folders = [f"{path}/{b['name']}" for b in info["batches"]]
        documents = _documents(spark, folders, info)
        schemas = {"postings": _postings_schema(info), "terms": TABLES["terms"]}
        schemas |= {name: TABLES[name] for name in [*(["bigrams"] if info["bigrams"] else []), *[wildcard.TABLES[w] for w in info["wildcards"]]]}
        tables = {name: _union([_reader(spark, info["kind"], schema).load(f"{f}/{name}") for f in folders]) for name, schema in schemas.items()}
        index = cls(documents, info["zones"], tables, info)
        if info["removed"]:
            index = index.without(_union([spark.read.parquet(f"{path}/{r}") for r in info["removed"]]))
        return index

    def without(self, removed: DataFrame) -> Index:
        """The index without the documents whose doc_id ``removed`` has; ids aren't given out anew. Counts of terms follow the
        postings that are left."""
        ids = removed.select("doc_id").distinct()
        tables = {name: self.tables[name].join(ids, "doc_id", "left_anti") for name in ("postings", "bigrams") if name in self.tables}
        tables |= {name: self.tables[name] for name in wildcard.TABLES.values() if name in self.tables}
        return Index(self.documents.join(ids, "doc_id", "left_anti"), self.zones, tables)

    @staticmethod
    def remove(spark: SparkSession, path: str, removed: DataFrame) -> None:
        """Take documents out of a saved index: their ids are written beside it, and every load leaves them out."""
        info, name = read_manifest(spark, path), f"removed-{uuid.uuid4().hex}"
        removed.select("doc_id").distinct().write.parquet(f"{path}/{name}")
        write_manifest(spark, path, info | {"removed": [*info["removed"], name]})

    @staticmethod
    def delete(spark: SparkSession, path: str) -> None:
        """Remove a saved index."""
        storage.delete(spark, path)

    @staticmethod
    def manifest(spark: SparkSession, path: str) -> DataFrame:
        """(file, range_id, first_term, last_term, rows) of a saved index's ranges, as they were counted when it was written.
        range_id is null unless the index has delimiters."""
        info = read_manifest(spark, path)
        schema = "file string, range_id int, first_term string, last_term string, rows long"
        return _union([_reader(spark, info["kind"], schema).load(f"{path}/{b['name']}/ranges") for b in info["batches"]])


TABLES = {
    "postings": "term string, doc_id long, tf long, zones int, length int, positions array<int>", "terms": "term string, df long, cf long", "bigrams": "prev string, term string, doc_id long, n long",
    "reversed": "reversed string, term string", "grams": "gram string, term string", "rotations": "rotation string, term string",
}


def _postings_schema(info: dict) -> str:
    out = TABLES["postings"] if info["positions"] else TABLES["postings"].removesuffix(", positions array<int>")
    id_kind = next(f["type"] for f in json.loads(info["columns"])["fields"] if f["name"] == "doc_id")
    return out.replace("doc_id long", f"doc_id {id_kind}") + (", range_id int" if info["delimiters"] else "")


def _reader(spark: SparkSession, kind: str, schema):
    return spark.read.format(kind).schema(schema)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _documents(spark: SparkSession, folders: str | list[str], info: dict) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(json.loads(info["columns"]))
    return _union([_reader(spark, info["kind"], schema).load(f"{f}/documents") for f in ([folders] if isinstance(folders, str) else folders)])


def manifest_number(spark: SparkSession, path: str) -> int | None:
    found = [int(n[9:-5]) for n in storage.names(spark, path) if n.startswith("manifest-") and n.endswith(".json")]
    return max(found, default=None)


def read_manifest(spark: SparkSession, path: str) -> dict:
    if (n := manifest_number(spark, path)) is None:
        raise FileNotFoundError(f"{path} has no index")
    return json.loads(storage.read_text(spark, f"{path}/manifest-{n:06}.json"))


def write_manifest(spark: SparkSession, path: str, info: dict) -> None:
    """The next manifest; what reads the index meanwhile goes on with the one before."""
    n = manifest_number(spark, path)
    storage.write_text(spark, f"{path}/manifest-{0 if n is None else n + 1:06}.json", json.dumps(info, indent=1))
