"""Text files as documents, from any file system Spark reads."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators.index import with_ids
from .books import fb2_zones


def read_texts(spark: SparkSession, paths: Sequence[str], extension: str | None = None, recursive: bool = False, start: int = 0) -> DataFrame:
    """(doc_id, path, text) of whole files: those of folders by path, then those named themselves.

    Folders are read flat unless ``recursive``; ``extension`` holds for files found in folders. Missing paths are
    reported on stderr and left out.
    """
    kinds = {p: storage.kind(spark, p) for p in dict.fromkeys(paths)}
    for p in (p for p, kind in kinds.items() if kind is None):
        print(f"{p} doesn't exist", file=sys.stderr)
    parts = []
    if folders := [p for p, kind in kinds.items() if kind == "dir"]:
        suffix = f"*.{extension.lstrip('.')}" if extension else None
        parts.append(spark.read.text(folders, wholetext=True, pathGlobFilter=suffix, recursiveFileLookup=recursive).select(F.lit(0).alias("_set"), F.input_file_name().alias("path"), F.col("value").alias("text")))
    if files := [p for p, kind in kinds.items() if kind == "file"]:
        parts.append(spark.read.text(files, wholetext=True).select(F.lit(1).alias("_set"), F.input_file_name().alias("path"), F.col("value").alias("text")))
    if not parts:
        return spark.createDataFrame([], "doc_id long, path string, text string")
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return with_ids(every, ["_set", "path"], start).select("doc_id", "path", "text")


#: Columns of documents from files; those of books that a plain text lacks are null.
BOOK = ["author_first", "author_last", "genre", "author", "title", "annotation", "body"]


def read_documents(spark: SparkSession, paths: Sequence[str], extension: str | None = None, recursive: bool = False, start: int = 0) -> DataFrame:
    """(doc_id, path, author_first, author_last, genre, author, title, annotation, body): FB2 books by their zones, every other
    file as body. Malformed books are left out; their ids aren't given to others."""
    every = storage.checkpoint(read_texts(spark, paths, extension, recursive, start))
    book = F.lower("path").endswith(".fb2")
    books = fb2_zones(every.filter(book)).join(every.filter(book).select("doc_id", "path"), "doc_id")
    plain = every.filter(~book).select("doc_id", "path", *[F.lit(None).cast("string").alias(c) for c in BOOK[:-1]], F.col("text").alias("body"))
    return books.select("doc_id", "path", *BOOK).unionByName(plain)
